"""Raw records of the known kinds of sources as chapter records of one schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chapter_number, clean_english, clean_html, clean_japanese, header_parts, strip

COLUMNS = ["series_title", "author", "source", "chapter_number", "chapter_title", "text_ja", "text_en", "text_zh", "tags"]


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _shape(df: DataFrame, **given: Column) -> DataFrame:
    empty = {"chapter_number": F.lit(None).cast("int"), "text_ja": F.lit(""), "text_en": F.lit(""), "text_zh": F.lit(""), "tags": F.lit(None).cast("string")}
    return df.select(*[(given | {k: v for k, v in empty.items() if k not in given})[c].alias(c) for c in COLUMNS])


def parallel(df: DataFrame) -> DataFrame:
    """Japanese and English side by side: meta.general.series_title_eng, meta.syosetu.writer, meta.novelupdates.{genres, tags}, src, trg."""
    src, trg = clean_japanese(F.col("src")), clean_english(clean_html(F.col("trg")))
    df = df.withColumns({"_src": src, "_trg": trg})
    h = header_parts(F.col("_src"), F.col("_trg"))
    empty = F.array().cast("array<string>")
    tags = F.array_join(F.array_distinct(F.concat(F.coalesce("meta.novelupdates.genres", empty), F.coalesce("meta.novelupdates.tags", empty))), ", ")
    return _shape(df, series_title=F.coalesce("meta.general.series_title_eng", F.lit("Unknown Title")), author=F.coalesce("meta.syosetu.writer", F.lit("Unknown")), source=F.lit("syosetu"), chapter_number=h["chapter_number"], chapter_title=h["title_en"], text_ja=h["body_ja"], text_en=h["body_en"], tags=tags)


def titled(df: DataFrame) -> DataFrame:
    """English with a title "Series - Chapter"; a title without the hyphen names both."""
    parts = F.split(_text(F.col("meta.title")), " - ", 2)
    series, chapter = strip(parts[0]), F.when(F.size(parts) > 1, strip(F.get(parts, F.lit(1)))).otherwise(strip(parts[0]))
    return _shape(df, series_title=series, author=F.coalesce("meta.author", F.lit("Unknown")), source=F.lit("scribblehub"), chapter_number=chapter_number(chapter), chapter_title=chapter, text_en=clean_english(clean_html(F.col("text"))))


def flat(df: DataFrame) -> DataFrame:
    """English in flat columns: title, author, chapter_title, text."""
    return _shape(df, series_title=F.coalesce("title", F.lit("Unknown Title")), author=F.coalesce("author", F.lit("Unknown")), source=F.lit("royalroad"), chapter_number=chapter_number(_text(F.col("chapter_title"))), chapter_title=_text(F.col("chapter_title")), text_en=clean_english(clean_html(F.col("text"))))


def chinese(df: DataFrame) -> DataFrame:
    """Chinese in flat columns; a tag names the kind of source."""
    return _shape(df, series_title=F.coalesce("title", F.lit("Unknown Title")), author=F.coalesce("author", F.lit("Unknown")), source=F.lit("cnnovel"), chapter_number=chapter_number(_text(F.col("chapter_title"))), chapter_title=_text(F.col("chapter_title")), text_zh=clean_html(F.col("text")), tags=F.lit("web novel, chinese"))


REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {"parallel": parallel, "titled": titled, "flat": flat, "chinese": chinese}
ALIASES = {"syosetu": "parallel", "scribblehub": "titled", "royalroad": "flat", "cnnovel": "chinese"}


def parse(df: DataFrame, kind: str) -> DataFrame:
    """Chapter records of a raw table of a registered kind or alias."""
    name = ALIASES.get(kind, kind)
    if name not in REGISTRY:
        raise ValueError(f"unknown kind {kind!r}; known: {', '.join([*REGISTRY, *ALIASES])}")
    return REGISTRY[name](df)
