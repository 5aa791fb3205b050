"""Whole books as their header and chapters (a table function: one text, many rows)."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

_FIELD = {k: re.compile(rf"^{k}:[ \t]*(.+)$", re.M) for k in ("Title", "Author", "Subjects")}
_START = re.compile(r"\*\*\*\s*START OF (?:THE|THIS) .*?\*\*\*", re.I)
_END = re.compile(r"\*\*\*\s*END OF (?:THE|THIS) .*?\*\*\*", re.I)
_HEAD = re.compile(r"^[ \t]*((?:CHAPTER|Chapter|BOOK|Book|PART|Part|LETTER|Letter|STAVE|Stave)[ \t]+(?:[IVXLCDM]+|\d+|[A-Z][a-z]+)\b[^\n]{0,80})$", re.M)


def split_book(text: str | None, least: int = 200) -> tuple[str, str, list[str], list[tuple[str, str]]]:
    """(title, author, subjects, [(heading, body)]): spans between headings of at least ``least`` characters, which also drops tables of contents.

    A book without a heading is one chapter; an empty text has none.
    """
    text = (text or "").replace("\r\n", "\n")
    found = {k: (m.group(1).strip() if (m := p.search(text)) else "") for k, p in _FIELD.items()}
    if m := _END.search(text):
        text = text[: m.start()]
    if m := _START.search(text):
        text = text[m.end() :]
    heads = list(_HEAD.finditer(text))
    spans = [(h.group(1).strip(), text[h.end() : heads[i + 1].start() if i + 1 < len(heads) else len(text)].strip()) for i, h in enumerate(heads)]
    chapters = [(h, b) for h, b in spans if len(b) >= least]
    if not chapters and text.strip():
        chapters = [("Chapter 1", text.strip())]
    return found["Title"] or "Unknown Title", found["Author"] or "Unknown", [s.strip() for s in re.split(r";|,|--", found["Subjects"]) if s.strip()], chapters


class _Chapters:
    def eval(self, text: str) -> Iterator[tuple]:
        title, author, subjects, chapters = split_book(text)
        for i, (head, body) in enumerate(chapters):
            yield title, author, ", ".join(subjects), i + 1, head, body


def register(spark: SparkSession, name: str = "book_chapters") -> None:
    """Makes the table function available in SQL: LATERAL book_chapters(text)."""
    spark.udtf.register(name, udtf(_Chapters, returnType="title string, author string, tags string, chapter_number int, chapter_title string, body string"))


def chapters(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, title, author, tags, chapter_number, chapter_title, body) of a table of whole books."""
    spark = df.sparkSession
    register(spark)
    df.select(F.col(key).alias("book_id"), F.col(text).alias("book_text")).createOrReplaceTempView("_books")
    return spark.sql("SELECT b.book_id, c.* FROM _books b, LATERAL book_chapters(b.book_text) c").withColumnRenamed("book_id", key)
