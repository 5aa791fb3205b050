"""Book catalogues landed as JSON pages, works of wanted genres, and stratified filling of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import non_blank, split_list
from ..functions.words import GENRE_TAGS
from ..operators.relational import quota

PAGE = "struct<results: array<struct<id: bigint, title: string, authors: array<struct<name: string>>, subjects: array<string>>>>"


def pages(spark: SparkSession, path: str) -> DataFrame:
    """(book, title, authors, subjects) of all landed catalogue pages, one JSON object a line; broken pages give none, repeated books count once."""
    rows = spark.read.text(path).select(F.explode(F.from_json("value", PAGE)["results"]).alias("b"))
    return rows.select(F.col("b.id").alias("book"), "b.title", "b.authors", "b.subjects").where("book IS NOT NULL").dropDuplicates(["book"])


def books(catalogued: DataFrame, texts: DataFrame, words: int | None = None, least: int = 0) -> DataFrame:
    """Chapter-like records of catalogued books that have a landed text (book, text): the first ``words`` words joined by single spaces (None: all);
    books of fewer than ``least`` words are left out."""
    parts = non_blank(F.split("text", "(?U)\\s+"))
    own = catalogued.join(texts.where("text <> ''"), "book").withColumn("_w", parts).where((F.size("_w") >= least) & (F.size("_w") > 0))
    return own.select(
        "book", F.coalesce("title", F.lit("Unknown Title")).alias("series_title"), F.coalesce(F.get("authors", F.lit(0))["name"], F.lit("Unknown Author")).alias("author"), F.lit("gutenberg").alias("source"),
        F.lit("Classic Literature Territory").alias("territory"), F.array_join(F.coalesce("subjects", F.array().cast("array<string>")), ", ").alias("tags"), F.lit("Full Text").alias("chapter_title"), F.array_join(F.slice("_w", 1, words) if words else F.col("_w"), " ").alias("text_en"),
    )


def matches_genre(tags: Column, genre: str) -> Column:
    """Whether some tag holds the genre's name or one of its keywords as whole words; false for null tags."""
    names = list(dict.fromkeys([genre.lower().strip(), *[k.lower() for k in GENRE_TAGS.get(genre, "").split("|") if k]]))
    quoted = "|".join("".join(f"\\{c}" if c in "\\^$.|?*+()[]{}-" else c for c in n) for n in names)
    return F.coalesce(F.exists(split_list(F.lower(tags)), lambda t: t.rlike(f"(?U)\\b(?:{quoted})\\b")), F.lit(False))


def stratified(works: DataFrame, strata: list[str], order: list[Column], most: int) -> DataFrame:
    """At most ``most`` works of every stratum, the first in ``order``."""
    return quota(works, strata, order, most)


def top_up(landed: DataFrame, catalogued: DataFrame, genre: str, count: int) -> DataFrame:
    """Works of a genre up to ``count``: landed ones whose tags name it first, then catalogued ones; both need (series_title, author, tags)."""
    own = landed.where(matches_genre(F.col("tags"), genre)).withColumn("_from", F.lit(0)).unionByName(catalogued.withColumn("_from", F.lit(1)), allowMissingColumns=True)
    first = own.dropDuplicates(["series_title", "author", "_from"])
    return first.orderBy("_from", "series_title", "author").limit(count).withColumn("genre", F.lit(genre)).drop("_from")
