"""Relational operators: upserts, quotas, ordered picks, set predicates, sampling and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def natural_key(*columns: str) -> list[Column]:
    """Trimmed, lower-case forms of the columns, for matching without case and outer spaces."""
    return [F.lower(F.trim(F.col(c))).alias(f"_k{i}") for i, c in enumerate(columns)]


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str], fill: list[str]) -> DataFrame:
    """``existing`` with the columns ``fill`` filled from ``incoming`` where they are null, and the rows of ``incoming`` that it lacks.

    Rows match by their natural key; of several incoming rows of a key the first non-null value in the order of all columns counts.  Extra
    columns of ``existing`` stay null on new rows.  An empty side gives the other.
    """
    names = [f"_k{i}" for i in range(len(key))]
    new = incoming.select(*natural_key(*key), *key, *fill).groupBy(*names).agg(*[F.min(c).alias(c) for c in [*key, *fill]])
    new = new.select(*names, *[F.col(c).alias(f"_new_{c}") for c in [*key, *fill]])
    old = existing.select(*natural_key(*key), "*").withColumn("_old", F.lit(True))
    both = old.join(new, names, "full_outer")
    return both.select(*[F.coalesce(F.col(c), F.col(f"_new_{c}")).alias(c) if c in fill else F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_new_{c}")).alias(c) if c in key else F.col(c) for c in existing.columns])


def keep_latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def quota(df: DataFrame, key: list[str], order: list[Column], most: int, held: DataFrame | None = None) -> DataFrame:
    """At most ``most`` rows per key in ``order``; ``held`` (key, n) counts those that the target holds already."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    if held is None:
        return ranked.where(F.col("_rn") <= most).drop("_rn")
    return ranked.join(held, key, "left").where(F.col("_rn") + F.coalesce("n", F.lit(0)) <= most).drop("_rn", "n")


def number_missing(df: DataFrame, key: str, number: str, order: list[Column], missing: Column) -> DataFrame:
    """Numbers the rows without one, per key: the greatest number that is there plus 1, 2, … in ``order``."""
    top = df.where(~missing).groupBy(key).agg(F.max(number).alias("_top"))
    at = F.row_number().over(Window.partitionBy(key, missing).orderBy(*order))
    out = df.withColumn("_at", at).join(top, key, "left")
    new = F.when(missing, F.coalesce("_top", F.lit(0)) + F.col("_at")).otherwise(F.col(number))
    return out.withColumn(number, new).select(*df.columns)


def opening_middle_end(df: DataFrame, key: str, order: list[Column], text: str) -> DataFrame:
    """(key, text): the only row's text, both of two, else the first, middle and last joined by a blank line.  Rows repeated under one ``id`` (without that
    column: in all columns but the text) count once.

    The rows are ranked without their texts; only the picked ones' texts are read into the groups, three at most.
    """
    keys = df.drop(text).distinct()
    on = [key, "id"] if "id" in keys.columns else keys.columns
    sizes = keys.groupBy(key).agg(F.count("*").alias("_n"))
    ranked = keys.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).join(sizes, key)
    picked = ranked.where((F.col("_i") == 0) | (F.col("_i") == F.col("_n") - 1) | ((F.col("_n") >= 3) & (F.col("_i") == F.floor(F.col("_n") / 2)))).select(*on, "_i")
    texts = picked.join(df.select(*on, text), on).dropDuplicates(on)
    return texts.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_i", text))), lambda x: x[text]), "\n\n").alias(text))


def has_any(c: Column, words: list[str]) -> Column:
    """Whether lower-case ``c`` holds any of the words as a substring; null holds none."""
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w.lower())
    return out


def search(df: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows with the query in any of the columns, without regard to case; a blank query gives all rows."""
    if not query.strip():
        return df
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(query.strip().lower())
    return df.where(hit)


def page(df: DataFrame, order: list[Column], number: int, size: int = 8) -> DataFrame:
    """The page with that number (from 1; smaller numbers give the first page) in the given order."""
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows by the smallest print of key and seed: the same rows for the same seed."""
    return df.withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))).orderBy("_h", key).limit(n).drop("_h")


def multi_bucket_counts(df: DataFrame, column: str, buckets: list[str]) -> DataFrame:
    """(bucket, n): rows whose column holds the bucket's name as a substring; a row may count in several, buckets without rows give 0."""
    low = F.lower(F.coalesce(F.col(column), F.lit("")))
    sums = df.agg(*[F.coalesce(F.sum(low.contains(b.lower()).cast("long")), F.lit(0)).alias(f"_{i}") for i, b in enumerate(buckets)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(f"_{i}").alias("n")) for i, b in enumerate(buckets)])).alias("x")).select("x.bucket", "x.n")
