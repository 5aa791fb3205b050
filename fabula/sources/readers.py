"""Scans: tables, caches kept as JSON maps or compressed blobs, centroid tables, resolved paths."""

from __future__ import annotations

import gzip
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NOVEL = T.StructType([T.StructField("id", T.LongType()), T.StructField("title", T.StringType()), T.StructField("author", T.StringType()), T.StructField("source", T.StringType()), T.StructField("genre", T.StringType()), T.StructField("territory", T.StringType()), T.StructField("tags", T.StringType())])
CHAPTER = T.StructType([T.StructField("id", T.LongType()), T.StructField("novel_id", T.LongType()), T.StructField("chapter_number", T.IntegerType()), T.StructField("title", T.StringType()), T.StructField("text_ja", T.StringType()), T.StructField("text_en", T.StringType()), T.StructField("text_zh", T.StringType()), T.StructField("ingested_at", T.TimestampType())])


def resolve(name: str, places: list[str]) -> str | None:
    """The first place where a local file or folder of that name exists; names with a scheme are taken as they are."""
    if "://" in name:
        return name
    return next((p for p in (os.path.join(x, name) for x in places) if os.path.exists(p)), None)


def table(spark: SparkSession, place: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet table of a folder; with a schema, missing columns are null."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{place.rstrip('/')}/{name}.parquet")


def json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(id, value struct) of a JSON file that holds one object keyed by id; keys that aren't numbers (notes, versions) are left out."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, {value}>").alias("m"))
    rows = whole.select(F.explode("m").alias("key", "value"))
    return rows.where(F.col("key").rlike("^-?[0-9]+$")).select(F.col("key").cast("long").alias("id"), "value")


def unzip(column: str, schema: str):
    """Struct of a binary column that holds gzip-compressed JSON; broken blobs give null."""

    @F.pandas_udf("string")
    def inflate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(b):
            try:
                return gzip.decompress(b).decode() if b is not None else None
            except (OSError, EOFError, UnicodeDecodeError):
                return None

        for s in batches:
            yield s.map(one)

    return F.from_json(inflate(F.col(column)), schema)


def zip_json(column):
    """Gzip-compressed JSON of a struct column."""

    @F.pandas_udf("binary")
    def deflate(s: pd.Series) -> pd.Series:
        return s.map(lambda t: gzip.compress(t.encode(), mtime=0) if t is not None else None)

    return deflate(F.to_json(column))


def point(df: DataFrame, key: str, value: int) -> DataFrame:
    """Rows of one key; the filter reaches the scan."""
    return df.where(F.col(key) == value)


def centroids(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame] | None:
    """(genre, territory) centroid tables; None unless both are there."""
    try:
        return table(spark, folder, "genre_centroids"), table(spark, folder, "territory_centroids")
    except Exception as e:  # a missing path is a normal state before the first build
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def first_available(df_by_tier: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Read-through of tiers with the same columns: each key from the first tier that has it, with the tier's name."""
    out = None
    for name, df in df_by_tier:
        own = df.withColumn("tier", F.lit(name))
        out = own if out is None else out.unionByName(own.join(out.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)
    return out
