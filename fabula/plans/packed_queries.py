"""Queries of the packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packed import unpack


def _values(spark: SparkSession, d: str, table: str) -> DataFrame:
    known = spark.read.parquet(f"{d}/taxonomy_label.parquet").select("label")
    return unpack(spark.read.parquet(f"{d}/{table}.parquet"), "id", ["genre", "tags"], known)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Each value of the genre and tags fields that hold at least two."""
    return _values(spark, d, "stats_cache").where("n >= 2").select("id", "field_name", "pos", "val").distinct()


def p2_value_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many novels carry each genre and tag, however the field was packed."""
    return _values(spark, d, "novel").groupBy("field_name", F.lower("val").alias("val")).agg(F.countDistinct("id").alias("novels"))


QUERIES = {"p2_found": p2_found, "p2_value_counts": p2_value_counts}
ORACLES: dict[str, str] = {}
