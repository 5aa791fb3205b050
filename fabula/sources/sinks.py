"""Writing: appends, guarded merges, atomic publishing, resumable rebuilds."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.exists(p)


def publish(df: DataFrame, path: str) -> None:
    """Writes beside ``path`` and then swaps the folders, so that readers see the old or the new table, never a part."""
    spark = df.sparkSession
    fresh, old = f"{path}.{uuid.uuid4().hex}.new", f"{path}.{uuid.uuid4().hex}.old"
    df.write.parquet(fresh)
    fs, target, make = _fs(spark, path)
    if fs.exists(target):
        fs.rename(target, make(old))
    fs.rename(make(fresh), target)
    if fs.exists(make(old)):
        fs.delete(make(old), True)


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("append")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def merge_cache(new: DataFrame, path: str, key: str) -> bool:
    """Rows of ``new`` replace those of the same key and are added to the rest; an empty ``new`` changes nothing and gives False."""
    if new.isEmpty():
        return False
    spark = new.sparkSession
    if exists(spark, path):
        kept = spark.read.parquet(path).join(new.select(key).distinct(), key, "left_anti")
        new = new.unionByName(kept, allowMissingColumns=True)
    publish(new, path)
    return True


def rebuild(todo: DataFrame, key: str, path: str, work: Callable[[DataFrame], DataFrame], version: int, parts: int = 8) -> int:
    """Works on the keys that ``path`` lacks in this version, in ``parts`` steps that are each kept when done; returns the steps that ran."""
    spark, steps = todo.sparkSession, 0
    for part in range(parts):
        own = todo.where(F.pmod(F.xxhash64(key), F.lit(parts)) == part)
        if exists(spark, path):
            done = spark.read.parquet(path).where(F.col("_v") == version).select(key)
            own = own.join(done, key, "left_anti")
        if own.isEmpty():
            continue
        append(work(own).withColumn("_v", F.lit(version)), path)
        steps += 1
    return steps


def save_centroids(genre: DataFrame, territory: DataFrame, folder: str) -> None:
    """Both tables (label, centroid, samples_used), each published whole."""
    publish(genre, f"{folder.rstrip('/')}/genre_centroids.parquet")
    publish(territory, f"{folder.rstrip('/')}/territory_centroids.parquet")
