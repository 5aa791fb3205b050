"""Streaming ingestion of chapters with quotas, and windowed aggregates of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lineage import cut
from ..operators.relational import quota
from ..sources.sinks import append, exists


def read_files(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the files of a folder, or of one file (then of the files of that name in its folder)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        return reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return reader.parquet(path)


def ingest_chapters(stream: DataFrame, target: str, checkpoint: str, most: int = 12) -> None:
    """Appends the chapters of a stream to ``target`` until every novel has ``most``; chapters that are there already are skipped.

    Each micro-batch drops repeats, leaves out what the target holds (anti join) and fills the quotas in the order of arrival.  A batch that is
    run again after a failure adds nothing twice, as the rows it wrote are found in the target.
    """

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        fresh = df.dropDuplicates(["id"])
        held = None
        if exists(spark, target):
            there = spark.read.parquet(target)
            fresh = fresh.join(there.select("id"), "id", "left_anti")
            held = there.groupBy("novel_id").agg(F.count("*").alias("n"))
        append(quota(fresh, ["novel_id"], [F.col("ingested_at"), F.col("id")], most, held), target)

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(stream: DataFrame, target: str, checkpoint: str, width: str = "1 day", late: str = "2 days") -> None:
    """Counts and sums per event type and window; rows up to ``late`` behind the latest are counted, the state of older windows is dropped.

    Each batch brings the windows that changed, which replace their rows in ``target``; only the touched days' files are rewritten, so a batch
    that is run again after a failure leaves the same table."""
    agg = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("event_type", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        new = df.select("event_type", F.col("w.start").alias("day"), "n", "total", F.date_format("w.start", "yyyy-MM-dd").alias("on_day"))
        if exists(spark, target):
            new = cut(new)
            there = spark.read.parquet(target).withColumn("on_day", F.col("on_day").cast("string"))
            old = there.join(new.select("on_day").distinct(), "on_day", "left_semi").join(new.select("event_type", "day"), ["event_type", "day"], "left_anti")
            new = cut(old.select(*new.columns).unionByName(new))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("on_day").parquet(target)

    agg.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def keyed_quota(stream: DataFrame, key: str, most: int) -> DataFrame:
    """The first ``most`` rows of every key of an endless stream, by a counter kept as state per key (columns: key, id)."""

    def take(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for pdf in batches:
            own = pdf.head(max(0, most - n))
            n += len(own)
            if len(own):
                yield own[[key, "id"]]
        state.update((n,))

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key, "id").groupBy(key).applyInPandasWithState(take, f"{key} {kind}, id long", "n long", "append", "NoTimeout")
