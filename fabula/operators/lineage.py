"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the checkpoint folder named in ``spark.checkpoint.dir``.

    A session with neither that setting nor a folder is refused on a cluster; in one process (as in tests) a temporary folder is taken.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where it is unset, a temporary one in one process, an error on a cluster."""
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if place:
        return place
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="fabula-")
