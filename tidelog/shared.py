"""The folder that all executors share, for what has to outlive a step."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder on a local master; on a cluster an error, because a folder
    of one machine would be lost with it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidelog-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def kept(df: DataFrame) -> DataFrame:
    """The rows, computed once and held in the shared folder, so that they outlive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
