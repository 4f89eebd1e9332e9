"""The folder that the driver and all executors share, and frames cut off from their lineage in it."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; an own folder where that is unset and Spark runs in one process (tests, notebooks)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``df`` to be broadcast if it has ``most`` rows at most (counted first), else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint a small ``df`` in the shared folder and drop its lineage; Spark removes the files with the frame."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
