"""Slides that arrive over time, each processed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``path, batch`` of what is done; empty before the first batch. A manifest that can't be read is an error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "path string, batch long")
    return spark.read.schema("path string, batch long").parquet(path)


def follow(
    spark: SparkSession, folder: str, done: str, checkpoint: str, process: Callable[[DataFrame], None], pattern: str = "*"
) -> StreamingQuery:
    """Call ``process`` on the paths of new files that the manifest lacks, batch by batch.

    A batch enters the manifest, under its number, once it has been processed;
    a number that is in there is not processed again. If a run ends between
    the two, the batch is processed once more: ``process`` must replace what it
    wrote (as ``overwrite`` does), not append to it.
    """
    files = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path", "length")
    )

    def each(batch: DataFrame, number: int) -> None:
        known = manifest(spark, done)
        if not known.where(F.col("batch") == number).isEmpty():
            return
        fresh = batch.join(known.select("path"), "path", "left_anti").persist()
        process(fresh)
        fresh.select("path", F.lit(number).cast("long").alias("batch")).write.mode("append").parquet(done)
        fresh.unpersist()

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window; rows later than ``late`` are dropped and windows then closed."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.count("*").alias("n"))
