"""Incremental preparation: only what is not done yet, failures logged, other settings refused. Works from batches and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items whose key is not done."""
    return items.join(done.select(key), key, "left_anti")


def settings_clash(done: DataFrame, settings: str) -> bool:
    """Whether anything was prepared under other settings."""
    return done.where(F.col("settings") != settings).limit(1).count() > 0


def prepare(items: DataFrame, out_path: str, key: str, settings: str, work: Callable[[DataFrame], DataFrame]) -> int:
    """Prepare what is pending and append it; returns the number of new rows. `work` keeps the key and gives status and reason columns."""
    spark = items.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(out_path)
    fresh = not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    if not fresh:
        done = spark.read.parquet(out_path)
        if settings_clash(done, settings):
            raise ValueError("the folder holds items of other settings")
        items = pending(items, done.where("status = 'ok'"), key)
    before = 0 if fresh else spark.read.parquet(out_path).count()
    work(items).withColumn("settings", F.lit(settings)).write.mode("append").parquet(out_path)
    return spark.read.parquet(out_path).count() - before


def prepare_stream(items: DataFrame, out_path: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]) -> None:
    """Prepare what has arrived since the last call, each file once."""
    work(items).writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def dedup_stream(items: DataFrame, key: str, stamp: str, watermark: str) -> DataFrame:
    """First item of each content key within the watermark."""
    return items.withWatermark(stamp, watermark).dropDuplicatesWithinWatermark([key])
