"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording (user), curve (type), t (microseconds), value, confidence, event_id."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("recording"), F.col("event_type").alias("curve"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "value", (F.pmod("event_id", F.lit(100)) / 100.0).alias("confidence"), "event_id", "props")


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per recording: `frame` counts its events in time."""
    w = Window.partitionBy("recording").orderBy("t", "event_id")
    return events(spark, sf_dir).withColumn("frame", (F.row_number().over(w) - 1).cast("long")).select("recording", "frame", "t", "curve", "value", "confidence")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated measurements: subject (supplier), condition (return flag), dimension (line status), value."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("subject"), F.col("l_returnflag").alias("condition"), F.col("l_linestatus").alias("dimension"), F.col("l_quantity").alias("value"))


def raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("a"), F.col("toxic").alias("b"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explanation items: one per event. Attribute, category, status and audibility are functions of the event."""
    i = F.col("event_id")
    pick = lambda names, x: F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(x, F.lit(len(names))) + 1).cast("int"))
    return events(spark, sf_dir).select(
        "recording", F.col("event_id").alias("item"), pick(["loudness", "tempo", "breathiness", "interval_compression", "vibrato"], i).alias("attribute"),
        pick(["dynamics", "rhythm", "phonation", "pitch", "ornament", "diction"], i).alias("category"), pick(["none", "missing", "same", "extra", "none", "none", "none"], i).alias("status"),
        (F.col("value") - 35).alias("magnitude"), "confidence", F.when(F.pmod(i, F.lit(11)) > 0, F.pmod(i, F.lit(97)) / 97.0).alias("audibility"), "t",
    )


def segments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Expert segments (errors) and predictions (purchases) of a clip (user): start and end in hours, label."""
    e = events(spark, sf_dir).withColumn("start", (F.col("t") - 1704067200000000) / 3.6e9)
    row = lambda kind, hours: e.where(F.col("curve") == kind).select(F.col("recording").alias("clip"), F.col("event_id").alias("seg"), "start", (F.col("start") + hours).alias("end"), F.concat(F.lit("l"), F.pmod("event_id", F.lit(3))).alias("label"), F.col("confidence").alias("score"))
    return row("error", 6.0), row("purchase", 4.0)
