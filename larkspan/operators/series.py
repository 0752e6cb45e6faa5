"""Windows and islands over series of frames.

A series is the rows of one key in the order of `frame`, a gapless integer. All operators partition by the key only where
their rule needs the order of a whole series; aggregates keep partial sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip01, known

Keys = Sequence[str]


def normalise(df: DataFrame, value: str = "value", confidence: str = "confidence") -> DataFrame:
    """Confidence in [0, 1], and 0 where the value is unknown; unknown values are NULL."""
    return df.withColumn(value, known(value)).withColumn(confidence, F.when(F.col(value).isNull(), 0.0).otherwise(F.coalesce(clip01(known(confidence)), F.lit(0.0))))


def masked(df: DataFrame, threshold: float, value: str = "value", confidence: str = "confidence") -> DataFrame:
    """Values at a confidence above the threshold; others NULL."""
    return df.withColumn(value, F.when(F.col(confidence) > threshold, F.col(value)))


def recording_values(df: DataFrame, keys: Keys, min_confidence: float = 0.5) -> DataFrame:
    """Median of confident known values per key; NULL for a key without any."""
    ok = (F.col("confidence") >= min_confidence) & F.col("value").isNotNull()
    return df.groupBy(*keys).agg(F.median(F.when(ok, F.col("value"))).alias("median_value"), F.count_if(ok).alias("n_used"))


def runs(df: DataFrame, keys: Keys, mask: Column) -> DataFrame:
    """Half-open islands [start, end) of frames where the mask is true."""
    on = df.where(F.coalesce(mask, F.lit(False))).select(*keys, "frame")
    island = F.col("frame") - F.row_number().over(Window.partitionBy(*keys).orderBy("frame"))
    return on.withColumn("_g", island).groupBy(*keys, "_g").agg(F.min("frame").alias("start"), (F.max("frame") + 1).alias("end")).drop("_g")


def long_runs(spans: DataFrame, least: int) -> DataFrame:
    """Runs of at least `least` frames."""
    return spans.where(F.col("end") - F.col("start") >= least)


def merge_runs(spans: DataFrame, keys: Keys, gap: int) -> DataFrame:
    """Sessions: runs that follow the one before within less than `gap` frames are one."""
    w = Window.partitionBy(*keys).orderBy("start")
    new = F.coalesce((F.col("start") - F.lag("end").over(w) >= gap).cast("int"), F.lit(1))
    grouped = spans.withColumn("_s", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "_s").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_s")


def within(df: DataFrame, spans: DataFrame, keys: Keys, how: str = "inner", cell: int = 256) -> DataFrame:
    """Frames inside spans. An interval meets a frame through the cells of `cell` frames that it touches, so the join is an equi-join."""
    s = spans.withColumn("_c", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor((F.col("end") - 1) / cell))))
    f = df.withColumn("_c", F.floor(F.col("frame") / cell))
    on = [f[k] == s[k] for k in (*keys, "_c")] + [f["frame"] >= s["start"], f["frame"] < s["end"]]
    extra = [s[x] for x in spans.columns if x not in keys]
    return f.join(s, on, how).select(*[f[x] for x in df.columns], *extra)


def relative_level(df: DataFrame, keys: Keys, voiced: Column, gap: int) -> DataFrame:
    """Level less the median of the voiced frames of its phrase; phrases are voiced runs merged over short gaps."""
    phrases = merge_runs(runs(df, keys, voiced), keys, gap)
    inside = within(df.withColumn("_v", voiced), phrases, keys)
    med = inside.groupBy(*keys, "start").agg(F.median(F.when(F.col("_v"), F.col("value"))).alias("_m"))
    return inside.join(med, [*keys, "start"]).withColumn("relative", F.col("value") - F.col("_m")).drop("_v", "_m", "end")


def moving_average(df: DataFrame, keys: Keys, width: int, value: str = "value", out: str = "smoothed") -> DataFrame:
    """Centred mean over known values; an even width reaches one further back; the width is at most the series' length."""
    by = Window.partitionBy(*keys).orderBy("frame")
    near = by.rowsBetween(-(width // 2), (width - 1) // 2)
    n, v, i = F.col("_n"), F.col("_v"), F.col("_i")
    rows = df.withColumns({"_v": known(value), "_n": F.count("*").over(Window.partitionBy(*keys)), "_i": F.row_number().over(by) - 1})
    mean = F.sum(v).over(near) / F.count(v).over(near)
    # a series shorter than the width is averaged over its own length: its rows are fewer than `width`
    whole = F.collect_list(F.when(n < width, F.struct(i.alias("i"), v.alias("v")))).over(by.rowsBetween(-width, width))
    own = F.filter(whole, lambda p: (p["i"] >= i - F.floor(n / 2)) & (p["i"] <= i + F.floor((n - 1) / 2)) & p["v"].isNotNull())
    own_mean = F.aggregate(own, F.lit(0.0), lambda a, p: a + p["v"]) / F.size(own)
    return rows.withColumn(out, F.when(n >= width, mean).when(n > 1, own_mean).otherwise(v)).drop("_n", "_i", "_v")


def gradient(df: DataFrame, keys: Keys, value: str = "value", out: str = "slope") -> DataFrame:
    """Central differences, one-sided at the ends."""
    w = Window.partitionBy(*keys).orderBy("frame")
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    first, last = F.lag("frame").over(w).isNull(), F.lead("frame").over(w).isNull()
    v = F.col(value)
    return df.withColumn(out, F.when(first & last, 0.0).when(first, after - v).when(last, v - before).otherwise((after - before) / 2))


def running_median(df: DataFrame, keys: Keys, width: int, value: str = "value", out: str = "smoothed") -> DataFrame:
    """Centred median over the known values of `width` frames."""
    w = Window.partitionBy(*keys).orderBy("frame").rowsBetween(-(width // 2), (width - 1) // 2)
    return df.withColumn(out, F.percentile(known(value), F.lit(0.5)).over(w))


def robust_z(df: DataFrame, keys: Keys, value: str = "value", out: str = "z") -> DataFrame:
    """(value - median) / (1.4826 MAD) per key."""
    med = df.groupBy(*keys).agg(F.median(value).alias("_m"))
    dev = df.join(med, [*keys])
    mad = dev.groupBy(*keys).agg((1.4826 * F.median(F.abs(F.col(value) - F.col("_m"))) + 1e-9).alias("_s"))
    return dev.join(mad, [*keys]).withColumn(out, (F.col(value) - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def outlier_spans(df: DataFrame, keys: Keys, z: float, least: int, value: str = "value") -> DataFrame:
    """Runs of at least `least` frames that are above `z` robust deviations."""
    return long_runs(runs(robust_z(df, keys, value), keys, F.col("z") > z), least)


def dynamic_range(df: DataFrame, keys: Keys, low: float = 0.1, high: float = 0.9, value: str = "value") -> DataFrame:
    p = F.percentile(value, F.array(F.lit(low), F.lit(high)))
    return df.groupBy(*keys).agg(p.alias("_p")).select(*keys, (F.col("_p")[1] - F.col("_p")[0]).alias("dynamic_range"))


def voice_range(df: DataFrame, keys: Keys, value: str = "value") -> DataFrame:
    """Outer (2nd to 98th percentile) and comfortable (10th to 90th) range."""
    p = F.percentile(value, F.array(*[F.lit(x) for x in (0.02, 0.1, 0.9, 0.98)]))
    cols = ["low", "comfort_low", "comfort_high", "high"]
    return df.groupBy(*keys).agg(p.alias("_p")).select(*keys, *[F.col("_p")[i].alias(n) for i, n in enumerate(cols)])


def span_medians(df: DataFrame, spans: DataFrame, keys: Keys, value: str = "value") -> DataFrame:
    """Median per span, and the median of its middle 60 %."""
    inside = within(df, spans, keys)
    length = F.col("end") - F.col("start")
    core = (F.col("frame") >= F.col("start") + 0.2 * length) & (F.col("frame") < F.col("end") - 0.2 * length)
    return inside.groupBy(*keys, "start", "end").agg(F.median(value).alias("centre"), F.median(F.when(core, F.col(value))).alias("core"))


def voiced_seconds(df: DataFrame, keys: Keys, mask: Column, hop_seconds: float) -> DataFrame:
    return df.groupBy(*keys).agg((F.count_if(mask) * hop_seconds).alias("voiced_seconds"))


def first_crossing(df: DataFrame, keys: Keys, level: Column, value: str = "value") -> DataFrame:
    """First place where a rising series reaches a level, with the fraction of the step before it."""
    w = Window.partitionBy(*keys).orderBy("frame")
    rows = df.withColumn("_l", level).withColumn("_b", F.lag(value).over(w)).where(F.col(value) >= F.col("_l"))
    at = F.when(F.col("_b").isNull() | (F.col(value) == F.col("_b")), F.col("frame")).otherwise(F.col("frame") - (F.col(value) - F.col("_l")) / (F.col(value) - F.col("_b")))
    return rows.groupBy(*keys).agg(F.min_by(at, "frame").alias("crossing"))


def clipping(df: DataFrame, keys: Keys, value: str = "value", least: int = 3) -> DataFrame:
    """Runs of at least three equal extremes: fraction of samples, number and longest."""
    ends = df.groupBy(*keys).agg(F.max(F.abs(F.col(value))).alias("_m"), F.count("*").alias("_n"))
    rows = df.join(ends, [*keys])
    found = long_runs(runs(rows, keys, (F.abs(F.col(value)) >= 0.999 * F.col("_m")) & (F.col("_m") > 0)), least)
    agg = found.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("_c"), F.count("*").alias("runs"), F.max(F.col("end") - F.col("start")).alias("longest"))
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    return ends.join(agg, [*keys], "left").select(*keys, (zero("_c") / F.col("_n")).alias("fraction"), zero("runs").alias("runs"), zero("longest").alias("longest"))


def pause_levels(df: DataFrame, keys: Keys, voiced: Column, margin: int, value: str = "value") -> DataFrame:
    """20th percentile of frames that are farther than `margin` from voice, and the voiced median."""
    w = Window.partitionBy(*keys).orderBy("frame").rowsBetween(-margin, margin)
    rows = df.withColumn("_v", voiced.cast("int")).withColumn("_near", F.max("_v").over(w))
    return rows.groupBy(*keys).agg(F.percentile(F.when(F.col("_near") == 0, F.col(value)), F.lit(0.2)).alias("floor"), F.median(F.when(F.col("_v") == 1, F.col(value))).alias("voiced"))


def trend(df: DataFrame, keys: Keys, width: int, order: str = "frame", value: str = "value") -> DataFrame:
    """Last against first `width` values in units of the noise of second differences."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("_r", F.row_number().over(w)).withColumn("_e", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order))))
    rows = rows.withColumn("_d", F.col(value) - 2 * F.lag(value).over(w) + F.lag(value, 2).over(w))
    agg = rows.groupBy(*keys).agg(F.median(F.abs("_d")).alias("_n"), F.median(F.when(F.col("_r") <= width, F.col(value))).alias("_a"), F.median(F.when(F.col("_e") <= width, F.col(value))).alias("_b"), F.count("*").alias("n"))
    noise = F.greatest(1.4826 * F.col("_n") / 6**0.5, F.lit(1e-9))
    return agg.select(*keys, ((F.col("_b") - F.col("_a")) / noise).alias("trend_z"), "n")
