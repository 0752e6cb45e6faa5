"""Threshold filters, ranking, consistency over takes, premises and benchmark scores."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import interp_arrays, known
from .joins import overlaps
from .series import runs

Keys = Sequence[str]

# Tiers of categories, and the relative difference of scores that counts as a tie.
TIERS = {"pitch": 0, "rhythm": 1, "ornament": 2, "dynamics": 3, "phonation": 4, "diction": 5}
TIE = 0.10
# Which premise an attribute depends on.
REQUIRES = {"tempo": "shared_clock", "loudness": "level_chain", "dynamic_range": "level_chain", "breathiness": "noise_floor", "interval_compression": "interval_set"}
# Limits of the premises.
MIN_COVERAGE, MIN_CONFIDENCE, MIN_CONSISTENCY, MIN_SNR_DB, MIN_INTERVALS = 0.6, 0.25, 0.8, 30.0, 3


def uncertainty(confidence: Column, mdc: Column, least: Column, levels: Column | None = None, errors: Column | None = None) -> Column:
    """Smallest magnitude that counts: the MDC, or the error expected at this confidence; infinite below the least confidence."""
    u = mdc if levels is None else F.greatest(mdc, F.coalesce(interp_arrays(confidence, levels, errors), mdc))
    return F.when(confidence < least, F.lit(float("inf"))).otherwise(u)


def threshold_reason(floor: float | None = None) -> Column:
    """First reason that an item is not shown, or `ok`. Columns: has_threshold, usable, min_confidence, confidence, status, magnitude, uncertainty, audibility."""
    c = F.col
    yes = lambda x: F.coalesce(x, F.lit(False))  # noqa: E731  unknown values fail the test they are in
    out = F.when(~yes(c("has_threshold")), "no_threshold").when(~yes(c("usable")), "attribute_not_reliable").when(~yes(c("confidence") >= c("min_confidence")), "below_confidence")
    out = out.when(yes(c("status").isin("missing", "extra")), "ok").when(yes(c("status") == "same"), "no_difference").when(~yes(F.abs(c("magnitude")) >= c("uncertainty")), "below_magnitude")
    if floor is not None:
        out = out.when(c("audibility") < floor, "below_audibility")
    return out.otherwise("ok")


def apply_thresholds(items: DataFrame, thresholds: DataFrame, floor: float | None = None) -> DataFrame:
    """items(attribute, confidence, magnitude, status, audibility) with `reason`; thresholds(attribute, mdc, min_confidence, usable) is a small table."""
    t = thresholds.select("attribute", "mdc", "min_confidence", "usable", F.lit(True).alias("has_threshold"))
    rows = items.join(t, "attribute", "left").withColumn("has_threshold", F.coalesce("has_threshold", F.lit(False)))
    rows = rows.withColumn("uncertainty", uncertainty(F.col("confidence"), F.col("mdc"), F.col("min_confidence")))
    return rows.withColumn("reason", threshold_reason(floor))


def item_scores(items: DataFrame, keys: Keys) -> DataFrame:
    """Confidence times audibility if every item of the key has one, else times magnitude over uncertainty."""
    heard = F.min(F.col("audibility").isNotNull().cast("int")).over(Window.partitionBy(*keys)) == 1
    u = F.col("uncertainty")
    size = F.when((u > 0) & (u < float("inf")), F.abs(F.col("magnitude")) / u).otherwise(1.0)
    size = F.when(F.col("status").isin("missing", "extra"), F.greatest(size, F.lit(1.0))).otherwise(size)
    return items.withColumn("basis", F.when(heard, "audibility").otherwise("magnitude_over_uncertainty")).withColumn("score", F.col("confidence") * F.when(heard, F.col("audibility")).otherwise(size))


def rank_items(items: DataFrame, keys: Keys, name: str, tie: float = TIE) -> DataFrame:
    """Position of every item: the best score is next; scores within the tie of the best left give way to the lower tier, then the higher score, then the name.

    The tie is relative to the best item that is left, so it depends on what was taken before: one key's items (one
    comparison, tens of rows) are ordered in one group. Items without a score come last.
    """
    tiers = F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv])
    rows = items.withColumn("tier", F.coalesce(F.try_element_at(tiers, F.col("category")), F.lit(max(TIERS.values()) + 1)))

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        left = list(zip(pdf["tier"], -pdf["score"].fillna(float("-inf")), pdf[name].astype(str), range(len(pdf)), strict=True))
        place = [0] * len(pdf)
        for k in range(len(pdf)):
            best = max(-s for _, s, _, _ in left)
            pick = min(x for x in left if -x[1] >= best / (1 + tie) or best <= 0)
            left.remove(pick)
            place[pick[3]] = k
        return pdf.assign(position=place)

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.groupBy(*keys).applyInPandas(order, f"{head}, position long")


def habits(items: DataFrame, keys: Keys, take: str, value: str = "magnitude") -> DataFrame:
    """style_or_habit if all takes deviate the same way by more than their spread, error if not, undetermined below two takes. Deviation of the last take is kept."""
    v = F.col(value)
    same = (F.min(v) > 0) | (F.max(v) < 0)
    out = F.when(F.count(v) < 2, "undetermined").when(same & (F.abs(F.avg(v)) > F.stddev_pop(v)), "style_or_habit").otherwise("error")
    return items.groupBy(*keys).agg(out.alias("consistency"), F.count(v).alias("takes"), F.max_by(v, take).alias("last"))


def octave_premise(frames: DataFrame, keys: Keys, step: float = 1200.0) -> DataFrame:
    """Coverage, confidence and consistency of a constant shift by whole steps, and whether the relation is established. frames: keys, difference (cents), sung, u_conf, t_conf."""
    both = F.col("sung") & F.col("difference").isNotNull()
    base = frames.withColumn("_both", both)
    shift = step * F.bround(F.median(F.when(F.col("_both"), F.col("difference"))) / step)
    head = base.groupBy(*keys).agg(shift.alias("transposition"), (F.count_if("_both") / F.greatest(F.count_if("sung"), F.lit(1))).alias("coverage"), F.count_if("_both").alias("_n"), F.median(F.when(F.col("_both"), F.col("u_conf"))).alias("user_confidence"), F.median(F.when(F.col("_both"), F.col("t_conf"))).alias("target_confidence"))
    agree = base.where("_both").join(head.select(*keys, "transposition"), [*keys]).groupBy(*keys).agg(F.avg((F.abs(F.col("difference") - F.col("transposition")) < step / 2).cast("double")).alias("consistency"))
    ok = (F.col("_n") >= 5) & (F.col("coverage") >= MIN_COVERAGE) & (F.least("user_confidence", "target_confidence") >= MIN_CONFIDENCE) & (F.col("consistency") >= MIN_CONSISTENCY)
    return head.join(agree, [*keys], "left").withColumn("passed", F.coalesce(ok, F.lit(False))).drop("_n")


def noise_premise(user_snr: Column, target_snr: Column) -> Column:
    return F.coalesce(user_snr >= MIN_SNR_DB, F.lit(False)) & F.coalesce(target_snr >= MIN_SNR_DB, F.lit(False))


def benchmark_recall(segments: DataFrame, predictions: DataFrame, tolerance: float, cell: float = 5.0) -> DataFrame:
    """Per label: segments that a prediction of the same label and clip overlaps, over all. segments: clip, seg, start, end, label; predictions: clip, start, end, label."""
    hit = overlaps(segments, predictions, ["clip", "label"], cell, tolerance).select("clip", "seg", "label").distinct().withColumn("_h", F.lit(1))
    return segments.join(hit, ["clip", "seg", "label"], "left").groupBy("label").agg(F.count("*").alias("segments"), F.count("_h").alias("hits"), (F.count("_h") / F.count("*")).alias("recall"))


def top_k_hit(predictions: DataFrame, truths: DataFrame, k: int) -> DataFrame:
    """Per clip: whether one of the k best distinct labels (score, then label) is true. predictions: clip, label, score; truths: clip, label."""
    best = predictions.groupBy("clip", "label").agg(F.max("score").alias("score"))
    rows = best.withColumn("_r", F.row_number().over(Window.partitionBy("clip").orderBy(F.desc("score"), "label"))).where(F.col("_r") <= k)
    hit = rows.join(truths.distinct(), ["clip", "label"], "left_semi").select("clip").distinct().withColumn("_h", F.lit(True))
    return truths.select("clip").distinct().join(predictions.select("clip").distinct(), "clip", "left_semi").join(hit, "clip", "left").select("clip", F.coalesce("_h", F.lit(False)).alias("hit"))


def contour_items(df: DataFrame, keys: Keys, floor: float, least: int, gap: int) -> DataFrame:
    """Stretches where a difference keeps one sign above a floor, over gaps of at most `gap` frames: start, end, sign, mean and area."""
    from .series import merge_runs, within

    sign = F.signum(known("value"))
    big = df.withColumn("sign", sign).where(F.abs(F.col("value")) >= floor)
    spans = merge_runs(runs(big, [*keys, "sign"], F.lit(True)), [*keys, "sign"], gap + 1).where(F.col("end") - F.col("start") >= least)
    inside = within(big, spans, [*keys, "sign"])
    return inside.groupBy(*keys, "sign", "start", "end").agg(F.avg("value").alias("mean"), F.sum(F.abs(F.col("value"))).alias("area"))


def missing_extra(user: DataFrame, target: DataFrame, keys: Keys, value: str, tolerance: float) -> DataFrame:
    """Full outer join of events of both sides: missing, extra, different or same."""
    u, t = user.select(*keys, F.col(value).alias("user_value")), target.select(*keys, F.col(value).alias("target_value"))
    status = F.when(F.col("user_value").isNull(), "missing").when(F.col("target_value").isNull(), "extra").when(F.abs(F.col("user_value") - F.col("target_value")) > tolerance, "different").otherwise("same")
    return u.join(t, [*keys], "full_outer").withColumn("status", status)


def feature_stats(codes: DataFrame, latent: str, value: str) -> DataFrame:
    """Per latent: share of rows in which it is active, mean when active, share of the squared total."""
    v = F.col(value)
    agg = codes.groupBy(latent).agg(F.avg((v > 0).cast("double")).alias("frequency"), F.avg(F.when(v > 0, v)).alias("mean_active"), F.sum(v * v).alias("_e"))
    total = agg.agg(F.sum("_e").alias("_t")).first()["_t"] or 1.0
    return agg.withColumn("energy_share", F.col("_e") / total).drop("_e")


def direction(pairs: DataFrame, a: str, b: str, dims: int) -> DataFrame:
    """Mean difference b - a by dimension of two vector columns, its unit vector, and how many pairs share its sign."""
    diffs = pairs.select(F.posexplode(F.zip_with(a, b, lambda x, y: (y - x).cast("double"))).alias("dim", "d"))
    mean = diffs.groupBy("dim").agg(F.avg("d").alias("mean"), F.avg((F.col("d") > 0).cast("double")).alias("positive"))
    norm = mean.agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("n")).first()["n"] or 1.0
    return mean.select("dim", "mean", (F.col("mean") / norm).alias("unit"), F.greatest("positive", 1 - F.col("positive")).alias("sign_consistency"))
