"""Takes against a target, from frame tables to ranked items: align, difference, notes, premises, thresholds, habits, rank.

curve frames: recording, frame, value (cents), level, confidence. `pairs` says which takes belong to which target.
Every step is a DataFrame operator; only the alignment and the final order of a comparison's items are grouped kernels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import decisions, joins, kernels, series

# Least confidence of a frame and of an item, least frames of a note.
MIN_CONFIDENCE, MIN_NOTE = 0.3, 5


def warps(frames: DataFrame, pairs: DataFrame, band: int = 52) -> DataFrame:
    """take, target, frame, tau, cost. Alignment features: pitch within the octave on a circle, level, voicing."""
    angle = F.col("value") * (2 * 3.141592653589793 / 1200)
    on = F.col("value").isNotNull()
    vec = F.array(F.when(on, F.cos(angle)).otherwise(0.0), F.when(on, F.sin(angle)).otherwise(0.0), F.coalesce(F.col("level") / 20, F.lit(0.0)), on.cast("double"), F.lit(0.5))
    f = frames.withColumn("vec", vec).select("recording", "frame", "vec")
    takes = pairs.join(f.withColumnRenamed("recording", "take"), "take")
    targets = pairs.join(f.withColumnRenamed("recording", "target"), "target").select("take", "target", "frame", "vec")
    return kernels.align_series(takes.select("take", "target", "frame", "vec"), targets, ["take", "target"], band=band)


def differences(frames: DataFrame, warp: DataFrame) -> DataFrame:
    """take, target, frame, difference (cents), level_difference, sung, u_conf, t_conf at the matched target place."""
    curve = lambda name, col: frames.select(F.col("recording").alias("target"), "frame", F.col(col).alias(name))
    rows = warp.select("take", "target", "frame", "tau")
    rows = joins.at_fraction(rows, curve("v", "value"), ["target"], "tau", "v", "t_value")
    rows = joins.at_fraction(rows, curve("v", "level"), ["target"], "tau", "v", "t_level")
    rows = joins.at_fraction(rows, curve("v", "confidence"), ["target"], "tau", "v", "t_conf")
    user = frames.select(F.col("recording").alias("take"), "frame", F.col("value").alias("u_value"), F.col("level").alias("u_level"), F.col("confidence").alias("u_conf"))
    both = rows.join(user, ["take", "frame"])
    ok = (F.col("u_conf") >= MIN_CONFIDENCE) & (F.col("t_conf") >= MIN_CONFIDENCE)
    return both.select("take", "target", "frame", F.when(ok, F.col("u_value") - F.col("t_value")).alias("difference"), (F.col("u_level") - F.col("t_level")).alias("level_difference"), F.col("u_value").isNotNull().alias("sung"), "u_conf", "t_conf")


def note_items(frames: DataFrame, diff: DataFrame, transposition: DataFrame) -> DataFrame:
    """take, target, note, category, attribute, magnitude, confidence, start, end: median offset of every note of a take, and its level."""
    notes = kernels.notes(frames.select(F.col("recording").alias("take"), "frame", "value"), ["take"], least=MIN_NOTE)
    d = diff.join(transposition.select("take", "target", "transposition"), ["take", "target"]).withColumn("offset", F.col("difference") - F.coalesce("transposition", F.lit(0.0)))
    inside = series.within(d, notes, ["take"])
    per = inside.groupBy("take", "target", "note", "start", "end").agg(F.median("offset").alias("intonation"), F.median("level_difference").alias("loudness"), F.avg(F.least("u_conf", "t_conf")).alias("confidence"))
    rows = per.select("take", "target", "note", "start", "end", "confidence", F.inline(F.array(F.struct(F.lit("pitch").alias("category"), F.lit("intonation").alias("attribute"), F.col("intonation").alias("magnitude")), F.struct(F.lit("dynamics").alias("category"), F.lit("loudness").alias("attribute"), F.col("loudness").alias("magnitude")))))
    return rows.where("magnitude is not null")


def compare(frames: DataFrame, pairs: DataFrame, thresholds: DataFrame, premises: DataFrame | None = None) -> dict[str, DataFrame]:
    """warp, octave (premise), items (ranked, those that are shown), withheld (with the premise or reason).

    pairs: take, target, take_no. premises: take, premise, passed, reason, beside the octave relation that is checked here.
    """
    warp = warps(frames, pairs.select("take", "target"))
    diff = differences(frames, warp)
    octave = decisions.octave_premise(diff, ["take", "target"])
    items = note_items(frames, diff, octave)
    spark = frames.sparkSession
    need = spark.createDataFrame([("intonation", "octave_relation", 0), ("loudness", "level_chain", 0)], "attribute string, premise string, pos int")
    checks = octave.select("take", F.lit("octave_relation").alias("premise"), "passed", F.lit("pitches do not agree on one octave").alias("reason"))
    if premises is not None:
        checks = checks.unionByName(premises.select("take", "premise", "passed", "reason"))
    kept, withheld = joins.withhold(items, need, checks, ["take"])
    judged = decisions.apply_thresholds(kept.withColumns({"status": F.lit("none"), "audibility": F.lit(None).cast("double")}), thresholds)
    shown = judged.where("reason = 'ok'")
    habit = decisions.habits(shown.join(pairs.select("take", "take_no"), "take"), ["target", "attribute", "note"], "take_no")
    scored = decisions.item_scores(shown.withColumn("item", F.concat_ws(":", "attribute", "note")), ["take"])
    ranked = decisions.rank_items(scored.select("take", "target", "item", "category", "attribute", "note", "magnitude", "confidence", "score", "basis"), ["take"], "item")
    ranked = ranked.join(habit.select("target", "attribute", "note", "consistency"), ["target", "attribute", "note"], "left")
    refused = withheld.select("take", "attribute", "note", F.col("premise").alias("by"), "reason").unionByName(judged.where("reason <> 'ok'").select("take", "attribute", "note", F.lit("threshold").alias("by"), "reason"))
    return {"warp": warp, "octave": octave, "items": ranked, "withheld": refused}
