"""Fading feedback per session, as a batch scan and as a stateful stream with the same rule.

A session starts with full feedback (1). After every attempt the mean load of the last `WINDOW` attempts decides: low load
fades feedback one step (1, 1/2, 1/4), high load brings it one step back; the window starts anew after a change.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# The schedule of feedback, attempts in the window, and the tolerance around the target load.
SCHEDULE = (1.0, 0.5, 0.25)
WINDOW, TOLERANCE = 3, 0.25
TARGET = 50.0
OUT = "attempt long, load double, stage int, feedback double"


def step(stage: int, loads: list[float], load: float, target: float = TARGET) -> tuple[int, list[float]]:
    """Stage and window after one attempt."""
    loads = [*loads, load][-WINDOW:]
    if len(loads) < WINDOW:
        return stage, loads
    mean = sum(loads) / WINDOW
    if mean <= target * (1 - TOLERANCE) and stage < len(SCHEDULE) - 1:
        return stage + 1, []
    if mean >= target * (1 + TOLERANCE) and stage > 0:
        return stage - 1, []
    return stage, loads


def _advance(rows: pd.DataFrame, stage: int, loads: list[float]) -> tuple[pd.DataFrame, int, list[float]]:
    rows = rows.sort_values("attempt", kind="stable")
    stages = []
    for load in rows["load"]:
        stages.append(stage)
        stage, loads = step(stage, loads, float(load))
    out = rows[["attempt", "load"]].assign(stage=stages, feedback=[SCHEDULE[s] for s in stages])
    return out, stage, loads


def fading_batch(attempts: DataFrame) -> DataFrame:
    """attempts: session, attempt (its order), load -> also the stage and feedback that the attempt had."""
    kind = attempts.schema["session"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, *_ = _advance(pdf, 0, [])
        out.insert(0, "session", pdf["session"].iloc[0])
        return out

    return attempts.groupBy("session").applyInPandas(run, f"session {kind}, {OUT}")


def fading_stream(attempts: DataFrame) -> DataFrame:
    """The same over a stream. A micro-batch's attempts are taken in order; an attempt that comes after later ones counts when it comes."""
    kind = attempts.schema["session"].dataType.simpleString()

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stage, loads = state.get if state.exists else (0, [])
        out, stage, loads = _advance(pd.concat(list(batches)), int(stage), list(loads))
        state.update((stage, loads))
        out.insert(0, "session", key[0])
        yield out

    return attempts.groupBy("session").applyInPandasWithState(run, f"session {kind}, {OUT}", "stage int, loads array<double>", "append", GroupStateTimeout.NoTimeout)


def gap_sessions(events: DataFrame, key: str, stamp: str, gap: str, watermark: str) -> DataFrame:
    """Session windows of a stream or table: count and extent of activity with pauses below the gap."""
    w = F.session_window(stamp, gap)
    out = events.withWatermark(stamp, watermark).groupBy(key, w.alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_totals(log: DataFrame, user: str, session: str, day: str, seconds: str) -> DataFrame:
    """user, session, day, session_seconds (of the whole session) and day_seconds (of the user's whole day). Negative seconds are an error."""
    whole = F.sum(F.when(F.col(seconds) < 0, F.raise_error(F.lit("negative seconds"))).otherwise(F.col(seconds)))
    rows = log.groupBy(user, session, day).agg(whole.alias("_s"))
    per = rows.groupBy(user, session).agg(F.sum("_s").alias("session_seconds"))
    daily = rows.groupBy(user, day).agg(F.sum("_s").alias("day_seconds"))
    return rows.select(user, session, day).join(per, [user, session]).join(daily, [user, day])


def warnings(totals: DataFrame, session_limit: float, day_limit: float) -> DataFrame:
    return totals.withColumn("warnings", F.array_compact(F.array(F.when(F.col("session_seconds") > session_limit, "session"), F.when(F.col("day_seconds") > day_limit, "day"))))
