"""Text beside music: syllables on notes, tokens on frames, and the merged pitch of several trackers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import octave_candidates, overlaps
from .kernels import allocate, best_path, per_series
from .series import within

Keys = Sequence[str]


def syllables_on_notes(notes: DataFrame, syllables: DataFrame, keys: Keys) -> DataFrame:
    """keys, note, start, end, text: syllables are dealt over notes by their length (largest quotient), in order.

    With fewer syllables than notes, the notes that get none carry on the syllable before (text NULL, melisma true).
    """
    notes_of = notes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_n"))
    text_of = syllables.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "syllable"))), lambda x: x["syllable"]).alias("_t"))
    rows = notes_of.join(text_of, [*keys], "left")

    @F.pandas_udf("array<int>")
    def deal(spans: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for n, t in zip(spans, texts, strict=True):
            total = 0 if t is None else len(t)
            out.append(allocate([x["end"] - x["start"] for x in n], total))
        return pd.Series(out)

    counts = rows.withColumn("_c", deal("_n", "_t"))
    before = lambda i: F.aggregate(F.slice("_c", 1, i), F.lit(0), lambda a, x: a + x)
    made = F.transform("_n", lambda n, i: F.struct(i.alias("note"), n["start"].alias("start"), n["end"].alias("end"), F.when(F.get("_c", i) > 0, F.array_join(F.slice(F.col("_t"), before(i) + 1, F.get("_c", i)), "")).alias("text"), (F.get("_c", i) == 0).alias("melisma")))
    return counts.select(*keys, F.inline(made))


def syllables_for(notes: DataFrame, syllables: DataFrame, keys: Keys, cell: float = 64.0) -> DataFrame:
    """keys, start, end, texts: syllables whose [start, end) overlaps the note, in order."""
    both = overlaps(notes.select(*keys, "start", "end"), syllables.select(*keys, "start", "end", "syllable"), keys, cell)
    return both.groupBy(*keys, "start", "end").agg(F.transform(F.sort_array(F.collect_list(F.struct("b_start", "b_syllable"))), lambda x: x["b_syllable"]).alias("texts"))


def frame_tokens(frames: DataFrame, spans: DataFrame, keys: Keys, order: str = "pos") -> DataFrame:
    """Frames with the token of the last span in order that holds them; NULL outside. spans: keys, start, end, token, pos."""
    inside = within(frames.select(*keys, "frame"), spans.select(*keys, "start", "end", "token", order), keys)
    best = inside.groupBy(*keys, "frame").agg(F.max_by("token", order).alias("token"))
    return frames.join(best, [*keys, "frame"], "left")


def merged_pitch(tracks: DataFrame, keys: Keys, jump_cost: float = 0.01, octave_cost: float = 4.0) -> DataFrame:
    """keys, frame, cents, confidence: the path of candidates that trackers agree on and that jumps least.

    tracks: keys, frame, tracker, cents, weight. A step costs `jump_cost` per cent, and `octave_cost` more beyond half an octave.
    The confidence is the share of a frame's weight that is within 50 cents of the choice.
    """
    tracks = tracks.where(F.col("cents").isNotNull())
    cands = octave_candidates(tracks, [*keys, "frame"])

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = [g.sort_values("candidate") for _, g in pdf.groupby("frame", sort=True)]
        frames = [int(g["frame"].iloc[0]) for g in groups]
        out, at = np.zeros(len(groups)), 0
        while at < len(groups):  # stretches of gapless frames
            end = at + 1
            while end < len(groups) and frames[end] == frames[end - 1] + 1:
                end += 1
            grid = np.unique(np.concatenate([g["candidate"].to_numpy() for g in groups[at:end]]).round(1))
            score = np.full((end - at, len(grid)), -np.inf)
            for t, g in enumerate(groups[at:end]):
                score[t, np.searchsorted(grid, g["candidate"].to_numpy().round(1))] = g["score"].to_numpy()
            gap = np.abs(np.subtract.outer(grid, grid))
            path = best_path(score, -(jump_cost * gap + octave_cost * (gap > 600)))
            out[at:end] = grid[path]
            at = end
        return pd.DataFrame({"frame": frames, "cents": out})

    chosen = per_series(cands, keys, work, "frame long, cents double")
    near = chosen.join(tracks.select(*keys, F.col("frame").cast("long").alias("frame"), F.col("cents").alias("_t"), "weight"), [*keys, "frame"])
    share = F.sum(F.when(F.abs(F.col("_t") - F.col("cents")) <= 50, F.col("weight")).otherwise(0.0)) / F.sum("weight")
    return near.groupBy(*keys, "frame", "cents").agg(share.alias("confidence"))
