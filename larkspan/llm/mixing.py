"""Mixing sources to target weights by entropy balancing.

Every document starts at rate 1 (one copy expected) and gets the rate nearest to that, in bounded relative entropy (the sum of
r log r + (cap - r) log(cap - r) against its value at 1), under one token constraint a source: its words times their rates add
up to the source's target. The dual is convex with one multiplier a source, and its solution is the exponentially tilted rate
r = cap * e / (1 + e), e = exp(b * x) / (cap - 1), x the document's size over the source's mean size. So a source that must grow
repeats its long documents first, and one that must shrink drops its long documents first, as few documents as can be.
Newton steps solve it for all sources at once, their sums taken by Spark over the histogram (source, size), which is all that
the constraints depend on. From 0 the steps approach the solution from one side, so they need neither damping nor a limit.

Rates become whole copies: every document gets the whole part; in each (source, size) cell so many documents get one more
that the words still owed to the source come out even, cell by cell from large to small sizes. Which ones is a matter of the
rank of a hash, and among equal rows of their place in the table. So a source ends within one of its smallest documents of its target where the cells allow it.
A source with d different sizes has d * d / 2 words at least, so the cells of one source, which one task rounds, grow like the root of its words.

Defined results: null text has size 0; a null source is a source and sorts last; documents of size 0 keep rate 1 and add no
words; an empty table gives an empty result; repeated rows are separate documents; input columns may have any names, since
they are kept in a struct. The sources' table (a row each) is metadata: it is sorted in one task.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as c

SATURATED = 40.0  # a rate this many nats from its bound is at the bound
ENDLESS = 1e18  # a multiplier that saturates every document with a word


def source_key(source: Column) -> Column:
    """Non-null text that sorts as sources do: by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def targets(sources: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """_k, _size -> also _target: weights repeat over the sources in order; all targets are share * all sizes, none above cap * its own size, the excess shared by weight.

    That is min(cap * size, weight * t) for one t, found where the sources reach their caps in the order of cap * size / weight.
    """
    one = Window.partitionBy(F.lit(0))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(one.orderBy("_k")) - 1) % len(weights) + 1)
    rows = sources.withColumn("_w", w).withColumn("_most", cap * F.col("_size"))
    by_ratio = one.orderBy(F.col("_most") / F.col("_w"), "_k")
    rows = rows.withColumn("_full", F.sum("_most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_rest", F.sum("_w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    goal = share * F.sum("_size").over(one)
    t = (goal - F.coalesce("_full", F.lit(0.0))) / F.col("_rest")
    # the first source that is not full gives t; before it, every t is at least the source's own ratio
    rows = rows.withColumn("_t", F.when(t < F.col("_most") / F.col("_w"), t))
    level = F.first("_t", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("_target", F.least(F.col("_most"), F.coalesce(F.col("_w") * level, F.col("_most")))).select("_k", "_size", "_target")


def _rate(b: Column, x: Column, cap: float) -> Column:
    """The tilted rate; 1 where b is 0 (half of the cap, if that is 1 or less)."""
    start = -math.log(cap - 1) if cap > 1 else 0.0
    return cap / (1 + F.exp(-F.least(F.greatest(start + b * x, F.lit(-SATURATED)), F.lit(SATURATED))))


def solve(cells: DataFrame, goals: DataFrame, cap: float, tol: float = 1e-9) -> DataFrame:
    """Newton's method on the dual: _k, _b. cells: _k, _x, _n (spooled); goals: _k, _docs, _words in units of x.

    A source whose target is at its cap, or zero, has its rates at the bound and no finite multiplier; it gets an endless one.
    """
    most = cap * F.col("_docs")
    state = c.spool(goals.withColumns({"_done": (F.col("_words") <= 0) | (F.col("_words") >= most * (1 - 1e-12)), "_b": F.when(F.col("_words") <= 0, -ENDLESS).when(F.col("_words") >= most * (1 - 1e-12), ENDLESS).otherwise(0.0)}))
    with_state = F.broadcast if goals.count() <= 50_000 else (lambda df: df)
    while state.where(~F.col("_done")).limit(1).count():
        r = _rate(F.col("_b"), F.col("_x"), cap)
        n, x = F.col("_n"), F.col("_x")
        sums = cells.join(with_state(state.where(~F.col("_done")).select("_k", "_b")), "_k").groupBy("_k").agg(F.sum(n * r * x).alias("_sum"), F.sum(n * r * (1 - r / cap) * x * x).alias("_slope"))
        gap = F.col("_words") - F.col("_sum")
        step = F.when(F.col("_slope") > 0, gap / F.when(F.col("_slope") > 0, F.col("_slope")))
        close = (F.abs(gap) <= tol * F.col("_docs")) | step.isNull() | (F.abs(step) <= 1e-14 * F.abs("_b"))
        new = state.join(sums, "_k", "left").select("_k", "_docs", "_words", (F.col("_b") + F.when(F.col("_done") | close, 0.0).otherwise(step)).alias("_b"), (F.col("_done") | F.coalesce(close, F.lit(True))).alias("_done"))
        old, state = state, c.spool(new)
        c.drop_spool(old)
    return state.select("_k", "_b")


def _round_cells(cap: float) -> object:
    """Copies of the cells of one source, from large sizes to small: what is owed decides how many get one more."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_size", ascending=False, kind="stable")
        owed, whole, more = 0.0, [], []
        for size, n, rate in zip(rows["_size"], rows["_n"], rows["_r"], strict=True):
            base = int(min(rate + 1e-9, cap))
            owed += n * (rate - base) * max(size, 1)
            k = int(min(n if base + 1 <= cap else 0, max(0, round(owed / max(size, 1)))))
            owed -= k * max(size, 1)
            whole.append(base)
            more.append(k)
        return pd.DataFrame({"_k": rows["_k"], "_size": rows["_size"], "_r": rows["_r"], "_base": whole, "_more": more})

    return run


def keyed(df: DataFrame, *kept: Column, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Spooled: the `kept` columns, `_h` (a hash of the document that breaks ties), `_t` (its place, for equal rows), `_k` (its source) and `_size` (its words)."""
    row = F.xxhash64("doc_id", text_col, source_col)
    return c.spool(df.select(*kept, row.alias("_h"), F.monotonically_increasing_id().alias("_t"), source_key(F.col(source_col)).alias("_k"), c.n_words(F.col(text_col)).alias("_size")))


def plan(rows: DataFrame, weights: list[float], share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """From keyed rows: a spooled row for each source and size with _source_size, _target, _base (copies of all its documents), _last_h and _last_t (documents not behind them get one more) and _r (the rate)."""
    slim = rows.select("_h", "_t", "_k", "_size")
    cells = c.spool(slim.groupBy("_k", "_size").agg(F.count("*").alias("_n")))
    totals = cells.groupBy("_k").agg(F.sum(F.col("_n") * F.col("_size")).alias("_size"), F.sum("_n").alias("_docs"))
    goals = c.spool(targets(totals, weights, share, cap).join(totals.select("_k", "_docs"), "_k"))
    mean = F.greatest(F.col("_size") / F.col("_docs"), F.lit(1e-9))
    scaled = c.spool(c.join_small(cells, goals.select("_k", mean.alias("_mean")), "_k").select("_k", "_size", "_n", (F.col("_size") / F.col("_mean")).alias("_x")))
    duals = solve(scaled, goals.where("_size > 0").select("_k", F.col("_docs").cast("double"), (F.col("_target") / mean).alias("_words")), cap)
    rated = c.join_small(scaled, duals, "_k", "left").withColumn("_r", _rate(F.coalesce("_b", F.lit(0.0)), F.col("_x"), cap))
    rounded = c.spool(rated.select("_k", "_size", "_n", "_r").groupBy("_k").applyInPandas(_round_cells(cap), "_k string, _size long, _r double, _base long, _more long"))
    ranked = c.bucket_rank(slim, ["_k", "_size"], F.col("_h"), tie="_t")
    chosen = c.join_small(ranked, rounded.where("_more > 0"), ["_k", "_size"], limit=200_000).where(F.col("rank") < F.col("_more"))
    last = chosen.groupBy("_k", "_size").agg(F.max(F.struct("_h", "_t")).alias("_last")).select("_k", "_size", F.col("_last._h").alias("_last_h"), F.col("_last._t").alias("_last_t"))
    out = c.spool(c.join_small(rounded.select("_k", "_size", "_r", "_base").join(last, ["_k", "_size"], "left"), goals.select("_k", F.col("_size").alias("_source_size"), "_target"), "_k"))
    c.drop_spool(cells, goals, scaled, rounded)
    return out


def with_copies(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Keyed rows with _source_size, _target, _r and _copies."""
    out = c.join_small(rows, planned, ["_k", "_size"], limit=200_000)
    more = (F.col("_h") < F.col("_last_h")) | ((F.col("_h") == F.col("_last_h")) & (F.col("_t") <= F.col("_last_t")))
    return out.withColumn("_copies", F.col("_base") + F.coalesce(more.cast("long"), F.lit(0)))


WEIGHTS = [5.0, 2.0, 1.0]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources (5, 2, 1, ... by code point, 150% of all words, at most twice a source) takes of every document."""
    rows = keyed(c.documents(spark, sf_dir), F.col("doc_id"))
    out = with_copies(rows, plan(rows, WEIGHTS))
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"), F.col("_copies").alias("copies"), F.round("_r", 9).alias("rate"))


def mixed_documents(docs: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with their own columns."""
    rows = keyed(docs, c.boxed(docs))
    taken = with_copies(rows, plan(rows, weights or WEIGHTS)).where("_copies > 0")
    return c.unboxed(taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy")), docs)
