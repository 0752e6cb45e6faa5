"""As-of, nearest, interval, pattern and role joins. Range conditions always ride on an equi-join, so no pair is formed by a cross join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


def asof(left: DataFrame, right: DataFrame, keys: Keys, time: str, values: Sequence[str], direction: str = "backward") -> DataFrame:
    """Each left row with the values of the last right row at or before its time (first at or after it for `forward`).

    Both sides are laid in one sorted sequence per key and the last known right row is carried along; one shuffle, no pairs.
    """
    back = direction == "backward"
    packed = F.struct(F.col(time).alias("_t"), *[F.col(v) for v in values])
    both = left.select(*[F.col(x) for x in left.columns], F.lit(None).cast(right.select(packed.alias("x")).schema["x"].dataType).alias("_p"), F.lit(1 if back else 0).alias("_o"))
    other = right.select(*[F.col(k) for k in keys], *[F.lit(None).cast(left.schema[x].dataType).alias(x) if x != time else F.col(time) for x in left.columns if x not in keys], packed.alias("_p"), F.lit(0 if back else 1).alias("_o"))
    rows = both.unionByName(other)
    w = Window.partitionBy(*keys).orderBy(time, "_o").rowsBetween(Window.unboundedPreceding, 0) if back else Window.partitionBy(*keys).orderBy(F.desc(time), F.desc("_o")).rowsBetween(Window.unboundedPreceding, 0)
    carried = rows.withColumn("_c", F.last("_p", ignorenulls=True).over(w)).where(F.col("_o") == (1 if back else 0))
    return carried.select(*left.columns, F.col("_c._t").alias(f"right_{time}"), *[F.col("_c")[v].alias(f"right_{v}") for v in values])


def nearest(left: DataFrame, right: DataFrame, keys: Keys, time: str, value: str, max_gap: float) -> DataFrame:
    """Value of the nearest right row within max_gap; the earlier one of two at the same distance."""
    both = asof(left, right, keys, time, [value]).withColumnsRenamed({f"right_{time}": "_t0", f"right_{value}": "_v0"})
    both = asof(both, right, keys, time, [value], "forward").withColumnsRenamed({f"right_{time}": "_t1", f"right_{value}": "_v1"})
    d0, d1 = F.col(time) - F.col("_t0"), F.col("_t1") - F.col(time)
    first = F.col("_t1").isNull() | (d0 <= d1)
    return both.withColumn(f"nearest_{value}", F.when(first & (d0 <= max_gap), F.col("_v0")).when(~F.coalesce(first, F.lit(False)) & (d1 <= max_gap), F.col("_v1"))).select(*left.columns, f"nearest_{value}")


def project(left: DataFrame, right: DataFrame, keys: Keys, time: str, value: str, max_gap: float, edge: float = 0.0) -> DataFrame:
    """Linear interpolation of the known right values at the left times; not across more than max_gap, held for `edge` beyond the ends."""
    ok = right.where(F.col(value).isNotNull() & ~F.isnan(value))
    both = asof(left, ok, keys, time, [value]).withColumnsRenamed({f"right_{time}": "_t0", f"right_{value}": "_v0"})
    both = asof(both, ok, keys, time, [value], "forward").withColumnsRenamed({f"right_{time}": "_t1", f"right_{value}": "_v1"})
    t, t0, t1 = F.col(time), F.col("_t0"), F.col("_t1")
    lerp = F.when(t1 == t0, F.col("_v0")).when(t1 - t0 <= max_gap, F.col("_v0") + (t - t0) / (t1 - t0) * (F.col("_v1") - F.col("_v0")))
    held = F.when(t1.isNull() & (t - t0 <= edge), F.col("_v0")).when(t0.isNull() & (t1 - t <= edge), F.col("_v1"))
    return both.withColumn(f"at_{value}", F.coalesce(lerp, held)).select(*left.columns, f"at_{value}")


def at_fraction(places: DataFrame, curve: DataFrame, keys: Keys, tau: str, value: str = "value", out: str = "sampled") -> DataFrame:
    """Curve value at a fractional frame: linear between two known neighbours, else the known one of them."""
    lo, part = F.floor(F.col(tau)).cast("long"), F.col(tau) - F.floor(F.col(tau))
    one = lambda shift, name: curve.select(*keys, (F.col("frame") - shift).cast("long").alias("_f"), F.col(value).alias(name))
    rows = places.withColumn("_f", lo).join(one(0, "_a"), [*keys, "_f"], "left").join(one(1, "_b"), [*keys, "_f"], "left")
    mixed = F.coalesce(F.col("_a") * (1 - part) + F.col("_b") * part, F.when(part < 0.5, F.coalesce("_a", "_b")).otherwise(F.coalesce("_b", "_a")))
    return rows.withColumn(out, F.when(part == 0, F.col("_a")).otherwise(mixed)).select(*places.columns, out)


def overlaps(a: DataFrame, b: DataFrame, keys: Keys, cell: float, tolerance: float = 0.0) -> DataFrame:
    """Pairs of intervals [start, end) of one key that overlap, or miss each other by less than the tolerance.

    Every interval is put into the cells that it touches; a pair meets in the first cell that both have, so it comes once.
    Columns of b get the prefix `b_`.
    """
    cells = lambda lo, hi: F.sequence(F.floor(lo / cell).cast("long"), F.floor(hi / cell).cast("long"))
    left = a.withColumn("_lo", F.floor((F.col("start") - tolerance) / cell).cast("long")).withColumn("_c", F.explode(cells(F.col("start") - tolerance, F.col("end") + tolerance)))
    right = b.select(*keys, *[F.col(x).alias(f"b_{x}") for x in b.columns if x not in keys]).withColumn("_blo", F.floor(F.col("b_start") / cell).cast("long")).withColumn("_c", F.explode(cells(F.col("b_start"), F.col("b_end"))))
    both = left.join(right, [*keys, "_c"]).where(F.col("_c") == F.greatest("_lo", "_blo"))
    return both.where(F.least("end", "b_end") - F.greatest("start", "b_start") > -tolerance).drop("_c", "_lo", "_blo")


def lookup_pattern(items: DataFrame, table: DataFrame, name: str, pattern: str = "pattern", order: str = "pos") -> DataFrame:
    """Exact match of the name, else the first matching pattern (`*`, `?`) in order. The table is metadata of bounded size; every name is resolved once.

    Names are resolved among the table's literal prefixes: a pattern meets only names that start with what stands before its first wildcard.
    """
    names = items.select(name).distinct()
    literal = F.regexp_extract(F.col(pattern), r"^[^*?]*", 0)
    like = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(pattern), r"([.\\+^$\[\]{}()|])", r"\\$1"), r"\*", ".*"), r"\?", "."), F.lit("$"))
    rows = table.withColumns({"_lit": literal, "_re": like, "_n": F.length(literal)})
    starts = names.withColumn("_lit", F.explode(F.transform(F.sequence(F.lit(0), F.length(name)), lambda i: F.substring(F.col(name), F.lit(1), i))))
    hits = starts.join(rows, "_lit").where(F.expr(f"`{name}` rlike `_re`")).withColumn("_rank", F.struct((F.col(pattern) != F.col(name)).alias("inexact"), F.col(order)))
    best = hits.groupBy(name).agg(F.min_by(F.struct(*[F.col(x) for x in table.columns]), "_rank").alias("_hit"))
    return items.join(best, name, "left").select(*items.columns, *[F.col("_hit")[x].alias(x) for x in table.columns])


def role_pairs(items: DataFrame, pair: str, role: str, order: str, roles: tuple[str, str] = ("off", "on")) -> DataFrame:
    """One row per pair that has both roles; of several items of one role the last in order wins."""
    ok = items.where(F.col(pair).isNotNull() & F.col(role).isin(*roles))
    row = F.struct(*[F.col(x) for x in items.columns])
    pick = [F.max_by(F.when(F.col(role) == r, row), F.when(F.col(role) == r, F.col(order))).alias(r) for r in roles]
    return ok.groupBy(pair).agg(*pick).where(F.col(roles[0]).isNotNull() & F.col(roles[1]).isNotNull())


def withhold(items: DataFrame, requires: DataFrame, premises: DataFrame, keys: Keys) -> tuple[DataFrame, DataFrame]:
    """(kept, withheld): an item is withheld with the first required premise that was checked and does not hold; unknown counts as not held.

    requires: attribute, premise, pos. premises: keys, premise, passed, reason.
    """
    row = [x for x in items.columns]
    failed = premises.where(~F.coalesce("passed", F.lit(False))).select(*keys, "premise", "reason")
    need = items.join(requires, "attribute").join(failed, [*keys, "premise"])
    first = need.groupBy(*row).agg(F.min_by(F.struct("premise", "reason"), "pos").alias("_p")).select(*row, F.col("_p.premise").alias("premise"), F.col("_p.reason").alias("reason"))
    bad = need.select(*row).distinct()
    on = None
    for x in row:
        c = items[x].eqNullSafe(bad[x])
        on = c if on is None else on & c
    return items.join(bad, on, "left_anti"), first


def octave_candidates(tracks: DataFrame, keys: Keys, within_cents: float = 50.0) -> DataFrame:
    """Each tracker's candidates at x1/2, x1 and x2, scored by the trackers that agree with them up to octaves.

    tracks: keys, tracker, cents, weight. Trackers of one frame are few, so they meet on the frame.
    """
    fold = lambda x: x + 600 - 1200 * F.floor((x + 600) / 1200) - 600
    cands = tracks.withColumn("candidate", F.explode(F.array(F.col("cents") - 1200, F.col("cents"), F.col("cents") + 1200))).select(*keys, "candidate").distinct()
    votes = cands.join(tracks, [*keys])
    d = F.col("cents") - F.col("candidate")
    vote = F.when(F.abs(d) <= within_cents, F.col("weight")).when(F.abs(fold(d)) <= within_cents, 0.8 * F.col("weight")).otherwise(0.0)
    return votes.groupBy(*keys, "candidate").agg(F.sum(vote).alias("score"))


def paired_frames(warp: DataFrame, on: DataFrame, off: DataFrame, keys: Keys, values: Sequence[str]) -> DataFrame:
    """Frame t of `on` with frame round(tau(t)) of `off`; pairs with an unknown value are dropped."""
    w = warp.withColumn("_f", F.bround("tau").cast("long"))
    a = on.select(*keys, "frame", *[F.col(v).alias(f"on_{v}") for v in values])
    b = off.select(*keys, F.col("frame").cast("long").alias("_f"), *[F.col(v).alias(f"off_{v}") for v in values])
    return w.join(a, [*keys, "frame"]).join(b, [*keys, "_f"]).drop("_f").dropna(subset=[f"{s}_{v}" for s in ("on", "off") for v in values])


def pitch_agreement(est: DataFrame, ref: DataFrame, keys: Keys, cents: float = 50.0) -> DataFrame:
    """Raw pitch, raw chroma and voicing rates of an estimate joined to a reference by frame; est and ref: keys, frame, cents (NULL unvoiced)."""
    e, r = est.select(*keys, "frame", F.col("cents").alias("e")), ref.select(*keys, "frame", F.col("cents").alias("r"))
    d = F.col("e") - F.col("r")
    fold = d + 600 - 1200 * F.floor((d + 600) / 1200) - 600
    voiced = F.col("r").isNotNull()
    share = lambda x: F.avg(F.when(voiced, F.coalesce(x.cast("double"), F.lit(0.0))))
    return r.join(e, [*keys, "frame"], "left").groupBy(*keys).agg(
        share(F.abs(d) <= cents).alias("raw_pitch"), share(F.abs(fold) <= cents).alias("raw_chroma"), share(F.col("e").isNotNull()).alias("voicing_recall"), F.avg(F.when(~voiced, F.col("e").isNotNull().cast("double"))).alias("false_alarm")
    )

