"""Registered queries and, for each, the SQL that gives the same rows. Doubles are rounded to six places on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as s
from ..operators import agreement, decisions, joins, kernels, series
from . import adapters as a

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

EVENTS = "ev AS (SELECT user_id AS recording, event_type AS curve, epoch_us(ts) AS t, value, CAST(event_id % 100 AS DOUBLE) / 100 AS confidence, event_id, props FROM events)"
TRACK = EVENTS + ", tr AS (SELECT recording, CAST(row_number() OVER (PARTITION BY recording ORDER BY t, event_id) - 1 AS BIGINT) AS frame, t, curve, value, confidence FROM ev)"
VOICED = 30.0


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def r6(x: Column | str, name: str | None = None) -> Column:
    """Rounded, without negative zero."""
    c = F.round(F.col(x) if isinstance(x, str) else x, 6) + 0.0
    return c.alias(name or x)


# ---------------------------------------------------------------- series


@query("recording_values", f"WITH {EVENTS} SELECT recording, curve, round(median(value) FILTER (WHERE confidence >= 0.5), 6) AS median_value, count(*) FILTER (WHERE confidence >= 0.5) AS n_used FROM ev GROUP BY 1, 2")
def recording_values(spark: SparkSession, d: str) -> DataFrame:
    return series.recording_values(a.events(spark, d), ["recording", "curve"]).select("recording", "curve", r6("median_value"), "n_used")


@query("masked_curve", f"WITH {TRACK} SELECT recording, frame, CASE WHEN confidence > 0.3 THEN round(value, 6) END AS value, round(confidence, 6) AS confidence FROM tr")
def masked_curve(spark: SparkSession, d: str) -> DataFrame:
    return series.masked(series.normalise(a.track(spark, d)), 0.3).select("recording", "frame", r6("value"), r6("confidence"))


RUNS = f"{TRACK}, vo AS (SELECT recording, frame, frame - row_number() OVER (PARTITION BY recording ORDER BY frame) AS g FROM tr WHERE value >= {VOICED}), ru AS (SELECT recording, min(frame) AS s, max(frame) + 1 AS e FROM vo GROUP BY recording, g)"
PHRASES = RUNS + ', fl AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY recording ORDER BY s) < 3 THEN 0 ELSE 1 END AS n FROM ru), se AS (SELECT *, sum(n) OVER (PARTITION BY recording ORDER BY s) AS k FROM fl), ph AS (SELECT recording, min(s) AS s, max(e) AS e FROM se GROUP BY recording, k)'


def _voiced() -> Column:
    return F.col("value") >= VOICED


@query("runs_islands", f'WITH {RUNS} SELECT recording, s AS start, e AS "end" FROM ru')
def runs_islands(spark: SparkSession, d: str) -> DataFrame:
    return series.runs(a.track(spark, d), ["recording"], _voiced())


@query("drop_short_runs", f'WITH {RUNS} SELECT recording, s AS start, e AS "end" FROM ru WHERE e - s >= 3')
def drop_short_runs(spark: SparkSession, d: str) -> DataFrame:
    return series.long_runs(runs_islands(spark, d), 3)


@query("phrases_sessionize", f'WITH {PHRASES} SELECT recording, s AS start, e AS "end" FROM ph')
def phrases(spark: SparkSession, d: str) -> DataFrame:
    return series.merge_runs(runs_islands(spark, d), ["recording"], 3)


@query(
    "relative_energy",
    f"WITH {PHRASES}, i AS (SELECT tr.*, ph.s FROM tr JOIN ph ON tr.recording = ph.recording AND tr.frame >= ph.s AND tr.frame < ph.e), m AS (SELECT recording, s, median(value) FILTER (WHERE value >= {VOICED}) AS m FROM i GROUP BY 1, 2) "
    "SELECT i.recording, i.frame, i.s AS start, round(i.value - m.m, 6) + 0.0 AS relative FROM i JOIN m ON i.recording = m.recording AND i.s = m.s",
)
def relative_energy(spark: SparkSession, d: str) -> DataFrame:
    return series.relative_level(a.track(spark, d), ["recording"], _voiced(), 3).select("recording", "frame", "start", r6("relative"))


@query("moving_average", f"WITH {TRACK} SELECT recording, frame, round(avg(value) OVER (PARTITION BY recording ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS smoothed FROM tr")
def moving_average(spark: SparkSession, d: str) -> DataFrame:
    return series.moving_average(a.track(spark, d), ["recording"], 4).select("recording", "frame", r6("smoothed"))


@query("running_median", f"WITH {TRACK} SELECT recording, frame, round(median(value) OVER (PARTITION BY recording ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smoothed FROM tr")
def running_median(spark: SparkSession, d: str) -> DataFrame:
    return series.running_median(a.track(spark, d), ["recording"], 5).select("recording", "frame", r6("smoothed"))


@query(
    "gradient",
    f"WITH {TRACK}, w AS (SELECT *, lag(value) OVER o AS b, lead(value) OVER o AS n FROM tr WINDOW o AS (PARTITION BY recording ORDER BY frame)) "
    "SELECT recording, frame, round(CASE WHEN b IS NULL AND n IS NULL THEN 0.0 WHEN b IS NULL THEN n - value WHEN n IS NULL THEN value - b ELSE (n - b) / 2 END, 6) + 0.0 AS slope FROM w",
)
def gradient(spark: SparkSession, d: str) -> DataFrame:
    return series.gradient(a.track(spark, d), ["recording"]).select("recording", "frame", r6("slope"))


ROBUST = f"{TRACK}, me AS (SELECT recording, median(value) AS m FROM tr GROUP BY 1), de AS (SELECT tr.*, m FROM tr JOIN me USING (recording)), sp AS (SELECT recording, 1.4826 * median(abs(value - m)) + 1e-9 AS sd FROM de GROUP BY 1), zz AS (SELECT de.*, (value - m) / sd AS z FROM de JOIN sp USING (recording))"


@query("mad_robust_z", f"WITH {ROBUST} SELECT recording, frame, round(z, 6) + 0.0 AS z FROM zz")
def robust_z(spark: SparkSession, d: str) -> DataFrame:
    return series.robust_z(a.track(spark, d), ["recording"]).select("recording", "frame", r6("z"))


@query("remainder_spans", f'WITH {ROBUST}, o AS (SELECT recording, frame, frame - row_number() OVER (PARTITION BY recording ORDER BY frame) AS g FROM zz WHERE z > 1) SELECT recording, min(frame) AS start, max(frame) + 1 AS "end" FROM o GROUP BY recording, g HAVING count(*) >= 2')
def remainder_spans(spark: SparkSession, d: str) -> DataFrame:
    return series.outlier_spans(a.track(spark, d), ["recording"], 1.0, 2)


@query("dynamic_range", f"WITH {EVENTS} SELECT recording, curve, round(quantile_cont(value, 0.9) - quantile_cont(value, 0.1), 6) AS dynamic_range FROM ev GROUP BY 1, 2")
def dynamic_range(spark: SparkSession, d: str) -> DataFrame:
    return series.dynamic_range(a.events(spark, d), ["recording", "curve"]).select("recording", "curve", r6("dynamic_range"))


@query("voice_range", f"WITH {EVENTS} SELECT recording, round(quantile_cont(value, 0.02), 6) AS low, round(quantile_cont(value, 0.1), 6) AS comfort_low, round(quantile_cont(value, 0.9), 6) AS comfort_high, round(quantile_cont(value, 0.98), 6) AS high FROM ev GROUP BY 1")
def voice_range(spark: SparkSession, d: str) -> DataFrame:
    return series.voice_range(a.events(spark, d), ["recording"]).select("recording", *[r6(x) for x in ("low", "comfort_low", "comfort_high", "high")])


@query(
    "note_centres",
    f'WITH {PHRASES} SELECT tr.recording, ph.s AS start, ph.e AS "end", round(median(value), 6) AS centre, round(median(value) FILTER (WHERE tr.frame >= ph.s + 0.2 * (ph.e - ph.s) AND tr.frame < ph.e - 0.2 * (ph.e - ph.s)), 6) AS core FROM tr JOIN ph ON tr.recording = ph.recording AND tr.frame >= ph.s AND tr.frame < ph.e GROUP BY 1, 2, 3',
)
def note_centres(spark: SparkSession, d: str) -> DataFrame:
    return series.span_medians(a.track(spark, d), phrases(spark, d), ["recording"]).select("recording", "start", "end", r6("centre"), r6("core"))


@query("voiced_seconds", f"WITH {EVENTS} SELECT recording, round(count(*) FILTER (WHERE value >= {VOICED}) * 0.5, 6) AS voiced_seconds FROM ev GROUP BY 1")
def voiced_seconds(spark: SparkSession, d: str) -> DataFrame:
    return series.voiced_seconds(a.events(spark, d), ["recording"], _voiced(), 0.5).select("recording", r6("voiced_seconds"))


@query(
    "pause_levels",
    f"WITH {TRACK}, n AS (SELECT *, max(CASE WHEN value >= {VOICED} THEN 1 ELSE 0 END) OVER (PARTITION BY recording ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM tr) "
    f"SELECT recording, round(quantile_cont(value, 0.2) FILTER (WHERE near = 0), 6) AS floor, round(median(value) FILTER (WHERE value >= {VOICED}), 6) AS voiced FROM n GROUP BY 1",
)
def pause_levels(spark: SparkSession, d: str) -> DataFrame:
    return series.pause_levels(a.track(spark, d), ["recording"], _voiced(), 1).select("recording", r6("floor"), r6("voiced"))


@query(
    "first_crossing",
    f"WITH {TRACK}, c AS (SELECT recording, frame, sum(confidence) OVER (PARTITION BY recording ORDER BY frame) AS v FROM tr), w AS (SELECT *, lag(v) OVER (PARTITION BY recording ORDER BY frame) AS b FROM c) "
    "SELECT recording, round(arg_min(CASE WHEN b IS NULL OR v = b THEN frame ELSE frame - (v - 5) / (v - b) END, frame), 6) AS crossing FROM w WHERE v >= 5 GROUP BY 1",
)
def first_crossing(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("recording").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    cum = a.track(spark, d).withColumn("value", F.sum("confidence").over(w))
    return series.first_crossing(cum, ["recording"], F.lit(5.0)).select("recording", r6("crossing"))


# ---------------------------------------------------------------- joins


@query("asof_join", f"WITH {EVENTS}, l AS (SELECT * FROM ev WHERE curve = 'purchase'), r AS (SELECT recording, t, max(value) AS value FROM ev WHERE curve = 'view' GROUP BY 1, 2) SELECT l.recording, l.event_id, r.t AS right_t, round(r.value, 6) AS right_value FROM l ASOF LEFT JOIN r ON l.recording = r.recording AND l.t >= r.t")
def asof_join(spark: SparkSession, d: str) -> DataFrame:
    e = a.events(spark, d)
    right = e.where("curve = 'view'").groupBy("recording", "t").agg(F.max("value").alias("value"))
    return joins.asof(e.where("curve = 'purchase'").select("recording", "event_id", "t"), right, ["recording"], "t", ["value"]).select("recording", "event_id", "right_t", r6("right_value"))


_SIDES = f"{EVENTS}, l AS (SELECT recording, event_id, t FROM ev WHERE curve = 'purchase'), r AS (SELECT recording, t, value FROM ev WHERE curve = 'view'), b AS (SELECT l.*, r.t AS t0, r.value AS v0 FROM l ASOF LEFT JOIN r ON l.recording = r.recording AND l.t >= r.t), f AS (SELECT b.*, r.t AS t1, r.value AS v1 FROM b ASOF LEFT JOIN r ON b.recording = r.recording AND b.t <= r.t)"
GAP = 86_400_000_000 * 2


@query("asof_nearest", f"WITH {_SIDES} SELECT recording, event_id, round(CASE WHEN t0 IS NOT NULL AND (t1 IS NULL OR t - t0 <= t1 - t) THEN CASE WHEN t - t0 <= {GAP} THEN v0 END WHEN t1 - t <= {GAP} THEN v1 END, 6) AS nearest_value FROM f")
def asof_nearest(spark: SparkSession, d: str) -> DataFrame:
    e = a.events(spark, d)
    out = joins.nearest(e.where("curve = 'purchase'").select("recording", "event_id", "t"), e.where("curve = 'view'"), ["recording"], "t", "value", GAP)
    return out.select("recording", "event_id", r6("nearest_value"))


@query("project_linear", f"WITH {_SIDES} SELECT recording, event_id, round(CASE WHEN t1 = t0 THEN v0 WHEN t1 - t0 <= {GAP} THEN v0 + CAST(t - t0 AS DOUBLE) / (t1 - t0) * (v1 - v0) END, 6) AS at_value FROM f")
def project_linear(spark: SparkSession, d: str) -> DataFrame:
    e = a.events(spark, d)
    out = joins.project(e.where("curve = 'purchase'").select("recording", "event_id", "t"), e.where("curve = 'view'"), ["recording"], "t", "value", GAP)
    return out.select("recording", "event_id", r6("at_value"))


SEGMENTS = f"{EVENTS}, sg AS (SELECT recording AS clip, event_id AS seg, (t - 1704067200000000) / 3.6e9 AS s, (t - 1704067200000000) / 3.6e9 + 6.0 AS e, 'l' || (event_id % 3) AS label, confidence AS score FROM ev WHERE curve = 'error'), pr AS (SELECT recording AS clip, event_id AS seg, (t - 1704067200000000) / 3.6e9 AS s, (t - 1704067200000000) / 3.6e9 + 4.0 AS e, 'l' || (event_id % 3) AS label, confidence AS score FROM ev WHERE curve = 'purchase')"


@query("interval_overlap", f"WITH {SEGMENTS} SELECT sg.clip, sg.seg, pr.seg AS b_seg FROM sg JOIN pr ON sg.clip = pr.clip AND least(sg.e, pr.e) - greatest(sg.s, pr.s) > 0")
def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    left, right = a.segments(spark, d)
    return joins.overlaps(left, right, ["clip"], 8.0).select("clip", "seg", "b_seg")


@query("benchmark_recall", f"WITH {SEGMENTS}, h AS (SELECT DISTINCT sg.clip, sg.seg FROM sg JOIN pr ON sg.clip = pr.clip AND sg.label = pr.label AND least(sg.e, pr.e) - greatest(sg.s, pr.s) > -0.5) SELECT label, count(*) AS segments, count(h.seg) AS hits, round(CAST(count(h.seg) AS DOUBLE) / count(*), 6) AS recall FROM sg LEFT JOIN h ON sg.clip = h.clip AND sg.seg = h.seg GROUP BY 1")
def benchmark_recall(spark: SparkSession, d: str) -> DataFrame:
    return decisions.benchmark_recall(*a.segments(spark, d), 0.5, 8.0).select("label", "segments", "hits", r6("recall"))


@query(
    "benchmark_top_k",
    f"WITH {SEGMENTS}, b AS (SELECT clip, label, max(score) AS score FROM pr GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY score DESC, label) AS n FROM b), t AS (SELECT DISTINCT clip, label FROM sg) "
    "SELECT c.clip, EXISTS (SELECT 1 FROM k JOIN t ON k.clip = t.clip AND k.label = t.label WHERE k.n <= 2 AND k.clip = c.clip) AS hit FROM (SELECT DISTINCT clip FROM sg) c WHERE c.clip IN (SELECT clip FROM pr)",
)
def benchmark_top_k(spark: SparkSession, d: str) -> DataFrame:
    truth, pred = a.segments(spark, d)
    return decisions.top_k_hit(pred, truth.select("clip", "label"), 2)


@query(
    "role_pairs",
    "WITH i AS (SELECT l_orderkey, l_linenumber, CASE l_linestatus WHEN 'O' THEN 'off' ELSE 'on' END AS role, l_partkey FROM lineitem), p AS (SELECT l_partkey AS pair, arg_max(struct_pack(k := l_orderkey, n := l_linenumber), l_orderkey * 10 + l_linenumber) FILTER (WHERE role = 'off') AS f, arg_max(struct_pack(k := l_orderkey, n := l_linenumber), l_orderkey * 10 + l_linenumber) FILTER (WHERE role = 'on') AS o FROM i GROUP BY 1) "
    "SELECT pair, f.k AS off_order, f.n AS off_line, o.k AS on_order, o.n AS on_line FROM p WHERE f IS NOT NULL AND o IS NOT NULL",
)
def role_pairs(spark: SparkSession, d: str) -> DataFrame:
    li = a.table(spark, d, "lineitem").select(F.col("l_partkey").alias("pair"), F.when(F.col("l_linestatus") == "O", "off").otherwise("on").alias("role"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), "l_orderkey", "l_linenumber")
    out = joins.role_pairs(li, "pair", "role", "pos")
    return out.select("pair", F.col("off.l_orderkey").alias("off_order"), F.col("off.l_linenumber").alias("off_line"), F.col("on.l_orderkey").alias("on_order"), F.col("on.l_linenumber").alias("on_line"))


ITEMS = EVENTS + (
    ", it AS (SELECT recording, event_id AS item, ['loudness','tempo','breathiness','interval_compression','vibrato'][CAST(event_id % 5 AS INT) + 1] AS attribute, ['dynamics','rhythm','phonation','pitch','ornament','diction'][CAST(event_id % 6 AS INT) + 1] AS category, "
    "['none','missing','same','extra','none','none','none'][CAST(event_id % 7 AS INT) + 1] AS status, value - 35 AS magnitude, confidence, CASE WHEN event_id % 11 > 0 THEN CAST(event_id % 97 AS DOUBLE) / 97 END AS audibility, t FROM ev)"
)
THRESHOLDS = "th(attribute, mdc, min_confidence, usable) AS (VALUES ('loudness', 10.0, 0.2, true), ('tempo', 25.0, 0.3, true), ('breathiness', 5.0, 0.1, false), ('vibrato', 40.0, 0.5, true))"
RANK_ROWS = [("loudness", 10.0, 0.2, True), ("tempo", 25.0, 0.3, True), ("breathiness", 5.0, 0.1, False), ("vibrato", 40.0, 0.5, True)]


@query(
    "threshold_reasons",
    f"WITH {ITEMS}, {THRESHOLDS} SELECT it.recording, it.item, CASE WHEN th.attribute IS NULL THEN 'no_threshold' WHEN NOT usable THEN 'attribute_not_reliable' WHEN confidence < min_confidence THEN 'below_confidence' WHEN status IN ('missing', 'extra') THEN 'ok' WHEN status = 'same' THEN 'no_difference' WHEN abs(magnitude) < mdc THEN 'below_magnitude' WHEN audibility < 0.2 THEN 'below_audibility' ELSE 'ok' END AS reason FROM it LEFT JOIN th ON it.attribute = th.attribute",
)
def threshold_reasons(spark: SparkSession, d: str) -> DataFrame:
    th = spark.createDataFrame(RANK_ROWS, "attribute string, mdc double, min_confidence double, usable boolean")
    return decisions.apply_thresholds(a.items(spark, d), th, 0.2).select("recording", "item", "reason")


_PREMISES = "pm AS (SELECT recording, curve AS premise, count(*) AS n FROM ev GROUP BY 1, 2), rq(attribute, curve, pos) AS (VALUES ('loudness', 'view', 0), ('loudness', 'error', 1), ('tempo', 'click', 0), ('vibrato', 'signup', 0)), fa AS (SELECT it.item, arg_min(rq.curve, rq.pos) AS premise FROM it JOIN rq ON it.attribute = rq.attribute JOIN pm ON pm.recording = it.recording AND pm.premise = rq.curve WHERE pm.n % 2 = 0 GROUP BY 1)"
_REQ = [("loudness", "view", 0), ("loudness", "error", 1), ("tempo", "click", 0), ("vibrato", "signup", 0)]


def _premises(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    need = spark.createDataFrame(_REQ, "attribute string, premise string, pos int")
    per = a.events(spark, d).groupBy("recording", F.col("curve").alias("premise")).agg((F.count("*") % 2 == 1).alias("passed"), F.concat(F.lit("n="), F.count("*")).alias("reason"))
    return joins.withhold(a.items(spark, d).select("recording", "item", "attribute"), need, per, ["recording"])


@query("premises_withheld", f"WITH {ITEMS}, {_PREMISES} SELECT it.recording, it.item, fa.premise FROM it JOIN fa ON it.item = fa.item")
def premises_withheld(spark: SparkSession, d: str) -> DataFrame:
    return _premises(spark, d)[1].select("recording", "item", "premise")


@query("premises_kept", f"WITH {ITEMS}, {_PREMISES} SELECT recording, item FROM it WHERE item NOT IN (SELECT item FROM fa)")
def premises_kept(spark: SparkSession, d: str) -> DataFrame:
    return _premises(spark, d)[0].select("recording", "item")


@query(
    "habit_vs_error",
    f"WITH {ITEMS} SELECT recording, attribute, CASE WHEN count(magnitude) < 2 THEN 'undetermined' WHEN (min(magnitude) > 0 OR max(magnitude) < 0) AND abs(avg(magnitude)) > stddev_pop(magnitude) THEN 'style_or_habit' ELSE 'error' END AS consistency, count(magnitude) AS takes, round(arg_max(magnitude, t), 6) AS last FROM it GROUP BY 1, 2",
)
def habit_vs_error(spark: SparkSession, d: str) -> DataFrame:
    return decisions.habits(a.items(spark, d), ["recording", "attribute"], "t").select("recording", "attribute", "consistency", "takes", r6("last"))


@query(
    "event_status",
    f"WITH {EVENTS}, u AS (SELECT recording, avg(value) AS v FROM ev WHERE curve = 'click' AND confidence > 0.8 GROUP BY 1), g AS (SELECT recording, avg(value) AS v FROM ev WHERE curve = 'view' AND confidence > 0.8 GROUP BY 1) "
    "SELECT coalesce(u.recording, g.recording) AS recording, CASE WHEN u.v IS NULL THEN 'missing' WHEN g.v IS NULL THEN 'extra' WHEN abs(u.v - g.v) > 20 THEN 'different' ELSE 'same' END AS status FROM u FULL JOIN g ON u.recording = g.recording",
)
def event_status(spark: SparkSession, d: str) -> DataFrame:
    e = a.events(spark, d).where("confidence > 0.8")
    side = lambda k: e.where(F.col("curve") == k).groupBy("recording").agg(F.avg("value").alias("v"))
    return decisions.missing_extra(side("click"), side("view"), ["recording"], "v", 20.0).select("recording", "status")


@query(
    "contour_items",
    f"WITH {TRACK}, b AS (SELECT recording, frame, value - 35 AS v, CASE WHEN value - 35 > 0 THEN 1.0 ELSE -1.0 END AS sg FROM tr WHERE abs(value - 35) >= 20), i AS (SELECT *, frame - row_number() OVER (PARTITION BY recording, sg ORDER BY frame) AS g FROM b), r AS (SELECT recording, sg, min(frame) AS s, max(frame) + 1 AS e FROM i GROUP BY recording, sg, g), "
    "f AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY recording, sg ORDER BY s) < 3 THEN 0 ELSE 1 END AS n FROM r), k AS (SELECT *, sum(n) OVER (PARTITION BY recording, sg ORDER BY s) AS k FROM f), p AS (SELECT recording, sg, min(s) AS s, max(e) AS e FROM k GROUP BY recording, sg, k HAVING max(e) - min(s) >= 3) "
    'SELECT p.recording, p.sg AS sign, p.s AS start, p.e AS "end", round(avg(b.v), 6) AS mean, round(sum(abs(b.v)), 6) AS area FROM p JOIN b ON b.recording = p.recording AND b.sg = p.sg AND b.frame >= p.s AND b.frame < p.e GROUP BY 1, 2, 3, 4',
)
def contour_items(spark: SparkSession, d: str) -> DataFrame:
    df = a.track(spark, d).withColumn("value", F.col("value") - 35)
    return decisions.contour_items(df.select("recording", "frame", "value"), ["recording"], 20.0, 3, 2).select("recording", "sign", "start", "end", r6("mean"), r6("area"))


# ---------------------------------------------------------------- agreement

_CELLS = "ce AS (SELECT l_linestatus AS dim, l_suppkey AS subject, l_returnflag AS cond, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3), fu AS (SELECT dim, subject FROM ce GROUP BY 1, 2 HAVING count(*) = (SELECT count(DISTINCT c2.cond) FROM ce c2 WHERE c2.dim = ce.dim)), cc AS (SELECT ce.* FROM ce JOIN fu USING (dim, subject))"
_ANOVA = _CELLS + (
    ", t AS (SELECT dim, avg(v) AS m, count(DISTINCT subject) AS n, count(DISTINCT cond) AS k, var_pop(v) * count(*) AS sst, var_pop(v) AS vp FROM cc GROUP BY 1), sm AS (SELECT dim, subject, avg(v) AS x, count(*) AS c FROM cc GROUP BY 1, 2), cm AS (SELECT dim, cond, avg(v) AS x, count(*) AS c FROM cc GROUP BY 1, 2), "
    "sr AS (SELECT sm.dim, sum(c * (x - m) * (x - m)) AS ssr FROM sm JOIN t USING (dim) GROUP BY 1), sc AS (SELECT cm.dim, sum(c * (x - m) * (x - m)) AS ssc FROM cm JOIN t USING (dim) GROUP BY 1), "
    "ms AS (SELECT dim, n, k, vp, ssr / (n - 1) AS r, ssc / (k - 1) AS c, (sst - ssr - ssc) / ((n - 1) * (k - 1)) AS e, (sst - ssr) / (n * (k - 1)) AS w FROM t JOIN sr USING (dim) JOIN sc USING (dim) WHERE n > 1 AND k > 1)"
)


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return agreement.complete_cases(a.records(spark, d), ["dimension"])


@query(
    "icc",
    f"WITH {_ANOVA}, i AS (SELECT *, (r - e) / (r + (k - 1) * e + k * (c - e) / n) AS two FROM ms) SELECT dim AS dimension, n, k, round((r - w) / (r + (k - 1) * w), 6) AS icc11, round(two, 6) AS icc21, round((r - e) / (r + (k - 1) * e), 6) AS icc31, round(sqrt(vp) * sqrt(greatest(0.0, 1 - two)), 6) AS sem, round(1.96 * sqrt(2.0) * sqrt(vp) * sqrt(greatest(0.0, 1 - two)), 6) AS mdc95 FROM i",
)
def icc(spark: SparkSession, d: str) -> DataFrame:
    return agreement.icc(_cells(spark, d), ["dimension"]).select("dimension", "n", "k", *[r6(x) for x in ("icc11", "icc21", "icc31", "sem", "mdc95")])


@query("bland_altman", "SELECT l_returnflag, round(avg(l_extendedprice / 1000 - l_quantity), 6) AS bias, round(stddev_samp(l_extendedprice / 1000 - l_quantity), 6) AS sd, count(*) AS n, round(avg(l_extendedprice / 1000 - l_quantity) - 1.96 * stddev_samp(l_extendedprice / 1000 - l_quantity), 6) AS loa_low, round(avg(l_extendedprice / 1000 - l_quantity) + 1.96 * stddev_samp(l_extendedprice / 1000 - l_quantity), 6) AS loa_high FROM lineitem GROUP BY 1")
def bland_altman(spark: SparkSession, d: str) -> DataFrame:
    li = a.table(spark, d, "lineitem").withColumn("b", F.col("l_extendedprice") / 1000)
    return agreement.bland_altman(li, "l_quantity", "b", ["l_returnflag"]).select("l_returnflag", r6("bias"), r6("sd"), "n", r6("loa_low"), r6("loa_high"))


@query("within_between_ratio", f"WITH {EVENTS}, p AS (SELECT curve, recording, var_samp(value) AS v, avg(value) AS m FROM ev GROUP BY 1, 2 HAVING count(*) > 1) SELECT curve, round(avg(v) / var_samp(m), 6) AS ratio, count(*) AS subjects FROM p GROUP BY 1")
def within_between(spark: SparkSession, d: str) -> DataFrame:
    return agreement.within_between(a.events(spark, d), "recording", "value", ["curve"]).select("curve", r6("ratio"), "subjects")


@query(
    "cohen_kappa",
    "WITH t AS (SELECT count(*) AS n, avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END) AS po FROM labels), x AS (SELECT quality AS c, count(*) AS x FROM labels GROUP BY 1), y AS (SELECT toxic AS c, count(*) AS y FROM labels GROUP BY 1), pe AS (SELECT sum(CAST(x.x AS DOUBLE) * coalesce(y.y, 0) / (CAST(n AS DOUBLE) * n)) AS pe FROM x LEFT JOIN y USING (c), t) SELECT round((po - pe) / (1 - pe), 6) AS kappa, n FROM t, pe",
)
def cohen_kappa(spark: SparkSession, d: str) -> DataFrame:
    return agreement.cohen_kappa(a.raters(spark, d), "a", "b").select(r6("kappa"), "n")


@query(
    "fleiss_kappa",
    "WITH c AS (SELECT doc_id, v, count(*) AS n FROM (SELECT doc_id, quality AS v FROM labels UNION ALL SELECT doc_id, toxic FROM labels UNION ALL SELECT doc_id, doc_id % 2 FROM labels) GROUP BY 1, 2), p AS (SELECT doc_id, sum(n) AS s, sum(n * n) AS q FROM c GROUP BY 1), a AS (SELECT avg((q - s) / (CAST(s AS DOUBLE) * (s - 1))) AS p, count(*) AS items FROM p), e AS (SELECT sum((x / t) * (x / t)) AS pe FROM (SELECT v, CAST(sum(n) AS DOUBLE) AS x FROM c GROUP BY 1), (SELECT CAST(sum(n) AS DOUBLE) AS t FROM c)) SELECT round((p - pe) / (1 - pe), 6) AS kappa, items FROM a, e",
)
def fleiss_kappa(spark: SparkSession, d: str) -> DataFrame:
    lab = a.table(spark, d, "labels")
    long = lab.select("doc_id", F.explode(F.array(F.col("quality").cast("long"), F.col("toxic").cast("long"), F.pmod("doc_id", F.lit(2)).cast("long"))).alias("v"))
    return agreement.fleiss_kappa(long.groupBy("doc_id", "v").agg(F.count("*").alias("n")), "doc_id", "v", "n").select(r6("kappa"), "items")


@query("auroc", f"WITH {EVENTS}, r AS (SELECT curve, value, confidence >= 0.7 AS p, rank() OVER (PARTITION BY curve ORDER BY value) + (count(*) OVER (PARTITION BY curve, value) - 1) / 2.0 AS r FROM ev) SELECT curve, round((sum(r) FILTER (WHERE p) - count(*) FILTER (WHERE p) * (count(*) FILTER (WHERE p) + 1) / 2.0) / (CAST(count(*) FILTER (WHERE p) AS DOUBLE) * count(*) FILTER (WHERE NOT p)), 6) AS auroc, count(*) FILTER (WHERE p) AS positives, count(*) FILTER (WHERE NOT p) AS negatives FROM r GROUP BY 1")
def auroc(spark: SparkSession, d: str) -> DataFrame:
    return agreement.auroc(a.events(spark, d), "value", F.col("confidence") >= 0.7, ["curve"]).select("curve", r6("auroc"), "positives", "negatives")


@query(
    "equal_error_rate",
    f"WITH {EVENTS}, l AS (SELECT curve, event_id, value, CASE WHEN confidence >= 0.5 THEN 1 ELSE 0 END AS t FROM ev), c AS (SELECT curve, event_id, 1 - CAST(sum(t) OVER w AS DOUBLE) / greatest(sum(t) OVER (PARTITION BY curve), 1) AS fnr, CAST(sum(1 - t) OVER w AS DOUBLE) / greatest(sum(1 - t) OVER (PARTITION BY curve), 1) AS fpr, row_number() OVER w AS i FROM l WINDOW w AS (PARTITION BY curve ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING)), o AS (SELECT *, row_number() OVER (PARTITION BY curve ORDER BY round(abs(fnr - fpr), 12), i) AS k FROM c) SELECT curve, round((fnr + fpr) / 2, 6) AS eer FROM o WHERE k = 1",
)
def equal_error_rate(spark: SparkSession, d: str) -> DataFrame:
    return agreement.equal_error_rate(a.events(spark, d), "value", F.col("confidence") >= 0.5, "event_id", ["curve"]).select("curve", r6("eer"))


@query("holm", f"WITH {EVENTS}, p AS (SELECT curve, event_id, confidence * confidence * 0.01 AS p FROM ev WHERE confidence > 0), r AS (SELECT *, CASE WHEN p <= 0.05 / (count(*) OVER (PARTITION BY curve) - row_number() OVER (PARTITION BY curve ORDER BY p, event_id) + 1) THEN 1 ELSE 0 END AS ok FROM p) SELECT curve, event_id, min(ok) OVER (PARTITION BY curve ORDER BY p, event_id) = 1 AS rejected FROM r")
def holm(spark: SparkSession, d: str) -> DataFrame:
    p = a.events(spark, d).where("confidence > 0").select("curve", "event_id", (F.col("confidence") * F.col("confidence") * 0.01).alias("p"))
    return agreement.holm(p, "event_id", "p", keys=["curve"]).select("curve", "event_id", "rejected")


@query("calibration_error", f"WITH {EVENTS}, b AS (SELECT curve, ceil(round(confidence * 15, 9)) AS k, count(*) AS n, avg(CASE WHEN value >= {VOICED} THEN 1.0 ELSE 0.0 END) AS a, avg(confidence) AS c FROM ev WHERE confidence > 0 GROUP BY 1, 2), t AS (SELECT curve, count(*) AS t FROM ev GROUP BY 1) SELECT curve, round(sum(CAST(n AS DOUBLE) / t * abs(a - c)), 6) AS ece FROM b JOIN t USING (curve) GROUP BY 1")
def calibration_error(spark: SparkSession, d: str) -> DataFrame:
    return agreement.calibration_error(a.events(spark, d), "confidence", _voiced(), keys=["curve"]).select("curve", r6("ece"))


@query("theil_sen", f"WITH {TRACK}, p AS (SELECT x.recording, (y.value - x.value) / (y.frame - x.frame) AS sl FROM tr x JOIN tr y ON x.recording = y.recording AND x.frame < y.frame) SELECT recording, round(median(sl), 6) + 0.0 AS slope, count(*) AS n_slopes FROM p GROUP BY 1")
def theil_sen(spark: SparkSession, d: str) -> DataFrame:
    return agreement.theil_sen(a.track(spark, d), "frame", "value", ["recording"]).select("recording", r6("slope"), "n_slopes")


@query(
    "residual_report",
    f"WITH {EVENTS}, b AS (SELECT ln(value) AS x FROM ev WHERE curve = 'view'), m AS (SELECT median(x) AS m FROM b), s AS (SELECT greatest(1.4826 * median(abs(x - m)), 1e-6) AS s FROM b, m), p AS (SELECT curve, median(ln(value)) AS x, count(*) AS n FROM ev GROUP BY 1) SELECT curve, n, round(exp(x), 6) AS median, round(exp(x - m), 6) AS ratio, round((x - m) / (s / sqrt(n)), 6) + 0.0 AS z, (x - m) / (s / sqrt(n)) > 1 AS flagged FROM p, m, s",
)
def residual_report(spark: SparkSession, d: str) -> DataFrame:
    e = a.events(spark, d)
    return agreement.residual_report(e, e.where("curve = 'view'"), "value", "curve", 1.0).select("curve", "n", r6("median"), r6("ratio"), r6("z"), "flagged")


@query("direction", "WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings), m AS (SELECT dim, avg(CAST(x AS DOUBLE)) AS mean FROM e GROUP BY 1), n AS (SELECT sqrt(sum(mean * mean)) AS n FROM m) SELECT CAST(dim AS INT) AS dim, round(mean, 6) + 0.0 AS mean, round(mean / n, 6) + 0.0 AS unit FROM m, n")
def direction(spark: SparkSession, d: str) -> DataFrame:
    e = a.table(spark, d, "embeddings").withColumn("zero", F.transform("embedding", lambda x: x * 0))
    return decisions.direction(e, "zero", "embedding", 64).select("dim", r6("mean"), r6("unit"))


@query("feature_stats", "WITH e AS (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings), f AS (SELECT dim, avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) AS frequency, avg(CAST(x AS DOUBLE)) FILTER (WHERE x > 0) AS mean_active, sum(CAST(x AS DOUBLE) * x) AS e FROM e GROUP BY 1) SELECT CAST(dim AS INT) AS dim, round(frequency, 6) AS frequency, round(mean_active, 6) AS mean_active, round(e / (SELECT sum(e) FROM f), 6) AS energy_share FROM f")
def feature_stats(spark: SparkSession, d: str) -> DataFrame:
    long = a.table(spark, d, "embeddings").select(F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return decisions.feature_stats(long, "dim", "x").select("dim", r6("frequency"), r6("mean_active"), r6("energy_share"))


# ---------------------------------------------------------------- scalars and splits


@query("pitch_scalars", f"WITH {EVENTS} SELECT event_id, round(1200 * log2(value / 440), 6) AS cents, round(10 * log10(greatest(value, 1e-20)), 6) AS db, round(1200 * log2(value / 440) + 600 - 1200 * floor((1200 * log2(value / 440) + 600) / 1200) - 600, 6) + 0.0 AS folded FROM ev")
def pitch_scalars(spark: SparkSession, d: str) -> DataFrame:
    cents = s.hz_to_cents("value")
    return a.events(spark, d).select("event_id", r6(cents, "cents"), r6(s.power_db("value"), "db"), r6(s.fold_octave(cents), "folded"))


@query(
    "singer_split",
    "WITH c AS (SELECT c_custkey, c_name, CAST(CAST('0x' || substr(sha256('0:' || c_name), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0 AS b FROM customer) SELECT c_custkey, CASE WHEN c_name IS NULL OR c_name = '' THEN 'unassigned' WHEN b <= 0.8 THEN 'train' WHEN b <= 0.9 THEN 'calib' ELSE 'test' END AS split FROM c",
)
def singer_split(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.splits import hash_split

    return hash_split(a.table(spark, d, "customer"), "c_name").select("c_custkey", "split")


@query("json_path", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.a.b') AS missing FROM events")
def json_path(spark: SparkSession, d: str) -> DataFrame:
    return a.table(spark, d, "events").select("event_id", s.json_path("props", "k").alias("k"), s.json_path("props", "a.b").alias("missing"))


@query("json_key_counts", "SELECT 'k' AS path, count(*) AS n FROM events WHERE props IS NOT NULL")
def json_key_counts(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.documents import key_counts

    return key_counts(a.table(spark, d, "events"), "props")


@query("agreement_bands", f"WITH {EVENTS} SELECT CASE WHEN confidence < 0.5 THEN 'poor' WHEN confidence < 0.75 THEN 'moderate' WHEN confidence < 0.9 THEN 'good' ELSE 'excellent' END AS band, count(*) AS n FROM ev GROUP BY 1")
def agreement_bands(spark: SparkSession, d: str) -> DataFrame:
    return a.events(spark, d).groupBy(s.agreement_band("confidence").alias("band")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- state over events


@query(
    "consent_state",
    f"WITH {EVENTS}, l AS (SELECT recording, curve AS purpose, arg_max(confidence >= 0.3, event_id) AS granted, max(event_id) AS last FROM ev GROUP BY 1, 2) SELECT recording, purpose, granted, last FROM l",
)
def consent_state(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.consent import latest_state

    log = a.events(spark, d).select("recording", F.col("curve").alias("purpose"), (F.col("confidence") >= 0.3).alias("granted"), F.col("event_id").alias("seq"))
    return latest_state(log, ["recording"]).select("recording", "purpose", "granted", F.col("seq").alias("last"))


@query("retention_sweep", f"WITH {EVENTS} SELECT recording, count(*) AS expired FROM ev WHERE (SELECT max(t) FROM ev) - t > 86400000000 * 14 GROUP BY 1")
def retention_sweep(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.consent import expired

    e = a.events(spark, d)
    now = e.agg(F.max("t")).first()[0]
    return expired(e, "t", now, 86_400_000_000 * 14).groupBy("recording").agg(F.count("*").alias("expired"))


# ---------------------------------------------------------------- kernels (no SQL; tested against brute force)


@query("rank_items")
def rank_items(spark: SparkSession, d: str) -> DataFrame:
    th = spark.createDataFrame(RANK_ROWS, "attribute string, mdc double, min_confidence double, usable boolean")
    shown = decisions.apply_thresholds(a.items(spark, d), th).where("reason = 'ok'")
    scored = decisions.item_scores(shown, ["recording"])
    return decisions.rank_items(scored.select("recording", "item", "category", "score", "basis"), ["recording"], "item").select("recording", "item", "basis", r6("score"), "tier", "position")


@query("pava_thresholds")
def pava_thresholds(spark: SparkSession, d: str) -> DataFrame:
    e = a.events(spark, d).select("curve", (F.col("value") - 35).alias("retest"), F.col("confidence").alias("level"), (F.col("value") * (1 - F.col("confidence"))).alias("error"))
    return kernels.fit_thresholds(e, ["curve"])


@query("segment_notes")
def segment_notes(spark: SparkSession, d: str) -> DataFrame:
    voiced = a.track(spark, d).select("recording", "frame", F.when(F.col("value") >= 5, s.hz_to_cents("value")).alias("value"))
    return kernels.notes(voiced, ["recording"], jump=600.0, least=2)


@query("dtw_alignment")
def dtw_alignment(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("recording", "curve").orderBy("t", "event_id")
    e = a.events(spark, d).withColumn("frame", (F.row_number().over(w) - 1).cast("long")).withColumn("vec", F.array("value", F.col("confidence") * 100, F.lit(10.0)))
    return kernels.align_series(e.where("curve = 'view'"), e.where("curve = 'click'"), ["recording"])


@query("onset_f_measure")
def onset_f_measure(spark: SparkSession, d: str) -> DataFrame:
    e = a.events(spark, d)
    return kernels.onset_f(e.where("curve = 'view'"), e.where("curve = 'click'"), ["recording"], "t", 6 * 3.6e9)


@query("equivalence_test")
def equivalence_test(spark: SparkSession, d: str) -> DataFrame:
    e = a.events(spark, d).withColumn("b", F.col("value") * 1.01)
    return agreement.equivalence(e, "value", "b", 1.0, ["curve"]).select("curve", r6("bias"), r6("sd"), "n", r6("p"))


@query("above_chance")
def above_chance(spark: SparkSession, d: str) -> DataFrame:
    return agreement.above_chance(a.events(spark, d), _voiced(), 2, ["curve"])


@query("icc_bootstrap")
def icc_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return agreement.bootstrap_icc(_cells(spark, d), ["dimension"], n_boot=500)


@query("session_stages")
def session_stages(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.sessions import fading_batch

    return fading_batch(a.events(spark, d).select(F.col("recording").alias("session"), F.col("event_id").alias("attempt"), F.col("value").alias("load")))
