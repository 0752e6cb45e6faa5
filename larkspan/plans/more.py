"""More registered queries with their SQL: syllables, grids, tokens and stores, sampling, pitch votes, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hangul
from ..functions import scalar as s
from ..operators import decisions, joins, practice, series
from ..streaming import consent, prepare, sessions
from . import adapters as a
from .catalog import EVENTS, ORACLE, QUERIES, TRACK, query, r6

__all__ = ["ORACLE", "QUERIES"]


def _syllable(k: Column) -> Column:
    """The k-th syllable of Unicode."""
    return F.decode(F.unhex(F.hex((k + hangul.FIRST).cast("long"))), "UTF-16BE")


@query("hangul_parts", "WITH k AS (SELECT p_partkey, p_partkey % 11172 AS k FROM part) SELECT p_partkey, k // 588 AS initial, k % 588 // 28 AS medial, k % 28 AS final, chr(CAST(44032 + k AS INT)) || CASE WHEN k % 28 > 0 THEN '은' ELSE '는' END AS topic FROM k")
def hangul_parts(spark: SparkSession, d: str) -> DataFrame:
    ch = a.table(spark, d, "part").select("p_partkey", _syllable(F.col("p_partkey") % 11172).alias("ch"))
    p = hangul.decompose("ch")
    return ch.select("p_partkey", *[p[x].alias(x) for x in ("initial", "medial", "final")], hangul.with_particle("ch", "은", "는").alias("topic"))


@query(
    "lyric_syllables",
    "WITH k AS (SELECT p_partkey, CAST(44032 + p_partkey % 11000 AS INT) AS k FROM part) SELECT p_partkey, 0 AS pos, chr(k) AS syllable, true AS word_initial FROM k UNION ALL SELECT p_partkey, 1, chr(k + 1), false FROM k UNION ALL SELECT p_partkey, 2, chr(k + 2), true FROM k UNION ALL SELECT p_partkey, 3, chr(k + 3), false FROM k",
)
def lyric_syllables(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 11000
    text = F.concat(_syllable(k), _syllable(k + 1), F.lit(" x"), _syllable(k + 2), F.lit("z,"), _syllable(k + 3))
    return hangul.syllables(a.table(spark, d, "part").select("p_partkey", text.alias("lyrics")), ["p_partkey"], "lyrics")


@query(
    "grid_scalars",
    f"WITH {EVENTS} SELECT event_id, CAST(greatest(0, least(199, round_even(value / 0.4, 0))) AS INT) AS frame, CAST(floor(event_id / 256) + 1 AS INT) AS frames, printf('%d:%02d:%02d', event_id // 3600, event_id % 3600 // 60, event_id % 60) AS clock, "
    "round(greatest(0, least(1, (value - 20) / 50)), 6) AS ramp, round(value * 37 + 600 - 1200 * floor((value * 37 + 600) / 1200) - 600, 6) + 0.0 AS folded, round(CASE WHEN value <= 10 THEN 0 WHEN value <= 30 THEN (value - 10) / 20 WHEN value <= 60 THEN 1 - (value - 30) / 60 ELSE least(2.0, 0.5 + (value - 60) / 20) END, 6) AS curve_value FROM ev",
)
def grid_scalars(spark: SparkSession, d: str) -> DataFrame:
    v, i = F.col("value"), F.col("event_id")
    return a.events(spark, d).select("event_id", s.frame_of("value", 0.4, 200).alias("frame"), s.frames_for_samples("event_id", 256).alias("frames"), s.clock(i).alias("clock"), r6(s.ramp("value", 20, 70), "ramp"), r6(s.fold_octave(v * 37), "folded"), r6(s.interp(v, [10, 30, 60, 90], [0, 1, 0.5, 2]), "curve_value"))


@query("content_ids", "SELECT p_partkey, p_brand || '-' || substr(sha1(p_name), 1, 16) AS id, regexp_replace(p_type, '^(quality|laryngeal)_', '') AS template FROM part")
def content_ids(spark: SparkSession, d: str) -> DataFrame:
    return a.table(spark, d, "part").select("p_partkey", s.content_id("p_brand", "p_name").alias("id"), s.template_key("p_type").alias("template"))


@query(
    "peak_offsets",
    f"WITH {TRACK}, w AS (SELECT recording, frame, lag(value) OVER o AS p, value AS q, lead(value) OVER o AS r FROM tr WINDOW o AS (PARTITION BY recording ORDER BY frame)), x AS (SELECT *, CASE WHEN abs(p - 2 * q + r) > 1e-12 THEN greatest(-0.5, least(0.5, 0.5 * (p - r) / (p - 2 * q + r))) ELSE 0 END AS o FROM w WHERE p < q AND r < q) "
    "SELECT recording, frame, round(o, 6) + 0.0 AS \"offset\", round(q - 0.25 * (p - r) * o, 6) AS height FROM x",
)
def peak_offsets(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("recording").orderBy("frame")
    rows = a.track(spark, d).select("recording", "frame", F.lag("value").over(w).alias("p"), F.col("value").alias("q"), F.lead("value").over(w).alias("r")).where("p < q and r < q")
    offset, height = s.parabolic_peak(F.col("p"), F.col("q"), F.col("r"))
    return rows.select("recording", "frame", r6(offset, "offset"), r6(height, "height"))


@query("allowed_exercises", "SELECT p_partkey AS id FROM part WHERE p_size % 4 <= 1 AND p_brand <> 'Brand#11' AND p_type <> 'STEEL'")
def allowed_exercises(spark: SparkSession, d: str) -> DataFrame:
    level = F.get(F.array(*[F.lit(x) for x in (*practice.LEVELS, "expert")]), F.col("p_size") % 4)
    rows = a.table(spark, d, "part").select(F.col("p_partkey").alias("id"), level.alias("level"), F.array("p_brand", "p_type").alias("tags"))
    return practice.allowed(rows, "intermediate", ["Brand#11", "STEEL"]).select("id")


GRANTS = f"{EVENTS}, lg AS (SELECT recording, curve, arg_max(event_id % 3 > 0, event_id) AS granted FROM ev GROUP BY 1, 2)"


def _log(spark: SparkSession, d: str) -> DataFrame:
    return a.events(spark, d).select("recording", F.col("curve").alias("purpose"), (F.col("event_id") % 3 > 0).alias("granted"), F.col("event_id").alias("seq"))


@query("valid_tokens", f"WITH {GRANTS}, g AS (SELECT recording, list(curve) AS g FROM lg WHERE granted GROUP BY 1) SELECT ev.recording, event_id AS token, (event_id % 7 > 0) AND coalesce(list_contains(g, curve) AND list_contains(g, 'click'), false) AS valid FROM ev LEFT JOIN g ON ev.recording = g.recording")
def valid_tokens(spark: SparkSession, d: str) -> DataFrame:
    tokens = a.events(spark, d).select("recording", F.col("event_id").alias("token"), F.array("curve", F.lit("click")).alias("purposes"), (F.col("event_id") % 7 == 0).alias("revoked"))
    return consent.valid_tokens(tokens, _log(spark, d), ["recording"]).select("recording", "token", "valid")


@query("revoked_tokens", "SELECT event_id AS token, event_id % 7 = 0 OR event_type = 'click' AS revoked FROM events")
def revoked_tokens(spark: SparkSession, d: str) -> DataFrame:
    tokens = a.events(spark, d).select(F.col("event_id").alias("token"), F.array("curve").alias("purposes"), (F.col("event_id") % 7 == 0).alias("revoked"))
    return consent.revoke(tokens, "click").select("token", "revoked")


@query("retained_rows", "SELECT event_id, CASE WHEN event_id % 10 > 0 AND 1000000 - event_id * 100 <= 500000 THEN 'retained' ELSE 'expired' END AS state FROM events")
def retained_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = a.events(spark, d).select("event_id", F.when(F.col("event_id") % 10 > 0, F.col("event_id") * 100.0).alias("stamp"))
    parts = [f(rows, "stamp", 1_000_000, 500_000).select("event_id", F.lit(name).alias("state")) for f, name in ((consent.retained, "retained"), (consent.expired, "expired"))]
    return parts[0].unionByName(parts[1])


@query("deleted_users", "SELECT event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0)")
def deleted_users(spark: SparkSession, d: str) -> DataFrame:
    gone = a.table(spark, d, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("recording"))
    return consent.without_users(a.events(spark, d), gone, "recording").select("event_id")


@query(
    "feature_store",
    f"WITH {GRANTS}, st AS (SELECT event_id % 50 AS k, recording, min(value) AS value FROM ev WHERE event_id % 2 = 0 GROUP BY 1, 2), nw AS (SELECT event_id % 50 AS k, recording, max(value) AS value FROM ev WHERE event_id % 2 = 1 AND recording IN (SELECT recording FROM lg WHERE curve = 'click' AND granted) GROUP BY 1, 2) "
    "SELECT k, recording, round(value, 6) AS value FROM st WHERE NOT EXISTS (SELECT 1 FROM nw WHERE nw.k = st.k AND nw.recording = st.recording) UNION ALL SELECT k, recording, round(value, 6) FROM nw",
)
def feature_store(spark: SparkSession, d: str) -> DataFrame:
    e = a.events(spark, d).withColumn("k", F.col("event_id") % 50)
    store = e.where("event_id % 2 = 0").groupBy("k", "recording").agg(F.min("value").alias("value"))
    new = e.where("event_id % 2 = 1").select("k", "recording", "value")
    return consent.upsert(store, new, ["k", "recording"], _log(spark, d), "recording", "click").select("k", "recording", r6("value"))


@query(
    "phonation_totals",
    f"WITH {EVENTS}, l AS (SELECT recording, event_id // 2000 AS session, t // 86400000000 AS day, event_id % 60 AS sec FROM ev), r AS (SELECT DISTINCT recording, session, day FROM l), p AS (SELECT recording, session, sum(sec) AS session_seconds FROM l GROUP BY 1, 2), q AS (SELECT recording, day, sum(sec) AS day_seconds FROM l GROUP BY 1, 2) "
    "SELECT r.recording, r.session, r.day, CAST(session_seconds AS BIGINT) AS session_seconds, CAST(day_seconds AS BIGINT) AS day_seconds, CASE WHEN session_seconds > 60 AND day_seconds > 50 THEN 'session,day' WHEN session_seconds > 60 THEN 'session' WHEN day_seconds > 50 THEN 'day' ELSE '' END AS warnings FROM r JOIN p USING (recording, session) JOIN q USING (recording, day)",
)
def phonation_totals(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    log = a.events(spark, d).select("recording", F.floor(i / 2000).alias("session"), F.floor(F.col("t") / 86_400_000_000).alias("day"), (i % 60).alias("sec"))
    out = sessions.warnings(sessions.running_totals(log, "recording", "session", "day", "sec"), 60, 50)
    return out.withColumn("warnings", F.array_join("warnings", ","))


@query("pending_items", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def pending_items(spark: SparkSession, d: str) -> DataFrame:
    done = a.table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return prepare.pending(a.table(spark, d, "part").select("p_partkey"), done, "p_partkey")


@query(
    "clipping",
    f"WITH {TRACK}, m AS (SELECT recording, max(abs(value)) AS m, count(*) AS n FROM tr GROUP BY 1), c AS (SELECT tr.recording, frame, frame - row_number() OVER (PARTITION BY tr.recording ORDER BY frame) AS g FROM tr JOIN m USING (recording) WHERE abs(floor(value / 20) * 20) >= 0.999 * floor(m.m / 20) * 20 AND floor(m.m / 20) > 0), "
    "r AS (SELECT recording, count(*) AS k FROM c GROUP BY recording, g HAVING count(*) >= 2), x AS (SELECT recording, sum(k) AS s, count(*) AS runs, max(k) AS longest FROM r GROUP BY 1) SELECT m.recording, round(coalesce(s, 0) / n, 6) AS fraction, coalesce(runs, 0) AS runs, coalesce(longest, 0) AS longest FROM m LEFT JOIN x USING (recording)",
)
def clipping(spark: SparkSession, d: str) -> DataFrame:
    rows = a.track(spark, d).withColumn("value", F.floor(F.col("value") / 20) * 20.0)
    return series.clipping(rows, ["recording"], least=2).select("recording", r6("fraction"), "runs", "longest")


@query(
    "practice_trend",
    f"WITH {TRACK}, w AS (SELECT recording, value, row_number() OVER (PARTITION BY recording ORDER BY frame) AS r, row_number() OVER (PARTITION BY recording ORDER BY frame DESC) AS e, value - 2 * lag(value) OVER o + lag(value, 2) OVER o AS d FROM tr WINDOW o AS (PARTITION BY recording ORDER BY frame)) "
    "SELECT recording, round((median(value) FILTER (WHERE e <= 3) - median(value) FILTER (WHERE r <= 3)) / greatest(1.4826 * median(abs(d)) / sqrt(6.0), 1e-9), 6) + 0.0 AS trend_z, count(*) AS n FROM w GROUP BY 1",
)
def practice_trend(spark: SparkSession, d: str) -> DataFrame:
    return series.trend(a.track(spark, d), ["recording"], 3).select("recording", r6("trend_z"), "n")


@query(
    "at_fraction",
    f"WITH {TRACK}, p AS (SELECT recording, frame, frame * 0.75 AS tau, CAST(floor(frame * 0.75) AS BIGINT) AS f FROM tr), c AS (SELECT recording, frame, CASE WHEN confidence > 0.3 THEN value END AS v FROM tr), j AS (SELECT p.*, x.v AS lo, y.v AS hi, tau - floor(tau) AS part FROM p LEFT JOIN c x ON p.recording = x.recording AND p.f = x.frame LEFT JOIN c y ON p.recording = y.recording AND p.f = y.frame - 1) "
    "SELECT recording, frame, round(CASE WHEN part = 0 THEN lo WHEN lo IS NOT NULL AND hi IS NOT NULL THEN lo * (1 - part) + hi * part ELSE coalesce(lo, hi) END, 6) AS sampled FROM j",
)
def at_fraction(spark: SparkSession, d: str) -> DataFrame:
    track = a.track(spark, d)
    places = track.select("recording", "frame", (F.col("frame") * 0.75).alias("tau"))
    curve = track.select("recording", "frame", F.when(F.col("confidence") > 0.3, F.col("value")).alias("value"))
    return joins.at_fraction(places, curve, ["recording"], "tau").select("recording", "frame", r6("sampled"))


@query("paired_frames", f"WITH {TRACK} SELECT o.recording, o.frame, round(o.value, 6) AS on_value, round(f.value, 6) AS off_value FROM tr o JOIN tr f ON o.recording = f.recording AND f.frame = CAST(round_even(o.frame * 0.75, 0) AS BIGINT)")
def paired_frames(spark: SparkSession, d: str) -> DataFrame:
    track = a.track(spark, d)
    warp = track.select("recording", "frame", (F.col("frame") * 0.75).alias("tau"))
    return joins.paired_frames(warp, track, track, ["recording"], ["value"]).select("recording", "frame", r6("on_value"), r6("off_value"))


@query(
    "octave_candidates",
    f"WITH {EVENTS}, k AS (SELECT recording, floor(value * 40) AS cents, confidence AS weight FROM ev), c AS (SELECT DISTINCT recording, unnest([cents - 1200, cents, cents + 1200]) AS candidate FROM k), v AS (SELECT c.recording, candidate, weight, abs(cents - candidate) AS d, abs(cents - candidate + 600 - 1200 * floor((cents - candidate + 600) / 1200) - 600) AS f FROM c JOIN k USING (recording)) "
    "SELECT recording, candidate, round(sum(CASE WHEN d <= 50 THEN weight WHEN f <= 50 THEN 0.8 * weight ELSE 0 END), 6) AS score FROM v GROUP BY 1, 2",
)
def octave_candidates(spark: SparkSession, d: str) -> DataFrame:
    tracks = a.events(spark, d).select("recording", F.floor(F.col("value") * 40).cast("double").alias("cents"), F.col("confidence").alias("weight"))
    return joins.octave_candidates(tracks, ["recording"]).select("recording", "candidate", r6("score"))


@query(
    "pitch_agreement",
    f"WITH {TRACK}, e AS (SELECT recording, frame, CASE WHEN confidence > 0.3 THEN floor(value * 40) END AS e, CASE WHEN frame % 5 > 0 THEN floor(value * 40) + (frame % 7 - 3) * 30 + CASE WHEN frame % 3 = 0 THEN 1200 ELSE 0 END END AS r FROM tr) "
    "SELECT recording, round(avg(CASE WHEN r IS NOT NULL THEN CASE WHEN abs(e - r) <= 50 THEN 1.0 ELSE 0 END END), 6) AS raw_pitch, round(avg(CASE WHEN r IS NOT NULL THEN CASE WHEN abs(e - r + 600 - 1200 * floor((e - r + 600) / 1200) - 600) <= 50 THEN 1.0 ELSE 0 END END), 6) AS raw_chroma, "
    "round(avg(CASE WHEN r IS NOT NULL THEN CASE WHEN e IS NOT NULL THEN 1.0 ELSE 0 END END), 6) AS voicing_recall, round(avg(CASE WHEN r IS NULL THEN CASE WHEN e IS NOT NULL THEN 1.0 ELSE 0 END END), 6) AS false_alarm FROM e GROUP BY 1",
)
def pitch_agreement(spark: SparkSession, d: str) -> DataFrame:
    cents, frame = F.floor(F.col("value") * 40).cast("double"), F.col("frame")
    track = a.track(spark, d)
    est = track.select("recording", "frame", F.when(F.col("confidence") > 0.3, cents).alias("cents"))
    ref = track.select("recording", "frame", F.when(frame % 5 > 0, cents + (frame % 7 - 3) * 30 + F.when(frame % 3 == 0, 1200).otherwise(0)).alias("cents"))
    return joins.pitch_agreement(est, ref, ["recording"]).select("recording", *[r6(x) for x in ("raw_pitch", "raw_chroma", "voicing_recall", "false_alarm")])


@query("uncertain_items", f"WITH {EVENTS} SELECT event_id, CASE WHEN confidence < 0.2 THEN NULL ELSE round(greatest(5.0, CASE WHEN confidence <= 0.3 THEN 40 WHEN confidence <= 0.8 THEN 40 - (confidence - 0.3) * 60 ELSE 10 END), 6) END AS least_magnitude FROM ev")
def uncertain_items(spark: SparkSession, d: str) -> DataFrame:
    levels, errors = F.array(F.lit(0.3), F.lit(0.8)), F.array(F.lit(40.0), F.lit(10.0))
    u = decisions.uncertainty(F.col("confidence"), F.lit(5.0), F.lit(0.2), levels, errors)
    return a.events(spark, d).select("event_id", r6(F.when(u < float("inf"), u), "least_magnitude"))
