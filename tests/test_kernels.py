import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.functions import scalar as s
from larkspan.operators import agreement, decisions, joins, kernels, series, splits


def test_pava_is_the_least_squares_fit():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = rng.integers(1, 7)
        y, w = rng.normal(size=n).round(1), rng.integers(1, 4, n)
        best = None
        for cuts in itertools.product([0, 1], repeat=n - 1):  # all ways to pool neighbours
            ids = np.concatenate([[0], np.cumsum(cuts)])
            fit = np.array([np.average(y[ids == k], weights=w[ids == k]) for k in ids])
            if (np.diff(fit) >= -1e-12).all() and (best is None or (w * (fit - y) ** 2).sum() < best[0] - 1e-12):
                best = ((w * (fit - y) ** 2).sum(), fit)
        assert np.allclose(kernels.pava(y, w), best[1])
        assert np.allclose(kernels.pava(-y, w, increasing=False), -best[1])


def test_operating_threshold():
    rng = np.random.default_rng(0)
    level = rng.uniform(0, 40, 2000)
    error = rng.normal(size=2000) * np.where(level < 26, 10, 1)
    assert 20 < kernels.operating_threshold(level, error, 5.0) < 32
    assert kernels.operating_threshold(level, error, 0.01) is None
    assert kernels.operating_threshold(-level, error, 5.0, higher_is_better=False) == pytest.approx(-kernels.operating_threshold(level, error, 5.0), abs=1.0)


def path_cost(cost, path, extra):
    return sum(cost[i, j] for i, j in path) + extra * sum(1 for (a, b), (c, d) in zip(path, path[1:]) if (c - a, d - b) != (1, 1))


def test_alignment_is_the_cheapest_path():
    rng = np.random.default_rng(2)
    for _ in range(10):
        a, b = rng.normal(size=(4, 3)), rng.normal(size=(5, 3))
        path, got = kernels.banded_alignment(a, b, 9, 0.15)
        unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
        cost = 1 - unit(a) @ unit(b).T
        extra = 0.15 * np.median(cost)

        def paths(i, j):
            yield [(i, j)]
            for di, dj in ((1, 1), (1, 0), (0, 1)):
                if i + di < 4 and j + dj < 5:
                    for rest in paths(i + di, j + dj):
                        yield [(i, j), *rest]

        best = min(path_cost(cost, p, extra) for p in paths(0, 0) if p[-1][0] == 3)
        assert path_cost(cost, [tuple(x) for x in path], extra) == pytest.approx(best)
        assert np.allclose(got, [cost[i, j] for i, j in path])
    same = rng.normal(size=(20, 4))
    path, cost = kernels.banded_alignment(same, same, 5, 0.15)
    assert (path[:, 0] == path[:, 1]).all() and np.allclose(cost, 0)


def test_best_path_against_enumeration():
    rng = np.random.default_rng(3)
    score, move = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
    total = lambda p: sum(score[t, k] for t, k in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:]))
    assert tuple(kernels.best_path(score, move)) == max(itertools.product(range(3), repeat=5), key=total)
    score[2] = -np.inf
    assert kernels.best_path(score, move)[2] == -1


def test_small_kernels():
    assert kernels.allocate([3, 1, 1], 4) == [2, 1, 1] and kernels.allocate([1, 1], 1) == [1, 0] and kernels.allocate([], 3) == []
    assert kernels.greedy_matches([0.0, 1.0], [0.04, 1.2], 0.05) == 1
    assert np.allclose(kernels.smooth_warp(np.arange(9), np.arange(9) * 2.0, 5.0), np.arange(9) * 2.0)


def test_distributions():
    assert agreement.t_sf(2.0, 10) == pytest.approx(0.036694, abs=1e-6) and agreement.t_sf(-2.0, 10) == pytest.approx(0.963306, abs=1e-6)
    assert agreement.binomial_sf(7, 10, 0.5) == pytest.approx(sum(math.comb(10, k) for k in range(7, 11)) / 1024)
    assert agreement.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248)


# Shrout and Fleiss' ratings of six targets by four judges, a published example.
RATINGS = [[9, 2, 5, 8], [6, 1, 3, 2], [8, 4, 6, 8], [7, 1, 2, 6], [10, 5, 6, 9], [6, 2, 4, 7]]


def test_intraclass_correlation_of_a_published_example(spark):
    cells = spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(RATINGS) for j, v in enumerate(r)], "subject long, condition long, value double")
    r = agreement.icc(cells).first()
    assert (round(r.icc11, 2), round(r.icc21, 2), round(r.icc31, 2)) == (0.17, 0.29, 0.71)


def test_invariance_drops_incomplete_subjects_and_empty_conditions(spark):
    rows = [("d", i, c, i + 0.1 * (c == "zoom")) for i in range(6) for c in ("ref", "zoom")] + [("d", 9, "ref", 1.0)] + [("d", i, "lost", None) for i in range(6)]
    df = spark.createDataFrame(rows, "dim string, subject long, condition string, value double")
    r = agreement.invariance(df, "ref", ["dim"]).first()
    assert (r.n, r.k, r.accepted, r.band) == (6, 2, True, "excellent") and r.worst_shift == pytest.approx(0.1)


def test_kappas(spark):
    df = spark.createDataFrame([(1, 1), (0, 0), (1, 1), (0, 0)], "a int, b int")
    assert agreement.cohen_kappa(df, "a", "b").first().kappa == 1.0
    assert agreement.cohen_kappa(df.withColumn("b", 1 - F.col("b")), "a", "b").first().kappa == -1.0
    counts = [[0, 0, 0, 0, 14], [0, 2, 6, 4, 2], [0, 0, 3, 5, 6], [0, 3, 9, 2, 0], [2, 2, 8, 1, 1], [7, 7, 0, 0, 0], [3, 2, 6, 3, 0], [2, 5, 3, 2, 2], [6, 5, 2, 1, 0], [0, 2, 2, 3, 7]]
    long = spark.createDataFrame([(i, j, n) for i, r in enumerate(counts) for j, n in enumerate(r)], "item int, cat int, n int")
    assert agreement.fleiss_kappa(long, "item", "cat", "n").first().kappa == pytest.approx(0.210, abs=5e-4)


def test_holm_and_auroc(spark):
    p = lambda *v: spark.createDataFrame(list(zip("abc", v)), "name string, p double")
    got = lambda *v: [r.rejected for r in agreement.holm(p(*v), "name", "p").orderBy("name").collect()]
    assert got(0.001, 0.02, 0.04) == [True] * 3 and got(0.001, 0.04, 0.04) == [True, False, False]
    sc = spark.createDataFrame([(1.0, 0), (2.0, 0), (3.0, 1)], "s double, y int")
    assert agreement.auroc(sc, "s", F.col("y") == 1).first().auroc == 1.0
    assert agreement.auroc(sc.withColumn("s", F.lit(1.0)), "s", F.col("y") == 1).first().auroc == 0.5
    assert agreement.auroc(sc.where("y = 0"), "s", F.col("y") == 1).first().auroc is None


def test_threshold_reasons(spark):
    th = spark.createDataFrame([("a", 10.0, 0.5, True), ("b", 1.0, 0.1, False)], "attribute string, mdc double, min_confidence double, usable boolean")
    rows = [("a", 0.9, 20.0, "none", 0.9), ("a", 0.1, 20.0, "none", None), ("a", 0.9, 1.0, "missing", None), ("a", 0.9, 50.0, "same", None), ("a", 0.9, 5.0, "none", None), ("a", 0.9, 20.0, "none", 0.01), ("b", 0.9, 9.0, "none", None), ("z", 0.9, 9.0, "none", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, attribute string, confidence double, magnitude double, status string, audibility double")
    got = [r.reason for r in decisions.apply_thresholds(df, th, 0.2).orderBy("i").collect()]
    assert got == ["ok", "below_confidence", "ok", "no_difference", "below_magnitude", "below_audibility", "attribute_not_reliable", "no_threshold"]


def test_rank_ties_prefer_lower_tiers(spark):
    rows = [("k", "x", "diction", 1.0), ("k", "y", "pitch", 0.95), ("k", "z", "rhythm", 0.5), ("k", "w", "unknown", 0.5)]
    got = decisions.rank_items(spark.createDataFrame(rows, "key string, item string, category string, score double"), ["key"], "item")
    assert [r.item for r in got.orderBy("position").collect()] == ["y", "x", "z", "w"]


def test_octave_premise(spark):
    rows = [("a", 1200.0 + i % 5, True, 0.9, 0.9) for i in range(20)] + [("b", float(500 * (i % 3)), True, 0.9, 0.9) for i in range(20)] + [("c", None, True, 0.9, 0.9)]
    got = {r.k: r for r in decisions.octave_premise(spark.createDataFrame(rows, "k string, difference double, sung boolean, u_conf double, t_conf double"), ["k"]).collect()}
    assert got["a"].passed and got["a"].transposition == 1200.0 and not got["b"].passed and not got["c"].passed


def test_pattern_lookup(spark):
    table = spark.createDataFrame([(0, "quality_*", 1), (1, "quality_breathy", 2), (2, "a.c?", 3)], "pos int, pattern string, v int")
    items = spark.createDataFrame([("quality_breathy",), ("quality_x",), ("a.cd",), ("abcd",), (None,)], "attribute string")
    got = {r.attribute: r.v for r in joins.lookup_pattern(items, table, "attribute").collect()}
    assert got == {"quality_breathy": 2, "quality_x": 1, "a.cd": 3, "abcd": None, None: None}


def test_series_edges(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, float("nan"), 3.0])] + [("b", 0, 7.0)] + [("c", i, float(i)) for i in range(6)], "k string, frame long, value double")
    got = {(r.k, r.frame): r.smoothed for r in series.moving_average(df, ["k"], 4).collect()}
    assert got["b", 0] == 7.0 and got["a", 0] == 1.0 and got["a", 1] == 2.0 and got["c", 2] == 1.5
    assert series.runs(df.limit(0), ["k"], F.col("value") > 0).count() == 0
    clip = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 1.0, 1.0, 0.2, -1.0, 0.1])], "k string, frame long, value double")
    r = series.clipping(clip, ["k"]).first()
    assert (r.fraction, r.runs, r.longest) == (0.5, 1, 3)
    tau = spark.createDataFrame([("c", 1.5), ("c", 4.0), ("c", 9.0)], "k string, tau double")
    assert [r.sampled for r in joins.at_fraction(tau, df, ["k"], "tau").orderBy("tau").collect()] == [1.5, 4.0, None]


def test_pitch_agreement_and_candidates(spark):
    ref = spark.createDataFrame([("r", 0, 0.0), ("r", 1, 100.0), ("r", 2, None), ("r", 3, 50.0)], "k string, frame long, cents double")
    est = spark.createDataFrame([("r", 0, 10.0), ("r", 1, 1300.0), ("r", 2, 5.0), ("r", 3, None)], "k string, frame long, cents double")
    r = joins.pitch_agreement(est, ref, ["k"]).first()
    assert (round(r.raw_pitch, 3), round(r.raw_chroma, 3), round(r.voicing_recall, 3), r.false_alarm) == (0.333, 0.667, 0.667, 1.0)
    tr = spark.createDataFrame([("f", "a", 0.0, 1.0), ("f", "b", 10.0, 1.0), ("f", "c", 1200.0, 1.0)], "k string, tracker string, cents double, weight double")
    best = joins.octave_candidates(tr, ["k"]).orderBy(F.desc("score")).first()
    assert best.candidate in (0.0, 10.0) and best.score == pytest.approx(2.8)


def test_splits(spark):
    df = spark.createDataFrame([(f"s{i % 40}", i) for i in range(120)] + [(None, 1), ("", 2)], "singer string, i int")
    got = splits.hash_split(df, "singer")
    assert splits.assert_disjoint(got, "singer").count() == 0
    assert {r.split for r in got.where("singer is null or singer = ''").collect()} == {"unassigned"}
    few = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "singer string")
    assert {r.split for r in splits.donate_split(few, "singer").collect()} == {"train", "calib", "test"}


def test_scalars(spark):
    r = spark.range(1).select(
        s.hz_to_cents(F.lit(880.0)).alias("c"), s.cents_to_hz(F.lit(-1200.0)).alias("h"), s.fold_octave(F.lit(-700.0)).alias("f"), s.frame_of(F.lit(0.25), 0.1, 10).alias("n"), s.hash_bucket(F.lit("s7")).alias("b"),
        s.clock(F.lit(3725.4)).alias("t"), s.interp(F.lit(1.5), [1, 2], [10, 20]).alias("i"), s.interp_arrays(F.lit(1.5), F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(10.0), F.lit(20.0))).alias("j"), s.known(F.lit(float("nan"))).alias("k"), s.ramp(F.lit(None).cast("double"), 0, 1).alias("r"),
    ).first()
    assert (r.c, r.h, r.f, r.n, r.t, r.i, r.j, r.k, r.r) == (1200.0, 220.0, 500.0, 2, "1:02:05", 15.0, 15.0, None, 0.0) and round(r.b, 5) == 0.79087


def test_notes_and_vibrato(spark):
    cents = [0.0] * 10 + [200.0] * 10 + [None] * 3 + [200.0] * 10
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(cents)], "k string, frame long, value double")
    assert [(r.start, r.end) for r in kernels.notes(df, ["k"]).orderBy("start").collect()] == [(0, 10), (10, 20), (23, 33)]
    hop = 0.01
    wave = [30 * math.sin(2 * math.pi * 5.5 * i * hop) + i for i in range(100)]
    v = kernels.vibrato(spark.createDataFrame([("a", i, x) for i, x in enumerate(wave)], "k string, frame long, value double"), ["k"], 50, [4.0, 4.5, 5.0, 5.5, 6.0, 7.0], hop)
    r = v.agg(F.median("rate").alias("rate"), F.median("extent").alias("extent")).first()
    assert r.rate == 5.5 and r.extent == pytest.approx(30, abs=1)


def test_stage_rule():
    from larkspan.streaming.sessions import step

    stage, loads = 0, []
    for load in [10, 10, 10, 10, 10, 10, 90, 90, 90]:
        stage, loads = step(stage, loads, load)
    assert stage == 1


