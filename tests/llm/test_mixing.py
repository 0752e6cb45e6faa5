import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from larkspan.llm import _common as c
from larkspan.llm import mixing


def brute_targets(sizes, weights, share, cap):
    """sizes: {source: words}; the stated rule, round by round."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, goal = set(), share * sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        left = goal - sum(cap * sizes[s] for s in full)
        t = {s: w[s] * left / sum(w[x] for x in rest) for s in rest}
        over = {s for s in rest if t[s] > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in full else t[s] for s in order}
        full |= over


def check(spark, docs, rows):
    slim = mixing.keyed(docs, F.col("doc_id"), F.col("source"))
    planned = mixing.plan(slim, mixing.WEIGHTS)
    got = mixing.with_copies(slim, planned).collect()
    assert len(got) == len(rows)
    size, most = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        size[s] += n
        most[s] = max(most[s], n)
    want = brute_targets(size, mixing.WEIGHTS, 1.5, 2.0)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["_copies"] <= 2 and r["_source_size"] == size[r.source]
        assert np.isclose(r["_target"], want[r.source])
        taken[r.source] += r["_copies"] * r["_size"]
    return size, want, taken, most, got


def test_targets_and_taken_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    rows = [tuple(r) for r in docs.collect()]
    size, want, taken, most, got = check(spark, docs, rows)
    assert all(abs(taken[s] - want[s]) <= 0.01 * size[s] for s in size)
    again = {r.doc_id: r["_copies"] for r in check(spark, docs.repartition(7), rows)[4]}
    assert again == {r.doc_id: r["_copies"] for r in got}


def test_cases(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "one two three", "a"), (4, "w " * 5000, None), (5, "x y", None), (None, "z z", "b"), (None, "z z", "b"), (6, "q", "ü"), (7, "q r s", "z"), (8, None, "only nulls"), (9, None, "only nulls")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(spark, docs, rows)
    assert mixing.plan(mixing.keyed(docs.limit(0)), mixing.WEIGHTS).count() == 0
    extra = docs.withColumn("_h", F.lit(1)).withColumn("size", F.lit("clash")).withColumn("row", F.lit(2)).withColumn("a.b", F.lit(3))
    out = mixing.mixed_documents(extra)
    assert out.columns == extra.columns and {(r["_h"], r.size, r.row, r["a.b"]) for r in out.collect()} == {(1, "clash", 2, 3)}


def test_repeated_rows_meet_the_target(spark):
    """Equal rows tie in every hash; only as many of them as the target needs are taken twice."""
    rows = [(1, "w x", "s")] * 3000 + [(2, "w x y z", "t")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size, want, taken, most, got = check(spark, docs, rows)
    assert size == {"s": 6000, "t": 12_000} and all(abs(taken[s] - want[s]) <= most[s] for s in size)
    assert mixing.mixed_documents(docs).where("doc_id = 2").count() * 4 == taken["t"]


def test_the_tilt_carries_the_result(spark):
    """Sources above and below their size are tilted to long and from long documents; plain proportional rates would not be."""
    rows = [(i, "w " * (1 + i % 40), "abc"[i % 3]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size, want, taken, most, got = check(spark, docs, rows)
    rate = {(r.source, r["_size"]): r["_r"] for r in got}
    for s in size:
        part = want[s] / size[s]
        by = [rate[s, n] for n in sorted({n for x, n in rate if x == s})]
        if part < 1.99:
            assert abs(part - 1) > 0.01 and (np.diff(by) * (part - 1) > 0).all()
        else:
            assert min(by) > 1.999
    # the rates are the solution: words come out exactly, and the log odds are a straight line through rate 1 at size 0
    for s in size:
        total = sum(r["_r"] * r["_size"] for r in got if r.source == s)
        assert np.isclose(total, want[s], rtol=1e-6)
        if want[s] / size[s] < 1.99:
            sizes = np.array(sorted({n for x, n in rate if x == s}))
            r = np.array([rate[s, n] for n in sizes])
            line = np.log(r / (2 - r)) / sizes
            assert np.allclose(line, line[0], rtol=1e-6)


def test_dual_meets_every_constraint(spark):
    cells = spark.createDataFrame([("a", x / 10, 5 + i) for i, x in enumerate(range(1, 40, 3))] + [("b", 1.0, 9), ("full", 1.0, 4), ("none", 2.0, 4)], "_k string, _x double, _n long")
    docs, words = {}, {}
    for r in cells.collect():
        docs[r["_k"]] = docs.get(r["_k"], 0) + r["_n"]
        words[r["_k"]] = words.get(r["_k"], 0) + r["_n"] * r["_x"]
    goals = spark.createDataFrame([("a", float(docs["a"]), 0.4 * words["a"]), ("b", 9.0, 11.0), ("full", 4.0, 8.0), ("none", 4.0, 0.0)], "_k string, _docs double, _words double")
    duals = {r["_k"]: r["_b"] for r in mixing.solve(c.spool(cells), goals, 2.0).collect()}
    rate = lambda k, x: 2 / (1 + np.exp(-min(40, duals[k] * x)))
    assert np.isclose(sum(r["_n"] * r["_x"] * rate("a", r["_x"]) for r in cells.collect() if r["_k"] == "a"), 0.4 * words["a"])
    assert duals["a"] < 0 and np.isclose(9 * rate("b", 1.0), 11) and duals["full"] == mixing.ENDLESS and duals["none"] == -mixing.ENDLESS


def test_bucket_rank(spark):
    rows = [(k, h) for k in (None, "a", "b") for h in np.random.default_rng(3).integers(-(2**63), 2**63, 300).tolist()]
    df = c.spool(spark.createDataFrame(rows, "k string, h long"))
    got = {(r.k, r.h): r["rank"] for r in c.bucket_rank(df, ["k"], F.col("h"), rows_per_bucket=20).collect()}
    for k in (None, "a", "b"):
        own = sorted(h for x, h in rows if x == k)
        assert [got[k, h] for h in own] == list(range(300))


def test_least_count(spark):
    df = spark.createDataFrame([(n,) for n in [1] * 50 + [2] * 10 + [999, 1004, 1009, 20_000]], "n long")
    for most, cut in ((3, 1000), (4, 999), (13, 999), (14, 2), (63, 2), (64, 1)):
        assert c.least_count(df, "n", most) == cut
    assert c.least_count(df, "n", 0) > 20_000 and c.least_count(df.limit(0), "n", 5) > 20_000
