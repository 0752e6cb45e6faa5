import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from larkspan.llm import _common as c
from larkspan.llm import hmm


def test_likelihood_is_exact(monkeypatch):
    rng = np.random.default_rng(0)
    m = hmm.Model(rng.dirichlet([1] * 3), np.ones(3) / 3, rng.dirichlet([1] * 3, 3), rng.dirichlet([1] * 11, 3).T)
    seqs = [rng.integers(0, 11, n).astype(np.int16) for n in (1, 2, 7, 50, 23)]

    def plain(q):
        a = m.start * m.emit[q[0]]
        for x in q[1:]:
            a = a @ m.move * m.emit[x]
        return math.log10(a.sum())

    for chunk in (2048, 5):
        monkeypatch.setattr(hmm, "CHUNK", chunk)
        assert np.allclose(hmm.log10_likelihood(m, seqs), [plain(q) for q in seqs])


def test_expected_counts_match_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    m = hmm.Model(rng.dirichlet([1] * 2), rng.dirichlet([1] * 2), rng.dirichlet([1] * 2, 2), rng.dirichlet([1] * 4, 2).T)
    seqs, first = [np.array([0, 3, 1]), np.array([2, 2]), np.array([1])], np.array([True, False, True])
    start, moves, emits = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))
    for q, f in zip(seqs, first):
        paths = []
        for p in product(range(2), repeat=len(q)):
            w = (m.start if f else m.again)[p[0]] * m.emit[q[0], p[0]]
            for a, b, x in zip(p, p[1:], q[1:]):
                w *= m.move[a, b] * m.emit[x, b]
            paths.append((p, w))
        total = sum(w for _, w in paths)
        for p, w in paths:
            w /= total
            start[p[0]] += w * f
            for x, k in zip(q, p):
                emits[x, k] += w
            for a, b in zip(p, p[1:]):
                moves[a, b] += w
    ends = np.array([3, 2, 1])
    codes = np.zeros((3, 3), np.int64)
    codes[np.arange(3) < ends[:, None]] = np.concatenate(seqs)
    got = hmm._expect(m, codes, first, ends)
    assert np.allclose(got[0], start, atol=1e-5) and np.allclose(got[1], moves, atol=1e-5) and np.allclose(got[2], emits, atol=1e-5)


def test_base_score_against_brute_force_and_gain(spark):
    docs = c.documents(spark, "/root/testdata/sf0.001").select("doc_id", "text").limit(200)
    extra = spark.createDataFrame([(9001, None), (9002, ""), (9003, "  \t\n"), (9004, "zzz ZZZ q"), (None, "the and"), (9004, "zzz ZZZ q")], "doc_id long, text string")
    rows = docs.union(extra).withColumn("held_out", c.id_remainder(F.col("doc_id"), 5) == 1)
    want = [(r.doc_id, r.text, r.held_out) for r in rows.collect()]
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    count = Counter(w for _, t, h in want if not h for w in tokens(t))
    n, v = sum(count.values()), len(count)
    for hot in (50, 200_000):
        got = hmm.score(rows, hot=hot, rounds=2).collect()
        assert len(got) == len(want) and {r.train_tokens for r in got} == {n}
        key = lambda d, k, b: (d or -1, k, round(b, 6))
        expect = sorted(key(d, len(tokens(t)), sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))) for d, t, _ in want)
        assert np.allclose(sorted(key(r.doc_id, r.n_tokens, r.base_score) for r in got), expect)
        known = {r.doc_id: r.n_known for r in got}
        assert all(known[d] == sum(count[w] > 0 for w in tokens(t)) for d, t, _ in want)
        held = [r for r in got if r.held_out]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id or "").encode()) % 5 == 1) for r in got)
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_empty_table(spark):
    assert hmm.score(spark.createDataFrame([], "doc_id long, held_out boolean, text string")).count() == 0
