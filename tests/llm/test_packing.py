import re
from collections import defaultdict
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from larkspan.llm import packing


def padding(counts, bounds):
    return sum(n * (min(b for b in bounds if b >= length) - length) for length, n in enumerate(counts) if n)


def test_bounds_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(30):
        counts = np.where(rng.random(12) < 0.7, rng.integers(0, 50, 12), 0)
        counts[0] = 0
        lengths = np.flatnonzero(counts)
        for k in (1, 2, 3, 20):
            got = packing.best_bounds(counts, k)
            if not len(lengths):
                assert got == []
                continue
            best = min(padding(counts, (*x, lengths[-1])) for x in combinations(lengths[:-1].tolist(), min(k, len(lengths)) - 1))
            assert len(got) <= k and padding(counts, got) == best


def test_every_word_is_packed_once(spark):
    texts = [None, "", " \n", "a", "a", "w " * 5000, *("x " * n for n in range(1, 80))]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "y y y"), (4, "a")], "doc_id long, text string").withColumn("bucket", F.lit("clash"))
    rows = packing.pack(df, max_len=64, buckets=4, budget=200).collect()
    words = defaultdict(int)
    for r in rows:
        words[r.doc_id] += r.n_words
        assert r.padding == r.bucket_len - r.n_words >= 0 and r.first_word == 64 * r.piece
    assert words[5] == 5000 and words[None] == 3 and words[4] == 2 and 0 not in words and 1 not in words
    assert all(words[i] == len(re.findall(r"\S+", t)) for i, t in enumerate(texts) if t and t.strip() and i != 4)
    batches = defaultdict(list)
    for r in rows:
        batches[r.bucket, r.batch].append(r)
    per = {r.bucket: max(1, 200 // r.bucket_len) for r in rows}
    size = defaultdict(int)
    for r in rows:
        size[r.bucket] += 1
    for (b, k), own in batches.items():
        assert sorted(r.slot for r in own) == list(range(len(own))) and len(own) <= per[b]
        assert len(own) == per[b] or k == (size[b] - 1) // per[b]  # only the last batch may be short
    assert len({r.bucket for r in rows}) <= 4
    assert packing.pack(df.limit(0)).count() == 0


def test_query_matches_brute_force_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    counts = np.zeros(2049, np.int64)
    for r in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        for at in range(0, n, 2048):
            counts[min(2048, n - at)] += 1
    got = packing.op6_packing(spark, "/root/testdata/sf0.01").agg(F.sum("padding"), F.count("*"), F.countDistinct("bucket")).first()
    assert tuple(got) == (padding(counts, packing.best_bounds(counts, 16)), counts.sum(), 16)


def test_batches_hold_every_word(spark):
    texts = [None, "", " \n", "a", "a", " ".join(f"v{i}" for i in range(1000)), *(" ".join(f"x{n}y{i}" for i in range(n)) for n in range(1, 60)), "long" * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "y y y"), (4, "a")], "doc_id long, text string").withColumn("_t", F.lit("clash"))
    found = defaultdict(list)
    for r in packing.batches(df, max_len=64, buckets=4, budget=200).collect():
        assert [p.slot for p in r.pieces] == list(range(len(r.pieces))) and len(r.pieces) * r.bucket_len <= max(200, r.bucket_len)
        for p in r.pieces:
            assert len(p.words) <= r.bucket_len
            found[p.doc_id].append((p.piece, p.words))
    got = {d: [w for _, ws in sorted(x) for w in ws] for d, x in found.items()}
    assert got.pop(None) == ["y"] * 3 and got.pop(4) == ["a", "a"]
    assert got == {i: t.split() for i, t in enumerate(texts) if t and t.split() and i != 4}
