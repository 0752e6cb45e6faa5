import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from larkspan.llm import passages as p
from larkspan.llm._words import word_hashes


def words(n, seed, top=10**6):
    r = random.Random(seed)
    return [f"w{r.randrange(top)}" for _ in range(n)]


def brute_chain(px, py, gap):
    score = []
    for a in range(len(px)):
        score.append(1 + max([0, *(score[b] - gap * (px[a] - px[b] + py[a] - py[b]) for b in range(a) if px[b] < px[a] and py[b] < py[a])]))
    return max(score)


def test_chains_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = rng.integers(1, 25)
        pts = sorted({(int(a), int(b)) for a, b in rng.integers(0, 60, (n, 2))})
        px, py = np.array(pts).T
        got = p.chains(px, py)
        assert sorted(np.concatenate(got).tolist()) == list(range(len(px)))
        best = 0
        for chain in got:
            assert (np.diff(px[chain]) > 0).all() and (np.diff(py[chain]) > 0).all()
            best = max(best, len(chain) - p.GAP * (np.diff(px[chain]).sum() + np.diff(py[chain]).sum()))
        assert abs(best - brute_chain(px, py, p.GAP)) < 1e-9


def test_every_shared_run_has_a_seed():
    for n in range(300):
        a, b, run = words(300, 3 * n + 1), words(200, 3 * n + 2), words(p.K + p.WINDOW - 1, 3 * n + 3)
        x, y = (p.rolling(word_hashes(" ".join(t).encode()), p.K) for t in (a[:77] + run + a[77:], run + b))
        assert np.intersect1d(x[p.seeds_at(x)], y[p.seeds_at(y)]).size
    assert len(p.seeds_at(p.rolling(word_hashes(" ".join(words(p.K, 1)).encode()), p.K))) == 1 and not len(p.seeds_at(np.zeros(0, np.uint64)))


def test_share_of_edited_passages_with_a_seed():
    """60 words, one in n edited: pairs that share a seed at all. From one in eight on, nearly all do."""
    got = {}
    for n in (7, 8, 9, 10, 12):
        hits = 0
        for k in range(300):
            one = words(60, 5000 + k)
            two = [f"edit{i}" if i % n == n - 1 else w for i, w in enumerate(one)]
            x, y = (p.rolling(word_hashes(" ".join(words(30, 6000 + k + s) + t + words(30, 7000 + k + s)).encode()), p.K) for t, s in ((one, 0), (two, 1000)))
            hits += bool(np.intersect1d(x[p.seeds_at(x)], y[p.seeds_at(y)]).size)
        got[n] = hits / 300
    assert got[7] > 0.88 and got[8] > 0.97 and min(got[9], got[10], got[12]) > 0.99, got


def cases():
    passage, other = words(80, 10), words(120, 11)
    edited = passage[:20] + ["new"] + passage[21:40] + passage[42:60] + ["added", "twice"] + passage[60:]
    texts = [words(100, 20) + passage + words(50, 21), words(30, 22) + [w.upper() for w in passage] + words(90, 23), edited + words(40, 24), words(400, 25), words(60, 26) + passage[:30] + words(60, 27), other + words(10, 28) + other, None, [], ["a"] * 300, words(30_000, 29), words(30_000, 29)]
    return [(i, None if t is None else " ".join(t)) for i, t in enumerate(texts)]


def test_planted_passages(spark):
    df = spark.createDataFrame(cases() + [(None, " ".join(words(80, 10))), (3, " ".join(words(400, 25)))], "doc_id long, text string").withColumn("x", F.lit("clash"))
    got = defaultdict(list)
    for r in p.repeated_passages(df).collect():
        got[r.doc_id].append((r.source_doc_id, r.start_word, r.end_word, r.source_start, r.source_end, r.matched_words))
    assert got[1] == [(0, 30, 110, 100, 180, 80)]
    ((source, lo, hi, a, b, m),) = got[2]
    assert (source, lo, hi, a, b) == (0, 0, 80, 100, 180) and m == 77
    assert got[5] == [(5, 130, 250, 0, 120, 120)]
    assert got[10] == [(9, 0, 30_000, 0, 30_000, 30_000)]
    assert got[8] == [(8, 1, 300, 0, 299, 299)]  # a run of one word repeats itself, one word on
    assert set(got) == {1, 2, 5, 8, 10}
    assert p.repeated_passages(df.limit(0)).count() == 0


def test_common_passage_and_many_copies(spark):
    passage = words(60, 1)
    rows = [(i, " ".join(words(40, 100 + i) + passage + words(30, 500 + i))) for i in range(150)]
    got = p.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.source_doc_id, r.start_word, r.end_word) for r in got) == [(i, 0, 40, 100) for i in range(1, 150)]


def test_query_finds_every_long_exact_repeat(spark):
    """Brute force over 50-word runs: a document with a run that an earlier document has must be reported, over that run."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    first, later = {}, defaultdict(list)
    for r in sorted(docs):
        w = r.text.encode().lower().split()
        for i in range(len(w) - 49):
            run = tuple(w[i : i + 50])
            if first.setdefault(run, r.doc_id) != r.doc_id:
                later[r.doc_id].append(i)
    spans = defaultdict(set)
    for r in p.op9_chaining(spark, "/root/testdata/sf0.01").collect():
        spans[r.doc_id].update(range(r.start_word, r.end_word))
    assert later and not [d for d, at in later.items() if not all(spans[d] >= set(range(i, i + 50)) for i in at)]


def test_passages_on_both_sides_of_a_gap(spark):
    """The chain bridges the gap and misses the identity as a whole; both exact passages are there nonetheless."""
    rows, want = [], {}
    for n, (size, gap, both) in enumerate([(60, 40, True), (60, 100, True), (60, 70, False), (100, 150, True), (300, 400, True), (300, 800, False)]):
        one, two = words(size, 900 + n), words(size, 920 + n)
        rows.append((2 * n, " ".join(words(20, 940 + n) + one + (words(gap, 960 + n) if both else []) + two)))
        rows.append((2 * n + 1, " ".join(words(30, 980 + n) + one + words(gap, 1000 + n) + two)))
        want[2 * n + 1] = {*range(30, 30 + size), *range(30 + size + gap, 30 + 2 * size + gap)}
    got = defaultdict(list)
    for r in p.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.source_doc_id == r.doc_id - 1 and r.matched_words >= 0.8 * max(r.end_word - r.start_word, r.source_end - r.source_start)
        got[r.doc_id] += range(r.start_word, r.end_word)
    assert set(got) == set(want) and all(len(v) == len(set(v)) and set(v) >= want[d] for d, v in got.items())
    assert {d: set(v) for d, v in got.items()} == want


def test_split_keeps_the_longest_part_that_reaches_the_identity():
    """30 words, 10 others, 30 words reach it together; a tail of short runs pulls the whole chain below."""
    one, two = words(30, 70), words(30, 71)
    tail = [words(8, 80 + i) for i in range(12)]
    x, y = (one + words(10, s) + two + [w for i, t in enumerate(tail) for w in words(9, s + 1 + i) + t] for s in (1100, 1200))
    hx, hy = (word_hashes(" ".join(t).encode()) for t in (x, y))
    at = np.flatnonzero(p.rolling(hx, p.K) == p.rolling(hy, p.K))
    got = p.align(hx, hy, at, at, 50, 0.8)
    assert got == [(0, 70, 0, 70, 60)]


def test_passages_edited_every_nine_words(spark):
    """Runs of eight equal words and no longer one: identity 0.89, and every pair must meet."""
    rows = []
    for n in range(40):
        passage = words(63, 2000 + n)
        edited = [f"edit{n}x{i}" if i % 9 == 8 else w for i, w in enumerate(passage)]
        rows += [(2 * n, " ".join(words(30, 2100 + n) + passage + words(30, 2200 + n))), (2 * n + 1, " ".join(words(20, 2300 + n) + edited + words(40, 2400 + n)))]
    got = p.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.source_doc_id, r.start_word, r.end_word, r.matched_words) for r in got) == [(2 * n + 1, 2 * n, 20, 82, 56) for n in range(40)]


def test_pieces_in_earlier_documents_do_not_hide_a_passage(spark):
    rows, want = [], []
    for n in range(20):
        text = words(70, 3000 + n)
        parts = [text[:49], text[21:], words(9, 3100 + n) + text, words(5, 3200 + n) + text + words(7, 3300 + n)]
        rows += [(4 * n + i, " ".join(t)) for i, t in enumerate(parts)]
        want.append((4 * n + 3, 4 * n + 2, 5, 75, 70))
    got = p.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.source_doc_id, r.start_word, r.end_word, r.matched_words) for r in got) == want


def test_many_short_pieces_do_not_hide_a_long_passage(spark):
    """A verbatim 200-word passage in two documents, of which earlier ones hold overlapping parts of 45 words."""
    rows, want = [], {}
    for n in range(10):
        text, at = words(200, 4000 + n), 100 * n
        rows += [(at + k, " ".join(words(8, 4100 + at + k) + text[lo : lo + 45] + words(9, 4200 + at + k))) for k, lo in enumerate(range(0, 200, 20))]
        rows += [(at + 50, " ".join(words(10, 4300 + n) + text + words(5, 4400 + n))), (at + 51, " ".join(words(6, 4500 + n) + text))]
        want[at + 51] = (at + 50, 6, 206)
    got = {r.doc_id: (r.source_doc_id, r.start_word, r.end_word) for r in p.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id % 100 == 51}
    assert got == want


def test_frequent_seeds_are_dealt_and_meet(spark, monkeypatch):
    passage = words(60, 1)
    rows = [(i, " ".join(words(40, 100 + i) + passage + words(30, 500 + i))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert p._frequent(docs)
    got = p.repeated_passages(docs).collect()
    assert sorted((r.doc_id, r.source_doc_id, r.start_word, r.end_word) for r in got) == [(i, 0, 40, 100) for i in range(1, 150)]
