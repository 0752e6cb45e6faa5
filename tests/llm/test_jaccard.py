import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.llm import _common as c
from larkspan.llm import jaccard


def brute(rows):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and min(len(x), len(y)) * 4 >= max(len(x), len(y)) * 3 and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[find(a)] = min(least.get(find(a), i), i)
    return {i: (len(s), least[find(a)]) for a, (i, s) in enumerate(sets)}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()}


def near_copies(n, seed, words=60):
    r = random.Random(seed)
    base = [f"w{r.randrange(500)}" for _ in range(words)]
    for _ in range(n):
        w = base[:]
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = f"e{r.randrange(99)}"
        yield " ".join(w)


def cases():
    out = [t for k in range(20) for t in near_copies(6, k)]
    out += [None, "", "a b", "A b", "a b c d e", "a  B c d e\n", "a b c d f", " ".join(f"x{i}" for i in range(30_000)), " ".join(f"x{i}" for i in range(29_000))]
    passage = " ".join(f"p{i}" for i in range(30))
    r = random.Random(5)
    out += [" ".join(f"q{r.randrange(10**6)}" for _ in range(40)) + " " + passage for _ in range(80)]
    return list(enumerate(out, 10))


def test_cases_against_brute_force(spark):
    rows = cases()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).repartition(5)
    assert got(df) == brute(rows)


@pytest.mark.parametrize(("most", "near"), [(8, 4), (40, 4096)])
def test_large_regions(spark, most, near):
    """Far and near copies, chains of copies of copies, and unlinked texts around one passage."""
    r = random.Random(3)
    chain = [f"c{i}" for i in range(60)]
    texts = [t for k in range(3) for t in near_copies(60, k)]
    for i in range(60):
        chain = chain[2:] + [f"d{i}", f"e{i}"]
        texts.append(" ".join(chain))
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [" ".join(f"q{r.randrange(10**6)}" for _ in range(30)) + " " + passage for _ in range(40)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    c.bounded_arrow(spark)
    sets = jaccard._sets(docs)
    roots = {r.node: r.root for r in jaccard.components(jaccard.links(docs, sets, jaccard._keys(sets), most, near)).collect()}
    key = {r.doc_id: r.key for r in sets.where("n is not null").collect()}
    want = brute(rows)
    ours, theirs = {}, {}
    for i, _ in rows:
        ours.setdefault(roots.get(key[i], key[i]), set()).add(i)
        theirs.setdefault(want[i][1], set()).add(i)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_parts_hold_every_possible_link():
    """Labels against all pairs, with pivots, windows and recursion."""
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 2**62, rng.choice([30, 150, 1000, 1100, 9000])).astype(np.uint64)
        sets += [np.unique(np.concatenate([base[rng.random(len(base)) > 0.06], rng.integers(0, 2**62, 4).astype(np.uint64)])) for _ in range(rng.integers(1, 12))]
    n = np.array([len(x) for x in sets])
    counts = [jaccard._counts(x) for x in sets]
    assert set(map(len, counts)) == {128, 1024, 8192}
    label = jaccard._joined_parts(n, counts, np.arange(len(n)))
    linked = 0
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if 4 * both >= 3 * (len(a) + len(sets[j]) - both):
                linked += 1
                assert label[i] == label[j]
    assert linked > 50 and len(set(label.tolist())) > 30


def test_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.op7_jaccard(spark, "/root/testdata/sf0.01").collect()} == brute(rows)


def test_null_ids_repeats_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (None, "other words than those"), (7, None)], "doc_id long, text string")
    rows = sorted(map(tuple, jaccard.near_duplicates(df).collect()), key=str)
    assert rows == sorted([(5, 36, 5), (5, 36, 5), (None, 36, 5), (None, 1, None), (7, 0, 7)], key=str)
    assert jaccard.near_duplicates(df.limit(0)).count() == 0
    kept = jaccard.one_of_each(df.withColumn("n", F.lit(1)).withColumn("row", F.lit(2)).withColumn("a.b", F.lit(3)))
    assert kept.columns == ["doc_id", "text", "n", "row", "a.b"] and kept.where("doc_id = 5").count() == 1 and kept.where("doc_id = 7").count() == 1
