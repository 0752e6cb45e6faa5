"""Every stage on what the one before kept, against brute force on the same rows."""

import re
from collections import defaultdict

import numpy as np

import corpus_pipeline
from larkspan.llm import _common, packing
from tests.llm.test_jaccard import brute as near
from tests.llm.test_linedup import brute as dedup
from tests.llm.test_mixing import brute_targets
from tests.llm.test_rules import brute as stats

SF = "/root/testdata/sf0.01"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_stages(spark):
    docs = _common.documents(spark, SF)
    cols, at = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()] if name != "quality" else [tuple(r) for r in docs.collect()]
        docs = _common.spool(stage(spark, docs, SF))
        at[name] = (before, [tuple(r) for r in docs.collect()])
        assert name == "pack" or docs.columns == cols
    before, after = at["quality"]
    # few labels at this size: no cutoff is sure, the base rule alone decides
    assert sorted(after) == sorted(r for r in before if not stats(r[1])[-1])
    before, after = at["lines"]
    want = dedup([(r[0], r[1]) for r in before], 2)
    assert {(r[0], r[1]) for r in after} == {(r[0], want[r[0], r[1]][3]) for r in before if len(want[r[0], r[1]][2]) < want[r[0], r[1]][0]}
    assert all(r[4] == len(r[1]) for r in after)
    before, after = at["near_copies"]
    least = near([(r[0], r[1]) for r in before])
    assert sorted(after) == sorted(r for r in before if least[r[0]][1] == r[0])
    before, after = at["mix"]
    size, taken = defaultdict(int), defaultdict(int)
    for r in before:
        size[r[3]] += words(r[1])
    for r in after:
        taken[r[3]] += words(r[1])
    goal = brute_targets(size, [5.0, 2.0, 1.0], 1.5, 2.0)
    assert set(after) <= set(before) and all(abs(taken[s] - goal[s]) <= 0.02 * size[s] for s in size)
    before, after = at["pack"]
    assert sum(r[3] for r in after) == sum(words(r[1]) for r in before)
    counts = np.zeros(2049, np.int64)
    for r in before:
        for lo in range(0, words(r[1]), 2048):
            counts[min(2048, words(r[1]) - lo)] += 1
    bounds = packing.best_bounds(counts, 16)
    assert sum(r[8] for r in after) == sum(n * (min(b for b in bounds if b >= k) - k) for k, n in enumerate(counts) if n)


def test_run_on_smallest_tables(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
