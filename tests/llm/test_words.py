import random

import numpy as np

from larkspan.llm import _words as w
from larkspan.llm import passages as p


def test_hashes_of_all_words_tell_the_same_words_apart():
    r, names = random.Random(5), {}
    texts = [bytes(r.choice(b"abABz \n\t\x0b\x00\xc3\xa9") for _ in range(n)) for n in [*range(60), 3000, 70_000, 200_000]]
    texts += [b"x" * 100_000 + b" ab a " + b"y" * 40, b"ab " * 30_000 + b"Q" * 70_000 + b" ab", b"q" * w.BLOCK + b" a", b" " * 100_000, b"ab " + b"r" * (w.BLOCK - 3) + b" b", b"k" * 40 + b" " + b"K" * 40, b"x\xa0\x85 y \x1c z", None]
    for text in texts:
        for h, word in zip(w.all_word_hashes(text).tolist(), (text or b"").lower().split(), strict=True):
            assert names.setdefault(h, word) == word and names.setdefault(word, h) == h


def test_common_subsequence_against_the_table():
    rng = np.random.default_rng(1)
    for _ in range(500):
        a, b = (rng.integers(0, rng.integers(2, 12), rng.integers(0, n)).astype(np.uint64) for n in (20, 90))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
            row = new
        assert p._common_subsequence(a, b) == row[-1]


def test_chains_that_stay_short_are_not_aligned_word_by_word(monkeypatch):
    """Their ends are looked for first; before, runs and gaps of every chain were compared."""
    rng = np.random.default_rng(2)
    x, y = (rng.integers(0, 1 << 60, 300).astype(np.uint64) for _ in range(2))
    x[100:120] = y[50:70]
    monkeypatch.setattr(p, "_runs", None)
    at = np.arange(15)
    assert p.align(x, y, 100 + at, 50 + at, 50, 0.8) == []


def test_equal_words_beside_matches():
    x, y = np.array([1, 2, 3, 4, 5], np.uint64), np.array([9, 1, 2, 7, 4], np.uint64)
    assert p._beside(x, y, np.array([0, 4]), np.array([1, 0]), 3).tolist() == [2, 0]
    assert p._beside(x, y, np.array([1]), np.array([2]), 50).tolist() == [3]
