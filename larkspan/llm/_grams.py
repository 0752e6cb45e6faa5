"""Hashed n-gram counts of whole texts, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

_MULT = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1], np.uint32)
#: Units of one slice of a long text; slices overlap, so no n-gram is lost.
SLICE = 400_000


def groups(sizes: list[int], rows: int, units: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most `rows` texts and about `units` units; one long text stands alone."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and (i - lo >= rows or total + n > units):
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


@cache
def letters() -> np.ndarray:
    """Code point -> itself if it is a letter, else 0."""
    return np.array([i if chr(i).isalpha() else 0 for i in range(0x110000)], np.uint32)


def hashed(units: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Hash of the n units that start at each place (the last n-1 places have none)."""
    m = len(units) - n + 1
    if m <= 0:
        return np.zeros(0, np.int32)
    h = units[:m] * _MULT[0]
    for k in range(1, n):
        h = (h ^ units[k : k + m]) * _MULT[k]
    h = (h ^ h >> np.uint32(15)) * _MULT[n - 1]
    return (h >> np.uint32(32 - bits)).astype(np.int32)
