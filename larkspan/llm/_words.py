"""Words and shingles as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_MUL = np.uint64(0x9E3779B97F4A7C15)
_hash = xxhash.xxh3_64_intdigest


def word_hashes(text: bytes | None) -> np.ndarray:
    """Hash of each word of the text in lower case (A-Z only)."""
    words = (text or b"").lower().split()
    return np.fromiter(map(_hash, words), np.uint64, len(words))


#: Texts are hashed in blocks of so many bytes at most, cut at blanks; words of more than LONG bytes one by one.
BLOCK, LONG = 1 << 15, 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_VALUE = np.random.Generator(np.random.PCG64(12)).integers(1, 1 << 64, 256, np.uint64)
_VALUE[65:91] = _VALUE[97:123]
_POWER, _BACK = (np.full(BLOCK, x, np.uint64) for x in (0xC2B2AE3D27D4EB4F, pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64)))
for _x in (_POWER, _BACK):
    _x[0] = 1
    np.multiply.accumulate(_x, out=_x)


def _block_hashes(text: bytes) -> np.ndarray:
    b = np.frombuffer(text, np.uint8)
    gap = np.ones(len(b) + 2, bool)
    gap[1:-1] = _BLANK[b]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edges[::2], edges[1::2]
    upto = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_VALUE[b] * _POWER[: len(b)], out=upto[1:])
    h = (upto[end] - upto[start]) * _BACK[start]
    h ^= h >> np.uint64(32)
    h *= _MUL
    h ^= h >> np.uint64(29)
    for i in np.flatnonzero(end - start > LONG).tolist():
        h[i] = _hash(text[start[i] : end[i]].lower())
    return h


def all_word_hashes(text: bytes | None) -> np.ndarray:
    """A hash of each word of the text in lower case (A-Z only), as `word_hashes` but other ones: polynomials over random values of
    the bytes, for all words of a block at once."""
    text, parts, at = text or b"", [], 0
    while len(text) - at > BLOCK:
        end = max(text.rfind(x, at, at + BLOCK) for x in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if end <= at:  # a word that is longer than a block
            words = text[at:].lower().split()
            return np.concatenate([*parts, np.fromiter((_hash(w) if len(w) > LONG else _block_hashes(w)[0] for w in words), np.uint64, len(words))])
        parts.append(_block_hashes(text[at:end]))
        at = end
    parts.append(_block_hashes(text[at:]))
    return np.concatenate(parts) if len(parts) > 1 else parts[0]


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that start at each word."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    acc = h[:m].copy()
    for k in range(1, n):
        acc ^= acc >> np.uint64(29)
        acc *= _MUL
        acc += h[k : k + m]
    acc ^= acc >> np.uint64(32)
    acc *= _MUL
    acc ^= acc >> np.uint64(29)
    return acc


def shingles(text: bytes | None, n: int = 5) -> np.ndarray:
    """Sorted distinct n-word shingles; a shorter text is one shingle; a text without words has none."""
    h = word_hashes(text)
    return np.unique(rolling(h, min(n, len(h)))) if len(h) else h
