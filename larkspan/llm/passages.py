"""Repeated passages by collinear chaining of shared k-mer seeds.

Seeds are runs of k words: those whose hash falls into one part of `SHARE`, whatever is around them, and where none of
`WINDOW` neighbouring runs does, the least of them. So two texts with k + WINDOW - 1 equal words in a row share a seed surely,
and edited texts share every seed that the edits leave whole. Occurrences of a seed are joined with its first occurrence (least id, then place), never with each other, so
a seed in thousands of documents makes a link for each and no more. Runs of consecutive seeds over `SPANS` words whose seeds all occur
earlier, but with first occurrences in several places, are joined with the first occurrence of the whole run too, so documents
that share it meet although earlier ones hold pieces of it. Pairs of documents with one match only are left: any 50 equal words have two seeds. A chain of four matches or less over less than half of `min_words` words is aligned only if two fifths of `min_words` words beside it are equal, place by place. Seeds that are frequent in a bounded sample of documents are dealt by document too, and
the first occurrences of the parts then meet, so no task sees all occurrences of one. For every pair of documents the matches are chained in
order in both, a chain's score being its seeds less a cost for the words skipped between them; a Fenwick tree over places
in the second text finds the best predecessor. Chains are aligned on the words: gaps by longest common subsequence, ends by
extension with an x-drop, so edited words do not end a passage. What has at least `min_words` words, of which `identity`
match, is a repeated passage; a chain that misses the identity as a whole is split into its longest parts that reach it.

Defined results: null texts and texts shorter than a seed have no passage; rows with a null id cannot be named and are left
out; an id stands for one text (repeated rows of it count once); a passage repeated inside one document is found too, with
the document as its own source; an empty table gives an empty result; other columns are not read; whole texts are used.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c
from ._words import all_word_hashes, rolling

K, WINDOW, SHARE = 6, 16, 3
SPANS = (44,)  # words from the first seed of a run to the last; 44 and a seed are 50 words
SAMPLE, SALTS = 4000, 64  # documents that tell frequent seeds, parts that these are dealt to
GAP = 0.02  # of a seed, for each word skipped in either text
DROP = 12  # words of score that an extension may lose


def seeds_at(kmers: np.ndarray, window: int = WINDOW, share: int = SHARE) -> np.ndarray:
    """Places of the seeds among the hashes of all runs of k words."""
    own = np.flatnonzero(kmers % np.uint64(share) == 0)
    edges = np.concatenate([[-1], own, [len(kmers)]])
    wide = np.flatnonzero(np.diff(edges) > min(window, max(1, len(kmers))))
    more = []
    for a, b in zip((edges[wide] + 1).tolist(), edges[wide + 1].tolist(), strict=True):  # rare
        part = kmers[a:b]
        if len(part) <= window:
            more.append(np.array([a + part.argmin()]))
        else:
            more.append(np.unique(np.lib.stride_tricks.sliding_window_view(part, window).argmin(1) + np.arange(len(part) - window + 1)) + a)
    return np.unique(np.concatenate([own, *more])) if more else own


def _seeds(docs: DataFrame) -> DataFrame:
    """h, doc, at: the seeds of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, ds, ats, size = [], [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                kmers = rolling(all_word_hashes(text), K)
                at = seeds_at(kmers)
                if len(at):
                    hs.append(kmers[at].view(np.int64))
                    ds.append(np.full(len(at), doc, np.int64))
                    ats.append(at)
                    size += len(at)
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs)), pa.array(np.concatenate(ds)), pa.array(np.concatenate(ats).astype(np.int32))], names=["h", "doc", "at"])
                    hs, ds, ats, size = [], [], [], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs)), pa.array(np.concatenate(ds)), pa.array(np.concatenate(ats).astype(np.int32))], names=["h", "doc", "at"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "h long, doc long, at int")


def _frequent(docs: DataFrame, most: int = 1000) -> list[int]:
    """Seeds that are more than a thousandth of all seeds of about SAMPLE documents: `most` at most. They only decide how occurrences are dealt to tasks."""
    share = SAMPLE / max(1, docs.count())
    u = F.xxhash64("doc_id", F.lit(9)) / F.lit(2.0**64) + 0.5
    counts = c.spool(_seeds(docs.where(u <= share)).groupBy("h").agg(F.count("*").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out = [r.h for r in counts.where(F.col("n") > max(20, total // most)).collect()]
    c.drop_spool(counts)
    return out


def _first_occurrence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by h, salt, doc, at -> x, y, px, py, h: each occurrence with the first of its h and salt (h null); firsts of salted ones with their h (y, py null)."""
    last = (None, 0, 0, 0)
    for batch in batches:
        h, salt, doc, at = (batch.column(i).to_numpy() for i in range(4))
        if not len(h):
            continue
        new = np.concatenate([[last[0] is None or h[0] != last[0] or salt[0] != last[3]], (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])])
        start = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
        y = np.where(start < 0, last[1], doc[np.maximum(start, 0)])
        py = np.where(start < 0, last[2], at[np.maximum(start, 0)]).astype(np.int32)
        last = (h[-1], y[-1], py[-1], salt[-1])
        other = (doc != y) | (at != py)
        head = new & (salt >= 0)
        if other.any() or head.any():
            use = other | head
            no = pa.array(head[use])
            yield pa.RecordBatch.from_arrays([pa.array(doc[use]), pa.array(y[use], mask=head[use]), pa.array(at[use]), pa.array(py[use], mask=head[use]), pa.array(h[use], mask=~no.to_numpy(zero_copy_only=False))], names=["x", "y", "px", "py", "h"])


def _matches(occurrences: DataFrame, frequent: list[int]) -> DataFrame:
    """x, y, px, py (spooled): each occurrence (h, doc, at) with the first of its h."""
    salt = F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")
    salt = F.when(F.col("h").isin(frequent), salt).otherwise(-1) if frequent else F.lit(-1)
    rows = occurrences.withColumn("salt", salt).repartition("h", "salt").sortWithinPartitions("h", "salt", "doc", "at").select("h", "salt", "doc", "at")
    met = c.spool(rows.mapInArrow(_first_occurrence, "x long, y long, px int, py int, h long"))
    found = met.where("h is null").drop("h")
    if not frequent:
        return found
    heads = met.where("h is not null").select("h", "x", "px")  # SALTS rows a frequent seed at most
    top = F.broadcast(heads.groupBy("h").agg(F.min(F.struct("x", "px")).alias("top")))
    heads = c.spool(heads.join(top, "h").select("x", "px", F.col("top.x").alias("tx"), F.col("top.px").alias("tp")))
    moved = found.join(F.broadcast(heads.withColumnsRenamed({"x": "y", "px": "py"})), ["y", "py"], "left")
    moved = moved.select("x", F.coalesce("tx", "y").alias("y"), "px", F.coalesce("tp", "py").alias("py"))
    return c.spool(moved.unionByName(heads.where("x <> tx or px <> tp").select("x", F.col("tx").alias("y"), "px", F.col("tp").alias("py"))))


_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xC2B2AE3D27D4EB4F


def _longer_runs(spans: tuple[int, ...]):  # noqa: ANN202
    """Rows sorted by x, px (each seed of x that has an earlier occurrence, with the first one) -> h, doc, at: runs of neighbouring seeds over so many
    words of which all occur earlier, but not all in one run of one document. Equal runs have equal first occurrences, so these and the distances name them."""

    def mixed(v: np.ndarray) -> np.ndarray:
        v = v.astype(np.uint64) * _MIX
        v ^= v >> np.uint64(32)
        return v * _MIX

    def work(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        x, y, px, py = cols
        step = np.diff(px)
        near = (np.diff(x) == 0) & (step <= WINDOW) & (step > 0)
        stretch = np.concatenate([[0], np.cumsum(~near)])
        turns = np.concatenate([[0], np.cumsum(~(near & (np.diff(y) == 0) & (np.diff(py) == step)))])
        place = px.astype(np.int64) + stretch * (1 << 34)
        name = mixed(y.astype(np.uint64) ^ mixed(py.astype(np.uint64) + np.uint64(1)))
        power, back = np.ones(len(x), np.uint64), np.ones(len(x), np.uint64)
        power[1:], back[1:] = _BASE, pow(_BASE, -1, 1 << 64)
        power, back = np.multiply.accumulate(power), np.multiply.accumulate(back)
        terms = (name + mixed(np.concatenate([[0], step]).astype(np.uint64) + np.uint64(7))) * power
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        for span in spans:
            j = np.searchsorted(place, place + span)
            i = np.flatnonzero(j < len(x))
            i = i[(stretch[j[i]] == stretch[i]) & (turns[j[i]] != turns[i])]
            if len(i):
                h = mixed((upto[j[i] + 1] - upto[i + 1]) * back[i] + name[i] + np.uint64(span))
                for end, at in ((h, px[i]), (mixed(h), px[i + 1])):  # two matches, so that they are a chain
                    yield pa.RecordBatch.from_arrays([pa.array(end.view(np.int64)), pa.array(x[i]), pa.array(at)], names=["h", "doc", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(4)]
            if not len(cols[0]):
                continue
            if held:
                cols = [np.concatenate(v) for v in zip(held, cols, strict=True)]
            cut = int(np.searchsorted(cols[0] == cols[0][-1], True))  # the last document may go on in the next batch
            if cut:
                yield from work([v[:cut] for v in cols])
            held = [v[cut:] for v in cols]
        if held:
            yield from work(held)

    return run


def chains(px: np.ndarray, py: np.ndarray, gap: float = GAP) -> list[np.ndarray]:
    """Disjoint best-first chains of matches (sorted by px, then py), as ascending indices.

    score(a) = 1 + max(0, score(b) - gap * (px_a - px_b + py_a - py_b)) over matches b before a in both texts.
    """
    n = len(px)
    if n == 1:
        return [np.array([0])]
    dx, dy = np.diff(px), np.diff(py)
    if (dx > 0).all() and (dx == dy).all():  # one diagonal: the predecessor is always the match before, unless too far
        return np.split(np.arange(n), np.flatnonzero(gap * (dx + dy) >= 1) + 1) if (gap * (dx + dy)).max() < 1 else _chain(px, py, gap)
    return _chain(px, py, gap)


def _chain(px: np.ndarray, py: np.ndarray, gap: float) -> list[np.ndarray]:
    n = len(px)
    places = sorted(set(py.tolist()))
    m = len(places)
    tree_v, tree_i = [-1e18] * (m + 1), [-1] * (m + 1)
    score, before = [1.0] * n, [-1] * n
    xs, ys = px.tolist(), py.tolist()
    a = 0
    while a < n:
        b = a
        while b < n and xs[b] == xs[a]:  # equal places of the first text do not precede each other
            r = bisect_left(places, ys[b])
            best, who = -1e18, -1
            while r > 0:
                if tree_v[r] > best:
                    best, who = tree_v[r], tree_i[r]
                r &= r - 1
            gain = best - gap * (xs[b] + ys[b])
            if gain > 0:
                score[b], before[b] = 1 + gain, who
            b += 1
        for k in range(a, b):
            v = score[k] + gap * (xs[k] + ys[k])
            r = bisect_left(places, ys[k]) + 1
            while r <= m:
                if v > tree_v[r]:
                    tree_v[r], tree_i[r] = v, k
                r += r & -r
        a = b
    used = [False] * n
    out = []
    for k in sorted(range(n), key=lambda k: (-round(score[k], 9), k)):  # equal scores in order of place
        run = []
        while k >= 0 and not used[k]:
            used[k] = True
            run.append(k)
            k = before[k]
        if run:
            out.append(np.array(run[::-1]))
    return out


def _chain_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by x, y, px, py -> x, y, px, py, sizes: the matches of each pair, chain after chain."""
    held: list[np.ndarray] = []

    def work(cols: list[np.ndarray]) -> pa.RecordBatch:
        x, y, px, py = cols
        keep = np.concatenate([[True], (np.diff(x) != 0) | (np.diff(y) != 0) | (np.diff(px) != 0) | (np.diff(py) != 0)])
        x, y, px, py = (v[keep] for v in cols)
        edges = np.flatnonzero(np.concatenate([[True], (np.diff(x) != 0) | (np.diff(y) != 0), [True]]))
        rows = []
        more = np.flatnonzero(np.diff(edges) > 1)  # pairs with one match are left
        for lo, hi in zip(edges[more].tolist(), edges[more + 1].tolist(), strict=True):
            parts = chains(px[lo:hi], py[lo:hi])
            order = np.concatenate(parts) + lo
            rows.append((int(x[lo]), int(y[lo]), px[order], py[order], np.array([len(p) for p in parts], np.int32)))
        a, b, p, q, s = zip(*rows, strict=True) if rows else ([],) * 5
        kind = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(p, kind), pa.array(q, kind), pa.array(s, kind)], names=["x", "y", "px", "py", "sizes"])

    for batch in batches:
        cols = [batch.column(i).to_numpy() for i in range(4)]
        if not len(cols[0]):
            continue
        if held:
            cols = [np.concatenate(v) for v in zip(held, cols, strict=True)]
        # the last pair may go on in the next batch
        tail = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
        cut = int(tail[-1]) + 1 if len(tail) else 0
        if cut:
            yield work([v[:cut] for v in cols])
        held = [v[cut:] for v in cols]
    if held and len(held[0]):
        yield work(held)


def _common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two short word runs."""
    if not len(a) or not len(b):
        return 0
    if len(a) == len(b) and (same := int((a == b).sum())) >= len(a) - 1:
        return same
    places: dict[int, int] = {}
    for i, w in enumerate(b.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    every = rest = (1 << len(b)) - 1  # a zero bit for each place of b where the length grows by one (Hyyro)
    for w in a.tolist():
        if at := rest & places.get(w, 0):
            rest = (rest + at | rest - at) & every
    return len(b) - rest.bit_count()


AHEAD = 8  # words that an extension may skip at once
#: Skips (words of a, of b) in the order in which they are tried.
_SKIPS = [(p, q) for t in range(1, AHEAD + 1) for p, q in [(t, t), *((t, s) for s in range(t - 1, -1, -1)), *((s, t) for s in range(t - 1, -1, -1))]]


def _extend(a: np.ndarray, b: np.ndarray, drop: int = DROP) -> tuple[int, int, int]:
    """How far a and b match from their starts: words of a, of b, and matching words. Runs of equal words score 1 each; a gap costs its longer side, and must be followed by two equal words."""
    i = j = score = matched = 0
    best = (0, 0, 0, 0)
    la, lb = len(a), len(b)
    while i < la and j < lb:
        n = min(la - i, lb - j)
        at, run = 0, 64
        while at < n:
            end = min(n, at + run)
            differ = a[i + at : i + end] != b[j + at : j + end]
            if differ[first := int(differ.argmax())]:
                at += first
                break
            at = end
            run *= 4
        i, j, score, matched = i + at, j + at, score + at, matched + at
        if score > best[0]:
            best = (score, i, j, matched)
        u, v = a[i : i + AHEAD + 2].tolist(), b[j : j + AHEAD + 2].tolist()
        u, v = list(zip(u, u[1:])), list(zip(v, v[1:]))  # two words in a row
        if set(u).isdisjoint(v):
            break
        p, q = next((p, q) for p, q in _SKIPS if p < len(u) and q < len(v) and u[p] == v[q])
        score -= max(p, q)
        if score < best[0] - drop:
            break
        i, j = i + p, j + q
    return best[1], best[2], best[3]


def _runs(hx: np.ndarray, hy: np.ndarray, px: np.ndarray, py: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """A chain as runs of equal words: starts and ends in x, in y, and the matching words up to each run's start and end, gaps by longest common subsequence."""
    dx, dy = np.diff(px), np.diff(py)
    skip = np.maximum(0, np.maximum(k - dx, k - dy))  # words of a seed that are in the alignment already
    new = np.flatnonzero((dx + skip > k) | (dy + skip > k)) + 1
    sx, sy = (np.concatenate([p[:1], p[new] + skip[new - 1]]) for p in (px, py))
    ex, ey = (np.concatenate([p[new - 1], p[-1:]]) + k for p in (px, py))
    lx, ly = sx[1:] - ex[:-1], sy[1:] - ey[:-1]
    gaps = np.zeros(len(lx), np.int64)
    level = np.flatnonzero((lx == ly) & (lx > 0))  # gaps of one length in both: words that match place by place, for all such gaps at once
    if len(level):
        n = lx[level]
        first = np.cumsum(n) - n
        at = np.arange(int(n.sum())) + np.repeat(ex[:-1][level] - first, n)
        gaps[level] = np.add.reduceat((hx[at] == hy[at + np.repeat(ey[:-1][level] - ex[:-1][level], n)]).astype(np.int64), first)
    for g in np.flatnonzero((lx > 0) & (ly > 0) & ((lx != ly) | (gaps < lx - 1))).tolist():
        gaps[g] = _common_subsequence(hx[ex[g] : sx[g + 1]], hy[ey[g] : sy[g + 1]])
    if (cut := (lx != ly) | (gaps < lx)).sum() < len(lx):  # runs with nothing but equal words between them are one
        sx, sy, ex, ey, gaps = sx[np.concatenate([[True], cut])], sy[np.concatenate([[True], cut])], ex[np.concatenate([cut, [True]])], ey[np.concatenate([cut, [True]])], gaps[cut]
    upto = np.cumsum(ex - sx + np.concatenate([[0], gaps]))
    return sx, ex, sy, ey, upto - (ex - sx), upto


def align(hx: np.ndarray, hy: np.ndarray, px: np.ndarray, py: np.ndarray, min_words: int, identity: float, k: int = K) -> list[tuple[int, int, int, int, int]]:
    """start and end in x, start and end in y, matching words of what one chain holds: all of it if it reaches `identity`, else its
    longest parts between runs that do, longest first and apart from each other."""
    a, b, u, v = int(px[0]), int(px[-1]) + k, int(py[0]), int(py[-1]) + k
    back, more = _extend(hx[:a][::-1], hy[:u][::-1]), _extend(hx[b:], hy[v:])
    if b + more[0] - a + back[0] < min_words:  # most chains end here
        return []
    sx, ex, sy, ey, before, upto = _runs(hx, hy, px, py, k)

    def extended(i: int, j: int, found: list[tuple[int, int, int, int, int]]) -> tuple[tuple[int, int, int, int, int], ...]:
        """Runs i to j with what extends them on both sides, on one side, on none; not into what is found already."""
        a, b, u, v, m = int(sx[i]), int(ex[j]), int(sy[i]), int(ey[j]), int(upto[j] - before[i])
        low_x, low_y = (min(s, max((f[n] for f in found if f[n] <= s), default=0)) for s, n in ((a, 1), (u, 3)))
        top_x, top_y = (max(e, min((f[n] for f in found if f[n] >= e), default=len(h))) for e, n, h in ((b, 0, hx), (v, 2, hy)))
        back, more = _extend(hx[low_x:a][::-1], hy[low_y:u][::-1]), _extend(hx[b:top_x], hy[v:top_y])
        none = (0, 0, 0)
        sides = sorted([(back, more), (back, none), (none, more), (none, none)], key=lambda s: -(s[0][0] + s[1][0]))
        return tuple((a - p[0], b + q[0], u - p[1], v + q[1], m + p[2] + q[2]) for p, q in sides)

    def same(g: tuple[int, int, int, int, int]) -> bool:
        return g[4] >= identity * max(g[1] - g[0], g[3] - g[2]) - 1e-9

    whole = (a - back[0], b + more[0], u - back[1], v + more[1], int(upto[-1]) + back[2] + more[2])
    if same(whole):
        return [whole]
    # runs i to j reach the identity where ends[:, j] >= starts[:, i]; behind `reach` no end can
    starts = np.stack([before - identity * sx, before - identity * sy]) - 1e-9
    ends = np.stack([upto - identity * ex, upto - identity * ey])

    def farthest(i: int, limit: int) -> int:
        while limit > i + 1:
            low = max(i, limit - 256)
            good = np.flatnonzero((ends[:, low:limit] >= starts[:, i : i + 1]).all(0))
            if len(good):
                return low + int(good[-1])
            limit = low
        return i

    reach = np.maximum.accumulate(ends[:, ::-1], 1)[:, ::-1]
    bound = [min(int(np.searchsorted(-reach[d], -starts[d, i], "right")) for d in (0, 1)) for i in range(len(sx))]
    heap = []

    def offer(i: int, limit: int) -> None:
        j = farthest(i, limit)
        heappush(heap, (int(sx[i] - ex[j]), i, j))

    for i, limit in enumerate(bound):
        offer(i, limit)
    taken: list[tuple[int, int]] = []
    found: list[tuple[int, int, int, int, int]] = []
    while heap:
        _, i, j = heappop(heap)
        at = bisect_left(taken, (i + 1, -1))
        if at and taken[at - 1][1] >= i:
            continue
        if at < len(taken) and taken[at][0] <= j:
            offer(i, taken[at][0])
            continue
        taken.insert(at, (i, j))
        if any(f[0] <= sx[i] and ex[j] <= f[1] and f[2] <= sy[i] and ey[j] <= f[3] for f in found):
            continue
        got = next((g for g in extended(i, j, found) if g[1] - g[0] >= min_words and same(g)), None)
        if got:
            found.append(got)
    return found


def _beside(hx: np.ndarray, hy: np.ndarray, px: np.ndarray, py: np.ndarray, reach: int) -> np.ndarray:
    """Equal words up to `reach` words before and behind each match, place by place."""
    no = np.zeros(reach, np.uint64)
    near = np.arange(2 * reach)
    return np.count_nonzero(np.concatenate([no, hx, no])[px[:, None] + near] == np.concatenate([~no, hy, ~no])[py[:, None] + near], axis=1)


def outermost(found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Passages that no other one of the two documents holds in both texts; equal ones once."""
    found = list(dict.fromkeys(found))
    if len(found) < 2:
        return found
    s, e, u, v = (np.array(x) for x in list(zip(*found, strict=True))[:4])
    return [f for i, f in enumerate(found) if not ((s <= s[i]) & (e >= e[i]) & (u <= u[i]) & (v >= v[i]) & ((s < s[i]) | (e > e[i]) | (u < u[i]) | (v > v[i]))).any()]


def _aligned(min_words: int, identity: float):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: OrderedDict[int, np.ndarray] = OrderedDict()
        weight = 0

        def hashes(doc: int, text: bytes) -> np.ndarray:
            nonlocal weight
            if doc in cache:
                cache.move_to_end(doc)
                return cache[doc]
            cache[doc] = h = all_word_hashes(c.unzip([text])[0])
            weight += len(h)
            while weight > 2_000_000 and len(cache) > 2:
                weight -= len(cache.popitem(last=False)[1])
            return h

        names = ["doc_id", "start_word", "end_word", "source_doc_id", "source_start", "source_end", "matched_words"]
        for batch in batches:
            rows = []
            ax, ay = (batch.column(i).flatten().to_numpy() for i in (2, 3))  # the matches of all pairs
            at = 0
            for x, y, sizes, tx, ty in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4, 5, 6)), strict=True):
                hx, hy = hashes(x, tx), hashes(y, ty)
                found: list[tuple[int, int, int, int, int]] = []
                end = at + np.cumsum(sizes)
                first, at = end - sizes, int(end[-1])
                short = np.flatnonzero((np.array(sizes) <= 4) & (ax[end - 1] - ax[first] < min_words // 2))
                tried = np.ones(len(end), bool)
                for part in np.split(short, range(1000, len(short), 1000)):
                    tried[part] = _beside(hx, hy, ax[first[part]], ay[first[part]], min_words) >= 0.4 * min_words
                for i, j in zip(first[tried].tolist(), end[tried].tolist(), strict=True):
                    a, b = ax[i:j], ay[i:j]
                    if any(s <= a[0] and a[-1] + K <= e and u <= b[0] and b[-1] + K <= v for s, e, u, v, _ in found):
                        continue  # an earlier chain's alignment holds this one
                    found += align(hx, hy, a, b, min_words, identity)
                rows += [(x, s, e, y, u, v, m) for s, e, u, v, m in outermost(found)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*rows, strict=True)], names=names)

    return run


def repeated_passages(docs: DataFrame, min_words: int = 50, identity: float = 0.8) -> DataFrame:
    """doc_id, start_word, end_word, source_doc_id, source_start, source_end, matched_words: passages that a document shares with an earlier one."""
    c.bounded_arrow(docs.sparkSession)
    matches = _matches(_seeds(docs), _frequent(docs))
    c.release(docs.sparkSession)
    runs = matches.repartition("x").sortWithinPartitions("x", "px").select("x", "y", "px", "py").mapInArrow(_longer_runs(SPANS), "h long, doc long, at int")
    longer = _matches(runs, [])
    c.release(docs.sparkSession)
    pairs = matches.unionByName(longer).repartition("x", "y").sortWithinPartitions("x", "y", "px", "py")
    chained = c.spool(pairs.select("x", "y", "px", "py").mapInArrow(_chain_pairs, "x long, y long, px array<int>, py array<int>, sizes array<int>"))
    c.release(docs.sparkSession)
    ids = c.spool(chained.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct())
    texts = c.texts_of(docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ids).dropDuplicates(["doc_id"])
    tx, ty = texts.select(F.col("doc_id").alias("x"), F.col("z").alias("tx")), texts.select(F.col("doc_id").alias("y"), F.col("z").alias("ty"))
    rows = chained.join(tx, "x").join(ty, "y").select("x", "y", "px", "py", "sizes", "tx", "ty")
    return rows.mapInArrow(_aligned(min_words, identity), "doc_id long, start_word long, end_word long, source_doc_id long, source_start long, source_end long, matched_words long")


def op9_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that a document shares with an earlier one, edits included."""
    return repeated_passages(c.documents(spark, sf_dir).select("doc_id", "text"))
