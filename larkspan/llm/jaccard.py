"""Exact Jaccard self-join of five-word shingle sets as a metric-space join (distance 1 - Jaccard, radius tau = 1/4).

1. Equal sets become one point, kept by a 64-bit hash of the set, with its size and its counts of shingles in hash buckets, in proportion to its size.
2. Anchors. Nearly all points are at distance 1 from any given document, so document pivots cannot tell them apart; this is the exact
   route for them. Two sets are nearer than 1 only if they share a shingle. With all shingles in one order (frequent ones
   last), sets within tau share one among their first n - ceil(3n/4) + 1: a set is replicated to these regions and no others.
   A region is parted where sizes leave a gap that no link can bridge; the first point of each part is its pivot, and parts
   with one pivot become that pivot's region, so a pair within tau meets in at least one.
3. Counts. The sum of absolute differences of two points' counts is a metric, and at most the size of their symmetric
   difference, which for a link is at most a seventh of both sizes together. In that space every region is joined by pivots: points
   go to the Voronoi cell of the nearest pivot, and to every other cell whose pivot is not farther by more than twice the radius
   of a link (triangle inequality), cell by cell and recursively. What can be linked stays together as a smaller
   region; the rest leaves without its text having been moved.
4. Texts. A region of at most `most` points is joined in one task by exact intersection sizes. A larger one gets sampled document
   pivots and exact distances: links to pivots are taken, points go to the cell of the nearest pivot and, within the window of
   2 tau, to others; points within tau of a cell's pivot are linked through it and stay only if a point beyond tau could reach them. Cells are
   regions again and join recursively. A cell with over three quarters of its region (pivots do not tell its points apart) is joined
   in pairs of blocks instead, and so is a region whose cells have as many pairs as itself.
5. Every task gives a spanning forest of its exact links. Regions overlap where many points are near each other, so step 4 first takes
   each point in its largest region only; then connected components are found, and regions go through step 3 again for
   what can be linked across components. Cells of large regions do the same, until no region is left.

The order of step 2 affects speed only; all links are decided by exact intersection sizes of
64-bit shingle hashes. The list of frequent shingles is a bounded hint of at most `HOT` entries.

Defined results: texts without words have no shingles and are alone in their component; rows of equal sets are in one
component; rows with a null id are given the component of the ids they equal in set (null if none) and link no others;
an id stands for one text (repeated rows are harmless); other columns are not read.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c
from ._graph import components
from ._words import shingles

HOT = 1 << 20
WINDOW = 4_000_000  # shingles among which repeats are noticed
BUCKETS = 128  # of sets up to 1,024 shingles; eight times as many up to eight times the size, and so on
PIVOTS = 8
TAU = 0.25


def _key(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _counts(s: np.ndarray) -> bytes:
    """Shingles by bucket, each count cut at 255 (which keeps differences a lower bound). An eighth as many buckets are sums of these."""
    buckets = BUCKETS
    while len(s) > 8 * buckets:
        buckets *= 8
    return np.minimum(np.bincount((s >> np.uint64(32)).astype(np.int64) % buckets, minlength=buckets), 255).astype(np.uint8).tobytes()


def _sets(docs: DataFrame) -> DataFrame:
    """Spooled rows: doc_id, key, n (key null and n 0 without words), counts, and with a null n the shingles (in key) that repeat within a window, with their count in times."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        size = 0

        def repeats(id_type: pa.DataType) -> pa.RecordBatch:
            nonlocal size
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            many = counts > 1
            held.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.nulls(int(many.sum()), id_type), pa.array(values[many].view(np.int64)), pa.nulls(int(many.sum()), pa.int64()), pa.array(counts[many]), pa.nulls(int(many.sum()), pa.binary())], names=["doc_id", "key", "n", "times", "counts"])

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            keys, ns, counted = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                s = shingles(text)
                k = _key(s) if len(s) else None
                keys.append(k)
                ns.append(len(s))
                counted.append(_counts(s) if len(s) else None)
                if k is not None and k not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(k)
                    held.append(s)
                    size += len(s)
                    if size > WINDOW:
                        yield repeats(id_type)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(ns, pa.int64()), pa.nulls(len(ns), pa.int64()), pa.array(counted, pa.binary())], names=["doc_id", "key", "n", "times", "counts"])
        if held:
            yield repeats(id_type)

    return c.spool(docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind.simpleString()}, key long, n long, times long, counts binary"))


def _keys(sets: DataFrame) -> DataFrame:
    """Spooled: each distinct set's key, size, counts, number of rows and least id."""
    return c.spool(sets.where("n > 0").groupBy("key").agg(F.max("n").alias("size"), F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("counts").alias("counts")))


def _prefixes(docs: DataFrame, hot: np.ndarray, times: np.ndarray) -> DataFrame:
    """s, n, key: each set's first shingles in the order (times, hash), with its size; a set comes once from each task."""
    shared = docs.sparkSession.sparkContext.broadcast((hot, times))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, times = shared.value
        seen: set[int] = set()
        for batch in batches:
            firsts, keys, counts, sizes = [], [], [], []
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                s = shingles(text)
                if not len(s) or (k := _key(s)) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(k)
                q = len(s) + (-3 * len(s) // 4) + 1
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                    often = np.where(hot[at] == s, times[at], 0)
                    if often[:q].any():
                        s = s[np.argsort(often, kind="stable")]
                firsts.append(s[:q])
                keys.append(k)
                counts.append(q)
                sizes.append(len(s))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(firsts).view(np.int64)), pa.array(np.repeat(np.array(sizes, np.int32), counts)), pa.array(np.repeat(np.array(keys, np.int64), counts))], names=["s", "n", "key"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "s long, n int, key long")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by s, n, key -> p, x: the first key of each region with each of its others.

    An anchor's region ends where the next size is more than a third above the last: no set on one side can be linked to
    one on the other (the size is the distance from the empty set, by symmetric difference).
    """
    last = None  # s and n of the last row, and its region's pivot
    for batch in batches:
        s, n, key = (batch.column(i).to_numpy() for i in range(3))
        if not len(s):
            continue
        n = n.astype(np.int64)
        first = last is None or s[0] != last[0] or 4 * last[1] < 3 * n[0]
        new = np.concatenate([[first], (s[1:] != s[:-1]) | (4 * n[:-1] < 3 * n[1:])])
        start = np.maximum.accumulate(np.where(new, np.arange(len(s)), -1))
        p = np.where(start < 0, last[2] if last else 0, key[np.maximum(start, 0)])
        last = (s[-1], n[-1], p[-1])
        other = p != key
        if other.any():
            pairs = np.unique(np.stack([p[other], key[other]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["p", "x"])


def _by_group(work: Callable[[int, list[int], list[np.ndarray]], Iterator[tuple]], names: list[str]) -> Callable:
    """Rows (g, x, z) sorted by g -> what `work` gives for each g, its keys and shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: OrderedDict[int, np.ndarray] = OrderedDict()
        weight = 0
        out: list[tuple] = []

        def set_of(key: int, text: bytes) -> np.ndarray:
            nonlocal weight
            if key in cache:
                cache.move_to_end(key)
                return cache[key]
            cache[key] = s = shingles(c.unzip([text])[0])
            weight += len(s)
            while weight > 2_000_000 and len(cache) > 1:
                weight -= len(cache.popitem(last=False)[1])
            return s

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=names)

        def done(group: int, rows: dict[int, np.ndarray]) -> None:
            keys = sorted(rows)
            out.extend(work(group, keys, [rows[k] for k in keys]))

        group, rows = None, {}
        for batch in batches:
            for g, x, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if g != group:
                    if rows:
                        done(group, rows)
                    group, rows = g, {}
                s = set_of(x, text)
                if len(s) and _key(s) == x:
                    rows[x] = s
            if len(out) > 2000:
                yield flush()
        if rows:
            done(group, rows)
        if out:
            yield flush()

    return run


def _forest(_group: int, keys: list[int], sets: list[np.ndarray]) -> Iterator[tuple]:
    """(u, v) edges of a spanning forest of the exact links among the sets."""
    m = len(keys)
    sizes = np.array([len(s) for s in sets])
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        if 4 * both >= 3 * (sizes.sum() - both):
            yield keys[0], keys[1]
        return
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    own = np.repeat(np.arange(m), sizes)
    shared = times[at] > 1
    if not shared.any():
        return
    at = np.cumsum(times > 1)[at] - 1
    both = np.zeros((m, m), np.float32)
    width = int(at[shared].max()) + 1
    step = max(1, 16_000_000 // m)
    for lo in range(0, width, step):
        use = shared & (at >= lo) & (at < lo + step)
        x = np.zeros((m, min(step, width - lo)), np.float32)
        x[own[use], at[use] - lo] = 1
        both += x @ x.T
    linked = 4 * both >= 3 * (sizes[:, None] + sizes[None, :] - both)
    root = np.full(m, -1)
    for i in range(m):
        if root[i] >= 0:
            continue
        root[i] = i
        todo = [i]
        while todo:
            near = np.flatnonzero(linked[todo.pop()] & (root < 0))
            root[near] = i
            todo += near.tolist()
            for j in near.tolist():
                yield keys[i], keys[j]


def _joined_parts(n: np.ndarray, counts: list[bytes], known: np.ndarray) -> np.ndarray:
    """Labels of the components of the graph of possible links between points not known to be in one component: sizes within 3/4, and counts that differ by a seventh of both sizes at most."""
    label = np.arange(len(n))
    buckets = np.array([len(x) for x in counts])
    for level in np.unique(buckets).tolist():
        # a link joins points of one level, or of this and the next one
        at = np.flatnonzero((buckets == level) | (buckets == 8 * level))
        folded = np.stack([np.frombuffer(counts[i], np.uint8).reshape(-1, level).sum(0, dtype=np.int16) for i in at])
        if len(at) > 1:
            _join_level(n[at], folded, known[at], buckets[at] == level, at, label)
    return label


def _join_level(n: np.ndarray, counts: np.ndarray, known: np.ndarray, own: np.ndarray, place: np.ndarray, label: np.ndarray) -> None:
    """Join what can be linked among points of one number of buckets, where one of two is of this level itself. Pivots, Voronoi cells and windows in the space of counts, recursively."""

    def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty((len(a), len(b)), np.int32)
        step = max(1, 2_000_000 // (len(a) * counts.shape[1]))
        for lo in range(0, len(b), step):
            out[:, lo : lo + step] = np.abs(counts[a][:, None] - counts[b[lo : lo + step]][None]).sum(2, dtype=np.int32)
        return out

    def compare(idx: np.ndarray) -> None:
        for lo in range(0, len(idx), 16):
            a = idx[lo : lo + 16]
            x, y = n[a][:, None], n[idx][None]
            i, j = np.nonzero((known[a][:, None] != known[idx][None]) & (own[a][:, None] | own[idx][None]) & (4 * np.minimum(x, y) >= 3 * np.maximum(x, y)) & (7 * apart(a, idx) <= x + y))
            link(place[a[i]], place[idx[j]])

    def link(u: np.ndarray, v: np.ndarray) -> None:
        """Give linked points, and all that had their labels, the least label."""
        while len(u):
            a, b = label[u], label[v]
            differ = a != b
            if not differ.any():
                return
            u, v, a, b = u[differ], v[differ], a[differ], b[differ]
            to = np.arange(len(label))
            np.minimum.at(to, np.maximum(a, b), np.minimum(a, b))
            label[:] = to[label]

    todo = [np.arange(len(n))]
    while todo:
        idx = todo.pop()
        if len(idx) <= 64:
            compare(idx)
            continue
        pivots = [0]
        far = apart(idx[:1], idx).T
        while len(pivots) < PIVOTS and far.min(1).max() > 0:  # farthest first
            pivots.append(int(far.min(1).argmax()))
            far = np.concatenate([far, apart(idx[pivots[-1:]], idx).T], 1)
        window = 2 * (2 * int(n[idx].max()) / 7)
        cells = [idx[far[:, k] - far.min(1) <= window] for k in range(len(pivots))]
        if max(map(len, cells)) > 0.75 * len(idx):
            compare(idx)
        else:
            todo += [x for x in cells if len(x) > 1]


def _subregions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, flat, x, n, root, counts) sorted by g -> g, x, flat: what can be linked within each region, named by the hash of its points."""
    held: list[tuple[np.ndarray, ...]] = []

    def work(x: np.ndarray, n: np.ndarray, root: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        x, at = np.unique(x, return_index=True)
        if len(x) < 2 or (root[at] == root[at[0]]).all():
            return
        label = _joined_parts(n[at], counts[at].tolist(), root[at])
        order = np.argsort(label, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], np.diff(label[order]) != 0, [True]]))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if hi - lo > 1:
                keys = x[order[lo:hi]]  # sorted, as x is
                yield np.full(hi - lo, xxhash.xxh3_64_intdigest(keys.tobytes()) - (1 << 63)), keys

    def flush(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        g, flat = cols[:2]
        edges = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]]))
        out = [(*r, np.full(len(r[0]), flat[lo])) for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) for r in work(*(v[lo:hi] for v in cols[2:]))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in zip(*out, strict=True)], names=["g", "x", "flat"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = (*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)), np.array([*batch.column(5).to_pylist(), None], object)[:-1])
        held.append(cols)
        if cols[0][0] == cols[0][-1] and held[0][0][0] == cols[0][0]:
            continue  # one region so far
        cols = [np.concatenate(v) for v in zip(*held, strict=True)]
        cut = int(np.searchsorted(cols[0] == cols[0][-1], True))  # the last region may go on in the next batch
        yield from flush([v[:cut] for v in cols])
        held = [tuple(v[cut:] for v in cols)]
    if held:
        yield from flush([np.concatenate(v) for v in zip(*held, strict=True)])


def _narrowed(regions: DataFrame, points: DataFrame, near: int) -> DataFrame:
    """regions: g, x, flat; points: x, n, counts, root -> the same (spooled) of what can be linked across roots. A region of more than `near` points goes whole, if it has two roots."""
    regions = c.spool(regions)
    sizes = c.spool(regions.groupBy("g").agg(F.count("*").alias("points")).where("points > 1"))
    rows = regions.join(sizes, "g").join(points, "x")
    small = rows.where(F.col("points") <= near).select("g", "flat", "x", "n", "root", "counts").repartition("g").sortWithinPartitions("g")
    out = small.mapInArrow(_subregions, "g long, x long, flat boolean")
    if sizes.where(F.col("points") > near).limit(1).count():
        large = rows.where(F.col("points") > near)
        mixed = large.groupBy("g").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("g")
        out = out.unionByName(large.select("g", "x", "flat").join(mixed, "g"))
    out = c.spool(out.groupBy("g", "x").agg(F.max("flat").alias("flat")))
    c.drop_spool(regions, sizes)
    return out


def _texts(docs: DataFrame, keys: DataFrame, used: DataFrame) -> DataFrame:
    """x, z: the compressed texts of the used keys."""
    ids = c.spool(used.join(keys.where("least is not null").select("key", F.col("least").alias("doc_id")), "key"))
    return c.texts_of(docs, ids).select(F.col("key").alias("x"), "z")


def _grouped(members: DataFrame, texts: DataFrame, work: Callable, names: list[str]) -> DataFrame:
    """members: g, x."""
    rows = members.join(texts, "x").select("g", "x", "z").repartition("g").sortWithinPartitions("g")
    return rows.mapInArrow(_by_group(work, names), ", ".join(f"{n} long" for n in names))


def _to_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, g, x, z, q) sorted by h, pivots (q their number) before points (q null) -> g, x, q, pivot, far, linked: each point with the nearest pivot, and with those that the window of 2 tau reaches."""
    group, pivots = None, {}
    for batch in batches:
        out = []
        for h, g, x, text, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), c.unzip(batch.column(3).to_pylist()), batch.column(4).to_pylist(), strict=True):
            if h != group:
                group, pivots = h, {}
            s = shingles(text)
            if not len(s) or _key(s) != x:
                continue
            if q is not None:
                pivots[q] = (x, s)
                continue
            both = {k: (p, len(np.intersect1d(s, t, assume_unique=True)), len(s) + len(t)) for k, (p, t) in pivots.items()}
            far = {k: 1 - b / (n - b) for k, (_, b, n) in both.items()}
            least = min(far.values(), default=0.0)
            out += [(g, x, k, p, far[k], 4 * b >= 3 * (n - b)) for k, (p, b, n) in both.items() if far[k] - least <= 2 * TAU + 1e-9]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.bool_()], strict=True)], names=["g", "x", "q", "pivot", "far", "linked"])


def _voronoi(regions: DataFrame, texts: DataFrame, most: int, turn: int) -> tuple[DataFrame, DataFrame]:
    """regions: g, x, size (spooled) -> links to pivots (u, v); the cells as regions (g, x, flat), flat where pivots do not part a region; the region itself, flat, where its cells have as many pairs."""
    chosen = regions.groupBy("g").agg(F.max("size").alias("size"), F.array(*[F.min_by("x", F.xxhash64("x", F.lit(turn * PIVOTS + k))) for k in range(PIVOTS)]).alias("qs"))
    parts = F.ceil(F.col("size") / most).cast("long")
    points = regions.select("g", "x", F.pmod(F.xxhash64("x", F.lit(turn)), parts).alias("part"), F.lit(None).cast("int").alias("q"))
    pivots = chosen.select("g", "size", F.posexplode(F.array_distinct("qs")).alias("q", "x")).select("g", "x", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), "q")
    rows = points.unionByName(pivots).join(texts, "x").select(F.xxhash64("g", "part").alias("h"), "g", "x", "z", "q")
    met = c.spool(rows.repartition("h").sortWithinPartitions("h", F.asc_nulls_last("q")).mapInArrow(_to_pivots, "g long, x long, q int, pivot long, far double, linked boolean"))
    links = met.where("linked and pivot <> x").select(F.col("pivot").alias("u"), F.col("x").alias("v"))
    edge = met.where("not linked").groupBy("g", "q").agg(F.min("far").alias("edge"))
    cells = met.join(edge, ["g", "q"]).where(F.col("far") >= F.col("edge") - TAU - 1e-9).select("g", "q", "x")
    sizes = c.spool(cells.groupBy("g", "q").agg(F.count("*").alias("cell")).join(chosen.select("g", "size"), "g"))
    # cells with as many pairs as their region do not part it: it goes on once, instead of as copies of itself
    whole = sizes.groupBy("g").agg(F.sum(F.col("cell") * F.col("cell")).alias("pairs"), F.max("size").alias("size")).where(F.col("pairs") >= F.col("size") * F.col("size")).select("g")
    parted = sizes.join(whole, "g", "left_anti").select("g", "q", (4 * F.col("cell") > 3 * F.col("size")).alias("flat"))
    out = cells.join(parted, ["g", "q"]).select(F.xxhash64("g", "q", F.lit(turn)).alias("g"), "x", "flat")
    return links, out.unionByName(regions.join(whole, "g").select(F.xxhash64("g", F.lit(-1), F.lit(turn)).alias("g"), "x", F.lit(True).alias("flat")))


def _blocks(regions: DataFrame, most: int, turn: int) -> DataFrame:
    """regions: g, x, size -> g, x: pairs of blocks of about half of `most` points."""
    n = F.ceil(F.col("size") / (most // 2)).cast("long")
    dealt = regions.select("g", "x", F.pmod(F.xxhash64("x", F.lit(-1 - turn)), n).alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("other"))
    return dealt.select(F.xxhash64("g", F.least("b", "other"), F.greatest("b", "other")).alias("g"), "x")


def _exact(regions: DataFrame, texts: DataFrame, most: int, turn: int) -> tuple[DataFrame, DataFrame | None]:
    """regions: g, x, flat -> links (u, v) and what is left to do as regions (g, x, flat). Small regions are joined whole, large ones meet pivots, large flat ones are joined in blocks."""
    sizes = regions.groupBy("g").agg(F.count("*").alias("size")).where("size > 1")
    sized = c.spool(regions.join(sizes, "g"))
    found, left = _grouped(sized.where(F.col("size") <= most).select("g", "x"), texts, _forest, ["u", "v"]), None
    large = sized.where(F.col("size") > most)
    kinds = {r.flat for r in large.select("flat").distinct().collect()}
    if False in kinds:
        links, left = _voronoi(c.spool(large.where("not flat")), texts, most, turn)
        found = found.unionByName(links)
    if True in kinds:
        found = found.unionByName(_grouped(_blocks(large.where("flat"), most, turn), texts, _forest, ["u", "v"]))
    return found, left


def _home(regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """regions: g, x, flat -> each point in its largest region only; and the regions that this leaves incomplete."""
    sizes = regions.groupBy("g").agg(F.count("*").alias("size"))
    home = c.spool(regions.join(sizes, "g").groupBy("x").agg(F.max_by("g", F.struct("size", "g")).alias("g")))
    whole = home.groupBy("g").agg(F.count("*").alias("here")).join(sizes, "g").where("here = size").select("g")
    return home.withColumn("flat", F.lit(False)), regions.join(whole, "g", "left_anti")


def links(docs: DataFrame, sets: DataFrame, keys: DataFrame, most: int = 512, near: int = 4096) -> DataFrame:
    """u, v: links whose components are those of all pairs of keys within tau; spooled. near: points of a region whose counts are joined in one task; more go on to step 4."""
    often = sets.where("times is not null").groupBy("key").agg(F.sum("times").alias("times")).where("times >= 32").orderBy(F.desc("times"), "key").limit(HOT).toPandas()
    hot = often["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hot)
    prefixes = _prefixes(docs, hot[order], often["times"].to_numpy(np.int64)[order])
    stars = prefixes.repartition("s").sortWithinPartitions("s", "n", "key").mapInArrow(_stars, "p long, x long")
    pairs = c.spool(stars.distinct())
    c.release(docs.sparkSession)
    members = pairs.unionByName(pairs.select("p", F.col("p").alias("x")).distinct()).select(F.col("p").alias("g"), "x", F.lit(False).alias("flat"))
    points = keys.where("least is not null").select(F.col("key").alias("x"), F.col("size").alias("n"), "counts")
    regions = _narrowed(members, points.withColumn("root", F.col("x")), near)
    texts = _texts(docs, keys, c.spool(regions.select(F.col("x").alias("key")).distinct()))
    now, rest = _home(regions)
    found, turn = None, 0
    while True:
        got, left = _exact(now, texts, most, turn)
        got = c.spool(got)
        c.release(docs.sparkSession)
        found = got if found is None else found.unionByName(got)
        if rest is not None:
            left = rest if left is None else left.unionByName(rest)
        if left is None:
            return c.spool(found)
        roots = components(found)
        found = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))  # stands for all links so far
        rooted = points.join(roots.withColumnRenamed("node", "x"), "x", "left").withColumn("root", F.coalesce("root", "x"))
        now, rest, turn = _narrowed(left, rooted, near), None, turn + 1
        if not now.limit(1).count():
            return c.spool(found)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text)."""
    c.bounded_arrow(docs.sparkSession)
    sets = _sets(docs)
    keys = _keys(sets)
    roots = components(links(docs, sets, keys))
    rooted = c.spool(keys.select("key", "n", "least").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")))
    whole = c.spool(rooted.groupBy("root").agg(F.count("*").alias("n"), F.min("least").alias("component_id")))
    named = c.spool(c.attach(rooted.withColumnRenamed("n", "rows"), whole, ["root"]).select("key", F.col("rows").alias("n"), "component_id"))
    rows = sets.where("n is not null").select("doc_id", "key", F.col("n").alias("n_shingles"))
    out = c.attach(rows.where("key is not null"), named, ["key"]).select("doc_id", "n_shingles", "component_id")
    return out.unionByName(rows.where("key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of Jaccard 0.75 and more between whole texts' shingle sets."""
    return near_duplicates(c.documents(spark, sf_dir).select("doc_id", "text"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without those that are linked to one of a smaller id, repeated rows once; docs' own columns."""
    gone = near_duplicates(docs.select("doc_id", "text")).where("component_id <> doc_id").select("doc_id").distinct()
    rows = docs.select("doc_id", "text", c.boxed(docs)).join(gone.hint("merge"), "doc_id", "left_anti")
    return c.unboxed(rows.dropDuplicates(["doc_id", "text"]), docs)
