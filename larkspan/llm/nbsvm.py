"""Quality classifier: naive Bayes support vectors over hashed n-gram indicators.

Indicators: byte 1- to 4-grams of the text, and 1- to 3-grams of word shapes (letter case, marks, length, and whether the
word equals an earlier neighbour). Class log-count ratios scale them; a linear hinge-loss model is fitted by dual coordinate
descent on a bounded sample of labelled rows (`max_rows`, drawn by hash of the id), and a logistic map fitted on a part of
that sample that the model has not seen turns margins into scores.

Defined results: null text counts as empty and gets the score of the bias alone; with no labels, or one class only, every
score is the share of label 1 (0.5 without labels); labels that contradict each other for one id count as their maximum;
null labels and null ids in the labels are left out; repeated rows get equal scores; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c
from . import _grams as g

BITS = 15  # of byte n-grams
SHAPE_BITS = 13  # of shape n-grams, which follow them in the table
DIMS = (1 << BITS) + (1 << SHAPE_BITS)


def _byte_class() -> np.ndarray:
    """1 lower-case letter or non-ASCII, 2 upper-case letter, 4 digit, 8 mark, by byte."""
    out = np.full(256, 8, np.uint8)
    out[ord("a") : ord("z") + 1] = 1
    out[128:] = 1
    out[ord("A") : ord("Z") + 1] = 2
    out[ord("0") : ord("9") + 1] = 4
    return out


_CLASS = _byte_class()
_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def _word_shapes(u: np.ndarray, at: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shape of each word, the text it is in, and its value. A word's shape: its byte classes, length (capped for the shape only), and whether it equals one of the two words before it in its text; `tail` has the values of words before u."""
    solid = ~_BLANK[u]
    edge = np.diff(np.concatenate([[0], solid.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint32), np.zeros(0, at.dtype), np.zeros(0, np.uint64)
    kinds = np.bitwise_or.reduceat(np.where(solid, _CLASS[u], 0), start).astype(np.uint32)
    v = u[start[0] :]
    place = (np.arange(len(v)) - np.repeat(start - start[0], np.diff(np.append(start, len(u))))).astype(np.uint64)
    value = np.add.reduceat((v.astype(np.uint64) + np.uint64(7)) * (place * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xC2B2AE3D27D4EB4F)) * solid[start[0] :], start - start[0])
    known, own = np.concatenate([tail, value]), np.concatenate([np.full(len(tail), at[0]), at[start]])
    same = np.zeros(len(known), np.uint32)
    for back in (1, 2):
        same[back:] |= (known[back:] == known[:-back]) & (own[back:] == own[:-back])
    same = same[len(tail) :]
    last_mark = np.where(_CLASS[u[end - 1]] == 8, u[end - 1], 0).astype(np.uint32)
    length = np.minimum(7, np.log2(end - start).astype(np.uint32) * 2)
    return kinds | length << np.uint32(4) | same << np.uint32(8) | last_mark << np.uint32(9), at[start], value


def indicators(texts: list[bytes | None]) -> np.ndarray:
    """Which hashed n-grams each whole text has (texts x DIMS, boolean)."""
    out = np.zeros((len(texts), DIMS), bool)
    flat = out.reshape(-1)
    texts = [t or b"" for t in texts]
    joined = b"\n\n\n".join([*texts, b""])
    long = len(texts) == 1 and len(texts[0]) > g.SLICE
    none = np.zeros(0, np.uint64)

    def grams(u8: np.ndarray, at: np.ndarray) -> None:
        row, u = at * np.int32(DIMS), u8.astype(np.uint32)
        for n in (1, 2, 3, 4):
            h = g.hashed(u, n, BITS)
            h += row[: len(h)]
            flat[h if n == 1 else h[at[n - 1 :][: len(h)] == at[: len(h)]]] = True

    def shape_grams(shapes: np.ndarray, where: np.ndarray) -> None:
        for n in (1, 2, 3):
            h = g.hashed(shapes, n, SHAPE_BITS) + where[: max(0, len(shapes) - n + 1)] * np.int32(DIMS) + (1 << BITS)
            flat[h[where[n - 1 :][: len(h)] == where[: len(h)]]] = True

    if not long:
        u8 = np.frombuffer(joined, np.uint8)
        at = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 3 for t in texts])
        grams(u8, at)
        shapes, where, _ = _word_shapes(u8, at, none)
        shape_grams(shapes, where)
        return out
    for a in range(0, len(joined), g.SLICE):  # slices overlap by what an n-gram needs
        u8 = np.frombuffer(joined[a : a + g.SLICE + 3], np.uint8)
        grams(u8, np.zeros(len(u8), np.int32))
    a, tail, last = 0, none, np.zeros(0, np.uint32)
    while a < len(joined):  # slices end between words; two words are carried over
        cut = _GAP.search(joined, a + g.SLICE)
        b = cut.end() if cut else len(joined)
        u8 = np.frombuffer(joined[a:b], np.uint8)
        shapes, _, values = _word_shapes(u8, np.zeros(len(u8), np.int32), tail)
        shapes, a = np.concatenate([last, shapes]), b
        shape_grams(shapes, np.zeros(len(shapes), np.int32))
        tail, last = np.concatenate([tail, values])[-2:], shapes[-2:]
    return out


class Model(NamedTuple):
    weights: np.ndarray  # of indicators, already scaled by the log-count ratios
    scale: np.ndarray  # squared log-count ratios, for the length of a row
    bias: float
    slope: float
    offset: float


def descend(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 15, seed: int = 0) -> tuple[np.ndarray, float]:
    """min |w|^2/2 + sum cost_i max(0, 1 - y_i (w.x_i + b)) by dual coordinate descent; x_i has values[rows_i] / |values[rows_i]|, b has a feature of its own."""
    w, b = np.zeros(len(values)), 0.0
    alpha = np.zeros(len(rows))
    x = [values[i] / max(1e-9, float(np.linalg.norm(values[i]))) for i in rows]
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(len(rows)):
            slope = y[i] * (float(w[rows[i]] @ x[i]) + b) - 1
            new = min(max(alpha[i] - slope / 2, 0.0), cost[i])  # |x_i|^2 + 1 = 2
            if step := (new - alpha[i]) * y[i]:
                w[rows[i]] += step * x[i]
                b += step
                most = max(most, abs(step))
                alpha[i] = new
        if most < 1e-3:
            break
    return w, b


def _logistic(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(y=1) by Newton steps on smoothed targets."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    ab = np.array([1.0, 0.0])
    x = np.stack([f, np.ones_like(f)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ ab))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (t - p) - 1e-6 * ab)
        ab = ab + np.clip(step, -5, 5)
        if abs(step).max() < 1e-9:
            break
    return float(ab[0]), float(ab[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 8000, cost: float = 1.0, smooth: float = 1.0) -> Model:
    """Learn from labelled rows, about max_rows of them at most: three quarters fit the model, one quarter the scores."""
    c.bounded_arrow(docs.sparkSession)
    lab = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("_y"))
    n = lab.count()
    u = F.xxhash64("_id", F.lit(5)) / F.lit(2.0**64) + 0.5
    sample = lab.withColumn("_u", u * max(1.0, n / max_rows)).where("_u <= 1")  # so many rows that the broadcast is bounded by max_rows
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t")).join(F.broadcast(sample), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            for lo, hi in g.groups([len(t or b"") for t in texts], 24):
                got = [np.flatnonzero(x).astype(np.uint16).tobytes() for x in indicators(texts[lo:hi])]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), batch.column(3).slice(lo, hi - lo), pa.array(got)], names=["id", "y", "u", "i"])

    got = sorted(map(tuple, rows.select("_t", F.col("_id").cast("string"), "_y", "_u").mapInArrow(run, "id string, y int, u double, i binary").collect()), key=lambda r: (r[2], r[0], r[3]))
    y = np.array([r[1] for r in got], np.int64)
    ids = [np.frombuffer(r[3], np.uint16).astype(np.int64) for r in got]
    del got
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        return Model(np.zeros(DIMS), np.ones(DIMS), 0.0, 0.0, float(np.log(share / (1 - share))))
    calib = np.arange(len(y)) % 4 == 3
    if min((y[calib] == 1).sum(), (y[calib] == 0).sum()) < 3:
        calib[:] = False
    counts = np.full((2, DIMS), smooth)
    for i, k, held in zip(ids, y, calib, strict=True):
        if not held:
            counts[k, i] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    use = np.flatnonzero(~calib)
    sign = np.where(y[use] == 1, 1.0, -1.0)
    weight = np.where(sign > 0, cost, cost * (sign > 0).sum() / max(1, (sign < 0).sum()))
    w, b = descend([ids[i] for i in use], ratio, sign, weight)
    model = Model(w * ratio, ratio**2, b, 1.0, 0.0)
    on = np.flatnonzero(calib) if calib.any() else use
    f = np.array([_margin(model, ids[i]) for i in on])
    return model._replace(**dict(zip(("slope", "offset"), _logistic(f, y[on]), strict=True)))


def _margin(m: Model, ids: np.ndarray) -> float:
    return float(m.weights[ids].sum()) / max(1e-9, float(np.sqrt(m.scale[ids].sum()))) + m.bias


def margins(m: Model, texts: list[bytes | None]) -> np.ndarray:
    x = indicators(texts)
    dots = x.astype(np.float32) @ np.stack([m.weights, m.scale], 1).astype(np.float32)
    return np.where(dots[:, 1] > 0, dots[:, 0] / np.sqrt(np.maximum(dots[:, 1], 1e-9)), 0) + m.bias


def score(df: DataFrame, model: Model, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """id_cols, margin and score of every row's whole text."""
    c.bounded_arrow(df.sparkSession)
    n = len(id_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(n).cast(pa.binary()).to_pylist()
            for lo, hi in g.groups([len(t or b"") for t in texts], 24):
                f = margins(model, texts[lo:hi]).astype(np.float64)
                p = 1 / (1 + np.exp(-np.clip(model.slope * f + model.offset, -60, 60)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(n)), pa.array(f), pa.array(p)], names=[*id_cols, "margin", "score"])

    rows = df.select(*id_cols, F.col(text_col).cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n])
    return rows.mapInArrow(run, f"{schema}, margin double, score double")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; labels are learnt from ids whose remainder (crc32 mod 5) is not 0."""
    docs = c.documents(spark, sf_dir)
    held = c.id_remainder(F.col("doc_id"), 5) == 0
    model = fit(docs, c.documents(spark, sf_dir, "labels").where(~held))
    out = score(docs.select("doc_id", held.alias("held_out"), "text"), model, ["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
