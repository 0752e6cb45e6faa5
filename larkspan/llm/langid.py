"""Language ID by nearest centroid: TF-IDF n-gram vectors against several clustered centroids per language.

Fit: document frequencies of hashed letter 2- and 3-grams over all labelled texts; then spherical k-means per language over
a bounded sample (about `per_lang` texts a language, drawn by hash). Predict: cosine with every centroid; the language of
the nearest centroid wins. A text that is farther from its centroid than nearly all of that language's sample is rejected.

Defined results: null text or text without a letter is `und` with score 0; with no labelled text at all every text is
`und`; ties go to the language that sorts first; repeated rows get equal results; only the id, text and label columns are
read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c
from . import _grams as g

BITS = 12
DIMS = 1 << BITS


class Model(NamedTuple):
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # rows of unit length
    owner: np.ndarray  # language of each centroid
    floor: np.ndarray  # least cosine that a language accepts


def gram_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of letter 2- and 3-grams (texts x DIMS; word edges count as a blank), and whether a text has a letter."""
    flat = [np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    out = np.zeros(len(texts) * DIMS, np.int64)
    some = np.zeros(len(texts), bool)
    table = g.letters()
    edge = np.zeros(2, np.uint32)
    if len(texts) == 1 and len(flat[0]) > g.SLICE:
        padded = np.concatenate([edge, flat[0], edge])
        slices = [(padded[a : a + g.SLICE + 2], None) for a in range(0, len(padded), g.SLICE)]
    else:
        parts = [x for f in flat for x in (edge, f)]
        rows = np.repeat(np.arange(len(texts)), [len(f) + 2 for f in flat])
        slices = [(np.concatenate([*parts, edge]), np.append(rows, [len(texts) - 1] * 2))]
    for units, rows in slices:
        u = table[units]
        at = np.zeros(len(u), np.int64) if rows is None else rows * DIMS
        some[(at[u > 0]) // DIMS] = True
        for n in (2, 3):
            h = g.hashed(u, n, BITS)
            m = len(h) if rows is not None else min(len(h), g.SLICE)  # a slice counts what starts in it
            h = h[:m]
            used = (u[:m] > 0) | (u[1 : 1 + m] > 0)  # not between words
            out += np.bincount((h + at[n - 1 : n - 1 + m])[used], minlength=len(out))
    return out.reshape(len(texts), DIMS), some


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors, with 1 + log of counts."""
    x = counts.astype(np.float32)
    np.log1p(x, out=x)
    x *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.maximum(norm, 1e-9)[:, None]


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from the texts farthest from the centroids so far, so it needs no random numbers."""
    centres = [x.mean(0)]
    near = x @ centres[0]
    chosen = []
    for _ in range(min(k, len(x))):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    cent = x[chosen]
    for _ in range(rounds):
        mine = (x @ cent.T).argmax(1)
        sums = np.zeros_like(cent)
        np.add.at(sums, mine, x)
        held = np.linalg.norm(sums, axis=1) > 0
        new = sums[held] / np.linalg.norm(sums[held], axis=1)[:, None]
        if new.shape == cent.shape and np.allclose(new, cent, atol=1e-6):
            break
        cent = new
    return cent


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_lang: int = 1000, clusters: int = 4, reject: float = 0.002) -> Model:
    """Learn from rows with a non-null language. reject: share of each language's sample that would be rejected."""
    spark = labelled.sparkSession
    c.bounded_arrow(spark)
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in g.groups([len(t or "") for t in texts], 64):
                counts, some = gram_counts(texts[lo:hi])
                seen += (counts > 0).sum(0)
                n += int(some.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMS)), pa.array(np.concatenate([[n], seen]))], names=["bin", "n"])

    df = dict(map(tuple, rows.select("text").mapInArrow(frequencies, "bin long, n long").groupBy("bin").agg(F.sum("n")).collect()))
    idf = np.log((1 + df.get(-1, 0)) / (1 + np.array([df.get(i, 0) for i in range(DIMS)]))).astype(np.float32) + 1
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], idf, np.zeros((0, DIMS), np.float32), np.zeros(0, np.int64), np.zeros(0))
    share = F.create_map(*[F.lit(v) for k in langs for v in (k, min(1.0, per_lang / sizes[k]))])
    sample = rows.where((F.xxhash64("text") / F.lit(2.0**64) + 0.5) <= share[F.col("lang")])

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in g.groups([len(t or "") for t in texts], 64):
                counts, some = gram_counts(texts[lo:hi])
                ids = [np.flatnonzero(x) for x in counts]
                cols = [batch.column(1).slice(lo, hi - lo), pa.array([i.astype(np.uint16).tobytes() for i in ids]), pa.array([x[i].astype(np.uint32).tobytes() for x, i in zip(counts, ids, strict=True)])]
                yield pa.RecordBatch.from_arrays([a.filter(pa.array(some)) for a in cols], names=["lang", "i", "n"])

    got = sorted(map(tuple, sample.mapInArrow(sparse, "lang string, i binary, n binary").collect()))
    cents, owner, floor = [], [], np.zeros(len(langs))
    for k, lang in enumerate(langs):
        own = [(i, n) for name, i, n in got if name == lang]
        if not own:
            continue
        counts = np.zeros((len(own), DIMS), np.uint32)
        for row, (i, n) in zip(counts, own, strict=True):
            row[np.frombuffer(i, np.uint16)] = np.frombuffer(n, np.uint32)
        x = vectors(counts, idf)
        cent = cluster(x, clusters)
        floor[k] = np.quantile((x @ cent.T).max(1), reject)
        cents.append(cent)
        owner += [k] * len(cent)
    return Model(langs, idf, np.concatenate(cents) if cents else np.zeros((0, DIMS), np.float32), np.array(owner, np.int64), floor)


def classify(model: Model, texts: list[str | None], sharpness: float = 25.0) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, cosine with the nearest centroid, and whether the text was rejected."""
    counts, some = gram_counts(texts)
    if not len(model.owner):
        return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
    sims = vectors(counts, model.idf) @ model.centroids.T
    best = np.full((len(texts), len(model.langs)), -np.inf)
    for k in range(len(model.langs)):
        if (own := model.owner == k).any():
            best[:, k] = sims[:, own].max(1)
    pick = best.argmax(1)
    top = best.max(1)
    odds = np.exp(sharpness * (best - top[:, None]))
    score = np.where(some, 1 / odds.sum(1), 0.0)
    far = top < model.floor[pick]
    score = np.where(far, score * np.clip(top / np.maximum(model.floor[pick], 1e-9), 0, 1), score)
    return [model.langs[k] if s else "und" for k, s in zip(pick, some, strict=True)], np.clip(score, 0, 1), np.where(some, top, 0.0), far | ~some


def predict(df: DataFrame, model: Model, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """id_cols and lang_pred, score, cosine, rejected for every row's whole text."""
    c.bounded_arrow(df.sparkSession)
    n = len(id_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(n).to_pylist()
            for lo, hi in g.groups([len(t or "") for t in texts], 64):
                got = classify(model, texts[lo:hi])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(n)), *map(pa.array, got)], names=[*id_cols, "lang_pred", "score", "cosine", "rejected"])

    rows = df.select(*id_cols, F.col(text_col).cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n])
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double, cosine double, rejected boolean")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learnt from those whose id remainder (crc32 mod 3) is not 1."""
    docs = c.documents(spark, sf_dir)
    held = (c.id_remainder(F.col("doc_id"), 3) == 1).alias("held_out")
    model = fit(docs.where(~held))
    return predict(docs.select("doc_id", held, "text"), model, ["doc_id", "held_out"])
