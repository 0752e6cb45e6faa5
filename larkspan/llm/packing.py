"""Packing by optimal length buckets.

Texts are cut into pieces of at most `max_len` words. Over the exact histogram of piece lengths, dynamic programming picks
the `buckets` upper bounds whose padding (bound minus length, over all pieces) is least. Inside a bucket, pieces in the order
of a hash fill batches of `budget // bound` pieces, so that a padded batch never holds more than `budget` words (a piece
longer than the budget has a batch of its own).

Defined results: null texts and texts without words have no piece and give no row; an empty table gives an empty result;
repeated rows are packed as often as they occur, and which of them takes which of their slots is arbitrary; equal pieces of
different documents are ordered by document; very long texts become many pieces and lose nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c


def best_bounds(counts: np.ndarray, buckets: int) -> list[int]:
    """counts[n] pieces of length n -> at most `buckets` upper bounds of least total padding; ties take shorter bounds."""
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return []
    n = counts[lengths].astype(float)
    total, words = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * lengths)])
    m = len(lengths)
    best = np.full(m + 1, np.inf)  # of the first j lengths, in so many buckets
    best[0] = 0
    cuts = []
    for _ in range(min(buckets, m)):
        new, cut = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        new[0] = 0
        for j in range(1, m + 1):
            cost = best[:j] + lengths[j - 1] * (total[j] - total[:j]) - (words[j] - words[:j])
            cut[j] = int(cost.argmin())
            new[j] = cost[cut[j]]
        best = new
        cuts.append(cut)
    out, j = [], m
    for cut in reversed(cuts):
        if j:
            out.append(int(lengths[j - 1]))
            j = int(cut[j])
    return out[::-1]


def pieces(docs: DataFrame, max_len: int, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, piece, first_word, n_words, _h and the columns to keep: cuts of each document's words; _h orders a bucket."""
    n = c.n_words(F.col(text_col))
    rows = docs.select("doc_id", *keep, n.alias("_n"), F.xxhash64("doc_id", text_col).alias("_d")).where("_n > 0")
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / max_len))))
    first = F.col("piece") * max_len
    return rows.select("doc_id", *keep, "piece", first.alias("first_word"), F.least(F.lit(max_len).cast("long"), F.col("_n") - first).alias("n_words"), F.xxhash64("_d", "piece").alias("_h"))


def pack(docs: DataFrame, max_len: int = 2048, buckets: int = 16, budget: int = 16_384, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, piece, first_word, n_words, bucket, bucket_len, batch, slot, padding and the columns to keep: one row per piece."""
    spark = docs.sparkSession
    rows = c.spool(pieces(docs, max_len, text_col, keep))
    counts = np.zeros(max_len + 1, np.int64)
    for r in rows.groupBy("n_words").count().collect():  # a row for each length up to max_len
        counts[r.n_words] = r["count"]
    bounds = best_bounds(counts, buckets)
    if not bounds:
        bounds = [max_len]
    table = spark.createDataFrame([(n, b, bounds[b], max(1, budget // bounds[b])) for b in range(len(bounds)) for n in range(bounds[b - 1] + 1 if b else 0, bounds[b] + 1)], "n_words long, bucket int, bucket_len long, per_batch long")
    placed = c.spool(rows.join(F.broadcast(table), "n_words"))  # max_len rows
    ranked = c.bucket_rank(placed, ["bucket"], F.col("_h"))
    return ranked.select(
        "doc_id", *keep, "piece", "first_word", "n_words", "bucket", "bucket_len",
        F.floor(F.col("rank") / F.col("per_batch")).alias("batch"), (F.col("rank") % F.col("per_batch")).alias("slot"), (F.col("bucket_len") - F.col("n_words")).alias("padding"),
    )


def batches(docs: DataFrame, max_len: int = 2048, buckets: int = 16, budget: int = 16_384, text_col: str = "text") -> DataFrame:
    """bucket, bucket_len, batch, pieces (slot, doc_id, piece, words, in order of slots): the batches themselves, each of `budget` words at most."""
    rows = c.spool(docs.select("doc_id", c.column(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("_t")))
    placed = pack(rows, max_len, buckets, budget, "text", ("_t",))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = rows.select("_t", words.alias("_w")).where(F.size("_w") > 0)
    cut = cut.select("_t", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("_w") - 1) / max_len).cast("int")), lambda i: F.slice("_w", i * max_len + 1, max_len))).alias("piece", "words"))
    slot = F.struct("slot", "doc_id", "piece", "words")
    return placed.join(cut.withColumn("piece", F.col("piece").cast("long")), ["_t", "piece"]).groupBy("bucket", "bucket_len", "batch").agg(F.sort_array(F.collect_list(slot)).alias("pieces"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every piece of every document."""
    return pack(c.documents(spark, sf_dir))
