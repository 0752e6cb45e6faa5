"""Hidden Markov language model: Baum-Welch counts summed over partitions, exact likelihood by scaled forward recursion.

A text is its words in lower case (A-Z only), then an end token. The model's symbols are the most frequent words, the end,
and hash buckets of all other words; a word in a bucket costs its smoothed share of the bucket, so the model gives every text
a whole probability. Word counts are exact over all training rows. The most frequent `hot` words travel as a bounded table;
the others meet their counts in a shuffled join. Training passes run over all training texts, cut into equal segments.

Defined results: null text counts as empty (the end token alone); with no training text every word is unseen and symbols
are uniform; repeated rows are scored alike, each in its own row; rows are numbered inside, so null or repeated ids and any
other columns do no harm; very long texts are cut into chunks whose transfer matrices are multiplied, which is exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

END = b""  # no word is empty
CHUNK = 2048


class Symbols(NamedTuple):
    """Frequent words in order of count, and what the rest fall into."""

    words: int  # words with a symbol of their own
    buckets: int

    @property
    def total(self) -> int:
        return self.words + self.buckets + 1

    def of(self, word: bytes, rank: int) -> int:
        if word == END:
            return self.total - 1
        return rank if 0 <= rank < self.words else self.words + (xxhash.xxh3_64_intdigest(word) % self.buckets)


def word_counts(texts: DataFrame, flush: int = 300_000) -> DataFrame:
    """word (binary, the end token as empty), n: exact counts over every row's one text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return got

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                seen[END] += 1
                if text:
                    seen.update(text.lower().split())
                if len(seen) >= flush:
                    yield out()
        if seen:
            yield out()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Counts(NamedTuple):
    table: DataFrame  # word, n, sym
    total: int
    distinct: int
    hot: list[tuple[bytes, int, int]]  # word, n, symbol
    symbols: Symbols
    bucket_n: np.ndarray  # by symbol: tokens and distinct words
    bucket_v: np.ndarray


def count_words(texts: DataFrame, hot: int = 200_000, words: int = 1024, buckets: int = 256) -> Counts:
    table = c.spool(word_counts(texts))
    total, distinct = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = sorted(table.where(F.col("n") >= c.least_count(table, "n", hot)).collect(), key=lambda r: (-r.n, bytes(r.word)))  # `hot` rows at most
    symbols = Symbols(words, buckets)
    ranks = {}
    for r in top:
        if bytes(r.word) != END and len(ranks) < words:
            ranks[bytes(r.word)] = len(ranks)
    rows = [(bytes(r.word), r.n, symbols.of(bytes(r.word), ranks.get(bytes(r.word), -1))) for r in top]
    own = set(ranks) | {END}

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(symbols.total, np.int64), np.zeros(symbols.total, np.int64)
        for batch in batches:
            for word, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if word not in own:
                    s = symbols.of(word, -1)
                    n[s] += k
                    v[s] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(symbols.total)), pa.array(n), pa.array(v)], names=["s", "n", "v"])

    bucket = {r.s: r for r in table.mapInArrow(tally, "s long, n long, v long").groupBy("s").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}
    n = np.array([bucket[s].n if s in bucket else 0 for s in range(symbols.total)], float)
    v = np.array([bucket[s].v if s in bucket else 0 for s in range(symbols.total)], float)
    return Counts(table, total, distinct, rows, symbols, n, v)


def encode(docs: DataFrame, counts: Counts) -> DataFrame:
    """Rows of two kinds, spooled. kind 0, a text: key, doc_id, held_out, n, known, base, within (log10 sums of its hot
    tokens), codes (its symbols, 2 bytes each). kind 1, a word of a text that is not hot: key, word, n, sym."""
    spark = docs.sparkSession
    c.bounded_arrow(spark)
    floor = np.log10(counts.total + 0.5 * (counts.distinct + 1))
    n_hot = np.array([n for _, n, _ in counts.hot], float)
    sym_hot = np.array([s for *_, s in counts.hot], np.int64)
    sym, words = counts.symbols, counts.symbols.words
    in_bucket = (sym_hot >= words) & (sym_hot < sym.total - 1)
    base_hot = np.log10(n_hot + 0.5) - floor
    within_hot = np.where(in_bucket, np.log10(n_hot + 0.5) - np.log10(counts.bucket_n + 0.5 * (counts.bucket_v + 1))[sym_hot], 0.0) if len(sym_hot) else np.zeros(0)
    shared = spark.sparkContext.broadcast(([w for w, *_ in counts.hot], base_hot, within_hot, sym_hot.astype(np.int16)))
    names = ["kind", "key", "doc_id", "held_out", "n", "known", "base", "within", "codes", "word", "sym"]
    id_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, base, within, syms = shared.value
        find = {w: i for i, w in enumerate(hot)}.get
        key = TaskContext.get().partitionId() << 36
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for lo in range(0, len(texts), 128):
                rows, rare = [], []
                for text in texts[lo : lo + 128]:
                    tokens = (text or b"").lower().split()
                    tokens.append(END)
                    at = np.array([find(w, -1) for w in tokens], np.int64)
                    miss = np.flatnonzero(at < 0)
                    codes = syms[at] if len(syms) else np.zeros(len(at), np.int16)
                    if len(miss):
                        names_ = [tokens[i] for i in miss.tolist()]
                        tf = Counter(names_)
                        code = {w: sym.of(w, -1) for w in tf}
                        codes[miss] = [code[w] for w in names_]
                        rare += [(key, w, k, code[w]) for w, k in tf.items()]
                        at = at[at >= 0]
                    rows.append((key, len(tokens), len(at), float(base[at].sum()), float(within[at].sum()), codes.tobytes()))
                    key += 1
                k, n, known, b, w, cd = zip(*rows, strict=True)
                m = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([0] * m, pa.int32()), pa.array(k), batch.column(0).slice(lo, m), batch.column(1).slice(lo, m), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(b), pa.array(w), pa.array(cd), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int32())], names=names)
                if rare:
                    k, w, n, s = zip(*rare, strict=True)
                    m = len(rare)
                    yield pa.RecordBatch.from_arrays([pa.array([1] * m, pa.int32()), pa.array(k), pa.nulls(m, batch.column(0).type), pa.nulls(m, pa.bool_()), pa.array(n, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.binary()), pa.array(w, pa.binary()), pa.array(s, pa.int32())], names=names)

    schema = f"kind int, key long, doc_id {id_type.simpleString()}, held_out boolean, n long, known long, base double, within double, codes binary, word binary, sym int"
    return c.spool(docs.select("doc_id", "held_out", F.col("text").cast("string")).mapInArrow(run, schema))


class Model(NamedTuple):
    start: np.ndarray
    again: np.ndarray  # state of a later segment's first token; for training only
    move: np.ndarray
    emit: np.ndarray  # symbols x states


def initial(symbols: Symbols, unigram: np.ndarray, states: int, seed: int = 7) -> Model:
    """States near the unigram distribution, told apart by a fixed random factor."""
    rng = np.random.default_rng(seed)
    emit = (unigram + 1e-7)[:, None] * rng.gamma(2.0, 0.5, (symbols.total, states))
    move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
    return Model(np.full(states, 1 / states), np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _expect(m: Model, codes: np.ndarray, first: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions of segments (rows of codes, of `ends` tokens each), and their log likelihood."""
    n, length = codes.shape
    s = len(m.start)
    a, e = m.move.astype(np.float32), m.emit.astype(np.float32)
    alpha = np.empty((length, n, s), np.float32)
    scale = np.empty((length, n), np.float32)
    now = np.where(first[:, None], m.start, m.again).astype(np.float32)
    for t in range(length):
        live = t < ends
        if t:
            now = now @ a
        now = now * e[codes[:, t]]
        scale[t] = now.sum(1)
        now /= np.maximum(scale[t], 1e-30)[:, None]
        scale[t][~live] = 1
        alpha[t] = now
    likely = float(np.log(np.maximum(scale, 1e-30), dtype=np.float64).sum())
    moves = np.zeros((s, s))
    beta = np.ones((n, s), np.float32)
    gamma = np.zeros((length, n, s), np.float32)
    for t in range(length - 1, -1, -1):
        live = t < ends
        beta[ends == t + 1] = 1
        g = alpha[t] * beta
        g /= np.maximum(g.sum(1), 1e-30)[:, None]
        g[~live] = 0
        gamma[t] = g
        if t:
            ahead = e[codes[:, t]] * beta / np.maximum(scale[t], 1e-30)[:, None]
            ahead[~live] = 0
            moves += (alpha[t - 1].T @ ahead) * a
            beta = np.where(live[:, None], ahead @ a.T, beta)
    flat = np.ascontiguousarray(codes.T).ravel()
    emits = np.stack([np.bincount(flat, gamma[:, :, k].ravel(), minlength=len(m.emit)) for k in range(s)], 1)
    return gamma[0][first].sum(0, dtype=np.float64), moves, emits, likely


def _step(coded: DataFrame, model: Model, length: int, batch_segments: int = 1024) -> tuple[Model, float]:
    """One Baum-Welch pass over all rows' codes; counts are summed over partitions by Spark."""
    states, total = model.emit.shape[1], model.emit.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, moves, emits, likely = np.zeros(states), np.zeros((states, states)), np.zeros((total, states)), 0.0
        rows: list[np.ndarray] = []
        first: list[bool] = []

        def work() -> None:
            nonlocal likely
            ends = np.array([len(r) for r in rows])
            codes = np.zeros((len(rows), length), np.int64)
            codes[np.arange(length) < ends[:, None]] = np.concatenate(rows)
            got = _expect(model, codes, np.array(first), ends)
            start.__iadd__(got[0])
            moves.__iadd__(got[1])
            emits.__iadd__(got[2])
            likely += got[3]
            rows.clear()
            first.clear()

        for batch in batches:
            for raw in batch.column(0).to_pylist():
                x = np.frombuffer(raw, np.int16)
                for at in range(0, len(x), length):
                    rows.append(x[at : at + length])
                    first.append(not at)
                    if len(rows) >= batch_segments:
                        work()
        if rows:
            work()
        values = np.concatenate([start, moves.ravel(), emits.ravel(), [likely]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["i", "x"])

    size = states + states * states + total * states + 1
    got = coded.select("codes").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    x = np.zeros(size)
    x[got.i.to_numpy()] = got.x.to_numpy()
    start, rest = x[:states], x[states:]
    moves, emits = rest[: states * states].reshape(states, states), rest[states * states : -1].reshape(total, states)
    again = emits.sum(0) + 1e-3
    move = moves + 0.1
    emit = emits + 0.5 / total  # so that no symbol is impossible
    return Model((start + 0.1) / (start + 0.1).sum(), again / again.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0)), float(x[-1])


def train(coded: DataFrame, counts: Counts, states: int = 8, rounds: int = 3, length: int = 64) -> Model:
    """Baum-Welch from a fixed start; every training text counts in every round."""
    unigram = counts.bucket_n.copy()
    for _, n, s in counts.hot:
        if s < counts.symbols.words or s == counts.symbols.total - 1:
            unigram[s] += n
    model = initial(counts.symbols, unigram / max(1.0, unigram.sum()), states)
    for _ in range(rounds):
        model, _likely = _step(coded, model, length)
    return model


def log10_likelihood(m: Model, seqs: list[np.ndarray]) -> np.ndarray:
    """Exact log10 probability of each symbol sequence. Chunks of one length run side by side; a sequence's later chunks run once for each state they may start in."""
    s = len(m.start)
    jobs, owner = [], []
    for i, q in enumerate(seqs):
        for at in range(0, len(q), CHUNK):
            jobs.append(q[at : at + CHUNK])
            owner.append((i, at > 0))
    order = sorted(range(len(jobs)), key=lambda k: -len(jobs[k]))
    widths = [s if owner[k][1] else 1 for k in order]
    base = np.concatenate([[0], np.cumsum(widths)])
    state = np.concatenate([m.move if owner[k][1] else m.start[None] for k in order]) if jobs else np.zeros((0, s))
    logs = np.zeros(len(state))
    lens = np.array([len(jobs[k]) for k in order])
    codes = np.zeros((len(order), int(lens.max()) if len(lens) else 0), np.int16)
    for row, k in zip(codes, order, strict=True):
        row[: len(jobs[k])] = jobs[k]
    codes = np.repeat(codes, widths, axis=0)
    for t in range(codes.shape[1]):
        live = int(base[np.searchsorted(-lens, -t, "left")])  # rows whose chunk is longer than t
        now = state[:live] if not t else state[:live] @ m.move
        now = now * m.emit[codes[:live, t]]
        scale = now.sum(1)
        logs[:live] += np.log10(np.maximum(scale, 1e-300))
        state[:live] = now / np.maximum(scale, 1e-300)[:, None]
    out = np.zeros(len(seqs))
    at = {k: j for j, k in enumerate(order)}
    current: dict[int, np.ndarray] = {}
    for k, (i, later) in enumerate(owner):
        j = base[at[k]]
        if not later:
            current[i], out[i] = state[j], logs[j]
            continue
        # row r of the chunk starts where state r leads: weigh the rows by the state before
        rows, lg = state[j : j + s], logs[j : j + s]
        top = lg[current[i] > 0].max()
        mix = current[i] * 10.0 ** (lg - top)
        out[i] += top + np.log10(mix.sum())
        current[i] = mix @ rows / mix.sum()
    return out


def forward(coded: DataFrame, model: Model) -> DataFrame:
    """key, doc_id, held_out, n, known, base, within, likely for rows of kind 0."""
    names = ["key", "doc_id", "held_out", "n", "known", "base", "within"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            likely = log10_likelihood(model, [np.frombuffer(x, np.int16) for x in t.column("codes").to_pylist()])
            held.clear()
            return pa.RecordBatch.from_arrays([*(t.column(x).combine_chunks() for x in names), pa.array(likely)], names=[*names, "likely"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 4096 or sum(b.column(7).nbytes for b in held) > 4_000_000:
                yield out()
        if held:
            yield out()

    kind = coded.schema["doc_id"].dataType.simpleString()
    return coded.select(*names, "codes").mapInArrow(run, f"key long, doc_id {kind}, held_out boolean, n long, known long, base double, within double, likely double")


def score(docs: DataFrame, hot: int = 200_000, states: int = 8, rounds: int = 3) -> DataFrame:
    """docs(doc_id, held_out, text): learn from rows that are not held out, score all."""
    c.bounded_arrow(docs.sparkSession)
    counts = count_words(docs.where(~F.col("held_out")).select(F.col("text").cast("string")), hot)
    coded = encode(docs, counts)
    texts, rare = coded.where("kind = 0"), coded.where("kind = 1")
    model = train(texts.where(~F.col("held_out")), counts, states, rounds)
    floor = float(np.log10(counts.total + 0.5 * (counts.distinct + 1)))
    size = F.array(*[F.lit(float(x)) for x in np.log10(counts.bucket_n + 0.5 * (counts.bucket_v + 1))])
    logged = F.log10(F.coalesce(F.col("c"), F.lit(0)) + 0.5)
    words = rare.select("key", "word", "n", "sym").join(counts.table.select("word", F.col("n").alias("c")), "word", "left")
    sums = words.groupBy("key").agg(
        F.sum(F.col("n") * (logged - floor)).alias("rare_base"), F.sum(F.col("n") * (logged - F.element_at(size, F.col("sym") + 1))).alias("rare_within"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known")
    )
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    return forward(texts, model).join(sums, "key", "left").select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + zero("rare_known")).alias("n_known"), F.lit(counts.total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rare_base")).alias("base_score"), (F.col("likely") + F.col("within") + zero("rare_within")).alias("score"),
    )


def op4_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document under the hidden Markov model, beside the smoothed unigram score."""
    docs = c.documents(spark, sf_dir)
    return score(docs.select("doc_id", (c.id_remainder(F.col("doc_id"), 5) == 1).alias("held_out"), "text"))
