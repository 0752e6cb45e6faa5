"""Shared pieces of the training-data operators: words, tables, shared-folder spooling, id hashing."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of whole texts that travel to Python in one Arrow batch, at most.
ARROW_ROWS = 400


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo `mod`; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def bounded_arrow(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Lower the number of rows per Arrow batch, so that a batch of long texts fits in a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or what setCheckpointDir named.

    Where neither is set, a single-machine session (local master, as in tests) gets a folder of its own; on a cluster the
    executors would not see each other's files there, so that is refused.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and (named := sc._jsc.sc().getCheckpointDir()).isDefined():
        where = named.get()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = getattr(spark, "_larkspan_shared", None)
        if where is None:
            where = spark._larkspan_shared = tempfile.mkdtemp(prefix="larkspan-")
    return where.rstrip("/")


def column(name: str) -> Column:
    """The top-level column of that name, whatever marks the name has."""
    return F.col(f"`{name.replace('`', '``')}`")


def boxed(docs: DataFrame) -> Column:
    """All columns of docs in one struct `row`, so that no working column can clash with them."""
    return F.struct(*[column(x).alias(f"c{i}") for i, x in enumerate(docs.columns)]).alias("row")


def unboxed(df: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """docs' columns out of `row`, some of them replaced by `new` ones."""
    return df.select(*[new.get(x, F.col(f"row.c{i}")).alias(x) for i, x in enumerate(docs.columns)])


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def spool(df: DataFrame) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: lineage is cut, executors may be lost.

    The files are removed by `drop_spool`, or else stay until the shared folder is cleared.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/larkspan/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._larkspan_path = path
    return out


def drop_spool(*frames: DataFrame) -> None:
    """Remove spooled tables that no later plan reads."""
    for df in frames:
        if path := getattr(df, "_larkspan_path", None):
            _remove(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of plans that are done. Spark removes them when the driver has collected their handles, which a large heap may put off until the disks are full."""
    spark.sparkContext._jvm.System.gc()


def join_small(df: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner", limit: int = 50_000) -> DataFrame:
    """Join a spooled lookup table: broadcast only after counting at most `limit` rows, else an ordinary shuffled join."""
    if small.limit(limit + 1).count() <= limit:
        small = F.broadcast(small)
    return df.join(small, on, how)


#: A group with more than this part of all rows is hot; there are less than so many.
HOT_SHARE = 1000


def attach(rows: DataFrame, groups: DataFrame, key: list[str]) -> DataFrame:
    """rows joined with their group (spooled, with its number of rows `n`). Groups of more than a thousandth of all rows are broadcast: there are less than a thousand."""
    total, most = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    limit = max(total // HOT_SHARE, 2000)
    if most <= limit:
        return rows.join(groups.drop("n"), key)
    hot = F.broadcast(groups.where(F.col("n") > limit).drop("n"))
    return rows.join(hot, key).unionByName(rows.join(hot.select(*key), key, "left_anti").join(groups.where(F.col("n") <= limit).drop("n"), key))


def least_count(df: DataFrame, count: str, most: int) -> int:
    """Least value of `count` (positive) at which not more than `most` rows have it or more; from a histogram of three digits, some ten thousand rows at most."""
    n = F.col(count)
    scale = F.pow(F.lit(10.0), F.greatest(F.floor(F.log10(n)) - 2, F.lit(0)))
    total, cut = 0, None
    rows = df.groupBy((F.floor(n / scale) * scale).cast("long").alias("edge")).agg(F.count("*").alias("rows")).collect()
    for r in sorted(rows, key=lambda r: -r["edge"]):
        total += r["rows"]
        if total > most:
            break
        cut = r["edge"]
    return cut if cut is not None else 1 << 62


def bucket_rank(df: DataFrame, keys: list[str], order: Column, rows_per_bucket: int = 2000, tie: str | None = None) -> DataFrame:
    """Add `rank` (0, 1, ...) within each key by `order`, a long column that is spread evenly over its 64 bits.

    No task sees a whole key: rows fall into ranges of `order`, about `rows_per_bucket` rows each over the whole table; the
    ranges' counts give each range's offset, and rows are numbered inside a range only. `df` must be cheap to read twice
    (spooled). Ties in `order` are numbered by the column `tie`, or in any way.
    """
    total = df.count()
    n = max(1, -(-total // rows_per_bucket))
    b = df.withColumn("_o", order).withColumn("_b", F.floor((F.col("_o").cast("double") / 2.0**64 + 0.5) * n).cast("long"))
    counts = b.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    # offsets by a second level of ranges: a key has at most n ranges, grouped by the square root of n
    step = max(1, int(n**0.5))
    counts = spool(counts.withColumn("_g", F.floor(F.col("_b") / step)))
    coarse = counts.groupBy(*keys, "_g").agg(F.sum("_n").alias("_gn"))
    before = lambda col, *parts: F.coalesce(F.sum(col).over(Window.partitionBy(*keys, *parts[:-1]).orderBy(parts[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    coarse = coarse.withColumn("_g0", before("_gn", "_g")).drop("_gn")
    c1, c2 = counts.alias("c1"), coarse.alias("c2")
    offsets = c1.join(c2, [F.col(f"c1.{k}").eqNullSafe(F.col(f"c2.{k}")) for k in [*keys, "_g"]]).select("c1.*", "c2._g0")
    offsets = offsets.withColumn("_first", F.col("_g0") + before("_n", "_g", "_b")).select(*keys, "_b", "_first")
    rows = b.withColumn("_i", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_o", *([tie] if tie else []))) - 1).alias("r")
    o = offsets.alias("o")
    out = rows.join(o, [F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in [*keys, "_b"]])
    return out.select(*[F.col(f"r.{c}") for c in df.columns], (F.col("r._i") + F.col("o._first")).cast("long").alias("rank"))


BLOOM_BITS = 1 << 24


def _zip_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=6).compress
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([squeeze(t or b"") for t in texts], pa.binary())], names=["doc_id", "z"])


def unzip(texts: list[bytes]) -> list[bytes]:
    """UTF-8 texts of a column `z`."""
    expand = zstandard.ZstdDecompressor().decompress
    return [expand(z) for z in texts]


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (spooled, with doc_id) joined with the whole text of each, compressed for the shuffles to come as `z`; spooled.

    A bitmap over hashed ids, of bounded size (BLOOM_BITS / 64 rows), keeps most other texts out of the shuffle; the join decides.
    """
    place = F.xxhash64("doc_id").bitwiseAND(F.lit(BLOOM_BITS - 1))
    word, bit = F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    bitmap = spool(ids.select(word.alias("_word"), bit.alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_bits")))
    near = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("_word", word).join(F.broadcast(bitmap), "_word").where(F.col("_bits").bitwiseAND(bit) != 0)
    kind = docs.schema["doc_id"].dataType.simpleString()
    zipped = near.select("doc_id", "text").mapInArrow(_zip_texts, f"doc_id {kind}, z binary")
    return spool(zipped.join(ids, "doc_id"))
