"""Line dedup with a suffix array over line-ID sequences, built by distributed prefix doubling.

A document is the sequence of the IDs (64-bit hashes) of its lines that have a word. Round by round, suffixes that agree
on their first k lines are ranked by (rank of the first k, rank of the next k), which gives their order on 2k lines. A class
of suffixes with one rank at depth k is an interval of the suffix array whose longest common prefix is k or more; suffixes
that are alone leave the work, since nothing repeats them any further.

The longest common prefix of every suffix with an earlier one (least document id first, then place) follows by halving: a
suffix that is not the first of its interval at depth 2^j, but is at 2^(j+1), is compared with the firsts of that interval on
the next 2^(j-1) lines, 2^(j-2) lines, ..., each time by ranks that are there already. Those that agree form the interval one
step deeper, whose first is their reference; the others stay where they are. At the end every suffix has the exact length of the
longest run of lines that begins there and begins at an earlier place too, and that interval's first as its source.

Runs of `min_lines` lines and more, and single lines of `min_chars` characters and more, are later copies and are deleted.
Those that are not a later part of the run that begins one line before are the maximal repeated runs. The first copy stays, wherever it is.

Joins never gather a class: least members are aggregates with partial sums, and classes with more than a thousandth of all
suffixes (less than a thousand classes, so they can be broadcast) meet their members without a shuffle.

Defined results: null texts and texts without a word have no lines and stay as they are; lines without a word are never
deleted; a null id sorts first; rows that repeat (same id, same text) are one document and get one result each; texts of
which no line is deleted are returned unchanged; an empty table gives an empty result; input columns may have any names, since they are kept in a struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

_HAS_WORD = r"[^\x20\x09-\x0D]"
MIN_CHARS = 100  # of a single line that counts as a passage


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def _worded(text: Column, min_chars: int) -> Column:
    """Structs of each line that has a word: its place among all lines, its ID, and whether it is long."""
    return F.filter(F.transform(_lines(text), lambda x, j: F.when(x.rlike(_HAS_WORD), F.struct(j.alias("raw"), F.xxhash64(x).alias("h"), (F.length(x) >= min_chars).alias("long")))), lambda s: s.isNotNull())


def _doc_key(text_col: str) -> Column:
    return F.xxhash64("doc_id", c.column(text_col))


def _ranked(rows: DataFrame, key: list[str]) -> DataFrame:
    """Spooled doc_id, d, i, rank, first of the rows (spooled) that share their key with others."""
    groups = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "d", "i")).alias("first")).where("n > 1")
    # ranks rise with the order of the keys: the sort is by range, the rank by partition and row
    groups = c.spool(groups.orderBy(*key).withColumn("rank", F.monotonically_increasing_id()))
    out = c.spool(c.attach(rows, groups, key).select("doc_id", "d", "i", "rank", "first"))
    c.drop_spool(groups)
    return out


def classes_at(suffixes: DataFrame, depth: int) -> DataFrame:
    """One doubling step. suffixes: doc_id, d, i, rank at `depth` -> the same at twice the depth (spooled), without suffixes that are alone, with `first`, the least (doc_id, d, i) of the class."""
    ahead = suffixes.select("d", (F.col("i") - depth).alias("i"), F.col("rank").alias("then"))
    both = c.spool(suffixes.select("doc_id", "d", "i", F.col("rank").alias("now")).join(ahead, ["d", "i"]))
    out = _ranked(both, ["now", "then"])
    c.drop_spool(both)
    return out


def _halve(todo: DataFrame, ranks: DataFrame, step: int) -> DataFrame:
    """todo: doc_id, d, i, interval, length, first (cheap to read again). Those that agree on `step` more lines with an earlier member of their interval go one interval deeper; the others stay."""
    refs = todo.select("first.*", "interval", "length").distinct().withColumn("target", F.lit(False))
    rows = todo.select("doc_id", "d", "i", "interval", "length").withColumn("target", F.lit(True)).unionByName(refs)
    at = ranks.select("d", F.col("i").alias("there"), F.col("rank").alias("then"))
    met = c.spool(rows.withColumn("there", F.col("i") + F.col("length")).join(at, ["d", "there"]).drop("there"))
    groups = met.groupBy("interval", "then").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "d", "i")).alias("deep")).where("n > 1")
    groups = c.spool(groups.withColumn("inner", F.xxhash64("interval", "then", F.lit(step))))
    deeper = c.attach(met.where("target").select("doc_id", "d", "i", "interval", "then"), groups, ["interval", "then"]).where(F.struct("doc_id", "d", "i") > F.col("deep"))
    out = todo.join(deeper.select("d", "i", "inner", "deep"), ["d", "i"], "left")
    gone = F.col("inner").isNotNull()
    out = c.spool(out.select("doc_id", "d", "i", F.coalesce("inner", "interval").alias("interval"), (F.col("length") + F.when(gone, step).otherwise(0)).alias("length"), F.when(gone, F.col("deep")).otherwise(F.col("first")).alias("first")))
    c.drop_spool(met, groups)
    return out


def repeats(docs: DataFrame, text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """d, i, length, first, long (spooled): for every place whose line occurs earlier, the exact length of the longest run that begins there and at an earlier place, the earliest such place, and whether its line has `min_chars` characters."""
    lines = docs.select("doc_id", _doc_key(text_col).alias("d"), F.posexplode(_worded(F.col(text_col), min_chars)).alias("i", "line")).select("doc_id", "d", "i", F.col("line.h").alias("h"), F.col("line.long").alias("long"))
    lines = c.spool(lines.distinct())
    levels = [_ranked(lines, ["h"])]
    while levels[-1].limit(1).count():
        levels.append(classes_at(levels[-1], 1 << len(levels) - 1))
    self_ = F.struct("doc_id", "d", "i")
    later = [x.where(F.col("first") < self_).select("doc_id", "d", "i", F.lit(k).alias("level"), F.struct("rank", "first").alias("in")) for k, x in enumerate(levels)]
    found = later[0]
    for x in later[1:]:
        found = found.unionByName(x)
    top = c.spool(found.groupBy("d", "i").agg(F.first("doc_id").alias("doc_id"), F.max("level").alias("level"), F.max_by("in", "level").alias("in")))
    start = top.select("doc_id", "d", "i", "level", F.xxhash64("level", "in.rank").alias("interval"), F.expr("shiftleft(1, level)").alias("length"), F.col("in.first").alias("first"))
    done, todo = start.where("level = 0").drop("level"), None
    for j in range(len(levels) - 2, -1, -1):
        new = start.where(F.col("level") == j + 1).drop("level")
        deeper = _halve(new if todo is None else todo.unionByName(new), levels[j], 1 << j)
        c.drop_spool(*([todo] if todo is not None else []))
        todo = deeper
    if todo is not None:
        done = done.unionByName(todo)
    marks = lines.where("long").select("d", "i", F.lit(True).alias("long"))
    out = c.spool(done.join(marks, ["d", "i"], "left").select("d", "i", "length", "first", F.coalesce("long", F.lit(False)).alias("long")))
    c.drop_spool(lines, top, *levels, *([todo] if todo is not None else []))
    return out


def deleted_runs(docs: DataFrame, min_lines: int = 2, text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """d, runs: the maximal repeated runs of each document with one, in order: start, length (in lines with a word), source_doc_id, source_start."""
    at = repeats(docs, text_col, min_chars).where((F.col("length") >= min_lines) | F.col("long"))
    run = F.struct(F.col("i").alias("start"), "length", F.col("first.doc_id").alias("source_doc_id"), F.col("first.i").alias("source_start"))
    per = at.groupBy("d").agg(F.sort_array(F.collect_list(run)).alias("runs"))
    inside = lambda x, y: F.coalesce((y["start"] == x["start"] - 1) & (y["length"] > x["length"]), F.lit(False))
    return per.select("d", F.filter("runs", lambda x, k: ~inside(x, F.get("runs", k - 1))).alias("runs"))


def dedup_lines(docs: DataFrame, min_lines: int = 2, text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, row (docs' columns), text (without later copies), n_lines, deleted (number of lines), runs (see `deleted_runs`)."""
    found = deleted_runs(docs, min_lines, text_col, min_chars)
    rows = docs.select("doc_id", c.boxed(docs), c.column(text_col).cast("string").alias("text"), _doc_key(text_col).alias("d"))
    # deletions grow with the corpus: a merge join at every size
    rows = rows.join(found.hint("merge"), "d", "left")
    text, runs = F.col("text"), F.col("runs")
    lines, worded = _lines(text), _worded(text, min_chars)
    end = lambda x: F.coalesce(x["start"] + x["length"], F.lit(0))
    # starts and ends both rise from run to run, so each run adds what the one before does not reach
    parts = F.transform(runs, lambda x, k: F.struct(F.greatest(x["start"], end(F.get("runs", k - 1))).alias("a"), (end(x) - 1).alias("b")))
    gone = F.flatten(F.transform(F.filter(parts, lambda x: x["a"] <= x["b"]), lambda x: F.sequence(x["a"], x["b"])))
    let = lambda value, body: F.transform(F.array(value), body)[0]
    kept = let(lines, lambda xs: let(worded, lambda ws: let(gone, lambda at: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(xs) - 1), F.transform(at, lambda i: F.get(ws, i)["raw"])), lambda j: F.get(xs, j)), "\n"))))
    none = F.array().cast(found.schema["runs"].dataType)
    return rows.select(
        "doc_id", "row", F.when(runs.isNull(), text).otherwise(kept).alias("text"), F.size(worded).cast("long").alias("n_lines"),
        F.when(runs.isNull(), 0).otherwise(F.aggregate(parts, F.lit(0), lambda acc, x: acc + F.greatest(x["b"] - x["a"] + 1, F.lit(0)))).cast("long").alias("deleted"), F.coalesce(runs, none).alias("runs"),
    )


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup does to every document: lines, deleted lines, maximal repeated runs and the longest, and a digest of the text that is left."""
    out = dedup_lines(c.documents(spark, sf_dir).select("doc_id", "text"))
    longest = F.coalesce(F.array_max(F.transform("runs", lambda r: r["length"])), F.lit(0)).cast("long")
    return out.select("doc_id", "n_lines", F.col("deleted").alias("deleted_lines"), F.size("runs").cast("long").alias("n_runs"), longest.alias("longest_run"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: The same result from all pairs of equal lines: runs are islands on the diagonals, and each place takes its longest.
OP8_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS raw FROM documents),
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY raw) AS i FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
p AS (SELECT a.doc_id, a.i, b.doc_id AS e, a.i - b.i AS g FROM w a JOIN w b ON a.line = b.line AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.i < a.i))),
q AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, e, g ORDER BY i) AS k FROM p),
z AS (SELECT doc_id, i, max(i) OVER (PARTITION BY doc_id, e, g, k) - i + 1 AS n FROM q),
f AS (SELECT z.doc_id, z.i, max(z.n) AS n FROM z JOIN w ON z.doc_id = w.doc_id AND z.i = w.i GROUP BY z.doc_id, z.i, w.line HAVING max(z.n) >= 2 OR length(w.line) >= 100),
m AS (SELECT f.* FROM f LEFT JOIN f AS b ON f.doc_id = b.doc_id AND f.i = b.i + 1 AND b.n > f.n WHERE b.i IS NULL),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM m),
per AS (SELECT doc_id, count(*) AS n_runs, max(n) AS longest_run FROM m GROUP BY 1), cut AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_lines FROM w GROUP BY 1),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.raw) AS t FROM l LEFT JOIN w ON l.doc_id = w.doc_id AND l.raw = w.raw LEFT JOIN gone ON w.doc_id = gone.doc_id AND w.i = gone.i WHERE gone.i IS NULL GROUP BY 1)
SELECT d.doc_id, coalesce(n.n_lines, 0) AS n_lines, coalesce(cut.n, 0) AS deleted_lines, coalesce(per.n_runs, 0) AS n_runs, coalesce(per.longest_run, 0) AS longest_run,
length(coalesce(kept.t, '')) AS kept_chars, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN per ON d.doc_id = per.doc_id LEFT JOIN cut ON d.doc_id = cut.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


def cleaned_documents(docs: DataFrame) -> DataFrame:
    """The documents without later copies of repeated runs, with n_chars of what is left; those left without a word go. docs' own columns."""
    out = dedup_lines(docs).where((F.col("deleted") == 0) | (F.col("deleted") < F.col("n_lines")))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        old = F.col(f"row.c{docs.columns.index('n_chars')}")
        new["n_chars"] = F.when(F.col("deleted") > 0, F.length("text")).otherwise(old).cast(docs.schema["n_chars"].dataType)
    return c.unboxed(out, docs, **new)
