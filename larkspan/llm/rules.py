"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule rejects a document whose statistic is above a cutoff. Labelled documents that pass the base rule are the holdout:
in every stratum, a cutoff of a fixed grid is admissible if the exact binomial test rules out, at level delta divided by the
number of (stratum, rule, cutoff) tests, that it rejects a share of good documents above risk / (number of rules). So with
probability 1 - delta no stratum loses more than `risk` of its good documents. Among admissible cutoffs the one with the
most rejected bad less rejected good documents is taken, then the most lenient; a rule without one is off in that stratum.

Defined results: null text has no words (all counts 0, base failed); a null stratum is a stratum of its own; documents in a
stratum without labels are judged by the base rule alone; contradicting labels of one id count as their maximum, null labels
and null ids are left out; repeated rows are judged alike; statistics carry reserved names, input columns are kept aside.
Windows of five words are compared by 64-bit hashes inside one text.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

WINDOW = 5
BLANKS = " \t\n\x0b\x0c\r"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words in windows of five that occur twice or more in the text."""
    size = F.size(words)

    def covered(at: Column) -> Column:
        """at: sorted first words of repeated windows; each covers five words."""
        last = F.size(at) - 1
        return F.aggregate(F.sequence(F.lit(0), last), F.lit(0), lambda acc, j: acc + F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - F.get(at, j), F.lit(WINDOW))))

    def repeated(pairs: Column) -> Column:
        same = lambda j, k: F.coalesce(F.get(pairs, j)["h"] == F.get(pairs, k)["h"], F.lit(False))
        places = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
        return F.sort_array(F.transform(places, lambda j: F.get(pairs, j)["i"]))

    def count(windows: Column) -> Column:
        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_let(pairs, lambda p: _let(repeated(p), covered)))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = lambda h: F.transform(F.sequence(F.lit(0), size - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
    return F.when(size < WINDOW, F.lit(0)).otherwise(_let(hashes, lambda h: _let(windows(h), count)))


def statistics(text: Column) -> Column:
    """Struct of counts over a whole text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    solid = text
    for blank in BLANKS:
        solid = F.replace(solid, F.lit(blank), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    long = lambda x, name: x.cast("long").alias(name)

    def of(ws: Column) -> Column:
        return F.struct(
            long(F.size(ws), "n_words"), long(F.length(solid), "word_chars"), long(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), "n_symbols"),
            _let(lines, lambda x: F.struct(long(F.size(x), "n_lines"), long(F.size(x) - F.size(F.array_distinct(x)), "n_dup_lines"))).alias("lines"),
            long(_repeat_words(ws), "n_repeat_words"), long(F.regexp_count(text, F.lit(r"\p{Lu}")), "n_upper"),
        )

    return _let(words, of)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def with_statistics(df: DataFrame, text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """df and a struct `_s`: the counts, base_failed and the stratum."""
    s = F.col("_s")
    base = (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])
    fields = [s[x].alias(x) for x in (*COUNTS[:3], "n_repeat_words", "n_upper")] + [s["lines"][x].alias(x) for x in ("n_lines", "n_dup_lines")]
    stratum = F.coalesce(F.concat(F.lit("="), F.col(stratum_col).cast("string")), F.lit("null"))
    return df.withColumn("_s", statistics(F.col(text_col))).withColumn("_s", F.struct(*fields, base.alias("base_failed"), stratum.alias("stratum")))


def _share(part: str, whole: str) -> Callable[[Column], Column]:
    return lambda s: F.when(s[whole] > 0, s[part] / s[whole]).otherwise(0.0)


#: name: (statistic, cutoffs from strict to lenient); above the cutoff a document is rejected.
RULES: dict[str, tuple[Callable[[Column], Column], list[float]]] = {
    "symbol_share": (_share("n_symbols", "word_chars"), [0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3]),
    "upper_share": (_share("n_upper", "word_chars"), [0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8]),
    "dup_line_share": (_share("n_dup_lines", "n_lines"), [0.1, 0.2, 0.3, 0.5, 0.7]),
    "repeat_share": (_share("n_repeat_words", "n_words"), [0.02, 0.05, 0.1, 0.15]),
    "mean_word_above": (_share("word_chars", "n_words"), [7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0]),
    "mean_word_below": (lambda s: -_share("word_chars", "n_words")(s), [-3.5, -3.0, -2.5, -2.0, -1.5]),
}


def _stirling_error(x: Column) -> Column:
    """log x! less Stirling's formula, for x >= 1: tabled up to 15, then its series, which is exact to the last digits there."""
    table = F.array(*[F.lit(math.lgamma(i + 1) - ((i + 0.5) * math.log(i) - i + 0.5 * math.log(2 * math.pi))) for i in range(1, 16)])
    y = x * x
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680) / y) / y) / y) / x
    return F.when(x <= 15, F.get(table, (x - 1).cast("int"))).otherwise(series)


def _log_binomial_cdf(n: Column, k: Column, p: float) -> Column:
    """log P(Bin(n, p) <= k) for k < n * p, exact at every size: the term of k in closed form, and the sum of the terms below in
    units of it, as far down as one can still add to a double (some ten standard deviations)."""
    q = 1 - p
    x, rest = F.greatest(k, F.lit(1)).cast("double"), (n - F.greatest(k, F.lit(1))).cast("double")
    top = _stirling_error(n.cast("double")) - _stirling_error(x) - _stirling_error(rest) + 0.5 * F.log(n / (2 * math.pi * x * rest)) - x * F.log(x / (n * p)) - rest * F.log(rest / (n * q))

    def step(acc: Column, j: Column) -> Column:
        term = acc["term"] * (j * q) / ((n - j + 1) * p)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    far = F.greatest(F.lit(1).cast("long"), k - F.ceil(10 * F.sqrt(n * (p * q))) - 50)
    one = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    total = F.aggregate(F.sequence(F.greatest(k, F.lit(1)).cast("long"), far, F.lit(-1).cast("long")), one, step, lambda acc: acc["total"])
    return F.when(k < 1, n * math.log1p(-p)).otherwise(top + F.log(total))


def thresholds(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", risk: float = 0.03, delta: float = 0.05) -> DataFrame:
    """stratum, cuts (map of rule to cutoff). stats has id_col and `_s`."""
    lab = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).alias("_good"))
    held = stats.select(F.col(id_col).alias("_id"), "_s").where(~F.col("_s.base_failed")).join(lab, "_id")
    s, good = F.col("_s"), F.col("_good")
    hits = {(r, x): stat(s) > x for r, (stat, grid) in RULES.items() for x in grid}
    aggs = [F.count_if(h & (good if g else ~good)).alias(f"_{i}_{g}") for i, h in enumerate(hits.values()) for g in (0, 1)]
    sums = c.spool(held.groupBy(s["stratum"].alias("stratum")).agg(F.count_if(good).alias("n"), *aggs))
    tests = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(x).alias("cut"), F.col(f"_{i}_1").alias("k"), F.col(f"_{i}_0").alias("caught")) for i, (r, x) in enumerate(hits)])
    rows = sums.select("stratum", "n", F.inline(tests))
    p = risk / len(RULES)
    level = math.log(delta / (max(1, sums.count()) * len(hits)))
    n, k = F.col("n"), F.col("k")
    sure = rows.where((n > 0) & (k < n * p) & (F.col("caught") > k)).where(_log_binomial_cdf(n, k, p) <= level)
    best = sure.groupBy("stratum", "rule").agg(F.max_by("cut", F.struct(F.col("caught") - k, -k, "cut")).alias("cut"))
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cut"))).alias("cuts"))


def judge(with_stats: DataFrame, cuts: DataFrame) -> DataFrame:
    """Add `_kept` and `_by` (the rules that reject) to rows that have `_s`; cuts is a spooled table of thresholds()."""
    s = F.col("_s")
    rows = c.join_small(with_stats.withColumn("_stratum", s["stratum"]), cuts.select(F.col("stratum").alias("_stratum"), F.col("cuts").alias("_cuts")), "_stratum", "left")
    against = F.array_compact(F.array(*[F.when(stat(s) > F.try_element_at("_cuts", F.lit(r)), F.lit(r)) for r, (stat, _) in RULES.items()]))
    return rows.withColumn("_by", against).withColumn("_kept", ~s["base_failed"] & (F.size("_by") == 0)).drop("_stratum", "_cuts")


def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; thresholds come from all labelled documents, by language."""
    stats = c.spool(with_statistics(c.documents(spark, sf_dir)).select("doc_id", "_s"))
    cuts = c.spool(thresholds(stats, c.documents(spark, sf_dir, "labels")))
    s = F.col("_s")
    return judge(stats, cuts).select("doc_id", *[s[x].alias(x) for x in COUNTS], s["base_failed"].alias("base_failed"), F.col("_kept").alias("kept"), s["stratum"].alias("stratum"), F.array_join("_by", ",").alias("rejected_by"))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns. Statistics are taken once, for thresholds and verdicts."""
    rows = c.spool(with_statistics(docs.select(c.boxed(docs), "doc_id", "text", "lang")).select("row", "doc_id", "_s"))
    cuts = c.spool(thresholds(rows, labels))
    return c.unboxed(judge(rows, cuts).where("_kept"), docs)
