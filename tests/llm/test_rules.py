import re
from math import comb, exp, lgamma, log, log1p

from pyspark.sql import functions as F

from larkspan.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    ws = WORD.findall(text)
    where = {}
    for i in range(len(ws) - 4):
        where.setdefault(tuple(ws[i : i + 5]), []).append(i)
    covered = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, r = len(ws), len(covered)
    return (n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), r, n < 10 or 100 * r > 20 * n)


def test_counts_against_brute_force(spark):
    odd = [None, "", " \n\t", "a b c d e", "a b c d e a b c d e", "x " * 40, "a b c d e f a b c d e f g\n\n a b \x0b q\x85r\n a b \x0b q\x85r", "a" * 100_000, "🙂 $#\n🙂 $#", "w " * 30_000]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()] + [(100_000 + i, t) for i, t in enumerate(odd)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string")).withColumn("n_words", F.lit("clash"))
    got = {r.doc_id: r["_s"] for r in rules.with_statistics(df).select("doc_id", "_s").collect()}
    for i, t in rows:
        s = got[i]
        assert (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, s.base_failed) == brute(t), i


def test_binomial(spark):
    for n, k, p in ((50, 0, 0.1), (200, 7, 0.1), (1000, 3, 0.02)):
        (got,) = spark.range(1).select(rules._log_binomial_cdf(F.lit(n).cast("long"), F.lit(k).cast("long"), p).alias("x")).first()
        assert abs(got - log(sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)))) < 1e-9


def test_binomial_at_every_size(spark):
    """Sums of logarithms of all terms, on both sides of any number of terms."""
    for n, k in ((4_100_000, 19_999), (4_100_000, 20_001), (9_000_000, 25_000), (50_000_000, 240_000), (400, 1), (400, 0), (3500, 16), (60_000, 299)):
        p = 0.005
        terms = [lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * log(p) + (n - j) * log1p(-p) for j in range(max(0, k - 60_000), k + 1)]
        top = max(terms)
        want = top + log(sum(exp(t - top) for t in terms))
        (got,) = spark.range(1).select(rules._log_binomial_cdf(F.lit(n).cast("long"), F.lit(k).cast("long"), p).alias("x")).first()
        assert abs(got - want) < 1e-6 * max(1, abs(want)), (n, k)


def stats(spark, rows):
    fields = "n_words long, word_chars long, n_symbols long, n_repeat_words long, n_upper long, n_lines long, n_dup_lines long, base_failed boolean, stratum string"
    return spark.createDataFrame([(i, (100, 500, sym, 0, 0, 10, 0, base, st)) for i, sym, base, st in rows], f"doc_id long, _s struct<{fields}>")


def test_thresholds_hold_the_risk(spark):
    # stratum a: bad documents have many symbols, 4000 good ones few; b: too few labels to be sure of anything
    rows = [(i, 30 if i % 5 == 0 else 1, False, "a") for i in range(5000)] + [(10_000 + i, 30 if i % 5 == 0 else 1, False, "b") for i in range(100)] + [(20_000, 400, True, "a")]
    df = stats(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i, *_ in rows] + [(None, 0), (3, None)], "doc_id long, quality int")
    cuts = rules.thresholds(df, labels)
    assert {r.stratum: r.cuts for r in cuts.collect()} == {"a": {"symbol_share": 0.05}}
    got = {r.doc_id: r for r in rules.judge(df, cuts).collect()}
    assert not got[5]["_kept"] and got[5]["_by"] == ["symbol_share"] and got[1]["_kept"] and got[10_000]["_kept"] and not got[20_000]["_kept"]
    # good documents just as often above every cutoff: no cutoff is admissible
    noisy = spark.createDataFrame([(i, 1) for i, *_ in rows], "doc_id long, quality int")
    assert rules.thresholds(df, noisy).count() == 0
    assert rules.thresholds(df.limit(0), labels).count() == 0 and rules.thresholds(df, labels.limit(0)).count() == 0


def test_query_keeps_good_documents(spark):
    got = {r.doc_id: r for r in rules.op3_rules(spark, "/root/testdata/sf0.1").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    good = [got[r.doc_id] for r in labels if r.quality == 1 and not got[r.doc_id].base_failed]
    bad = [got[r.doc_id].kept for r in labels if r.quality == 0]
    assert sum(not r.kept for r in good) <= 0.03 * len(good)
    assert sum(bad) < 0.5 * len(bad)
    assert not any("Python" in x or "Arrow" in x for x in [rules.op3_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()])


def test_kept_documents_have_their_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    extra = docs.withColumn("_s", F.lit(1)).withColumn("_kept", F.lit(2)).withColumn("row", F.lit(3)).withColumn("a.b", F.lit(4))
    out = rules.kept_documents(extra, labels)
    assert out.columns == extra.columns and 0 < out.count() < docs.count()
    assert {(r["_s"], r["_kept"], r.row, r["a.b"]) for r in out.collect()} == {(1, 2, 3, 4)}
