import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from larkspan.llm import _common as c
from larkspan.llm import linedup

HAS = re.compile(r"[^\x20\x09-\x0D]")


def brute(rows, k, chars=linedup.MIN_CHARS):
    """rows: (doc_id, text) -> {row: (n_lines, maximal runs, deleted places, text)} by comparing every place with every earlier one."""
    rows = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    raw = [(text or "").split("\n") for _, text in rows]
    seqs = [[(j, x) for j, x in enumerate(r) if HAS.search(x)] for r in raw]
    where = defaultdict(list)
    out = {}
    for n, (row, ws) in enumerate(zip(rows, seqs, strict=True)):
        longest = []
        for i, (_, line) in enumerate(ws):
            best, source = 0, None
            for m, j in where[line]:
                size = 0
                while i + size < len(ws) and j + size < len(seqs[m]) and ws[i + size][1] == seqs[m][j + size][1]:
                    size += 1
                if size > best:
                    best, source = size, (rows[m][0], j)
            longest.append((best, source) if best >= k or best and len(line) >= chars else (0, None))
            where[line].append((n, i))
        runs = [(i, size, *source) for i, (size, source) in enumerate(longest) if size and not (i and longest[i - 1][0] > size)]
        gone = {i for start, size, *_ in runs for i in range(start, start + size)}
        dead = {ws[i][0] for i in gone}
        out[row] = (len(ws), runs, sorted(gone), "\n".join(x for j, x in enumerate(raw[n]) if j not in dead) if gone else row[1])
    return out


def check(spark, rows, k, docs=None):
    docs = docs or spark.createDataFrame(rows, "doc_id long, text string")
    got = linedup.dedup_lines(docs, k).collect()
    want = brute(rows, k)
    assert len(got) == len(rows)
    for r in got:
        n, runs, gone, text = want[r.doc_id, r.row.c1]
        assert (r.n_lines, [tuple(x) for x in r.runs], r.text, r.deleted) == (n, runs, text, len(gone)), r.doc_id
    return got


@pytest.mark.parametrize("k", [1, 2, 3])
def test_random_lines_against_brute_force(spark, k):
    r = random.Random(k)
    rows = [(i, "\n".join(r.choice("abcdefgh") + r.choice(["", "", "x"]) for _ in range(r.randrange(12)))) for i in range(60)]
    rows += [(60 + i, "\n".join(r.choice("ab") for _ in range(r.randrange(40)))) for i in range(20)]
    rows += [(100, None), (101, ""), (102, " \n\t\n"), (103, "a\n\nb\n \nc"), (104, "a\n\nb\n \nc"), (104, "a\n\nb\n \nc"), (None, "q\nr\ns"), (105, "q\nr\ns")]
    rows += [(106, "x\n" + "long " * 20 + "\ny"), (107, "z\n" + "long " * 20 + "\nw"), (108, "long " * 20)]
    check(spark, rows, k)


def test_long_copies(spark):
    lines = [f"line {i}" for i in range(300)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["head", *lines[50:250], "tail"])), (3, "only\n" + "\n".join(lines[:1])), (4, "same\n" * 9 + "same"), (5, "\n".join([*lines[100:157], *lines[7:20]]))]
    got = {r.doc_id: r for r in check(spark, rows, 2)}
    assert [tuple(x) for x in got[2].runs] == [(1, 200, 1, 50)] and got[2].text == "head\ntail"
    assert [tuple(x) for x in got[5].runs] == [(0, 57, 1, 100), (57, 13, 1, 7)]
    assert got[4].text == "same" and got[4].runs[0].length == 9 and got[3].deleted == 0


def test_doubling_decides_the_runs(spark, monkeypatch):
    """Without ranks beyond one line, no run longer than a line is known."""
    docs = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, "x\nb\nc\nd")], "doc_id long, text string")
    assert [tuple(x) for r in linedup.dedup_lines(docs).collect() for x in r.runs] == [(1, 3, 1, 1)]
    monkeypatch.setattr(linedup, "classes_at", lambda suffixes, depth: suffixes.limit(0))
    assert not [x for r in linedup.dedup_lines(docs).collect() for x in r.runs]


def test_hot_lines_take_the_broadcast_path(spark, monkeypatch):
    r = random.Random(9)
    rows = [(i, "\n".join(r.choice(["hot", "hot", f"cold {r.randrange(40)}"]) for _ in range(9))) for i in range(50)]
    monkeypatch.setattr(c, "HOT_SHARE", 10)
    monkeypatch.setattr(c, "max", lambda a, b: a, raising=False)
    check(spark, rows, 2)


def test_query_and_stage(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows, 2)
    got = {r.doc_id: r for r in linedup.op8_lines(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(rows) and sum(r.deleted_lines for r in got.values()) > 0
    for (doc, _), (n, runs, gone, text) in want.items():
        assert (got[doc].n_lines, got[doc].deleted_lines, got[doc].kept_chars, got[doc].n_runs, got[doc].longest_run) == (n, len(gone), len(text), len(runs), max((x[1] for x in runs), default=0))
    extra = docs.withColumn("_text", F.lit(1)).withColumn("d", F.lit(2)).withColumn("runs", F.lit(3)).withColumn("a.b", F.lit(4))
    clean = linedup.cleaned_documents(extra)
    assert clean.columns == extra.columns
    kept = {r.doc_id: r for r in clean.collect()}
    assert set(kept) == {d for (d, _), (n, _, gone, _) in want.items() if not gone or len(gone) < n}
    assert all((r["_text"], r.d, r.runs, r["a.b"]) == (1, 2, 3, 4) for r in kept.values())
    assert all(kept[d].text == text and (not gone or kept[d].n_chars == len(text)) for (d, _), (_, _, gone, text) in want.items() if d in kept)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert linedup.dedup_lines(df).count() == 0


def test_query_gives_the_rows_of_its_sql(spark):
    from tests.oracle import differences

    assert differences(spark, "/root/testdata/sf0.01", linedup.op8_lines, linedup.OP8_SQL) is None
