import zlib

import numpy as np

from larkspan.llm import _grams, langid, nbsvm

SF = "/root/testdata/sf0.01"


def test_langid_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = langid.op2_langid(spark, SF).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_langid_cases(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").limit(300)
    model = langid.fit(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !! 3"), (4, "the and of that " * 50_000), (5, "the and of that"), (None, "the and of that"), (6, "ЖЩЫЪ ъыь " * 30)], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(odd, model, ["doc_id"]).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0 and got[1].rejected
    assert got[4].lang_pred == got[5].lang_pred == got[None].lang_pred == "en"
    assert got[6].rejected and got[6].lang_pred in model.langs
    none = langid.fit(docs.selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert {r.lang_pred for r in langid.predict(odd, none, ["doc_id"]).collect()} == {"und"}
    assert langid.predict(odd.limit(0), model, ["doc_id"]).count() == 0


def test_slices_lose_no_gram(monkeypatch):
    text = "the quick onal " * 200 + "One, one two one two2 THREE!\n\n x y x y y é " * 60 + "w" * 2500 + " end end"
    whole, _ = langid.gram_counts([text])
    marks = nbsvm.indicators([text.encode()])
    monkeypatch.setattr(_grams, "SLICE", 1000)
    assert (langid.gram_counts([text])[0] == whole).all()
    for size in (1000, 333, 64):
        monkeypatch.setattr(_grams, "SLICE", size)
        assert (nbsvm.indicators([text.encode()])[0] == marks[0]).all()


def test_indicators_do_not_depend_on_neighbours():
    texts = [b"one two two", b"", b"Ab!! cd", b"one two two", b"two two", b" lead"]
    together = nbsvm.indicators(texts)
    assert all((nbsvm.indicators([t])[0] == together[i]).all() for i, t in enumerate(texts))


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(30, 6, replace=False)) for _ in range(60)]
    values, y = np.ones(30), np.sign(np.array([(3 in r) + (5 in r) - 0.5 for r in rows]))
    w, b = nbsvm.descend(rows, values, y, np.ones(60), epochs=500)

    def loss(w, b):
        f = np.array([w[r].sum() / 6**0.5 for r in rows]) + b
        return (w @ w + b * b) / 2 + np.maximum(0, 1 - y * f).sum()

    best = loss(w, b)
    assert all(best <= loss(w + rng.normal(0, s, 30), b + rng.normal(0, s)) + 1e-3 for s in (0.01, 0.1, 1) for _ in range(50))


def test_quality_on_held_out_labels(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = nbsvm.op5_quality(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [(r.score, labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    good, bad = [s for s, q, _ in held if q], [s for s, q, _ in held if not q]
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert np.mean([p for _, q, p in held if q]) > 0.97


def test_quality_cases(spark):
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "BAD!! BAD!!", "x") for i in range(80)] + [(None, None, None), (5, None, "y")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = nbsvm.fit(docs, labels)
    got = nbsvm.score(docs, model, ["doc_id"]).collect()
    assert len(got) == 82 and all(0 <= r.score <= 1 for r in got)
    assert min(r.score for r in got[1:80:2]) > max(r.score for r in got[0:80:2])
    empty = nbsvm.fit(docs, labels.limit(0))
    assert {r.score for r in nbsvm.score(docs, empty, ["doc_id"]).collect()} == {0.5}
    assert nbsvm.score(docs.limit(0), model, ["doc_id"]).count() == 0
