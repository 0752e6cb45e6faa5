import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.sources import audio, documents
from larkspan.streaming import consent, prepare, sessions


def pcm(x, bits, channels=1, rate=8000):
    x = np.asarray(x)
    if bits == 24:
        v = (x * 2**23).astype("<i4")
        body = v.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    elif bits == 8:
        body = (x * 128 + 128).astype(np.uint8).tobytes()
    else:
        body = (x * 2 ** (bits - 1)).astype(f"<i{bits // 8}").tobytes()
    head = struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + head + b"data" + struct.pack("<I", len(body)) + body


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
def test_integer_samples(bits):
    x = np.array([0.0, 0.5, -0.5, 0.25])
    rate, got = audio.decode_wav(pcm(x, bits))
    assert rate == 8000 and np.allclose(got[:, 0], x, atol=2.0**-7)


def test_recordings(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "ok.wav").write_bytes(audio.encode_wav(np.sin(np.arange(4096) / 10), 8000, {"ISFT": "test"}))
    (tmp_path / "bad.wav").write_bytes(b"not a sound")
    (tmp_path / "nan.wav").write_bytes(audio.encode_wav(np.array([1.0, np.nan]), 8000))
    (tmp_path / "empty.wav").write_bytes(audio.encode_wav(np.zeros(0), 8000))
    (tmp_path / "two.wav").write_bytes(pcm([0.5, 0.0, 0.5, 0.0], 16, 2))
    df = audio.read_recordings(spark, str(tmp_path))
    got = {r.path.rsplit("/")[-1]: r for r in df.collect()}
    assert got["ok.wav"].status == "ok" and len(got["ok.wav"].samples) == 4096 and got["two.wav"].samples == [0.25, 0.25]
    assert got["bad.wav"].reason.startswith("unreadable") and got["empty.wav"].reason == "empty" and got["nan.wav"].status == "failed"
    assert audio.frame_levels(df).where("path like '%ok.wav'").count() == 9
    melody = audio.tone(spark, [(440.0, 0.5), (220.0, 0.25)])
    assert melody.count() == 6000 and melody.where("note = 1").agg(F.min("sample")).first()[0] == 4000


def test_manifest_and_paths(spark, tmp_path):
    doc = {"dataset": "d", "root": "/r", "items": [{"path": "b.wav", "singer": "s", "labels": {"x": "1"}, "meta": {}}, {"path": "a.wav", "singer": None, "labels": {}, "meta": {"pair_id": "p"}}]}
    (tmp_path / "m.json").write_text(json.dumps(doc, indent=1))
    items = documents.read_manifest(spark, str(tmp_path / "m.json"))
    assert sorted(r.full_path for r in items.collect()) == ["/r/a.wav", "/r/b.wav"]
    documents.write_manifest(items, str(tmp_path / "out"))
    assert sorted(map(str, documents.read_manifest(spark, str(tmp_path / "out")).collect())) == sorted(map(str, items.collect()))
    files = spark.createDataFrame([("/x/FULL/s1/long/vibrato/a.wav",), ("/x/FULL/s1/b.wav",)], "path string")
    got = documents.path_parts(files, "FULL", ["singer", "context", "technique", "file"]).orderBy("path").collect()
    assert got[1].technique == "vibrato" and got[0].skipped == "depth 2"
    audio_files = spark.createDataFrame([("/a/one.wav",), ("/a/two.wav",)], "path string")
    labels = spark.createDataFrame([("/b/one.json", 5)], "path string, v int")
    matched, rest = documents.stem_join(audio_files, labels)
    assert matched.first().label_v == 5 and rest.count() == 1


def test_realset_problems(spark, tmp_path):
    ok = {"id": "t", "audio": "a", "role": "target", "condition": "clean"}
    lines = [ok, {**ok, "id": "u", "role": "take", "target": "t"}, {**ok, "id": "v", "role": "take", "target": "zz"}, {**ok, "id": "w", "condition": "moon"}, {"id": "x"}, {**ok, "id": "y"}, {**ok, "id": "y"}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n\n")
    got = sorted((r.id or "", r.problem or "") for r in documents.read_realset(spark, str(tmp_path / "r.jsonl")).collect())
    assert got == sorted([("t", ""), ("u", ""), ("v", "unknown target"), ("w", "unknown condition"), ("x", "missing audio"), ("y", "duplicate id"), ("y", "duplicate id"), ("", "not JSON")])


def test_pitch_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text("# comment\n0.0,440\n0.01,0\nbad,1\n0.02 , 220.5\n")
    got = [(r.time, r.hz) for r in documents.read_pitch_csv(spark, str(tmp_path / "p.csv")).orderBy("time").collect()]
    assert got == [(0.0, 440.0), (0.01, None), (0.02, 220.5)]
    (tmp_path / "p.pv").write_text("0\n69\n81\n")
    assert [(round(r.time, 2), r.hz) for r in documents.read_semitones(spark, str(tmp_path / "p.pv")).orderBy("time").collect()] == [(0.0, None), (0.02, 440.0), (0.04, 880.0)]


TIERS = 'File type = "ooTextFile"\nObject class = "TextGrid"\n\nxmin = 0\nxmax = 2\ntiers? <exists>\nsize = 1\nitem []:\n    item [1]:\n        class = "IntervalTier"\n        name = "words 1"\n        xmin = 0\n        xmax = 2\n        intervals: size = 2\n        intervals [1]:\n            xmin = 0\n            xmax = 1.5\n            text = "say ""hi"""\n        intervals [2]:\n            xmin = 1.5\n            xmax = 2\n            text = ""\n'


def test_tiers(spark, tmp_path):
    want = [("words 1", 0.0, 1.5, 'say "hi"'), ("words 1", 1.5, 2.0, "")]
    assert documents.parse_tiers(TIERS) == want
    short = '"ooTextFile"\n"TextGrid"\n0\n2\n<exists>\n1\n"IntervalTier"\n"words 1"\n0\n2\n2\n0\n1.5\n"say ""hi"""\n1.5\n2\n""\n'
    assert documents.parse_tiers(short) == want
    (tmp_path / "t.TextGrid").write_bytes(TIERS.encode("utf-16"))
    assert documents.read_tiers(spark, str(tmp_path)).count() == 2


def test_json_documents(spark):
    df = spark.createDataFrame([('{"a": {"b": [1, 2], "c": null}, "d": 1}',), ('{"a": {"b": []}}',), (None,)], "j string")
    assert {r.path: r.n for r in documents.key_counts(df, "j").collect()} == {"a.b.0": 1, "a.c": 1, "d": 1, "a.b": 1}
    deep = spark.createDataFrame([('{"a": {"b": {"c": {"d": {"e": [{"f": 1}], "g": 2}}}}}',)], "j string")
    assert {r.path: r.n for r in documents.key_counts(deep, "j").collect()} == {"a.b.c.d.e.0.f": 1, "a.b.c.d.g": 1}
    made = spark.createDataFrame([(1,)], "x int").select(documents.document("explanation", F.struct("x")).alias("j"))
    assert documents.checked(made, "j", "explanation", "struct<x:int>").first().body.x == 1
    bad = spark.createDataFrame([('{"schema":"explanation","version":9,"body":{}}',), ('{"schema":"demo","version":1}',), ('{"schema":"explanation","version":0}',)], "j string")
    assert [r.problem for r in documents.checked(bad, "j", "explanation", "struct<x:int>").collect()] == ["newer version", "schema", "version"]


def test_consent(spark):
    log = spark.createDataFrame([("u", "train", True, 1), ("u", "train", False, 3), ("u", "eval", True, 2), ("v", "train", True, 1)], "user string, purpose string, granted boolean, seq int")
    tokens = spark.createDataFrame([("u", "t1", ["eval"], False), ("u", "t2", ["eval", "train"], False), ("v", "t3", ["train"], True)], "user string, token string, purposes array<string>, revoked boolean")
    assert {r.token: r.valid for r in consent.valid_tokens(tokens, log, ["user"]).collect()} == {"t1": True, "t2": False, "t3": False}
    assert {r.token for r in consent.revoke(tokens, "eval").where("revoked").collect()} == {"t1", "t2", "t3"}
    store = spark.createDataFrame([("u", "k", 1)], "user string, k string, v int")
    new = spark.createDataFrame([("u", "k", 2), ("v", "k", 3)], "user string, k string, v int")
    assert sorted(map(tuple, consent.upsert(store, new, ["user", "k"], log, "user", "train").collect())) == [("u", "k", 1), ("v", "k", 3)]
    assert consent.without_users(store, new.where("v = 2"), "user").count() == 0


def test_prepare_is_incremental(spark, tmp_path):
    items = spark.createDataFrame([(i,) for i in range(6)], "k int")
    work = lambda df: df.withColumn("status", F.when(F.col("k") == 3, "failed").otherwise("ok"))
    out = str(tmp_path / "out")
    assert prepare.prepare(items.where("k < 4"), out, "k", "s1", work) == 4
    assert prepare.prepare(items, out, "k", "s1", work) == 3  # the failed one again
    with pytest.raises(ValueError):
        prepare.prepare(items, out, "k", "s2", work)


def test_fading_stream_gives_the_batch_result(spark, tmp_path):
    rows = [(s, a, float((s * 37 + a * 53) % 120)) for s in range(4) for a in range(12)]
    schema = "session long, attempt long, load double"
    df = spark.createDataFrame(rows, schema)
    want = sorted(map(tuple, sessions.fading_batch(df).collect()))
    src = str(tmp_path / "in")
    df.where("attempt < 5").coalesce(1).write.parquet(src)
    stream = sessions.fading_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src))
    run = lambda: stream.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    run()
    df.where("attempt >= 5").coalesce(1).write.mode("append").parquet(src)
    run()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "o")).collect()))
    assert got == want


def test_gap_sessions(spark):
    df = spark.sql("select 'u' k, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,x) ts from values (0),(5),(60) t(x)")
    assert sorted(r.n for r in sessions.gap_sessions(df, "k", "ts", "10 minutes", "1 hour").collect()) == [1, 2]
