import pytest
from pyspark.sql import functions as F

from larkspan.operators import context, practice
from larkspan.sources import audio, writers


def test_syllables_and_notes(spark):
    notes = spark.createDataFrame([("r", 0, 10), ("r", 10, 20), ("r", 20, 60), ("q", 0, 5), ("q", 5, 9)], "k string, start long, end long")
    syl = spark.createDataFrame([("r", i, s) for i, s in enumerate("사랑해요")] + [("q", 0, "아")], "k string, pos int, syllable string")
    got = {(r.k, r.note): (r.text, r.melisma) for r in context.syllables_on_notes(notes, syl, ["k"]).collect()}
    assert got == {("r", 0): ("사", False), ("r", 1): ("랑", False), ("r", 2): ("해요", False), ("q", 0): ("아", False), ("q", 1): (None, True)}
    timed = spark.createDataFrame([("r", 8, 12, "a"), ("r", 12, 20, "b"), ("r", 60, 70, "c")], "k string, start long, end long, syllable string")
    over = {r.start: r.texts for r in context.syllables_for(notes.where("k = 'r'"), timed, ["k"]).collect()}
    assert over == {0: ["a"], 10: ["a", "b"]}


def test_frame_tokens(spark):
    frames = spark.createDataFrame([("r", i) for i in range(6)], "k string, frame long")
    spans = spark.createDataFrame([("r", 0, 4, "a", 0), ("r", 2, 3, "b", 1)], "k string, start long, end long, token string, pos int")
    assert [r.token for r in context.frame_tokens(frames, spans, ["k"]).orderBy("frame").collect()] == ["a", "a", "b", "a", None, None]


def test_merged_pitch_follows_the_agreement(spark):
    rows = []
    for i in range(8):
        rows += [("r", i, "a", 100.0, 1.0), ("r", i, "b", 105.0 if i != 4 else 1305.0, 1.0), ("r", i, "c", 1300.0 if i == 4 else 110.0, 0.5)]
    got = context.merged_pitch(spark.createDataFrame(rows, "k string, frame long, tracker string, cents double, weight double"), ["k"]).orderBy("frame").collect()
    assert len(got) == 8 and all(abs(r.cents - 105) <= 10 for r in got)
    assert got[0].confidence == 1.0 and got[4].confidence == pytest.approx(0.4)


def test_practice(spark):
    mapping = spark.createDataFrame([(0, "scoop:missing", "e1"), (1, "intonation:-", "e2"), (2, "intonation", "e3"), (3, "quality_*", "e4"), (4, "z", "gone")], "pos int, pattern string, exercise string")
    items = spark.createDataFrame([("scoop", "missing", 1.0), ("intonation", "none", -1.0), ("intonation", "none", 1.0), ("quality_breathy", "none", 1.0), ("other", "none", 1.0)], "attribute string, status string, magnitude double")
    got = {(r.attribute, r.magnitude): r.exercise for r in practice.exercise_of(items, mapping).collect()}
    assert got == {("scoop", 1.0): "e1", ("intonation", -1.0): "e2", ("intonation", 1.0): "e3", ("quality_breathy", 1.0): "e4", ("other", 1.0): None}
    ex = spark.createDataFrame([("e1", "beginner", ["loud"]), ("e2", "advanced", []), ("e3", "intermediate", ["soft"]), ("e4", "expert", None)], "id string, level string, tags array<string>")
    assert {r.id for r in practice.allowed(ex, "intermediate", ["loud"]).collect()} == {"e3"}
    assert {r.problem for r in practice.check_mapping(mapping, ex).collect()} == {"no such exercise: gone", "unknown level of e4"}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("b", 2.0), ("a", None)], "name string, v double")
    writers.write_lines(df, str(tmp_path / "j"), ["name"])
    assert [r.name for r in spark.read.json(str(tmp_path / "j")).orderBy("name").collect()] == ["a", "b"]
    writers.write_partition(df.withColumn("p", F.lit(1)), str(tmp_path / "p"), "p")
    writers.write_partition(df.limit(1).withColumn("p", F.lit(2)), str(tmp_path / "p"), "p")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    assert writers.text_table(df.orderBy("name")).splitlines()[2:] == ["a", "b     2.000"]
    text, problems = writers.card({"name": "m", "purpose": "p", "data": ["d"], "metrics": {"x": 1}})
    assert problems == ["missing limits"] and "- x: 1" in text
    sound = spark.createDataFrame([("x", 8000, [0.0, 0.5])], "path string, rate int, samples array<double>")
    assert audio.decode_wav(bytes(writers.sound_files(sound).first().content))[1][:, 0].tolist() == [0.0, 0.5]
