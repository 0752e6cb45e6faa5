import pytest
from pyspark.sql import functions as F

from larkspan.plans.compare import compare

NOTES = [0.0, 200.0, 400.0, 500.0, 700.0]


def series(name, detune=None, shift=0.0, stretch=1):
    rows, frame = [], 0
    for k, cents in enumerate(NOTES):
        for _ in range(12 * stretch):
            rows.append((name, frame, cents + shift + (detune or {}).get(k, 0.0), 10.0, 0.9))
            frame += 1
        for _ in range(3):
            rows.append((name, frame, None, -20.0, 0.0))
            frame += 1
    return rows


@pytest.fixture(scope="module")
def result(spark):
    rows = series("target") + series("t1", {2: 60.0}, 1200.0) + series("t2", {2: 55.0, 4: -80.0}, 1200.0, 2)
    frames = spark.createDataFrame(rows, "recording string, frame long, value double, level double, confidence double")
    pairs = spark.createDataFrame([("t1", "target", 1), ("t2", "target", 2)], "take string, target string, take_no int")
    thresholds = spark.createDataFrame([("intonation", 30.0, 0.3, True), ("loudness", 3.0, 0.3, True)], "attribute string, mdc double, min_confidence double, usable boolean")
    chain = spark.createDataFrame([("t1", "level_chain", True, ""), ("t2", "level_chain", None, "unknown gain")], "take string, premise string, passed boolean, reason string")
    return {k: v.cache() for k, v in compare(frames, pairs, thresholds, chain).items()}


def test_octave_is_found(result):
    assert {(r["take"], r.transposition, r.passed) for r in result["octave"].collect()} == {("t1", 1200.0, True), ("t2", 1200.0, True)}


def test_planted_notes_are_the_items(result):
    got = {(r["take"], r.note): (round(r.magnitude), r.consistency, r.position) for r in result["items"].collect()}
    assert got == {("t1", 2): (60, "style_or_habit", 0), ("t2", 4): (-80, "undetermined", 0), ("t2", 2): (55, "style_or_habit", 1)}


def test_the_rest_is_withheld_with_a_reason(result):
    rows = result["withheld"].collect()
    assert {(r.by, r.reason) for r in rows if r["take"] == "t2" and r.attribute == "loudness"} == {("level_chain", "unknown gain")}
    assert {r.reason for r in rows if r["take"] == "t1"} == {"below_magnitude"}
    assert result["warp"].where(F.col("take") == "t1").count() == 75
