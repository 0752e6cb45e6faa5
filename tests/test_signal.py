import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.functions import hangul
from larkspan.operators import signal as s

RATE = 8000


def tone(hz, seconds=1.0):
    t = np.arange(int(RATE * seconds)) / RATE
    return np.sin(2 * np.pi * hz * t) + 0.4 * np.sin(4 * np.pi * hz * t)


def test_frames_are_centred():
    x = np.arange(1, 101, dtype=float)
    f = s.frames(x, 8, 10)
    assert f.shape == (11, 8) and f[0].tolist() == [0, 0, 0, 0, 1, 2, 3, 4] and f[3, 4] == 31


def test_difference_function_against_its_definition():
    rng = np.random.default_rng(0)
    f = rng.normal(size=60)
    got = s.difference_function(f, 20)
    d = np.array([((f[:40] - f[k : k + 40]) ** 2).sum() for k in range(21)])
    want = np.concatenate([[1], d[1:] * np.arange(1, 21) / np.cumsum(d[1:])])
    assert np.allclose(got, want)


@pytest.mark.parametrize("hz", [110.0, 220.0, 440.0])
def test_pitch_of_a_tone(hz):
    got = s.yin(tone(hz), RATE, 256)
    assert abs(1200 * np.log2(np.nanmedian(got["hz"]) / hz)) < 5
    assert np.isnan(s.yin(np.zeros(4000), RATE, 256)["hz"]).all()


def test_measures():
    rng = np.random.default_rng(1)
    x = tone(200)
    assert s.si_sdr(2 * x, x) > 100 and s.si_sdr(s.add_noise(x, 20, "white", rng), x) == pytest.approx(20, abs=1)
    noise = rng.normal(size=4000)
    assert s.delay(noise, s.shift(noise, 37), 100)[0] == 37 and s.delay(noise, s.shift(noise, -12), 100)[0] == -12
    p = s.spectrum(x, 512, 256)
    assert s.log_spectral_distance(p, p).max() == 0 and s.log_spectral_distance(p, 10 * p).mean() == pytest.approx(10, abs=1)
    assert s.mel_cepstrum(x, RATE, 256).shape[1] == 13
    low = s.band_limit(tone(200) + np.sin(2 * np.pi * 3000 * np.arange(RATE) / RATE), RATE, 0, 1000)
    assert np.abs(np.fft.rfft(low))[3000] < 1e-3 * np.abs(np.fft.rfft(low))[200]
    assert np.abs(s.clip(x, 0.5)).max() == pytest.approx(0.5 * np.abs(x).max())
    assert s.si_sdr(s.quantised_spectrum(x), x) > 10


def test_decay():
    hop = 0.01
    level, voiced = [], []
    for _ in range(4):
        level += [0.0] * 20 + [-1.5 * k for k in range(40)]
        voiced += [True] * 20 + [False] * 40
    assert s.decay_time(np.array(level), hop, np.array(voiced)) == pytest.approx(0.4, abs=0.02)


def test_recordings(spark):
    df = spark.createDataFrame([("a", RATE, tone(220, 0.5).tolist()), ("b", RATE, s.clip(tone(300, 0.5), 0.3).tolist()), ("e", RATE, [])], "path string, rate int, samples array<double>")
    q = {r.path: r for r in s.quality(df).collect()}
    assert q["b"].clipped > 0.2 > q["a"].clipped and q["e"].level_db is None
    track = s.pitch_track(df.where("path <> 'e'")).groupBy("path").agg(F.median("hz").alias("hz")).collect()
    assert {r.path: round(r.hz) for r in track} == {"a": 220, "b": 300}
    grid = s.condition_grid(df.where("path = 'a'"))
    assert grid.count() == len(s.CONDITIONS)
    again = s.condition_grid(df.where("path = 'a'"), ["white_20"])
    assert again.first().samples == grid.where("condition = 'white_20'").first().samples
    levels = s.per_recording(grid, lambda x, r: {"value": float(np.abs(x).max())}, "value double", ("path", "condition")).withColumn("dimension", F.lit("peak"))
    rep = {r.condition: r for r in s.robustness(levels).collect()}
    assert rep["clean"].deviation == 0 and rep["clipped"].deviation > 0.3 and rep["room"].presence == 1


def test_hangul(spark):
    df = spark.createDataFrame([(1, "사랑해, 요!  그대여"), (2, "abc"), (3, None), (4, "가가")], "id int, text string")
    got = [(r.syllable, r.word_initial) for r in hangul.syllables(df, ["id"], "text").where("id = 1").orderBy("pos").collect()]
    assert got == list(zip("사랑해요그대여", [True, False, False, True, True, False, False]))
    assert [r.syllable for r in hangul.syllables(df, ["id"], "text").where("id = 4").orderBy("pos").collect()] == ["가", "가"]
    r = spark.createDataFrame([("강", "나무", "한")], "a string, b string, c string").select(hangul.with_particle("a", "은", "는").alias("x"), hangul.with_particle("b", "은", "는").alias("y"), hangul.decompose("c").alias("d"), hangul.decompose(F.lit("a")).alias("n")).first()
    assert (r.x, r.y, tuple(r.d), r.n) == ("강은", "나무는", (18, 0, 4), None)
