"""Measurements and changes of sound, one recording per row: NumPy over whole arrays, in Arrow batches.

Recordings have `path`, `rate` and `samples`. Every operator reads and writes columns, so conditions, measurements and their
comparison are ordinary joins and aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Array = np.ndarray


def per_recording(df: DataFrame, work: Callable[[Array, int], dict[str, object]], out: str, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """One row of `out` per recording; work gets samples and rate."""
    head = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [work(np.asarray(x, float), int(r)) for x, r in zip(pdf["samples"], pdf["rate"], strict=True)]
            yield pd.concat([pdf[list(keys)].reset_index(drop=True), pd.DataFrame(rows)], axis=1)

    return df.select(*keys, "rate", "samples").mapInPandas(run, f"{head}, {out}")


def per_frame(df: DataFrame, work: Callable[[Array, int], dict[str, Array]], out: str, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """One row of `out` per frame; work gives equally long arrays."""
    head = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                got = pd.DataFrame({k: list(v) for k, v in work(np.asarray(row["samples"], float), int(row["rate"])).items()})
                got.insert(0, "frame", np.arange(len(got)))
                for i, k in enumerate(keys):
                    got.insert(i, k, row[k])
                yield got

    return df.select(*keys, "rate", "samples").mapInPandas(run, f"{head}, frame long, {out}")


def frames(x: Array, window: int, hop: int) -> Array:
    """Centred frames, frame i around sample i * hop; zeros beyond the ends."""
    pad = np.concatenate([np.zeros(window // 2), x, np.zeros(window)])
    return np.lib.stride_tricks.sliding_window_view(pad, window)[: 1 + len(x) // hop + (len(x) // hop) * (hop - 1) : hop][: 1 + len(x) // hop]


def spectrum(x: Array, window: int, hop: int) -> Array:
    """Power by frame and bin, Hann window."""
    return np.abs(np.fft.rfft(frames(x, window, hop) * np.hanning(window), axis=1)) ** 2


def noise_floor(power: Array, share: float = 10.0) -> Array:
    """Low percentile over time of every bin."""
    return np.percentile(power, share, axis=0)


def log_spectral_distance(a: Array, b: Array) -> Array:
    """RMS difference in dB of two spectra, by frame."""
    n = min(len(a), len(b))
    d = 10 * np.log10(np.maximum(a[:n], 1e-12)) - 10 * np.log10(np.maximum(b[:n], 1e-12))
    return np.sqrt((d**2).mean(1))


def si_sdr(estimate: Array, reference: Array) -> float:
    """Scale-invariant signal-to-distortion ratio in dB."""
    scale = estimate @ reference / max(reference @ reference, 1e-20)
    target = scale * reference
    return float(10 * np.log10(max(target @ target, 1e-20) / max(((estimate - target) ** 2).sum(), 1e-20)))


def difference_function(frame: Array, most: int) -> Array:
    """Cumulative-mean-normalised squared difference of a frame with itself, by lag."""
    n = len(frame) - most
    size = 1 << int(np.ceil(np.log2(len(frame) + n)))
    cross = np.fft.irfft(np.fft.rfft(frame, size) * np.conj(np.fft.rfft(frame[:n], size)), size)[: most + 1]
    energy = np.concatenate([[0], np.cumsum(frame**2)])
    d = energy[n] + energy[n : n + most + 1] - energy[: most + 1] - 2 * cross
    d[0] = 0
    return np.concatenate([[1.0], d[1:] * np.arange(1, most + 1) / np.maximum(np.cumsum(d[1:]), 1e-12)])


def yin(x: Array, rate: int, hop: int, low: float = 70.0, high: float = 1000.0, limit: float = 0.15) -> dict[str, Array]:
    """Pitch and its clarity by frame: the first dip below the limit, refined by a parabola; NaN where there is none."""
    most, least = int(rate / low), max(2, int(rate / high))
    hz, clarity = [], []
    for f in frames(x, 3 * most, hop):
        d = difference_function(f, most)
        dips = np.flatnonzero((d[1:-1] < limit) & (d[1:-1] <= d[:-2]) & (d[1:-1] < d[2:])) + 1
        dips = dips[dips >= least]
        if not len(dips) or not f.any():
            hz.append(np.nan)
            clarity.append(0.0)
            continue
        k = int(dips[0])
        a, b, c = d[k - 1 : k + 2]
        shift = 0.5 * (a - c) / (a - 2 * b + c) if a - 2 * b + c else 0.0
        hz.append(rate / (k + float(np.clip(shift, -0.5, 0.5))))
        clarity.append(1 - float(b))
    return {"hz": np.array(hz), "confidence": np.array(clarity)}


def pitch_track(recordings: DataFrame, hop: int = 256, low: float = 70.0, high: float = 1000.0) -> DataFrame:
    """path, frame, hz (NULL unvoiced), confidence."""
    out = per_frame(recordings, lambda x, r: yin(x, r, hop, low, high), "hz double, confidence double")
    return out.withColumn("hz", F.when(~F.isnan("hz"), F.col("hz")))


def onset_strength(x: Array, window: int = 1024, hop: int = 256) -> Array:
    """Half-wave rectified rise of the log spectrum."""
    s = np.log1p(spectrum(x, window, hop))
    return np.concatenate([[0], np.maximum(np.diff(s, axis=0), 0).sum(1)])


def delay(a: Array, b: Array, most: int) -> tuple[int, float]:
    """Samples by which b lags a, from the phase of the cross spectrum, and the height of the peak."""
    n = 1 << int(np.ceil(np.log2(len(a) + len(b))))
    cross = np.fft.rfft(b, n) * np.conj(np.fft.rfft(a, n))
    r = np.fft.irfft(cross / np.maximum(np.abs(cross), 1e-12), n)
    lags = np.concatenate([r[-most:], r[: most + 1]])
    k = int(lags.argmax())
    return k - most, float(lags[k])


def shift(x: Array, n: int) -> Array:
    """Advance (n < 0) or delay, with zeros."""
    return np.concatenate([np.zeros(n), x[: len(x) - n]]) if n > 0 else np.concatenate([x[-n:], np.zeros(-n)]) if n else x


def mel_cepstrum(x: Array, rate: int, hop: int, window: int = 1024, bands: int = 26, count: int = 13) -> Array:
    """Cosine transform of log band energies on a mel scale, mean and variance normalised over the recording."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(50), mel(rate / 2), bands + 2) / 2595) - 1)
    freq = np.fft.rfftfreq(window, 1 / rate)
    up = (freq - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - freq) / (edges[2:] - edges[1:-1])[:, None]
    energy = np.log(np.maximum(spectrum(x, window, hop) @ np.maximum(0, np.minimum(up, down)).T, 1e-10))
    c = energy @ np.cos(np.pi / bands * np.outer(np.arange(bands) + 0.5, np.arange(count)))
    return (c - c.mean(0)) / np.maximum(c.std(0), 1e-9)


def aperiodicity(x: Array, rate: int, hop: int) -> Array:
    """Level in dB of what the pitch does not explain, against the whole, by frame."""
    d = yin(x, rate, hop)
    return 10 * np.log10(np.maximum(1 - np.clip(d["confidence"], 0, 1), 1e-6))


def decay_time(level: Array, hop_seconds: float, voiced: Array, span: float = 0.3) -> float | None:
    """Median time to fall by 60 dB, from the slope after every voiced stretch; None below two stretches."""
    ends = np.flatnonzero(voiced[:-1] & ~voiced[1:]) + 1
    n = int(span / hop_seconds)
    found = []
    for e in ends:
        part = level[e : e + n]
        part = part[: int(np.argmax(voiced[e : e + n]))] if voiced[e : e + n].any() else part
        if len(part) >= 5:
            slope = np.polyfit(np.arange(len(part)) * hop_seconds, part, 1)[0]
            if slope < -1:
                found.append(-60 / slope)
    return float(np.median(found)) if len(found) >= 2 else None


# ---------------------------------------------------------------- conditions


def coloured_noise(n: int, kind: str, rng: np.random.Generator) -> Array:
    """White or pink noise of unit power."""
    x = rng.normal(size=n)
    if kind == "pink":
        s = np.fft.rfft(x)
        s[1:] /= np.sqrt(np.arange(1, len(s)))
        s[0] = 0
        x = np.fft.irfft(s, n)
    return x / max(x.std(), 1e-12)


def add_noise(x: Array, snr_db: float, kind: str, rng: np.random.Generator) -> Array:
    active = np.abs(x) > 0.01 * max(np.abs(x).max(), 1e-12)
    power = (x[active] ** 2).mean() if active.any() else 0.0
    return x + coloured_noise(len(x), kind, rng) * np.sqrt(power / 10 ** (snr_db / 10))


def band_limit(x: Array, rate: int, low: float, high: float) -> Array:
    """Zero-phase band by smooth edges in the spectrum."""
    f = np.fft.rfftfreq(len(x), 1 / rate)
    gain = 1 / (1 + (f / max(high, 1)) ** 16) * (1 - 1 / (1 + (f / max(low, 1e-9)) ** 16) if low > 0 else 1)
    return np.fft.irfft(np.fft.rfft(x) * gain, len(x))


def reverberate(x: Array, rate: int, seconds: float, mix: float, rng: np.random.Generator) -> Array:
    """Convolution with decaying noise; the level is kept."""
    t = np.arange(int(rate * seconds)) / rate
    tail = rng.normal(size=len(t)) * 10 ** (-3 * t / seconds)
    n = 1 << int(np.ceil(np.log2(len(x) + len(t))))
    wet = np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(tail, n), n)[: len(x)]
    out = (1 - mix) * x + mix * wet * x.std() / max(wet.std(), 1e-12)
    return out * x.std() / max(out.std(), 1e-12)


def compress(x: Array, threshold_db: float, ratio: float) -> Array:
    """Static compression above a threshold."""
    level = 20 * np.log10(np.maximum(np.abs(x), 1e-9))
    return x * 10 ** (-(np.maximum(level - threshold_db, 0) * (1 - 1 / ratio)) / 20)


def clip(x: Array, level: float) -> Array:
    top = level * max(np.abs(x).max(), 1e-12)
    return np.clip(x, -top, top)


def quantised_spectrum(x: Array, window: int = 512, bits: int = 4) -> Array:
    """Coding noise: magnitudes of overlapping blocks rounded to 2**bits steps of a log scale."""
    hop = window // 2
    w = np.sin(np.pi * (np.arange(window) + 0.5) / window)
    pad = np.concatenate([np.zeros(hop), x, np.zeros(window)])
    out = np.zeros(len(pad))
    for at in range(0, len(pad) - window + 1, hop):
        s = np.fft.rfft(pad[at : at + window] * w)
        mag = np.abs(s)
        top = mag.max()
        if top > 0:
            step = 60 / 2**bits
            db = np.round(20 * np.log10(np.maximum(mag / top, 1e-3)) / step) * step
            s = s / np.maximum(mag, 1e-12) * top * 10 ** (db / 20) * (mag / top > 1e-3)
        out[at : at + window] += np.fft.irfft(s, window) * w
    return out[hop : hop + len(x)]


#: name: change(samples, rate, generator)
CONDITIONS: dict[str, Callable[[Array, int, np.random.Generator], Array]] = {
    "clean": lambda x, r, g: x,
    "white_20": lambda x, r, g: add_noise(x, 20, "white", g),
    "pink_25": lambda x, r, g: add_noise(x, 25, "pink", g),
    "phone": lambda x, r, g: band_limit(x, r, 300, min(3400, 0.45 * r)),
    "room": lambda x, r, g: reverberate(x, r, 0.4, 0.3, g),
    "compressed": lambda x, r, g: compress(x, -20, 4),
    "clipped": lambda x, r, g: clip(x, 0.5),
    "coded": lambda x, r, g: quantised_spectrum(x),
}


def condition_grid(recordings: DataFrame, names: list[str] | None = None, seed: int = 0) -> DataFrame:
    """Every recording under every condition: path, condition, rate, samples. The generator depends on the path and the condition."""
    import zlib

    kinds = names or list(CONDITIONS)
    rows = recordings.select("path", "rate", "samples").withColumn("condition", F.explode(F.array(*[F.lit(k) for k in kinds])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [CONDITIONS[k](np.asarray(x, float), int(r), np.random.default_rng([seed, zlib.crc32(f"{p}|{k}".encode())])).tolist() for p, r, x, k in zip(pdf["path"], pdf["rate"], pdf["samples"], pdf["condition"], strict=True)]
            yield pdf.assign(samples=made)

    return rows.select("path", "condition", "rate", "samples").mapInPandas(run, "path string, condition string, rate int, samples array<double>")


def quality(recordings: DataFrame, hop: int = 256) -> DataFrame:
    """path, peak, clipped share, level_db, floor_db, snr_db (voiced median less the floor), bandwidth_hz."""

    def work(x: Array, rate: int) -> dict[str, object]:
        if not len(x):
            return {"peak": 0.0, "clipped": 0.0, "level_db": None, "floor_db": None, "snr_db": None, "bandwidth_hz": None}
        peak = float(np.abs(x).max())
        top = np.abs(x) >= 0.999 * peak if peak else np.zeros(len(x), bool)
        edge = np.diff(np.concatenate([[0], top.astype(int), [0]]))
        lengths = np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)
        level = 10 * np.log10(np.maximum((frames(x, 2 * hop, hop) ** 2).mean(1), 1e-15))
        voiced = level > level.max() - 30
        floor = float(np.percentile(level[~voiced], 20)) if (~voiced).any() else None
        mid = float(np.median(level[voiced]))
        power = np.percentile(spectrum(x, 2 * hop, hop), 95, axis=0)
        loud = np.flatnonzero(power > power.max() * 1e-6)
        return {"peak": peak, "clipped": float(lengths[lengths >= 3].sum() / len(x)), "level_db": mid, "floor_db": floor, "snr_db": None if floor is None else mid - floor, "bandwidth_hz": float(loud[-1] * rate / (2 * hop)) if len(loud) else None}

    return per_recording(recordings, work, "peak double, clipped double, level_db double, floor_db double, snr_db double, bandwidth_hz double")


def robustness(values: DataFrame, clean: str = "clean") -> DataFrame:
    """Per condition and dimension: share of recordings that still have a value, and the median absolute deviation from the clean one. values: path, condition, dimension, value."""
    ref = values.where(F.col("condition") == clean).select("path", "dimension", F.col("value").alias("_r"))
    both = values.join(ref, ["path", "dimension"]).where("_r is not null")
    return both.groupBy("condition", "dimension").agg(F.avg(F.col("value").isNotNull().cast("double")).alias("presence"), F.median(F.abs(F.col("value") - F.col("_r"))).alias("deviation"), F.count("*").alias("n"))
