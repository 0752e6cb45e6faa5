"""Pitch, time-grid, hashing and string expressions. Unknown values are NULL, never NaN (`known`)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

A4_HZ = 440.0


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def known(x: Column | str) -> Column:
    """Finite values; NaN and infinities become NULL."""
    x = col(x).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def ieee_log(x: Column | str, base: float | None = None) -> Column:
    """Logarithm (natural, or to `base` 2 or 10) by IEEE rules: minus infinity at 0 and NaN below, where Spark's are NULL."""
    x = col(x)
    log = {None: F.log, 2: F.log2, 10: F.log10}[base]
    return F.when(x > 0, log(x)).when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan")))


def hz_to_cents(hz: Column | str, ref: float = A4_HZ) -> Column:
    """Minus infinity at 0 Hz, NaN below, as in NumPy and SQL; callers mask what is unvoiced."""
    return 1200.0 * ieee_log(col(hz) / ref, 2)


def cents_to_hz(cents: Column | str, ref: float = A4_HZ) -> Column:
    return ref * F.pow(F.lit(2.0), col(cents) / 1200.0)


def power_db(power: Column | str, floor_db: float = -200.0) -> Column:
    return 10.0 * F.log10(F.greatest(col(power), F.lit(10.0 ** (floor_db / 10.0))))


def fold_octave(cents: Column | str) -> Column:
    """Into [-600, 600) with a floored modulo; NaN for infinities, which have no place in an octave."""
    x = col(cents) + 600.0
    return F.when(F.abs(x) == float("inf"), F.lit(float("nan"))).otherwise(x - 1200.0 * F.floor(x / 1200.0) - 600.0)


def frame_of(seconds: Column | str, hop_seconds: float, n_frames: Column | int) -> Column:
    """Nearest frame, halves to even, inside the grid."""
    last = (F.lit(n_frames) if isinstance(n_frames, int) else n_frames) - 1
    return F.greatest(F.lit(0), F.least(last, F.bround(col(seconds) / hop_seconds).cast("int")))


def time_of(frame: Column | str, hop_seconds: float) -> Column:
    return col(frame) * hop_seconds


def frames_for_samples(samples: Column | str, hop: int) -> Column:
    return (F.floor(col(samples) / hop) + 1).cast("int")


def clip01(x: Column | str) -> Column:
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def hash_bucket(key: Column | str, seed: int = 0) -> Column:
    """Place of a key in [0, 1): the first eight bytes of SHA-256("seed:key") over 2^64."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), col(key).cast("string")).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / 2.0**64


def content_id(dataset: Column | str, path: Column | str) -> Column:
    """dataset-<16 hex digits of the SHA-1 of the path>."""
    return F.concat_ws("-", col(dataset), F.substring(F.sha1(col(path).cast("binary")), 1, 16))


def agreement_band(value: Column | str) -> Column:
    """Words for an intraclass correlation: poor, moderate, good, excellent; undefined for NULL."""
    x = col(value)
    return F.when(x.isNull() | F.isnan(x), "undefined").when(x < 0.5, "poor").when(x < 0.75, "moderate").when(x < 0.9, "good").otherwise("excellent")


def clock(seconds: Column | str) -> Column:
    """h:mm:ss."""
    s = F.bround(col(seconds)).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def json_path(doc: Column | str, path: str) -> Column:
    """A dotted path into JSON text; a part of digits is a list index."""
    steps = "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in path.split("."))
    return F.get_json_object(col(doc), "$" + steps)


def template_key(attribute: Column | str) -> Column:
    """The attribute without the prefix of its family."""
    return F.regexp_replace(col(attribute), "^(quality|laryngeal)_", "")


def location_phrase(start_s: Column | str, end_s: Column | str) -> Column:
    return F.when(col(end_s) - col(start_s) < 0.05, F.format_string("at %.1f s", col(start_s))).otherwise(F.format_string("from %.1f to %.1f s", col(start_s), col(end_s)))


def ramp(x: Column | str, low: float, high: float) -> Column:
    """0 at low, 1 at high, linear between; NULL counts as low."""
    return F.coalesce(clip01((col(x) - low) / (high - low)), F.lit(0.0))


def interp(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise linear through (xs, ys), ends held; xs ascend."""
    out = F.when(x <= xs[0], F.lit(float(ys[0])))
    for a, b, c, d in zip(xs, xs[1:], ys, ys[1:], strict=False):
        out = out.when(x <= b, c + (x - a) * ((d - c) / (b - a)))
    return F.when(x.isNull(), None).otherwise(out.otherwise(F.lit(float(ys[-1]))))


def interp_arrays(x: Column, xs: Column, ys: Column) -> Column:
    """`interp` with the points in array columns."""
    n = F.size(xs)
    k = F.size(F.filter(xs, lambda v: v < x))
    a, b, p, q = F.get(xs, k - 1), F.get(xs, k), F.get(ys, k - 1), F.get(ys, k)
    return F.when(k == 0, F.get(ys, F.lit(0))).when(k >= n, F.get(ys, n - 1)).otherwise(p + (x - a) / (b - a) * (q - p))


def parabolic_peak(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """Offset (within half a step) and height of the parabola through three neighbours."""
    curve = a - 2 * b + c
    delta = F.when(F.abs(curve) > 1e-12, 0.5 * (a - c) / curve).otherwise(0.0)
    delta = F.greatest(F.lit(-0.5), F.least(F.lit(0.5), delta))
    return delta, b - 0.25 * (a - c) * delta


def raised_cosine(x: Column) -> Column:
    """0 to 1 over [0, 1]."""
    return 0.5 - 0.5 * F.cos(clip01(x) * math.pi)


def resonance_gain_db(f: Column, centre: Column, bandwidth: Column, rate: float) -> Column:
    """Gain in dB at f of a two-pole resonance, against its gain at 0 Hz."""
    r = F.exp(-math.pi * bandwidth / rate)
    w, w0 = 2 * math.pi * f / rate, 2 * math.pi * centre / rate
    dc = 1 - 2 * r * F.cos(w0) + r * r
    near, far = 1 - 2 * r * F.cos(w0 - w) + r * r, 1 - 2 * r * F.cos(w0 + w) + r * r
    return 20 * F.log10(dc) - 10 * F.log10(near) - 10 * F.log10(far)
