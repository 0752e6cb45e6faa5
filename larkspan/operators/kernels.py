"""Order-dependent scans over one series: alignment, paths, isotonic fits, greedy matches. NumPy inside, one group per series."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Keys = Sequence[str]


def per_series(df: DataFrame, keys: Keys, work: Callable[[pd.DataFrame], pd.DataFrame], out: str, order: str = "frame") -> DataFrame:
    """Run `work` on each key's rows in order; it returns the columns of `out`, to which the keys are added."""
    head = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = work(pdf.sort_values(order, kind="stable"))
        for i, k in enumerate(keys):
            got.insert(i, k, [pdf[k].iloc[0]] * len(got))
        return got

    return df.groupBy(*keys).applyInPandas(run, f"{head}, {out}")


def pava(y: np.ndarray, w: np.ndarray, increasing: bool = True) -> np.ndarray:
    """Weighted isotonic regression. Each block's mean is least over its later and greatest over its earlier neighbours; blocks grow while order is broken."""
    sign = 1.0 if increasing else -1.0
    blocks: list[list[float]] = []  # weighted sum, weight, length
    for value, weight in zip(sign * np.asarray(y, float), np.asarray(w, float), strict=True):
        blocks.append([value * weight, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] > blocks[-1][0] * blocks[-2][1]:
            s, t, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + t, blocks[-1][2] + n]
    return sign * np.repeat([s / t for s, t, _ in blocks], [int(n) for *_, n in blocks]) if blocks else np.zeros(0)


def operating_threshold(level: np.ndarray, error: np.ndarray, mdc: float, higher_is_better: bool = True, bins: int = 10, quantile: float = 0.95, least: int = 5) -> float | None:
    """Level from which the monotone 95 % error bound stays at or below the MDC; None if it never does."""
    x, e = np.asarray(level, float), np.abs(np.asarray(error, float))
    ok = np.isfinite(x) & np.isfinite(e)
    x, e = x[ok], e[ok]
    centres, place = np.unique(x, return_inverse=True)
    if len(centres) > bins:
        edges = np.quantile(x, np.linspace(0, 1, bins + 1))
        centres, place = (edges[:-1] + edges[1:]) / 2, np.clip(np.searchsorted(edges, x, "right") - 1, 0, bins - 1)
    size = np.bincount(place, minlength=len(centres))
    use = np.flatnonzero(size >= least)
    if not len(use):
        return None
    centres, size = centres[use], size[use]
    bound = pava(np.array([np.quantile(e[place == k], quantile) for k in use]), size, increasing=not higher_is_better)
    if higher_is_better:
        centres, bound = centres[::-1], bound[::-1]  # from the best level outwards
    good = np.flatnonzero(bound > mdc)
    last = (good[0] if len(good) else len(bound)) - 1
    if last < 0:
        return None
    if last == len(bound) - 1:
        return float(centres[last])
    return float(np.interp(mdc, [bound[last], bound[last + 1]], [centres[last], centres[last + 1]]))


def fit_thresholds(pairs: DataFrame, keys: Keys, higher_is_better: bool = True) -> DataFrame:
    """Per key: MDC from retest pairs (1.96 SD of the differences) and the operating level of `level` for `error`. pairs: keys, retest, level, error."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf["retest"].dropna()
        mdc = 1.96 * float(d.std(ddof=1)) if len(d) > 2 else float("nan")
        level = operating_threshold(pdf["level"].to_numpy(), pdf["error"].to_numpy(), mdc, higher_is_better) if mdc == mdc else None
        return pd.DataFrame({"mdc": [mdc], "level": [level], "n": [len(pdf)]})

    return per_series(pairs, keys, work, "mdc double, level double, n long", order="level")


def banded_alignment(a: np.ndarray, b: np.ndarray, band: int, penalty: float, open_begin: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Cheapest monotone path of frame pairs within the band by cosine cost, and its costs.

    A step along one series only costs `penalty` times the median cost more; of equal steps the diagonal wins, then the
    step in a. The end is open in b, the begin too if asked.
    """
    n, m = len(a), len(b)
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    cost = 1 - unit(np.asarray(a, float)) @ unit(np.asarray(b, float)).T
    cost[np.abs(np.subtract.outer(np.arange(n), np.arange(m))) > band] = np.inf
    finite = cost[np.isfinite(cost)]
    extra = penalty * (float(np.median(finite)) if len(finite) else 1.0)
    total = np.full((n + 1, m + 1), np.inf)
    total[0, : m + 1 if open_begin else 1] = 0
    step = np.zeros((n, m), np.int8)
    for i in range(n):
        diag, up = total[i, :-1], total[i, 1:] + extra
        left = np.inf
        row = total[i + 1]
        for j in range(max(0, i - band), min(m, i + band + 1)):
            options = (diag[j], up[j], left + extra)
            k = int(np.argmin(options))
            step[i, j] = k
            left = row[j + 1] = cost[i, j] + options[k]
    lo, hi = max(0, n - 1 - band), min(m, n + band)
    j = lo + int(np.argmin(total[n, lo + 1 : hi + 1]))
    i, path = n - 1, []
    while i >= 0 and j >= 0:
        path.append((i, j))
        if open_begin and i == 0:
            break
        k = step[i, j]
        i, j = i - (k != 2), j - (k != 1)
    path = np.array(path[::-1])
    return path, cost[path[:, 0], path[:, 1]]


def align_series(left: DataFrame, right: DataFrame, keys: Keys, vec: str = "vec", band: int = 52, penalty: float = 0.15) -> DataFrame:
    """keys, frame, tau, cost: mean matched right frame of every left frame. Both series of a key meet in one group."""

    def work(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        cols = [*keys, "frame", "tau", "cost"]
        if a.empty or b.empty:
            return pd.DataFrame({c: [] for c in cols})
        a, b = a.sort_values("frame"), b.sort_values("frame")
        path, cost = banded_alignment(np.stack(a[vec]), np.stack(b[vec]), max(band, abs(len(a) - len(b)) + 1), penalty)
        got = pd.DataFrame({"frame": a["frame"].to_numpy()[path[:, 0]], "tau": b["frame"].to_numpy()[path[:, 1]].astype(float), "cost": cost}).groupby("frame", as_index=False).mean()
        for k, v in zip(keys, key, strict=True):
            got[k] = v
        return got[cols]

    head = ", ".join(f"`{k}` {left.schema[k].dataType.simpleString()}" for k in keys)
    own = lambda df: df.select(*[F.col(x).alias(x) for x in (*keys, "frame", vec)])  # noqa: E731  fresh columns, also where both come from one table
    left, right = own(left), own(right)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(work, f"{head}, frame long, tau double, cost double")


def best_path(scores: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Path of greatest total score through frames x states; move[i, j] is added for a step from i to j; -1 where no state is finite."""
    n, s = scores.shape
    out = np.full(n, -1)
    live = np.isfinite(scores).any(1)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], live.astype(int), [0]])))
    for lo, hi in zip(edges[::2], edges[1::2], strict=True):
        best, back = scores[lo], np.zeros((hi - lo, s), np.int64)
        for t in range(lo + 1, hi):
            via = best[:, None] + move
            back[t - lo] = via.argmax(0)
            best = via.max(0) + scores[t]
        k = int(best.argmax())
        for t in range(hi - 1, lo - 1, -1):
            out[t] = k
            k = int(back[t - lo][k])
    return out


def greedy_matches(a: Sequence[float], b: Sequence[float], within: float) -> int:
    """One-to-one matches in the order of a, each with the nearest b that is left."""
    left, hits = sorted(b), 0
    for x in sorted(a):
        if left:
            k = min(range(len(left)), key=lambda i: (abs(left[i] - x), i))
            if abs(left[k] - x) <= within:
                left.pop(k)
                hits += 1
    return hits


def onset_f(est: DataFrame, ref: DataFrame, keys: Keys, time: str, within: float = 0.05) -> DataFrame:
    """F-measure of onsets per key."""
    pack = lambda df, n: df.groupBy(*keys).agg(F.sort_array(F.collect_list(time)).alias(n))
    rows = pack(est, "_e").join(pack(ref, "_r"), [*keys], "full_outer")

    @F.pandas_udf("long")
    def hits(e: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([greedy_matches(list(x) if x is not None else [], list(y) if y is not None else [], within) for x, y in zip(e, r, strict=True)])

    n, m = F.coalesce(F.size("_e"), F.lit(0)), F.coalesce(F.size("_r"), F.lit(0))
    return rows.withColumn("_h", hits("_e", "_r")).select(*keys, F.col("_h").alias("hits"), F.try_divide(2.0 * F.col("_h"), F.greatest(n, F.lit(0)) + F.greatest(m, F.lit(0))).alias("f"))


def notes(pitch: DataFrame, keys: Keys, jump: float = 70.0, least: int = 5) -> DataFrame:
    """Half-open note spans: voiced stretches of cents, cut where the pitch has moved by `jump` from the median of the note so far; short ones join their neighbour."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        spans: list[list[int]] = []
        held: list[float] = []
        before = None
        for frame, v in zip(pdf["frame"], pdf["value"], strict=True):
            if v != v or v is None:
                before = None
                continue
            if before != frame - 1 or abs(v - float(np.median(held))) >= jump:
                spans.append([int(frame), int(frame) + 1])
                held = []
            held.append(v)
            spans[-1][1] = int(frame) + 1
            before = frame
        out: list[list[int]] = []
        for s in spans:
            if out and s[0] == out[-1][1] and (s[1] - s[0] < least or out[-1][1] - out[-1][0] < least):
                out[-1][1] = s[1]
            else:
                out.append(s)
        out = [s for s in out if s[1] - s[0] >= least]
        return pd.DataFrame({"note": range(len(out)), "start": [s[0] for s in out], "end": [s[1] for s in out]})

    return per_series(pitch, keys, work, "note long, start long, end long")


def vibrato(pitch: DataFrame, keys: Keys, window: int, rates: Sequence[float], hop_seconds: float) -> DataFrame:
    """Rate and extent of the strongest sinusoid in a sliding window of a detrended pitch curve."""
    t = np.arange(window) * hop_seconds
    basis = [np.stack([np.cos(2 * np.pi * r * t), np.sin(2 * np.pi * r * t), np.ones(window), t], 1) for r in rates]
    solve = [np.linalg.pinv(x)[:2] for x in basis]

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf["value"].to_numpy(float)
        if len(v) < window:
            return pd.DataFrame({"frame": pdf["frame"][:0], "rate": [], "extent": []})
        w = np.lib.stride_tricks.sliding_window_view(v, window)
        amp = np.stack([np.hypot(*(w @ s.T).T) for s in solve], 1)
        known = np.isfinite(amp).all(1)
        best = np.where(known, np.nan_to_num(amp).argmax(1), 0)
        frames = pdf["frame"].to_numpy()[window // 2 : window // 2 + len(w)]
        return pd.DataFrame({"frame": frames, "rate": np.where(known, np.array(rates)[best], np.nan), "extent": np.where(known, amp[np.arange(len(w)), best], np.nan)})

    return per_series(pitch, keys, work, "frame long, rate double, extent double")


def allocate(weights: Sequence[float], total: int) -> list[int]:
    """`total` things over weighted places, one each first, then by the largest quotient."""
    if not weights or total <= 0:
        return [0] * len(weights)
    got = [1 if i < total else 0 for i in range(len(weights))]
    for _ in range(total - sum(got)):
        k = max(range(len(weights)), key=lambda i: (weights[i] / (got[i] + 1), -i))
        got[k] += 1
    return got


def smooth_warp(frame: np.ndarray, tau: np.ndarray, lam: float) -> np.ndarray:
    """Smoothing of a warp: least squares with `lam` times squared second differences, at unit spacing."""
    n = len(tau)
    if n < 3:
        return np.asarray(tau, float)
    d = np.diff(np.eye(n), 2, axis=0)
    return np.linalg.solve(np.eye(n) + lam * d.T @ d, np.asarray(tau, float))
