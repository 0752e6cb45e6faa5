"""Reliability and agreement statistics over long tables. All are exact; NULL values are left out as stated."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ieee_log

Keys = Sequence[str]
_ALL = "_all"


def _group(df: DataFrame, keys: Keys) -> tuple[DataFrame, list[str]]:
    return (df, list(keys)) if keys else (df.withColumn(_ALL, F.lit(1)), [_ALL])


def complete_cases(records: DataFrame, keys: Keys) -> DataFrame:
    """Without conditions in which nothing was measured, and without subjects that miss one of the others. records: keys, subject, condition, value."""
    known = records.where(F.col("value").isNotNull())
    df, g = _group(known, keys)
    cells = df.groupBy(*g, "subject", "condition").agg(F.avg("value").alias("value"))
    wanted = cells.groupBy(*g).agg(F.count_distinct("condition").alias("_k"))
    full = cells.groupBy(*g, "subject").agg(F.count("*").alias("_n")).join(wanted, g).where("_n = _k").select(*g, "subject")
    out = cells.join(full, [*g, "subject"])
    return out if keys else out.drop(_ALL)


def anova(cells: DataFrame, keys: Keys = ()) -> DataFrame:
    """Mean squares of complete subject x condition cells: n, k, msr, msc, mse, msw."""
    df, g = _group(cells, keys)
    subj = df.groupBy(*g, "subject").agg(F.avg("value").alias("_sm"), F.count("*").alias("_k"))
    cond = df.groupBy(*g, "condition").agg(F.avg("value").alias("_cm"), F.count("*").alias("_n"))
    total = df.groupBy(*g).agg(F.avg("value").alias("_m"), F.count_distinct("subject").alias("n"), F.count_distinct("condition").alias("k"), F.var_pop("value").alias("_v"), F.count("*").alias("_nk"))
    ssr = subj.join(total.select(*g, "_m"), g).groupBy(*g).agg(F.sum(F.col("_k") * F.pow(F.col("_sm") - F.col("_m"), 2)).alias("_ssr"))
    ssc = cond.join(total.select(*g, "_m"), g).groupBy(*g).agg(F.sum(F.col("_n") * F.pow(F.col("_cm") - F.col("_m"), 2)).alias("_ssc"))
    rows = total.join(ssr, g).join(ssc, g).where("n > 1 and k > 1")
    sst = F.col("_v") * F.col("_nk")
    sse = sst - F.col("_ssr") - F.col("_ssc")
    n, k = F.col("n"), F.col("k")
    return rows.select(*keys, "n", "k", (F.col("_ssr") / (n - 1)).alias("msr"), (F.col("_ssc") / (k - 1)).alias("msc"), (sse / ((n - 1) * (k - 1))).alias("mse"), ((F.col("_ssc") + sse) / (n * (k - 1))).alias("msw"), F.sqrt(F.col("_v")).alias("sd"))


def icc(cells: DataFrame, keys: Keys = ()) -> DataFrame:
    """Intraclass correlations (1,1), (2,1) and (3,1), with SEM and MDC95 of the second."""
    a = anova(cells, keys)
    r, c, e, w, n, k = (F.col(x) for x in ("msr", "msc", "mse", "msw", "n", "k"))
    two = (r - e) / (r + (k - 1) * e + k * (c - e) / n)
    sem = F.col("sd") * F.sqrt(F.greatest(F.lit(0.0), 1 - two))
    return a.select(*keys, "n", "k", ((r - w) / (r + (k - 1) * w)).alias("icc11"), two.alias("icc21"), ((r - e) / (r + (k - 1) * e)).alias("icc31"), sem.alias("sem"), (1.96 * math.sqrt(2) * sem).alias("mdc95"))


def bland_altman(pairs: DataFrame, a: str, b: str, keys: Keys = ()) -> DataFrame:
    """Bias b - a, its SD and the 95 % limits of agreement."""
    d = F.col(b) - F.col(a)
    out = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys).agg(F.avg(d).alias("bias"), F.stddev_samp(d).alias("sd"), F.count("*").alias("n"))
    return out.withColumns({"loa_low": F.col("bias") - 1.96 * F.col("sd"), "loa_high": F.col("bias") + 1.96 * F.col("sd")})


def within_between(df: DataFrame, subject: str, value: str, keys: Keys = ()) -> DataFrame:
    """Mean variance within subjects of two and more values over the variance of their means; NULL below two subjects."""
    per = df.where(F.col(value).isNotNull()).groupBy(*keys, subject).agg(F.var_samp(value).alias("_v"), F.avg(value).alias("_m"), F.count("*").alias("_n")).where("_n > 1")
    between = F.var_samp("_m")
    return per.groupBy(*keys).agg(F.when(F.count("*") < 2, None).when(between > 0, F.avg("_v") / between).otherwise(float("inf")).alias("ratio"), F.count("*").alias("subjects"))


def invariance(records: DataFrame, reference: str, keys: Keys, min_icc: float = 0.9) -> DataFrame:
    """Per key: intraclass correlation over conditions, SEM, MDC95, acceptance; at least three complete subjects."""
    from ..functions.scalar import agreement_band

    cells = complete_cases(records, keys)
    ref = cells.where(F.col("condition") == reference).select(*keys, "subject", F.col("value").alias("_r"))
    bias = cells.where(F.col("condition") != reference).join(ref, [*keys, "subject"]).groupBy(*keys).agg(F.max(F.abs(F.col("value") - F.col("_r"))).alias("worst_shift"))
    return icc(cells, keys).where("n >= 3").join(bias, [*keys]).select(*keys, "n", "k", "icc21", agreement_band("icc21").alias("band"), "sem", "mdc95", "worst_shift", (F.col("icc21") >= min_icc).alias("accepted"))


def bootstrap_icc(cells: DataFrame, keys: Keys, n_boot: int = 2000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Percentile interval of ICC(2,1) over resampled subjects; a key's subject x condition cells are one group (a study's size, not the corpus')."""
    import numpy as np

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.pivot_table(index="subject", columns="condition", values="value").dropna().to_numpy()
        out = pdf[list(keys)].iloc[:1].copy()
        lo = hi = float("nan")
        if min(y.shape) > 1:
            n, k = y.shape
            pick = np.random.default_rng(seed).integers(0, n, (n_boot, n))
            s = y[pick]
            gm = s.mean((1, 2))
            ssr = k * ((s.mean(2) - gm[:, None]) ** 2).sum(1)
            ssc = n * ((s.mean(1) - gm[:, None]) ** 2).sum(1)
            sse = ((s - gm[:, None, None]) ** 2).sum((1, 2)) - ssr - ssc
            r, c, e = ssr / (n - 1), ssc / (k - 1), sse / ((n - 1) * (k - 1))
            with np.errstate(all="ignore"):
                v = (r - e) / (r + (k - 1) * e + k * (c - e) / n)
            v = v[np.isfinite(v)]
            if len(v):
                lo, hi = np.percentile(v, [(1 - level) * 50, (1 + level) * 50])
        return out.assign(low=float(lo), high=float(hi))

    head = ", ".join(f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in keys)
    return cells.groupBy(*keys).applyInPandas(run, f"{head}, low double, high double")


def auroc(df: DataFrame, score: str, positive: Column, keys: Keys = ()) -> DataFrame:
    """Area under the ROC curve; equal scores share their mean rank. Scores are counted per value first, so ties cost one row."""
    d, g = _group(df.where(F.col(score).isNotNull()), keys)
    per = d.groupBy(*g, F.col(score).alias("_s")).agg(F.count_if(positive).alias("_p"), F.count_if(~positive).alias("_n"))
    w = Window.partitionBy(*g).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    below = per.withColumn("_b", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    p, n = F.sum("_p"), F.sum("_n")
    return below.groupBy(*g).agg(F.when((p > 0) & (n > 0), F.sum(F.col("_p") * (F.col("_b") + F.col("_n") / 2.0)) / (p * n)).alias("auroc"), p.alias("positives"), n.alias("negatives")).select(*keys, "auroc", "positives", "negatives")


def equal_error_rate(df: DataFrame, score: str, target: Column, tie: str, keys: Keys = ()) -> DataFrame:
    """Where false rejection and false acceptance are closest, scores descending (ties by `tie`)."""
    d, g = _group(df, keys)
    w = Window.partitionBy(*g).orderBy(F.desc(score), tie)
    whole = Window.partitionBy(*g)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    t = target.cast("int")
    rows = d.withColumn("_fnr", 1 - F.sum(t).over(run) / F.greatest(F.sum(t).over(whole), F.lit(1))).withColumn("_fpr", F.sum(1 - t).over(run) / F.greatest(F.sum(1 - t).over(whole), F.lit(1))).withColumn("_i", F.row_number().over(w))
    return rows.groupBy(*g).agg(F.min_by((F.col("_fnr") + F.col("_fpr")) / 2, F.struct(F.abs(F.col("_fnr") - F.col("_fpr")), "_i")).alias("eer")).select(*keys, "eer")


def holm(pvalues: DataFrame, name: str, p: str, alpha: float = 0.05, keys: Keys = ()) -> DataFrame:
    """Step-down: the i-th smallest p (ties by name) is rejected if it and all smaller ones are at most alpha / (m - i)."""
    d, g = _group(pvalues, keys)
    w = Window.partitionBy(*g).orderBy(p, name)
    ok = (F.col(p) <= alpha / (F.count("*").over(Window.partitionBy(*g)) - F.row_number().over(w) + 1)).cast("int")
    rows = d.withColumn("_ok", ok).withColumn("rejected", F.min("_ok").over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("_ok")
    return rows if keys else rows.drop(_ALL)


def cohen_kappa(df: DataFrame, a: str, b: str, keys: Keys = ()) -> DataFrame:
    """Chance-corrected agreement of two label columns."""
    d, g = _group(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), keys)
    total = d.groupBy(*g).agg(F.count("*").alias("_n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("_po"))
    left = d.groupBy(*g, F.col(a).cast("string").alias("_c")).agg(F.count("*").alias("_x"))
    right = d.groupBy(*g, F.col(b).cast("string").alias("_c")).agg(F.count("*").alias("_y"))
    pe = left.join(right, [*g, "_c"], "left").join(total, g).groupBy(*g).agg(F.sum(F.coalesce("_y", F.lit(0)) * F.col("_x") / (F.col("_n") * F.col("_n"))).alias("_pe"))
    return total.join(pe, g).select(*keys, F.when(F.col("_pe") < 1, (F.col("_po") - F.col("_pe")) / (1 - F.col("_pe"))).alias("kappa"), F.col("_n").alias("n"))


def fleiss_kappa(counts: DataFrame, item: str, category: str, count: str, keys: Keys = ()) -> DataFrame:
    """Agreement of many raters from long item x category counts; every item must have as many ratings (NULL else)."""
    d, g = _group(counts, keys)
    per = d.groupBy(*g, item).agg(F.sum(count).alias("_n"), F.sum(F.col(count) * F.col(count)).alias("_q"))
    share = d.groupBy(*g, category).agg(F.sum(count).alias("_c"))
    pe = share.join(share.groupBy(*g).agg(F.sum("_c").alias("_t")), g).groupBy(*g).agg(F.sum(F.pow(F.col("_c") / F.col("_t"), 2)).alias("_pe"))
    n = F.max("_n")
    stats = per.groupBy(*g).agg(F.when((F.min("_n") == n) & (n > 1), F.avg((F.col("_q") - F.col("_n")) / (F.col("_n") * (F.col("_n") - 1)))).alias("_p"), F.count("*").alias("items"))
    return stats.join(pe, g).select(*keys, F.when(F.col("_pe") < 1, (F.col("_p") - F.col("_pe")) / (1 - F.col("_pe"))).alias("kappa"), "items")


def calibration_error(df: DataFrame, confidence: str, correct: Column, bins: int = 15, keys: Keys = ()) -> DataFrame:
    """Mean gap of accuracy and confidence over equal bins (low, high]; confidence 0 is in no bin."""
    d, g = _group(df, keys)
    total = d.groupBy(*g).agg(F.count("*").alias("_t"))
    per = d.where(F.col(confidence) > 0).groupBy(*g, F.ceil(F.round(F.col(confidence) * bins, 9)).alias("_b")).agg(F.count("*").alias("_n"), F.avg(correct.cast("double")).alias("_a"), F.avg(confidence).alias("_c"))
    return per.join(total, g).groupBy(*g).agg(F.sum(F.col("_n") / F.col("_t") * F.abs(F.col("_a") - F.col("_c"))).alias("ece")).select(*keys, "ece")


def theil_sen(df: DataFrame, x: str, y: str, keys: Keys) -> DataFrame:
    """Median slope over all pairs of a key. The slopes of a key are quadratic in its rows by definition; keys are short series."""
    pts = df.groupBy(*keys).agg(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))).alias("_p"))
    slopes = F.flatten(F.transform("_p", lambda a: F.transform(F.filter("_p", lambda b: b["x"] > a["x"]), lambda b: (b["y"] - a["y"]) / (b["x"] - a["x"]))))
    rows = pts.select(*keys, F.sort_array(slopes).alias("_s")).where(F.size("_s") > 0)
    n = F.size("_s")
    return rows.select(*keys, ((F.get("_s", F.floor((n - 1) / 2).cast("int")) + F.get("_s", F.floor(n / 2).cast("int"))) / 2).alias("slope"), n.alias("n_slopes"))


def residual_report(records: DataFrame, baseline: DataFrame, value: str, slice_col: str, z: float = 3.0) -> DataFrame:
    """Slices whose log median is above the baseline by more than z robust standard errors. baseline: one column `value`.

    A value of 0 counts, with a logarithm of minus infinity; a baseline without a known value leaves ratio, z and flag NULL.
    """
    logs = baseline.select(ieee_log(value).alias("_b"))
    med = logs.agg(F.median("_b").alias("_med"))
    spread = logs.crossJoin(F.broadcast(med)).agg(F.greatest(1.4826 * F.median(F.abs(F.col("_b") - F.col("_med"))), F.lit(1e-6)).alias("_spread"))
    per = records.groupBy(slice_col).agg(F.median(ieee_log(value)).alias("_m"), F.count("*").alias("n"))
    per = per.crossJoin(F.broadcast(med)).crossJoin(F.broadcast(spread))  # one row each
    above = F.col("_m") - F.col("_med")
    zs = above / (F.col("_spread") / F.sqrt("n"))
    return per.select(slice_col, "n", F.exp("_m").alias("median"), F.exp(above).alias("ratio"), zs.alias("z"), (zs > z).alias("flagged"))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_sf(t: float, df: float) -> float:
    """P(T > t) of Student's t."""
    half = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return half if t > 0 else 1 - half


def binomial_sf(k: int, n: int, p: float) -> float:
    """P(X >= k)."""
    return 1.0 if k <= 0 else incomplete_beta(k, n - k + 1, p)


def equivalence(pairs: DataFrame, a: str, b: str, margin: float, keys: Keys = ()) -> DataFrame:
    """Two one-sided t tests of a mean difference within the margin: the larger p. Sums are Spark's, the distribution a row-wise function of them."""
    stats = bland_altman(pairs, a, b, keys).where("n > 1").select(*keys, "bias", "sd", "n")

    @F.pandas_udf("double")
    def p(bias: pd.Series, sd: pd.Series, n: pd.Series) -> pd.Series:
        def one(m: float, s: float, k: int) -> float:
            se = s / math.sqrt(k)
            return max(t_sf((m + margin) / se, k - 1), 1 - t_sf((m - margin) / se, k - 1)) if se > 0 else float(abs(m) >= margin)

        return pd.Series([one(*x) for x in zip(bias, sd, n, strict=True)])

    return stats.withColumn("p", p("bias", "sd", "n"))


def above_chance(df: DataFrame, correct: Column, classes: int, keys: Keys = ()) -> DataFrame:
    """One-sided binomial p that the share of correct answers is above 1 / classes."""
    counts = df.groupBy(*keys).agg(F.count_if(correct).alias("n_correct"), F.count("*").alias("n"))

    @F.pandas_udf("double")
    def p(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([binomial_sf(int(a), int(b), 1 / classes) for a, b in zip(k, n, strict=True)])

    return counts.withColumn("p", p("n_correct", "n"))
