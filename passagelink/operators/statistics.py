"""Multiple testing, midranks, robust spread, quantiles, empirical tails, bootstraps and null-count calibration."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagelink.operators.spread import running


def benjamini_hochberg(df: DataFrame, p: str, ident: str, family: list[str] | None = None, q: str = "q_value") -> DataFrame:
    """Benjamini-Hochberg q-values within each family; null p-values are not tested and get null.

    Equal p-values share the q-value of their last rank, so ranks and minima run over the distinct p-values of a family with
    their counts, in slices that carry over, and the q-values are joined back: no family has to fit into a task. ``ident`` only names the rows; it decides nothing.
    """
    keys = family or []
    named = [f"bh_{k}" for k in keys]
    bins = df.filter(F.col(p).isNotNull()).groupBy(*[F.col(k).alias(n) for k, n in zip(keys, named)], F.col(p).alias("bh_p")).agg(F.count("*").alias("k"))
    upto = running(bins, named, ["bh_p"], "k", "upto")
    if keys:
        total = upto.groupBy(*[F.col(n).alias(f"{n}_") for n in named]).agg(F.sum("k").alias("total"))
        on = None
        for n in named:
            one = F.col(n).eqNullSafe(F.col(f"{n}_"))
            on = one if on is None else on & one
        raw = upto.join(total, on)
    else:
        raw = upto.crossJoin(F.broadcast(upto.agg(F.sum("k").alias("total"))))  # one row
    raw = raw.select(*named, "bh_p", (F.col("bh_p") * F.col("total") / F.col("upto")).alias("raw"))
    low = running(raw, named, [F.desc("bh_p")], "raw", "low", "min")
    out = low.select(*named, "bh_p", F.least(F.lit(1.0), F.col("low")).alias(q))
    same = F.col(p) == F.col("bh_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"bh_{k}"))
    return df.join(out, same, "left").select(*df.columns, q)


def midrank(df: DataFrame, value: str, group: list[str], name: str = "percentile") -> DataFrame:
    """(values below + half of those equal) / number, within the group.

    Equal values are counted first, so the window holds one row per distinct value, not per row.
    """
    bins = df.groupBy(*group, value).agg(F.count("*").alias("k"))
    w = Window.partitionBy(*group).orderBy(value)
    below = F.coalesce(F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("k").over(Window.partitionBy(*group))
    score = bins.select(*group, value, ((below + F.col("k") / 2.0) / total).alias(name))
    return df.join(score, [*group, value])


def upper_tail(df: DataFrame, value: str, group: list[str]) -> DataFrame:
    """Every row with ``n_ge``, how many of its group have its value or a higher one, and ``n``, the size of the group.

    Distinct values are counted in slices that carry over, so no group has to fit into a task. Groups aren't null.
    """
    bins = df.groupBy(*group, value).agg(F.count("*").alias("k"))
    ge = running(bins, group, [F.desc(value)], "k", "n_ge").select(*group, value, "n_ge")
    size = bins.groupBy(*group).agg(F.sum("k").alias("n"))
    return df.join(ge, [*group, value]).join(size, group)


def mad(df: DataFrame, value: str, group: list[str]) -> DataFrame:
    """Exact median and median absolute deviation of each group."""
    m = df.groupBy(*group).agg(F.median(value).alias("median"))
    return df.join(m, group).groupBy(*group).agg(F.max("median").alias("median"), F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"), F.count("*").alias("n"))


def empirical_tail(exceedances: Column, n: Column) -> Column:
    return (exceedances + F.lit(1.0)) / (n + F.lit(1.0))


def null_counts(observed: DataFrame, nulls: DataFrame, thresholds: DataFrame) -> DataFrame:
    """For each threshold: observed count at or above it, and over the null replicates their mean, sample deviation,
    enrichment, empirical tail of the counts, and FDR (mean null / observed, at most 1).

    observed(score); nulls(replicate, score), a replicate without scores having one row of null score; thresholds(t), a
    small grid. All replicates count, also those with no score above a threshold.
    """
    t = F.broadcast(thresholds.select("t"))
    obs = observed.crossJoin(t).groupBy("t").agg(F.count_if(F.col("score") >= F.col("t")).alias("observed"))
    per = nulls.crossJoin(t).groupBy("t", "replicate").agg(F.count_if(F.col("score") >= F.col("t")).alias("k"))
    j = per.join(F.broadcast(obs), "t")
    agg = j.groupBy("t", "observed").agg(F.count("*").alias("n"), F.avg("k").alias("mean_null"), F.stddev_samp("k").alias("sd_null"), F.count_if(F.col("k") >= F.col("observed")).alias("ge"))
    return agg.select(
        "t", "observed", "mean_null", "sd_null", F.when(F.col("mean_null") > 0, F.col("observed") / F.col("mean_null")).alias("enrichment"),
        empirical_tail(F.col("ge"), F.col("n")).alias("tail"), F.when(F.col("observed") > 0, F.least(F.lit(1.0), F.col("mean_null") / F.col("observed"))).otherwise(1.0).alias("fdr"),
    )


def select_threshold(calibrated: DataFrame, families: int, max_fdr: float = 0.2, group: list[str] | None = None) -> DataFrame:
    """The first threshold whose FDR is low enough in all null families; infinity where none is, so that nothing passes.

    calibrated(group…, family, t, fdr)."""
    keys = group or []
    ok = calibrated.groupBy(*keys, "t").agg(F.count_distinct("family").alias("n"), F.max("fdr").alias("worst"))
    return ok.groupBy(*keys).agg(F.coalesce(F.min(F.when((F.col("n") == families) & (F.col("worst") <= max_fdr), F.col("t"))), F.lit(float("inf"))).alias("threshold"))


def bootstrap_kernel(diffs: np.ndarray, iterations: int, seed: int) -> np.ndarray:
    """Means of resamples, by a multinomial over the distinct values; order of the input doesn't matter."""
    values, counts = np.unique(diffs, return_counts=True)
    rng = np.random.default_rng(seed)
    draws = rng.multinomial(counts.sum(), counts / counts.sum(), size=iterations)
    return draws @ values / counts.sum()


def paired_bootstrap(df: DataFrame, a: str, b: str, group: list[str], iterations: int = 1000, seed: int = 7201, level: float = 0.95) -> DataFrame:
    """Mean difference of paired scores and its bootstrap interval per group, on counts of distinct differences.

    Columns out: group, n, mean, low, high. Equal differences are counted before they are grouped.
    """
    counts = df.groupBy(*group, F.round(F.col(a) - F.col(b), 12).alias("diff")).agg(F.count("*").alias("k"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        n = int(p["k"].sum())
        rng = np.random.default_rng(seed)
        p = p.sort_values("diff")
        v, k = p["diff"].to_numpy(), p["k"].to_numpy()
        means = rng.multinomial(n, k / n, size=iterations) @ v / n
        low, high = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
        return pd.DataFrame([[*(p[g].iloc[0] for g in group), n, float((v * k).sum() / n), float(low), float(high)]], columns=[*group, "n", "mean", "low", "high"])

    fields = ", ".join(f"{g} {df.schema[g].dataType.simpleString()}" for g in group)
    return counts.groupBy(*group).applyInPandas(run, f"{fields}, n bigint, mean double, low double, high double")


def mersenne_bootstrap(diffs: list[float], iterations: int, seed: int) -> list[float]:
    """Means of resamples drawn by Python's seeded generator, for callers that need that very sequence."""
    rng = random.Random(seed)
    n = len(diffs)
    return [sum(diffs[rng.randrange(n)] for _ in range(n)) / n for _ in range(iterations)]


def auroc(scores: DataFrame, group: list[str]) -> DataFrame:
    """Area under the ROC curve of score over positive (boolean) per group, ties counting half: group, auroc, n_pos, n_neg.

    Mann-Whitney over counts per distinct score, so the window has one row for each of them. Null without both classes.
    """
    bins = scores.groupBy(*group, "score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    w = Window.partitionBy(*group).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    b = bins.withColumn("below", F.coalesce(F.sum("n").over(w), F.lit(0)))
    out = b.groupBy(*group).agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2.0)).alias("u"), F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"))
    return out.select(*group, F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("u") / (F.col("n_pos") * F.col("n_neg"))).alias("auroc"), "n_pos", "n_neg")


def round_half_even(decimals: int):
    """Rounding of doubles as Python does it, for audits of stored scores."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: round(v, decimals), na_action="ignore").astype(float)

    return F.pandas_udf(run, T.DoubleType())
