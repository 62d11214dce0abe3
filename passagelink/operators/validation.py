"""Constraint checks that return the violating rows, and comparisons of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagelink.operators.statistics import round_half_even


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """Named checks as one report: check, n_violations; a check's frame holds its violating rows."""
    rows = [df.agg(F.count("*").alias("n_violations")).select(F.lit(n).alias("check"), "n_violations") for n, df in sorted(checks.items())]
    return reduce(DataFrame.unionByName, rows)


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def dangling(df: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def breaks(df: DataFrame, rule: Column) -> DataFrame:
    """Rows for which a rule doesn't hold; a null outcome is a violation."""
    return df.filter(~F.coalesce(rule, F.lit(False)))


def broken_positions(members: DataFrame, key: str, position: str) -> DataFrame:
    """Groups whose positions aren't 1 to n without repeats."""
    g = members.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(position).alias("d"), F.min(position).alias("lo"), F.max(position).alias("hi"))
    return g.filter((F.col("lo") != 1) | (F.col("hi") != F.col("n")) | (F.col("d") != F.col("n")))


def not_monotone(df: DataFrame, order: Column, value: str, group: list[str]) -> DataFrame:
    """Rows whose value is below the one before it in order."""
    prev = F.lag(value).over(Window.partitionBy(*group).orderBy(order))
    return df.withColumn("previous", prev).filter(F.col(value) < F.col("previous"))


def misrounded(df: DataFrame, raw: str, rounded: str, decimals: int) -> DataFrame:
    """Rows whose stored value isn't the half-even rounding of the raw one."""
    return df.filter(~round_half_even(decimals)(F.col(raw)).eqNullSafe(F.col(rounded)))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one run that the other lacks, with how often: side, row columns. Repeats count."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


def traceable(candidates: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Keys that only candidates or only review records have."""
    a, b = candidates.select(key).distinct().withColumn("a", F.lit(True)), records.select(key).distinct().withColumn("b", F.lit(True))
    return a.join(b, key, "full_outer").filter("a is null or b is null").select(key, F.when(F.col("a").isNull(), "only_record").otherwise("only_candidate").alias("problem"))


def null_table_checks(nulls: DataFrame) -> dict[str, DataFrame]:
    """Checks of a threshold table (scope, t, observed, mean_null, fdr): ranges, and FDR and counts never rising with t."""
    up = lambda c: not_monotone(nulls, F.col("t") * -1, c, ["scope"])
    return {"fdr_range": breaks(nulls, F.col("fdr").between(0, 1)), "counts_range": breaks(nulls, (F.col("observed") >= 0) & (F.col("mean_null") >= 0)), "observed_monotone": up("observed")}


def review_records(candidates: DataFrame, prior: DataFrame, key: str) -> DataFrame:
    """Candidates with what reviewers decided before, ``not_reviewed`` where nothing is recorded."""
    latest = prior.groupBy(key).agg(F.max_by("decision", "decided_at").alias("decision"))
    return candidates.join(latest, key, "left").na.fill("not_reviewed", ["decision"])
