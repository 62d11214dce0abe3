"""Splits that keep related records together. Components come from ``operators.graph``; keys are normalized before."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagelink.operators.graph import components
from passagelink.operators.references import loose_key
from passagelink.operators.spread import numbered
from passagelink.session import materialize

__all__ = ["assign_splits", "components", "group_key", "stored_split", "torn"]

#: Written stand-ins for "no group" (fixed values).
PLACEHOLDERS = ("unknown", "n/a", "none", "-")
#: Other names of stored splits (fixed values).
SPLIT_NAMES = {"dev": "development", "validation": "development"}
#: Not read any more: components were rounded to fewer kinds above it. Tests set it to show that nothing depends on it.
KINDS = 100_000


def group_key(c: Column) -> Column:
    """A group id without outer blanks and letter case; null for blanks and placeholders."""
    k = loose_key(c)
    return F.when(~k.isin(*PLACEHOLDERS), k)


def stored_split(c: Column) -> Column:
    k = loose_key(c)
    for a, b in SPLIT_NAMES.items():
        k = F.when(k == a, b).otherwise(k)
    return k


def label_vectors(rows: DataFrame, comps: DataFrame, ident: str, label: str) -> DataFrame:
    """How many rows of each component have each label: component_id, label, n. Null labels and identifiers don't count.

    Rows combine by (identifier, label) before they meet their component.
    """
    held = rows.select(F.col(ident).cast("string").alias(ident), F.col(label).cast("string").alias("label")).filter(F.col(ident).isNotNull() & F.col("label").isNotNull())
    held = held.groupBy(ident, "label").agg(F.count("*").alias("n"))
    return held.join(comps, ident).groupBy("component_id", "label").agg(F.sum("n").alias("n"))


def torn(rows: DataFrame, comps: DataFrame, ident: str, split: str) -> DataFrame:
    """Records of components whose label vector, the labels being the stored splits, has two or more entries.

    Columns out: ident, component_id; one row for each distinct identifier.
    """
    bad = label_vectors(rows, comps, ident, split).groupBy("component_id").agg(F.count("*").alias("k")).filter("k >= 2")
    return comps.join(bad.select("component_id"), "component_id", "left_semi").select(ident, "component_id")


def _deal(need: dict[str, float], each: float, m: int, order: list[str]) -> dict[str, int]:
    """How many of ``m`` equal components every split gets, if one after another goes where the need is greatest."""
    n = dict.fromkeys(order, 0)
    if m > 4 * len(order):  # most of them at once: the needs are lowered to one level
        by = sorted(need.values(), reverse=True)
        for j in range(1, len(by) + 1):
            level = (sum(by[:j]) - m * each) / j
            if j == len(by) or level >= by[j]:
                break
        for s in order:
            n[s] = max(0, int((need[s] - level) // each) - 1)
    for _ in range(m - sum(n.values())):
        n[max(order, key=lambda s: need[s] - n[s] * each)] += 1
    return n


def assign_splits(rows: DataFrame, comps: DataFrame, ident: str, label: str, shares: dict[str, float]) -> DataFrame:
    """A split for every record, so that a component stays whole and sizes and labels keep the wanted proportions.

    Columns out: ident, component_id, split. ``label`` is a column of few values (a schema's classes); null is a value.
    Shares are normalized to sum 1. A component larger than any split's need goes where the need is greatest.

    Grouped iterative stratification: components' label vectors are summed first. The label of which least is
    outstanding comes first; the components that hold it are placed, those that hold most of it first, each into the
    split that needs most of it (of splits in equal need the one that needs most rows), and so on with the next label.
    Components with equally many rows of the label are placed in one step, as if one after another. Among them those of
    one label vector stand side by side, in the order of hashes, and the splits alternate along that order, so that all
    other labels are spread too. Counts are never rounded. The driver holds the distinct counts of one label at a time,
    whose sum is no more than the rows: of N rows at most the square root of 2 N. A label is one pass.
    """
    spark = rows.sparkSession
    total = sum(shares.values())
    shares = {s: x / total for s, x in sorted(shares.items())}
    splits = list(shares)
    per = label_vectors(rows.withColumn(label, F.coalesce(F.col(label).cast("string"), F.lit(""))), comps, ident, label)
    per = materialize(per.groupBy("component_id").agg(F.sort_array(F.collect_list(F.struct("label", "n"))).alias("vector")))  # as many entries as labels
    counted = lambda df, *by: df.select(*by, F.explode("vector").alias("e")).groupBy(*by, "e.label").agg(F.sum("e.n").alias("n")).collect()  # noqa: E731, a row a label and split
    left = {r.label: float(r.n) for r in counted(per)}
    need = {s: {k: x * n for k, n in left.items()} for s, x in shares.items()}
    done: list[str] = []
    chosen = spark.createDataFrame([], "component_id string, split string")
    while len(done) < len(left):
        k = min((k for k in left if k not in done), key=lambda k: (left[k], k))
        held = F.aggregate("vector", F.lit(0).cast("bigint"), lambda a, e: a + F.when(e["label"] == k, e["n"]).otherwise(0))
        open_ = per.filter(~F.exists("vector", lambda e: e["label"].isin(*done))) if done else per
        open_ = open_.withColumn("held", held).filter("held > 0")
        many = {r.held: r.m for r in open_.groupBy("held").agg(F.count("*").alias("m")).collect()}
        done.append(k)
        cuts, start = [], 0
        for each in sorted(many, reverse=True):
            m, at = many[each], 0
            step = next(x for x in range(max(1, round(m * 0.6180339887)), m + 2) if gcd(x, m) == 1)  # place * step runs over all of m evenly
            for s, n in _deal({s: need[s][k] for s in splits}, each, m, sorted(splits, key=lambda s: (-sum(need[s].values()), s))).items():
                if n:
                    cuts.append((each, start, m, step, at, at + n, s))
                at += n
                need[s][k] -= n * each
            start += m
        if not cuts:
            continue
        bounds = spark.createDataFrame(cuts, "held bigint, start bigint, m bigint, step bigint, lo bigint, hi bigint, split string")
        line = numbered(open_.withColumn("kind", F.xxhash64(F.to_json("vector"))), F.desc("held"), "kind", F.xxhash64("component_id"), "component_id")
        turn = F.expr("(position - start) * step % m")
        placed = materialize(line.join(F.broadcast(bounds), "held").filter((turn >= F.col("lo")) & (turn < F.col("hi"))).select("component_id", "split", "vector"))
        for r in counted(placed, "split"):
            left[r.label] -= r.n
            if r.label != k:
                need[r.split][r.label] -= r.n
        chosen = chosen.unionByName(placed.select(F.col("component_id").cast("string").alias("component_id"), "split"))
    return comps.join(chosen, "component_id").select(ident, "component_id", "split")
