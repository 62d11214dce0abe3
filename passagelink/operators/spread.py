"""Work on keys and orders of any skew: joins whose hot keys are salted, and positions in a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagelink.session import materialize, shuffle_width

#: A key is hot if it holds at least this share of all rows, so there are at most 1 / HOT of them.
HOT = 1 / 1000
#: Parts that the rows of a hot key are dealt to.
SALTS = 64


def hot_keys(counts: DataFrame, key: str, n: str, total: int | None = None) -> DataFrame:
    """The hashes of hot keys, as (hot): of ``counts(key, n)`` those with at least HOT of all rows; at most 1 / HOT rows.

    ``counts`` holds a key once. An empty table gives none.
    """
    if total is None:
        total = counts.agg(F.sum(n).alias("n")).collect()[0].n or 0  # one number
    return counts.filter(F.col(n) >= max(1.0, HOT * total)).select(F.xxhash64(key).alias("hot")).distinct()


def spread_join(rows: DataFrame, one: DataFrame, key: str, hot: DataFrame, by: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``one``, which has a key at most once, on ``key``, the rows of hot keys dealt to SALTS tasks.

    ``hot`` comes from ``hot_keys()`` and is broadcast, at most 1 / HOT numbers. ``by`` is a hash of the row that deals
    it; the same on every run, so that a lost task is repeated alike. Null keys join nothing. ``how`` is inner, left,
    left_semi or left_anti. Rows of hot keys meet a copy of their one partner in every part; nothing is dropped or
    doubled, whatever ``hot`` names.
    """
    mark = F.broadcast(hot.select("hot", F.lit(True).alias("_hot")))
    dealt = rows.withColumn("hot", F.xxhash64(key)).join(mark, "hot", "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(by, F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot", "_hot")
    copies = one.withColumn("hot", F.xxhash64(key)).join(mark, "hot", "left")
    copies = copies.withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("hot", "_hot")
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")


def numbered(df: DataFrame, *order: str | Column, name: str = "position") -> DataFrame:
    """``df`` with every row's position, from 0, in the order of the columns ``order``, without one task for all.

    Rows are range-partitioned and sorted; the sizes of the partitions, one row each, give every partition its start.
    Rows that tie in all of ``order`` take adjacent positions in no certain order, so give a total order. Nulls come
    first. The sorted rows are written once.
    """
    spark = df.sparkSession
    lined = df.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    lined = materialize(lined)
    part = F.shiftright("_id", 33)
    sizes = lined.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    start = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))  # a row a partition
    return lined.withColumn("_part", part).join(F.broadcast(start), "_part").withColumn(name, F.col("_start") + F.col("_id").bitwiseAND(F.lit(2**33 - 1))).drop("_id", "_part", "_start")


def running(df: DataFrame, keys: list[str], order: list[str | Column], value: str, name: str, how: str = "sum") -> DataFrame:
    """``df`` with the running sum (or ``how`` = min) of ``value`` within ``keys`` in the order ``order``, its own row included.

    No task holds a key or the whole: rows are range-partitioned by (keys, order), summed within each partition, and the
    totals, one row for each key in each partition, carry over. ``order`` must be total within a key. The sorted rows
    are written once. Null keys are a key of their own.
    """
    fold, join = (F.sum, lambda a, b: a + F.coalesce(b, F.lit(0))) if how == "sum" else (F.min, lambda a, b: F.least(a, b))
    lined = df.repartitionByRange(shuffle_width(df.sparkSession), *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_id", F.monotonically_increasing_id())
    lined = materialize(lined).withColumn("_part", F.shiftright("_id", 33))
    marks = [f"_key{k}" for k in range(len(keys))]
    # a key as one value that is equal to itself also where it is null
    lined = lined.withColumns({m: F.xxhash64(F.lit(1), F.col(k).isNull(), F.col(k)) for m, k in zip(marks, keys)})
    own = fold(value).over(Window.partitionBy("_part", *marks).orderBy("_id").rowsBetween(Window.unboundedPreceding, 0))
    parts = lined.groupBy("_part", *marks).agg(fold(value).alias("_all"))
    before = fold("_all").over(Window.partitionBy(*marks, F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    carried = parts.select("_part", *marks, before.alias("_before"))
    return lined.withColumn("_own", own).join(carried, ["_part", *marks]).withColumn(name, join(F.col("_own"), F.col("_before"))).drop("_id", "_part", "_own", "_before", *marks)
