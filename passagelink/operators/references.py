"""References to records that do not exist, or did not exist at the time of the reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagelink.operators.spread import hot_keys, spread_join
from passagelink.session import materialize

#: Blanks that are trimmed from loosely written keys.
BLANKS = " \t\n\v\f\r\u00a0\u2007\u202f\ufeff"


def loose_key(c: Column) -> Column:
    """A key without surrounding blanks and letter case; null where nothing is left."""
    k = F.lower(F.btrim(c, F.lit(BLANKS)))
    return F.when(F.length(k) > 0, k)


def references(df: DataFrame, name: str, record: str, key: str, time: str) -> DataFrame:
    """The references of one table as (ref_table, record_id, key, at); null and blank keys are none. Repeats stay."""
    return df.select(F.lit(name).alias("ref_table"), F.col(record).alias("record_id"), loose_key(F.col(key)).alias("key"), F.col(time).alias("at")).filter(F.col("key").isNotNull())


def orphan_references(refs: DataFrame, parents: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Every reference whose key no parent has (``missing``), has not yet (``late``) or no longer (``deleted``).

    refs: ``references()`` of any number of tables, united; a reference is a distinct row of it. Each parent row makes
    its key valid from ``start`` (null: always) up to but not including ``end`` (null: for ever). A null reference time
    can only be ``missing``. Repeated parent rows, empty intervals and keys of any spelling are allowed; an empty
    parent table makes all ``missing``. Columns out: ref_table, record_id, ref_month (yyyy-MM or unknown), reason.

    The distinct keys are anti-joined to the parents' keys, and the result joined back. Keys with one interval are
    decided by comparison in that join; repeats are dropped after it, when few rows are left. Keys with several are
    swept by time within (key, day): the distinct moments at which a key is asked for, not the records that ask; the
    balance at the start of a day comes from daily sums. Joins of the references are salted where a key is hot.
    """
    low, high = F.lit("0001-01-01").cast("timestamp_ntz"), F.lit("9999-12-31").cast("timestamp_ntz")
    p = parents.select(loose_key(F.col(key)).alias("key"), F.coalesce(F.col(start), low).alias("s"), F.coalesce(F.col(end), high).alias("e")).filter(F.col("key").isNotNull())
    known = materialize(
        p.groupBy("key").agg(F.min("s").alias("first_s"), F.max("e").alias("last_e"), F.max("s").alias("last_s"), F.min("e").alias("first_e"))
        .select("key", "first_s", "last_e", ((F.col("first_s") != F.col("last_s")) | (F.col("first_e") != F.col("last_e"))).alias("several"))
    )
    asked_keys = materialize(refs.groupBy("key").agg(F.count("*").alias("n")))
    missing_keys = asked_keys.join(known.select("key"), "key", "left_anti")
    told = known.unionByName(missing_keys.select("key", F.lit(None).cast("timestamp_ntz").alias("first_s"), F.lit(None).cast("timestamp_ntz").alias("last_e"), F.lit(False).alias("several")))
    seen = F.col("at")
    state = (
        F.when(F.col("first_s").isNull(), "missing").when(seen < F.col("first_s"), "late")
        .when(seen >= F.col("last_e"), "deleted").when(F.col("several") & seen.isNotNull(), "open")
    )
    judged = spread_join(refs, told, "key", hot_keys(asked_keys, "key", "n"), F.xxhash64("record_id", "at")).withColumn("reason", state).filter(F.col("reason").isNotNull())
    judged = materialize(judged.select("ref_table", "record_id", "key", "at", "reason").distinct())
    plain = judged.filter("reason <> 'open'").select("ref_table", "record_id", "at", "reason")
    open_refs = judged.filter("reason = 'open'")
    many = p.join(known.filter("several").select("key"), "key", "left_semi").filter("e > s").distinct()
    # an end at the same instant counts before a reference, as does a start: [s, e)
    changes = many.select("key", F.col("s").alias("at"), F.lit(1).alias("d")).unionByName(many.filter(F.col("e") < high).select("key", F.col("e").alias("at"), F.lit(-1).alias("d")))
    daily = changes.groupBy("key", F.to_date("at").alias("day")).agg(F.sum("d").alias("net"))
    asked = open_refs.select("key", F.to_date("at").alias("day")).distinct().withColumn("net", F.lit(0).cast("bigint"))
    before = Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        daily.unionByName(asked).groupBy("key", "day").agg(F.sum("net").alias("net"))
        .select("key", "day", F.coalesce(F.sum("net").over(before), F.lit(0)).alias("base"))
    )
    # the moments at which a key is asked for, however many records ask
    moments = materialize(open_refs.groupBy("key", "at").agg(F.count("*").alias("n")))
    events = changes.groupBy("key", "at").agg(F.sum("d").alias("d")).select("key", F.to_date("at").alias("day"), "at", "d", F.lit(0).alias("o"))
    events = events.unionByName(moments.select("key", F.to_date("at").alias("day"), "at", F.lit(0).cast("bigint").alias("d"), F.lit(1).alias("o")))
    run = Window.partitionBy("key", "day").orderBy("at", "o").rowsBetween(Window.unboundedPreceding, 0)
    shut = (
        events.withColumn("live", F.sum("d").over(run)).filter("o = 1")
        .join(base, ["key", "day"]).filter(F.col("live") + F.col("base") <= 0).select(F.struct("key", "at").alias("moment"))
    )
    hot = hot_keys(moments.select(F.struct("key", "at").alias("moment"), "n"), "moment", "n")
    swept = spread_join(open_refs.withColumn("moment", F.struct("key", "at")), shut, "moment", hot, F.xxhash64("record_id"), "left_semi").select("ref_table", "record_id", "at", F.lit("deleted").alias("reason"))
    return (
        plain.unionByName(swept)
        .select("ref_table", "record_id", F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("unknown")).alias("ref_month"), "reason")
    )


def orphan_counts(orphans: DataFrame, refs: DataFrame) -> DataFrame:
    """Orphans of each kind per table and period beside all references there."""
    month = F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("unknown")).alias("ref_month")
    total = refs.distinct().groupBy("ref_table", month).agg(F.count("*").alias("n_references"))
    kind = lambda r: F.count_if(F.col("reason") == r).alias(f"n_{r}")
    return (
        orphans.groupBy("ref_table", "ref_month").agg(kind("missing"), kind("late"), kind("deleted"))
        .join(total, ["ref_table", "ref_month"], "right")
        .na.fill(0, ["n_missing", "n_late", "n_deleted"])
    )
