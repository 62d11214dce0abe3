"""Recovery metrics, baselines, strata, and leakage checks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECALL_AT, NDCG_AT, PRECISION_AT = (5, 10, 20), 20, 10


def _ideal(n: Column, k: int) -> Column:
    """Best DCG at k of n relevant items: prefix sums of the discounts, a table of k numbers."""
    sums, total = [0.0], 0.0
    for i in range(1, k + 1):
        total += 1 / math.log2(i + 1)
        sums.append(total)
    return F.get(F.array(*[F.lit(x) for x in sums]), F.least(n, F.lit(k)).cast("int"))


def query_metrics(ranked: DataFrame, relevant: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query: recall at 5, 10, 20, precision at 10, reciprocal rank, nDCG at 20, and whether anything relevant was found.

    ranked(q, t, rank), relevant(q, t), queries(q, …). Queries without relevant targets get null metrics.
    """
    rel = relevant.select("q", "t").distinct()
    total = rel.groupBy("q").agg(F.count("*").alias("n_relevant"))
    hits = ranked.select("q", "t", "rank").join(rel, ["q", "t"])
    agg = hits.groupBy("q").agg(
        *[F.count_if(F.col("rank") <= k).alias(f"hit_{k}") for k in (*RECALL_AT,)], F.min("rank").alias("first"),
        F.sum(F.when(F.col("rank") <= NDCG_AT, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
    )
    j = queries.join(total, "q", "left").join(agg, "q", "left")
    n = F.col("n_relevant")
    has = n.isNotNull()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.select(
        *[queries[c] for c in queries.columns], F.coalesce(n, F.lit(0)).alias("n_relevant"), *[F.when(has, zero(f"hit_{k}") / n).alias(f"recall_{k}") for k in RECALL_AT],
        F.when(has, zero(f"hit_{PRECISION_AT}") / F.lit(float(PRECISION_AT))).alias("precision_10"), F.when(has, F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("reciprocal_rank"),
        F.when(has, F.coalesce("dcg", F.lit(0.0)) / _ideal(n, NDCG_AT)).alias("ndcg_20"), F.col("first").isNotNull().alias("covered"),
    )


METRICS = (*[f"recall_{k}" for k in RECALL_AT], "precision_10", "reciprocal_rank", "ndcg_20")


def summarize(metrics: DataFrame, dims: list[str] | None = None) -> DataFrame:
    """Means over the queries that have relevant targets; coverage over all queries. One row for each value of the dimensions."""
    return metrics.groupBy(*(dims or [])).agg(
        F.count("*").alias("n_queries"), F.count_if(F.col("n_relevant") > 0).alias("n_evaluated"), *[F.round(F.avg(m), 9).alias(m) for m in METRICS],
        F.round(F.avg(F.when(F.col("covered"), 1.0).otherwise(0.0)), 9).alias("coverage"),
    )


def summarize_strata(metrics: DataFrame, dims: list[str], values: DataFrame | None = None) -> DataFrame:
    """One summary for each value of each dimension by itself, in one pass: dimension, value, metrics.

    ``values(dimension, value)`` lists strata that must appear even if empty.
    """
    long = metrics.select(F.explode(F.array(*[F.struct(F.lit(x).alias("dimension"), F.coalesce(F.col(x).cast("string"), F.lit("")).alias("value")) for x in dims])).alias("d"), *METRICS, "n_relevant", "covered").select("d.*", *METRICS, "n_relevant", "covered")
    out = summarize(long, ["dimension", "value"])
    return out if values is None else values.join(out, ["dimension", "value"], "left").na.fill(0, ["n_queries", "n_evaluated"])


def random_ranking(queries: DataFrame, candidates: DataFrame, seed: int, k: int) -> DataFrame:
    """The first k of each query's candidates (q, t) in the order of a seeded hash: a baseline."""
    h = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("q").cast("string"), F.col("t").cast("string")), 256)
    r = F.row_number().over(Window.partitionBy("q").orderBy("h", "t"))
    return candidates.join(queries.select("q"), "q", "left_semi").withColumn("h", h).withColumn("rank", r).filter(F.col("rank") <= k).select("q", "t", "rank")


def length_ranking(candidates: DataFrame, lengths: DataFrame, k: int) -> DataFrame:
    """The first k of each query's candidates (q, t) by difference of length, then identifier."""
    a, b = lengths.select(F.col("pid").alias("q"), F.col("len").alias("lq")), lengths.select(F.col("pid").alias("t"), F.col("len").alias("lt"))
    d = candidates.join(a, "q").join(b, "t").withColumn("delta", F.abs(F.col("lq") - F.col("lt")))
    r = F.row_number().over(Window.partitionBy("q").orderBy("delta", "t"))
    return d.withColumn("rank", r).filter(F.col("rank") <= k).select("q", "t", "delta", "rank")


def overlap_ranking(jaccard: DataFrame, k: int) -> DataFrame:
    """The first k targets of each query by unweighted overlap: jaccard(q, t, score)."""
    r = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "t"))
    return jaccard.withColumn("rank", r).filter(F.col("rank") <= k).select("q", "t", "score", "rank")


def partition_violations(assignments: DataFrame, groups: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """Leakage groups that lie in more than one partition: assignments(relationship, partition), groups(group_type, group_id,
    relationship). Excluded rows don't count."""
    g = groups if types is None else groups.filter(F.col("group_type").isin(*types))
    j = g.join(assignments.filter(F.col("partition") != "excluded"), "relationship")
    return j.groupBy("group_type", "group_id").agg(F.count_distinct("partition").alias("n_partitions"), F.count_distinct("relationship").alias("n_relationships")).filter("n_partitions > 1")


def recovery_gate(comparison: DataFrame, least_queries: int = 100, least_links: int = 100) -> DataFrame:
    """Decision per corpus pair: rows (corpus_pair, n_queries, n_relationships, low_random, low_overlap)."""
    enough = (F.col("n_queries") >= least_queries) & (F.col("n_relationships") >= least_links)
    return comparison.withColumn("decision", F.when(~enough, "no_claim").when((F.col("low_random") > 0) & (F.col("low_overlap") > 0), "passed").otherwise("failed"))


def expand_queries(links: DataFrame) -> DataFrame:
    """Every link as queries in both directions, one for each source passage: links(relationship, sources_a array, sources_b
    array). Columns out: relationship, direction, q, relevant (sorted list), exclusion (no_source, no_target, self_only or null)."""
    one = lambda n, x, y: links.select("relationship", F.lit(n).alias("direction"), F.explode_outer(x).alias("q"), F.col(y).alias("targets"))
    u = one("a_to_b", "sources_a", "sources_b").unionByName(one("b_to_a", "sources_b", "sources_a"))
    rel = F.array_sort(F.array_distinct(F.filter("targets", lambda t: t != F.col("q"))))
    why = F.when(F.col("q").isNull(), "no_source").when(F.coalesce(F.size("targets"), F.lit(0)) <= 0, "no_target").when(F.size(rel) == 0, "self_only")
    return u.select("relationship", "direction", "q", F.when(why.isNull(), rel).alias("relevant"), why.alias("exclusion"))


def candidate_universe(ranked: DataFrame, limit: int) -> DataFrame:
    """Sorted distinct targets of each query; fails where a query has more than ``limit``, as nothing may be cut off."""
    u = ranked.groupBy("q").agg(F.sort_array(F.collect_set("t")).alias("targets"))
    return u.withColumn("targets", F.when(F.size("targets") > limit, F.raise_error(F.lit("candidate universe exceeds its limit")).cast(u.schema["targets"].dataType)).otherwise(F.col("targets")))


def control_recovery(controls: DataFrame, scores: DataFrame, negatives: DataFrame) -> DataFrame:
    """Whether a control's best pair beats its matched negative: controls(control, split, pair), scores(method, pair, score),
    negatives(control, pair). Columns out: method, split, n_controls, n_recovered, rate; missing scores count as 0."""
    methods = scores.select("method").distinct()
    best = lambda t, n: t.crossJoin(F.broadcast(methods)).join(scores, ["method", "pair"], "left").groupBy("method", "control").agg(F.coalesce(F.max("score"), F.lit(0.0)).alias(n))
    j = best(controls.select("control", "pair"), "pos").join(best(negatives, "neg"), ["method", "control"], "left").join(controls.select("control", "split").distinct(), "control")
    out = j.groupBy("method", "split").agg(F.count("*").alias("n_controls"), F.count_if(F.col("pos") > F.coalesce("neg", F.lit(0.0))).alias("n_recovered"))
    return out.withColumn("rate", F.col("n_recovered") / F.col("n_controls"))


def matched_negatives(controls: DataFrame, passages: DataFrame, seed: int) -> DataFrame:
    """For each control the passage of its genre that is nearest in length (then of its own book, then by seeded hash):
    controls(control, pid, genre, book, len), passages(pid, genre, book, len).

    Passages join on (genre, length) within a window of lengths that widens to the nearest occupied one: lengths of a
    genre are few numbers, so the nearest is found on those first.
    """
    lens = passages.groupBy("genre", "len").agg(F.count_distinct("pid").alias("n"))
    near = controls.join(lens.withColumnRenamed("len", "l2"), "genre").withColumn("delta", F.abs(F.col("len") - F.col("l2"))).filter((F.col("delta") > 0) | (F.col("n") > 1))
    best = near.groupBy("control", "pid", "genre", "book", "len").agg(F.min("delta").alias("delta"))
    p = passages.select(F.col("genre").alias("g2"), F.col("len").alias("l2"), F.col("pid").alias("cand"), F.col("book").alias("b2"))
    probe = best.withColumn("l2", F.explode(F.array_distinct(F.array(F.col("len") - F.col("delta"), F.col("len") + F.col("delta")))))
    hit = probe.join(p.withColumnRenamed("l2", "l3"), (F.col("genre") == F.col("g2")) & (F.col("l2") == F.col("l3"))).filter("pid <> cand")
    key = F.struct(F.when(F.col("book") == F.col("b2"), 0).otherwise(1).alias("other_book"), F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("control").cast("string"), F.col("cand").cast("string")), 256).alias("h"), F.col("cand").alias("cand"))
    return hit.groupBy("control", "delta").agg(F.min(key).alias("k")).select("control", "delta", F.col("k.cand").alias("negative"))
