"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagelink.llm import encode, leakage, pii, setsim, splits, topn, vectors
from passagelink.operators.references import loose_key
from passagelink.session import materialize, table

VECTOR_SIZE, NEAREST, LEAST_COSINE = 64, 5, 0.8
SET_SIMILARITY, SET_LEAST = 0.7, 3


def _controls(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "positive_controls")
    return t.select(
        "control_id", splits.group_key(F.col("leakage_group_id")).alias("leakage"), splits.group_key(F.col("relationship_family_id")).alias("family"),
        splits.stored_split(F.col("split")).alias("split"), "relationship_class",
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _controls(spark, d)
    return splits.torn(rows, splits.components(rows, "control_id", ["leakage", "family"]), "control_id", "split")


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    rows = _controls(spark, d)
    shares = {r.split: r.split_share for r in table(spark, d, "split_shares").select("split", "split_share").collect()}  # a fixed table, a row a split
    return splits.assign_splits(rows, splits.components(rows, "control_id", ["leakage", "family"]), "control_id", "relationship_class", shares)


def _sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    member = table(spark, d, "passage_membership").select("passage_id", loose_key(F.col("token_id")).alias("token_id"))
    pairs = table(spark, d, "selected_m7_pairs").filter("passage_a_id <> passage_b_id").select("passage_a_id", "passage_b_id")
    partner = pairs.select(F.explode(F.array(F.struct(F.col("passage_a_id").alias("p"), F.col("passage_b_id").alias("q")), F.struct(F.col("passage_b_id").alias("p"), F.col("passage_a_id").alias("q")))).alias("s")).select("s.*")
    a, wide_a = setsim.value_sets(member, "passage_id", "token_id", SET_LEAST, "membership")
    b, wide_b = setsim.value_sets(partner, "p", "q", SET_LEAST, "selection")
    return materialize(a.unionByName(b)), wide_a.unionByName(wide_b)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    sets, wide = _sets(spark, d)
    found = setsim.expand_pairs(sets, setsim.similar_sets(sets, SET_SIMILARITY))
    found = found.unionByName(setsim.similar_large(sets, wide, SET_SIMILARITY))
    return found.select(F.col("part").alias("basis"), F.col("lo").alias("passage_lo"), F.col("hi").alias("passage_hi"))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    sets, wide = _sets(spark, d)
    out = setsim.set_classes(sets, setsim.similar_sets(sets, SET_SIMILARITY), setsim.large_pairs(sets, wide, SET_SIMILARITY))
    return out.select(F.col("part").alias("basis"), F.col("rid").alias("passage_id"), "class_id", "class_size", "similar_classes")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "passage_vectors").select(F.col("passage_id").alias("id"), F.col("embedded_at").alias("t"), F.col("embedding").alias("v"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return vectors.nearest(_vectors(spark, d), NEAREST, VECTOR_SIZE, LEAST_COSINE, exact=False).select("query_id", "target_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "neighbor").select("query_id", "target_id", "cosine_similarity").filter("query_id <> target_id and cosine_similarity between -1 and 1")
    return topn.top_n(rows, "query_id", "target_id", "cosine_similarity", NEAREST).select("query_id", "target_id", "top_rank")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "heldout_items"), "item_id", "text")


def _lexicon(spark: SparkSession, d: str) -> list[tuple[str, str]]:
    return [tuple(r) for r in table(spark, d, "name_lexicon").select("name_part", "name_role").collect()]  # a fixed table


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_pii(table(spark, d, "documents"), "doc_id", "text", _lexicon(spark, d)).filter(F.col("pii_kind").isin(*pii.KINDS))


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact_pii(table(spark, d, "documents"), "doc_id", "text", _lexicon(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p2_splits, p3_found, p3_classes, p4_found, p5_found, p6_ids, p7_found, p8_found, p8_redacted)
}
