"""Grammar, structure and meaning as evidence for a pair of passages.

Each function takes pairs that carry the annotation arrays of both passages (suffixes _a and _b) and adds scores in
[0, 1]. Arrays are passage-sized, so the scores run in Arrow batches without grouping anything.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagelink.operators.detectors import aligned_similarity, cosine, jaccard
from passagelink.operators.features import grammar_features, structural_signature
from passagelink.session import materialize


def _multiset(a, b) -> float:
    x, y = Counter(a), Counter(b)
    high = sum((x | y).values())
    return sum((x & y).values()) / high if high else 0.0


def _count_cosine(a, b) -> float:
    x, y = Counter(a), Counter(b)
    norm = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
    return sum(v * y[k] for k, v in x.items()) / norm if norm else 0.0


@F.pandas_udf(T.DoubleType())
def multiset_jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    """Sum of smaller over sum of larger counts of two arrays; 0 for two empty ones."""
    return pd.Series([_multiset(x, y) for x, y in zip(a, b)], dtype=float)


@F.pandas_udf(T.DoubleType())
def count_cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_count_cosine(x, y) for x, y in zip(a, b)], dtype=float)


def grammar_frequencies(passages: DataFrame) -> DataFrame:
    """In how many passages each grammar feature occurs: passages(pid, pos, morph)."""
    return passages.select("pid", F.explode(F.array_distinct(grammar_features(F.col("pos"), F.col("morph")))).alias("feature")).groupBy("feature").agg(F.count("*").alias("df"))


def grammar_evidence(pairs: DataFrame, frequencies: DataFrame, rare_df: int) -> DataFrame:
    """grammar_score: mean of the overlap of grammar features and the alignments of parts of speech and morphology;
    rare_score: shared over all features of at most ``rare_df`` passages. pairs(a, b, pos_a, pos_b, morph_a, morph_b)."""
    # written once, as every score below reads the features
    x = materialize(pairs.withColumn("fa", grammar_features(F.col("pos_a"), F.col("morph_a"))).withColumn("fb", grammar_features(F.col("pos_b"), F.col("morph_b"))))
    score = (multiset_jaccard("fa", "fb") + aligned_similarity("pos_a", "pos_b") + aligned_similarity("morph_a", "morph_b")) / 3
    rare = frequencies.filter(F.col("df") <= rare_df).select("feature")
    side = lambda f: x.select("a", "b", F.explode(F.array_distinct(f)).alias("feature"))
    each = side("fa").unionByName(side("fb")).join(rare, "feature").groupBy("a", "b", "feature").agg(F.count("*").alias("sides"))
    n = each.groupBy("a", "b").agg((F.count_if(F.col("sides") == 2) / F.count("*")).alias("rare_score"))
    return x.withColumn("grammar_score", score).drop("fa", "fb").join(n, ["a", "b"], "left").na.fill(0.0, ["rare_score"])


COMPONENTS = ("frames", "frame_transitions", "participants", "participant_transitions", "entities", "actions", "action_progression")


def structure_evidence(pairs: DataFrame) -> DataFrame:
    """structure_score: mean over the components that at least one passage has, of overlap (and alignment for the ordered
    ones); role_reversal: the same two participants in the other order.

    pairs(a, b, frames_a, participants_a, entities_a, and the same with _b).
    """
    sig = lambda s: structural_signature(F.col(f"frames_{s}"), F.col(f"participants_{s}"), F.col(f"entities_{s}"))
    x = materialize(pairs.withColumn("sa", sig("a")).withColumn("sb", sig("b")))
    one = lambda c: F.when(F.size(F.col(f"sa.{c}")) + F.size(F.col(f"sb.{c}")) > 0, (multiset_jaccard(f"sa.{c}", f"sb.{c}") + aligned_similarity(f"sa.{c}", f"sb.{c}")) / 2)
    parts = F.filter(F.array(*[one(c) for c in COMPONENTS]), lambda v: v.isNotNull())
    mean = F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda s, v: s + v) / F.size(parts)).otherwise(0.0)
    pa, pb = F.array_distinct("sa.participants"), F.array_distinct("sb.participants")
    swapped = (F.size(pa) >= 2) & (F.size(pb) >= 2) & (F.get(pa, F.lit(0)) == F.get(pb, F.lit(1))) & (F.get(pa, F.lit(1)) == F.get(pb, F.lit(0)))
    return x.withColumn("structure_score", mean).withColumn("role_reversal", F.coalesce(swapped, F.lit(False))).drop("sa", "sb")


def semantic_evidence(pairs: DataFrame) -> DataFrame:
    """domain_score: Jaccard of semantic domains; sequence_score: mean of the count cosines and alignments of lemmas and roots;
    embedding_score: cosine mapped to [0, 1], null without both vectors.

    pairs(a, b, domains_a, lemmas_a, roots_a, vector_a, and the same with _b).
    """
    seq = (count_cosine("lemmas_a", "lemmas_b") + count_cosine("roots_a", "roots_b") + aligned_similarity("lemmas_a", "lemmas_b") + aligned_similarity("roots_a", "roots_b")) / 4
    return pairs.withColumn("domain_score", jaccard(F.col("domains_a"), F.col("domains_b"))).withColumn("sequence_score", seq).withColumn("embedding_score", (cosine(F.col("vector_a"), F.col("vector_b")) + 1) / 2)


def encode(passages: DataFrame, text: str, encoder, size: int, prefix: str = "query: ") -> DataFrame:
    """A unit vector for every passage by a given encoder, list[str] -> array of shape (n, size), in Arrow batches.

    Fails on vectors of other shape, not finite or of no length. Null texts get null.
    """
    import numpy as np

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(s: pd.Series) -> pd.Series:
        keep = s.notna()
        unit = iter(())
        if keep.any():
            v = np.asarray(encoder([prefix + t for t in s[keep]]), dtype=np.float64)
            if v.shape != (int(keep.sum()), size) or not np.isfinite(v).all() or not (np.linalg.norm(v, axis=1) > 0).all():
                raise ValueError("the encoder gave unusable vectors")
            unit = iter((v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32))
        return pd.Series([next(unit) if k else None for k in keep], dtype=object)

    return passages.withColumn("vector", run(text))


def matched_trace(pairs: DataFrame) -> DataFrame:
    """Values that both passages hold, with positions and token ids on both sides: pairs(a, b, values_a, tokens_a, values_b,
    tokens_b) gives a, b, value, pos_a, tokens_a, pos_b, tokens_b."""
    def side(s: str) -> DataFrame:
        x = pairs.select("a", "b", F.posexplode(f"values_{s}").alias("p", "value"), f"tokens_{s}").filter("value is not null")
        return x.groupBy("a", "b", "value").agg(F.sort_array(F.collect_list(F.col("p") + 1)).alias(f"pos_{s}"), F.transform(F.array_sort(F.collect_list(F.struct("p", F.get(f"tokens_{s}", F.col("p")).alias("t")))), lambda e: e["t"]).alias(f"tokens_{s}"))

    return side("a").join(side("b"), ["a", "b", "value"])
