"""Ranking, top-k, fusion and ablation of rankings.

Every ranking has the total order (score downward, identifier upward); scores are rounded before they are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DECIMALS = 12


def both_ways(pairs: DataFrame, score: str = "score") -> DataFrame:
    """An unordered score as two directed rows: q, t, score."""
    s = F.col(score).alias("score")
    return pairs.select(F.col("a").alias("q"), F.col("b").alias("t"), s).unionByName(pairs.select(F.col("b").alias("q"), F.col("a").alias("t"), s))


def top_k(scored: DataFrame, k: int, decimals: int = DECIMALS) -> DataFrame:
    """The k best targets of each query with a positive score: q, t, score, rank.

    The limit is applied within tasks before rows are shuffled by query.
    """
    s = scored.withColumn("score", F.round("score", decimals)).filter("score > 0")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "t"))
    return s.withColumn("rank", rank).filter(F.col("rank") <= k).select("q", "t", "score", "rank")


def union_rankings(rankings: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, r in rankings.items():
        one = r.select(F.lit(name).alias("detector"), "q", "t", "score", "rank")
        out = one if out is None else out.unionByName(one)
    return out


def fuse(ranked: DataFrame, k: int = 60, families: dict[str, str] | None = None, best_of_family: bool = False, without: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal rank fusion of rows (detector, q, t, rank): q, t, score, detectors.

    With ``best_of_family`` only the detector of best (rank, name) counts in each family; ``without`` names detectors
    that are taken away (ablation).
    """
    r = ranked.filter(~F.col("detector").isin(*without)) if without else ranked
    if best_of_family:
        fam = F.col("detector")
        for d, f in (families or {}).items():
            fam = F.when(F.col("detector") == d, F.lit(f)).otherwise(fam)
        first = F.row_number().over(Window.partitionBy("q", "t", "family").orderBy("rank", "detector"))
        r = r.withColumn("family", fam).withColumn("first", first).filter("first = 1")
    return r.groupBy("q", "t").agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score"), F.count("*").alias("detectors"))


def rank_ablations(ranked: DataFrame, names: dict[str, tuple[str, ...]], k: int = 60) -> DataFrame:
    """Rank of every candidate of a query in the full fusion and without the detectors each ablation names:
    ablation, q, t, full_rank, ablated_rank (null where it falls out), changed."""
    order = Window.partitionBy("q").orderBy(F.desc("score"), "t")
    ranks = lambda f, n: f.withColumn("score", F.round("score", DECIMALS)).withColumn(n, F.row_number().over(order)).select("q", "t", n)
    full = ranks(fuse(ranked, k), "full_rank")
    out = None
    for name, gone in names.items():
        one = full.join(ranks(fuse(ranked, k, without=gone), "ablated_rank"), ["q", "t"], "left").withColumn("ablation", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("ablation", "q", "t", "full_rank", "ablated_rank", (~F.col("full_rank").eqNullSafe(F.col("ablated_rank"))).alias("changed"))


def cosignals(signals: DataFrame) -> DataFrame:
    """Independent co-signals of each candidate: rows (candidate, signal_id, independence_key, primary_key, english,
    feature_ids array, primary_ids array). English-derived ones, restatements of the primary features and all but the
    first of a key go: candidate, signal_id."""
    fine = signals.filter(~F.col("english") & (F.col("independence_key") != F.col("primary_key")) & (F.size(F.array_except("feature_ids", "primary_ids")) > 0))
    first = F.row_number().over(Window.partitionBy("candidate", "independence_key").orderBy("signal_id"))
    return fine.withColumn("first", first).filter("first = 1").select("candidate", "signal_id")


def merge_directions(scored: DataFrame) -> DataFrame:
    """Directed scores of pairs as one row for each unordered pair: a, b, best, forward, backward."""
    a, b = F.least("q", "t"), F.greatest("q", "t")
    return scored.groupBy(a.alias("a"), b.alias("b")).agg(F.max("score").alias("best"), F.max(F.when(F.col("q") < F.col("t"), F.col("score"))).alias("forward"), F.max(F.when(F.col("q") > F.col("t"), F.col("score"))).alias("backward"))


def neighbour_pairs(neighbours: DataFrame, q: str = "q", t: str = "t") -> DataFrame:
    """Distinct unordered pairs of a neighbour table."""
    return neighbours.filter(F.col(q) != F.col(t)).select(F.least(q, t).alias("a"), F.greatest(q, t).alias("b")).distinct()


def pair_bound(n: int, k: int) -> int:
    """Most unordered pairs that n directed lists of k neighbours can hold."""
    return min(n * (n - 1) // 2, n * min(k, n - 1)) if n > 1 else 0


def book_ordinal(df: DataFrame, book: str, order: str) -> DataFrame:
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(book).orderBy(order)))


def penalized(score: Column, formulaic: Column, local: Column, short: Column, fractions: tuple[float, float, float] = (0.5, 0.5, 0.75)) -> Column:
    """A score after penalties, each taking its fraction of what is left."""
    for flag, f in zip((formulaic, local, short), fractions):
        score = score * F.when(flag, 1 - f).otherwise(1.0)
    return score


def scale_contract(n_passages: int, top_k_sparse: int = 16, top_k_dense: int = 16, detectors: int = 9, seeds: int = 100_000) -> dict[str, int]:
    """Most pairs and evidence rows a campaign can hold; caps are checked, never used to drop rows."""
    pairs = pair_bound(n_passages, top_k_sparse) + 2 * pair_bound(n_passages, top_k_dense) + seeds
    return {"passages": n_passages, "pairs": pairs, "evidence": pairs * detectors}
