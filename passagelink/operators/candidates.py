"""Candidates: rare-evidence rule, penalties, ablations, score traces, review queue."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagelink.operators.detectors import lcs
from passagelink.operators.retrieval import penalized

SEP = "␟"
#: Detectors each ablation takes away, and the penalties it drops.
ABLATIONS = {
    "remove_tfidf": (("tfidf",), ()), "remove_bm25": (("bm25",), ()), "remove_rare_evidence": (("rare",), ()), "remove_phrase_evidence": (("phrase",), ()), "remove_ordered_sequence": (("lcs", "alignment"), ()),
    "remove_formulaic_penalty": ((), ("formulaic",)), "remove_local_context_penalty": ((), ("local",)), "remove_all_english_derived_features": (("english",), ()),
}


def rare_rule(evidence: DataFrame) -> DataFrame:
    """Whether a pair's rare features are backed by something independent of the first of them.

    evidence: one row for each pair with pair, rows array<struct<family, value, feature_id, positions, is_rare, is_high>>
    (shared features of families lemma, root, lemma_ngram, root_ngram, part_of_speech, morphology), seq_a, seq_b (lemmas),
    pos_a, pos_b (parts of speech), set_score and grammar_score. Columns out: pair, co_signals, kinds, passed.

    Rare lemmas and roots at the same positions are one group; the first group is primary. Each further group counts,
    then at most one each of: a phrase that brings unused material, an ordered sequence of three with two unused features, a
    part-of-speech sequence, and the set detectors with an unused feature. A feature backs one signal only. The rule is
    greedy over the features of one pair, so it runs per row; pairs are independent and nothing is grouped.
    """

    def one(rows: list[dict], sa: list, sb: list, pa_: list, pb: list, set_score: float, grammar: float) -> tuple[int, list[str]]:
        rare = sorted((r for r in rows if r["is_rare"] and r["family"] in ("lemma", "root")), key=lambda r: (r["positions"], r["family"], r["value"]))
        if not rare:
            return 0, ["no_rare_evidence"]
        groups: dict[str, list] = {}
        for r in rare:
            groups.setdefault(r["positions"], []).append(r)
        first, *others = groups.values()
        used = {r["feature_id"] for r in first}
        kinds = []
        for g in others:
            kinds.append("second_distinct_rare")
            used |= {r["feature_id"] for r in g}
        family, primary = first[0]["family"], {r["value"] for r in first}
        rare_values = {r["value"] for r in rare if r["family"] == family}
        base = {r["value"]: r for r in rows if r["family"] == family}
        for r in sorted((r for r in rows if r["family"] == f"{family}_ngram"), key=lambda r: r["value"]):
            parts = r["value"].split(SEP)
            more = {base[v]["feature_id"] for v in parts if v not in rare_values and v in base and not base[v]["is_high"]}
            if primary & set(parts) and more - used:
                kinds.append("phrase_with_additional_material")
                used |= more
                break
        support = sorted((r for v, r in base.items() if v not in primary and not r["is_high"]), key=lambda r: (r["value"], r["feature_id"]))
        fresh = [r for r in support if r["feature_id"] not in used]
        if len(fresh) >= 2 and lcs(sa, sb) >= 3:
            kinds.append("ordered_sequence")
            used |= {r["feature_id"] for r in fresh[:2]}
        if grammar > 0.5 and min(len(pa_), len(pb)) >= 2 and lcs(pa_, pb) / min(len(pa_), len(pb)) > 0.5:
            own = [r for r in rows if r["family"] in ("part_of_speech", "morphology")]
            if any(r["feature_id"] not in used for r in own):
                kinds.append("grammar_sequence")
                used |= {r["feature_id"] for r in own}
        if set_score > 0 and any(r["feature_id"] not in used for r in support):
            kinds.append("set_overlap")
        return len(kinds), kinds

    def run(batches):
        for p in batches:
            got = [one(list(r.rows), list(r.seq_a), list(r.seq_b), list(r.pos_a), list(r.pos_b), r.set_score, r.grammar_score) for r in p.itertuples(index=False)]
            yield pd.DataFrame({"pair": p["pair"], "co_signals": [n for n, _ in got], "kinds": [k for _, k in got], "passed": [n > 0 or k == ["no_rare_evidence"] for n, k in got]})

    kind = evidence.schema["pair"].dataType.simpleString()
    return evidence.mapInPandas(run, f"pair {kind}, co_signals int, kinds array<string>, passed boolean")


def penalty_state(formulaic: Column, same_book: Column, distance: Column, shorter: Column, near: int = 5, short: int = 5) -> dict[str, Column]:
    """Which penalties a candidate bears: shared formulas, nearness in one book, a short passage."""
    return {"formulaic": F.coalesce(formulaic, F.lit(False)), "local": F.coalesce(same_book & (distance <= near), F.lit(False)), "short": F.coalesce(shorter <= short, F.lit(False))}


def ablation_scores(ranked: DataFrame, state: DataFrame, k: int = 60) -> DataFrame:
    """Adjusted fused score of every candidate in full and under each ablation: candidate, ablation, score.

    ranked(candidate, direction, detector, rank); state(candidate, formulaic, local, short). Fusion is per direction, the
    better one counts. One pass over the ranks serves all ablations by conditional sums.
    """
    names = {"full": ((), ()), **ABLATIONS}
    sums = [F.sum(F.when(~F.col("detector").isin(*gone) if gone else F.lit(True), 1.0 / (F.lit(k) + F.col("rank"))).otherwise(0.0)).alias(n) for n, (gone, _) in names.items()]
    best = ranked.groupBy("candidate", "direction").agg(*sums).groupBy("candidate").agg(*[F.max(n).alias(n) for n in names])
    j = best.join(state, "candidate")
    flag = lambda f, off: F.lit(False) if f in off else F.col(f)
    rows = [F.struct(F.lit(n).alias("ablation"), penalized(F.col(n), *[flag(f, off) for f in ("formulaic", "local", "short")]).alias("score")) for n, (_, off) in names.items()]
    return j.select("candidate", F.explode(F.array(*rows)).alias("x")).select("candidate", "x.*")


def ablation_ranks(scores: DataFrame, group: DataFrame) -> DataFrame:
    """Rank of each candidate within its corpus pair in full and under every ablation: ablation, candidate, before, after, changed."""
    s = scores.join(group.select("candidate", "corpus_pair"), "candidate").withColumn("score", F.round("score", 12))
    r = s.withColumn("r", F.row_number().over(Window.partitionBy("corpus_pair", "ablation").orderBy(F.desc("score"), "candidate")))
    full = r.filter("ablation = 'full'").select("candidate", F.col("r").alias("before"))
    return r.filter("ablation <> 'full'").join(full, "candidate").select("ablation", "candidate", "before", F.col("r").alias("after"), (F.col("before") != F.col("r")).alias("changed"))


def detector_rows(scores: DataFrame, detectors: list[str]) -> DataFrame:
    """Wide scores as one row for each candidate and detector, with a JSON trace of the row they come from."""
    trace = F.to_json(F.struct(*[F.col(d) for d in sorted(detectors)]))
    return scores.withColumn("trace", trace).unpivot(["candidate", "trace"], detectors, "detector", "score").select("candidate", "detector", "score", "trace")


def eligibility(rules: dict[str, Column]) -> Column:
    """The reasons against a candidate, joined by commas in the order given; empty where none holds."""
    return F.array_join(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull()), ",")


def review_queue(candidates: DataFrame, score: str = "score", ident: str = "candidate", slices: int = 1024) -> DataFrame:
    """All candidates ranked by (score downward, identifier): rank added.

    The ranks come from a distributed sort: slices by score range are numbered within and offset by their counts, so no
    task holds the whole queue.
    """
    lo_hi = candidates.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col(score)) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    c = candidates.crossJoin(F.broadcast(lo_hi)).withColumn("slice", F.least(F.lit(slices - 1), F.floor(width * slices)).cast("int")).drop("lo", "hi")
    sizes = c.groupBy("slice").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("slice").orderBy(F.desc(score), ident))
    return c.withColumn("own", own).join(F.broadcast(sizes.select("slice", before.alias("before"))), "slice").withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "slice")


def top_evidence(evidence: DataFrame, group: str, score: str, ident: str, k: int = 12) -> DataFrame:
    """The first k evidence rows of each pair for a report."""
    r = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), ident))
    return evidence.withColumn("rank", r).filter(F.col("rank") <= k)


def select_pairs(scored: DataFrame, required: DataFrame, n: int) -> DataFrame:
    """The n pairs of highest score and all required ones: pair, score, required."""
    top = scored.orderBy(F.desc("score"), "pair").limit(n).select("pair", "score")
    must = scored.join(required.select("pair").distinct(), "pair", "left_semi").select("pair", "score")
    need = required.select("pair", F.lit(True).alias("required")).distinct()
    return top.unionByName(must).distinct().join(need, "pair", "left").na.fill(False, ["required"])
