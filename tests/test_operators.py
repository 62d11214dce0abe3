"""Operators on small inputs: hand values, brute force, conservation and edge cases."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagelink.operators import benchmark as B
from passagelink.operators import candidates as C
from passagelink.operators import detectors as D
from passagelink.operators import ensemble as N
from passagelink.operators import evaluation as V
from passagelink.operators import evidence as E
from passagelink.operators import features as X
from passagelink.operators import nulls as U
from passagelink.operators import retrieval as R
from passagelink.operators import segment as S
from passagelink.operators import statistics as T
from passagelink.operators import streams as M
from passagelink.operators import validation as K
from passagelink.operators.dense import exact_knn
from passagelink.operators.graph import components
from passagelink.operators.references import orphan_counts, orphan_references, references


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- references


def _orphans(spark, refs, parents):
    r = spark.createDataFrame(refs, "rec string, fk string, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    p = spark.createDataFrame(parents, "id string, s string, e string").withColumn("s", F.col("s").cast("timestamp_ntz")).withColumn("e", F.col("e").cast("timestamp_ntz"))
    return orphan_references(references(r, "t", "rec", "fk", "at"), p, "id", "s", "e"), references(r, "t", "rec", "fk", "at")


def test_orphans(spark):
    parents = [("A", "2024-01-10", "2024-02-01"), (" a ", "2024-03-01", None), ("B", None, "2024-01-05"), ("C", None, None), ("A", "2024-01-10", "2024-02-01"), (None, None, None), ("D", "2024-05-02", "2024-05-01")]
    refs = [("1", "a", "2024-01-01"), ("2", "A ", "2024-01-10"), ("3", "A", "2024-02-01"), ("4", "a", "2024-03-01"), ("5", "b", "2024-01-05"), ("6", "zz", None), ("6", "zz", None), ("7", "c", None), ("8", None, "2024-01-01"), ("9", "  ", "2024-01-01"), ("10", "a", None), ("11", "d", "2024-05-03")]
    o, refs = _orphans(spark, refs, parents)
    assert {(r.record_id, r.ref_month, r.reason) for r in o.collect()} == {("1", "2024-01", "late"), ("3", "2024-02", "deleted"), ("5", "2024-01", "deleted"), ("6", "unknown", "missing"), ("11", "2024-05", "deleted")}
    assert o.count() == 5
    c = {(r.ref_month): r for r in orphan_counts(o, refs).collect()}
    assert c["unknown"].n_missing == 1 and c["unknown"].n_references == 3 and c["2024-03"].n_late == 0


def test_orphans_empty(spark):
    assert {r.reason for r in _orphans(spark, [("1", "a", "2024-01-01")], [])[0].collect()} == {"missing"}
    assert _orphans(spark, [], [("a", None, None)])[0].count() == 0


def test_orphans_against_brute_force(spark):
    rng = random.Random(3)
    day = lambda: f"2024-01-{rng.randrange(1, 28):02d} {rng.randrange(24):02d}:00:00"
    parents = [(f"k{rng.randrange(4)}", day() if rng.random() < 0.8 else None, day() if rng.random() < 0.6 else None) for _ in range(40)]
    refs = [(str(i), f"k{rng.randrange(6)}", day()) for i in range(200)]
    want = set()
    for r, k, t in refs:
        own = [(s or "0", e or "9") for i, s, e in parents if i == k]
        if not own:
            want.add((r, "missing"))
        elif t < min(s for s, _ in own):
            want.add((r, "late"))
        elif not any(s <= t < e for s, e in own):
            want.add((r, "deleted"))
    assert {(r.record_id, r.reason) for r in _orphans(spark, refs, parents)[0].collect()} == want


# --- features


def _occ(spark, docs):
    return spark.createDataFrame([(p, i, w) for p, ws in docs.items() for i, w in enumerate(ws, 1)], "pid string, pos int, feature string")


def test_ngrams_and_skipgrams(spark):
    s = spark.createDataFrame([(["a", "b", "c", "d"],), (["a"],), ([],)], "s array<string>")
    got = s.select(X.ngrams(F.col("s"), 2), X.ngrams(F.col("s"), 3), X.skipgrams(F.col("s"), 1), X.skipgrams(F.col("s"), 1, True)).collect()
    j = X.SEP.join
    assert list(got[0]) == [[j("ab"), j("bc"), j("cd")], [j("abc"), j("bcd")], [j("ac"), j("bd")], [j("ab"), j("bc"), j("cd"), j("ac"), j("bd")]]
    assert list(got[1]) == [[], [], [], []] == list(got[2])


def test_pmi_and_g2(spark):
    df = spark.createDataFrame([(2, 4, 5, 20)], "j int, a int, b int, n int")
    j, a, b, n = (F.col(c) for c in "jabn")
    assert df.select(X.pmi(j, [a, b], n)).collect()[0][0] == pytest.approx(1.0)
    assert df.select(X.pmi(F.lit(1), [a, b], n, 2)).collect()[0][0] == 0.0
    assert df.select(X.pmi(F.lit(20), [F.lit(1), F.lit(1)], n, 1, 3.0)).collect()[0][0] == 3.0
    o = [10.0, 5.0, 3.0, 30.0]
    e = [15 * 13 / 48, 15 * 35 / 48, 33 * 13 / 48, 33 * 35 / 48]
    want = 2 * sum(x * math.log(x / y) for x, y in zip(o, e))
    assert df.select(X.log_likelihood(*[F.lit(x) for x in o])).collect()[0][0] == pytest.approx(want)
    assert df.select(X.bigram_g2(F.lit(0), F.lit(10), F.lit(10), F.lit(100))).collect()[0][0] < 0


def test_vocabulary_counts_tokens_once(spark):
    occ = spark.createDataFrame([("p1", 1, "x", "t1"), ("p2", 1, "x", "t1"), ("p2", 2, "y", "t2")], "pid string, pos int, feature string, token string")
    p = spark.createDataFrame([("p1", "b", "g"), ("p2", "b", "g")], "pid string, book string, genre string")
    v = {r.feature: r for r in X.vocabulary(occ, p, token="token").collect()}
    assert (v["x"].corpus_frequency, v["x"].document_frequency, v["x"].book_frequency) == (1, 2, 1)
    assert v["x"].idf == pytest.approx(1.0)
    fine, clash = X.combine_vocabularies(spark.createDataFrame([("l", "x", 1)], "family string, feature string, n int"), spark.createDataFrame([("l", "x", 1), ("l", "y", 2), ("l", "y", 3)], "family string, feature string, n int"))
    assert rows(fine) == [("l", "x", 1)] and rows(clash) == [("l", "y")]


def test_formulaic_and_grammar(spark):
    docs = {f"p{i}": ["in", "the", "day", f"w{i}"] for i in range(6)} | {"q": ["all", "new", "words", "here"], "one": ["a"]}
    f = {r.pid: r for r in X.formulaic_passages(X.sequences(_occ(spark, docs)), min_count=5).collect()}
    assert f["p0"].is_formulaic and not f["q"].is_formulaic and f["one"].n_features == 0 and not f["one"].is_formulaic
    g = spark.createDataFrame([(["NOUN", None, "verb neg"], ["qatal"])], "p array<string>, m array<string>").select(X.grammar_features(F.col("p"), F.col("m"))).collect()[0][0]
    assert set(g) == {"pos:NOUN", "pos:verb neg", f"pos2:NOUN{X.SEP}verb neg", "morph:qatal", "marker:negation", "marker:perfective"}


def test_frequency_change(spark):
    a, b = _occ(spark, {"p": ["x", "x", "y"], "only": ["z"]}), _occ(spark, {"p": ["x", "y", "y", "y"]})
    assert rows(X.frequency_change(a, b)) == [("x", 2, 1, -1), ("y", 1, 3, 2)]


# --- detectors


@pytest.mark.parametrize("seed", range(4))
def test_sequence_detectors_against_plain_versions(seed):
    rng = random.Random(seed)
    a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 9))] for _ in range(2))

    def plain_lcs(x, y):
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, j in itertools.product(range(len(x)), range(len(y))):
            t[i + 1][j + 1] = t[i][j] + 1 if x[i] == y[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    def plain_edit(x, y):
        t = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            p, t = t, [i]
            for j, e in enumerate(y, 1):
                t.append(min(p[j] + 1, t[-1] + 1, p[j - 1] + (c != e)))
        return t[-1]

    assert D.lcs(a, b) == plain_lcs(a, b) == len(D.lcs_path(a, b))
    assert D.edit_distance(a, b) == plain_edit(a, b)
    assert D.global_alignment(a, a) == (1.0 if a else 0.0)
    assert 0 <= D.global_alignment(a, b) <= 1
    w = {c: 1.0 for c in "abcd"}
    assert D.local_alignment(a, a, w) == (1.0 if a else 0.0)


def test_set_detectors(spark):
    docs = {"a": ["x", "y", "y", "z"], "b": ["x", "y", "w"], "c": ["q"]}
    p = X.postings(_occ(spark, docs))
    assert rows(D.jaccard_pairs(p)) == [("a", "b", 2, 0.5)]
    assert rows(D.weighted_jaccard_pairs(p)) == [("a", "b", pytest.approx(2 / 5))]
    assert rows(D.count_cosine_pairs(p)) == [("a", "b", pytest.approx((1 + 2) / math.sqrt(6 * 3)))]
    r = rows(D.rare_pairs(p, 3))
    assert r == [("a", "b", 2, pytest.approx(1 / 2 + 1 / 3))]
    n = p.agg(F.count_distinct("pid").alias("n"))
    w = X.tfidf(p, n)
    norm = w.groupBy("pid").agg(F.sum(F.col("w") * F.col("w")).alias("s")).collect()
    assert all(x.s == pytest.approx(1) for x in norm)
    bm = {(x.q, x.t): x.score for x in D.bm25_pairs(p, n, X.bm25_idf).collect()}
    idf = math.log(1 + (3 - 2 + 0.5) / 2.5)
    part = lambda tf, ln: idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * ln / (8 / 3)))
    assert bm["b", "a"] == pytest.approx(part(1, 4) + part(2, 4)) and bm["a", "b"] == pytest.approx(2 * part(1, 3))
    e = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["b", "c"])], "x array<string>, y array<string>")
    assert [x[0] for x in e.select(D.jaccard(F.col("x"), F.col("y"))).collect()] == [0.0, 0.0, pytest.approx(1 / 3)]


def test_udfs_and_evidence(spark):
    df = spark.createDataFrame([(1, 2, ["a", "b", "c"], ["a", "c"])], "a int, b int, x array<string>, y array<string>")
    r = df.select(D.lcs_length("x", "y").alias("l"), D.token_edits("x", "y").alias("e"), D.lcs_positions("x", "y").alias("p"), E.multiset_jaccard("x", "y").alias("j"), E.count_cosine("x", "y").alias("c")).collect()[0]
    assert (r.l, r.e, [tuple(t) for t in r.p]) == (2, 1, [(1, 1), (3, 2)]) and r.j == pytest.approx(2 / 3) and r.c == pytest.approx(2 / math.sqrt(6))
    t = spark.createDataFrame([(1, 2, ["x", "y", "x"], ["t1", "t2", "t3"], ["x"], ["u1"])], "a int, b int, values_a array<string>, tokens_a array<string>, values_b array<string>, tokens_b array<string>")
    assert rows(E.matched_trace(t)) == [(1, 2, "x", [1, 3], ["t1", "t3"], [1], ["u1"])]
    s = spark.createDataFrame([(1, 2, ["event:go", "noun"], ["X", "Y"], [], ["event:go", "noun"], ["Y", "X"], [])], "a int, b int, frames_a array<string>, participants_a array<string>, entities_a array<string>, frames_b array<string>, participants_b array<string>, entities_b array<string>")
    x = E.structure_evidence(s).collect()[0]
    assert x.role_reversal and 0 < x.structure_score < 1
    v = E.encode(spark.createDataFrame([("a",), (None,)], "t string"), "t", lambda ts: [[3.0, 4.0]] * len(ts), 2).collect()
    assert v[0].vector == pytest.approx([0.6, 0.8]) and v[1].vector is None


# --- ranking


def test_fusion_hand_values(spark):
    r = spark.createDataFrame([("tfidf", "q", "a", 1), ("tfidf", "q", "b", 2), ("bm25", "q", "b", 1), ("bm25", "q", "a", 2), ("phrase", "q", "a", 1), ("phrase", "q", "b", 2)], "detector string, q string, t string, rank int")
    f = {x.t: x for x in R.fuse(r, 10, {"tfidf": "tf", "bm25": "tf"}, True).collect()}
    assert f["a"].score == pytest.approx(2 / 11) and f["a"].detectors == 2
    assert {x.t: x.score for x in R.fuse(r.filter("detector <> 'bm25'"), 10).collect()}["a"] == pytest.approx(2 / 11)


def test_top_k_order_and_penalties(spark):
    s = spark.createDataFrame([("q", "b", 0.5), ("q", "a", 0.5), ("q", "c", 0.9), ("q", "d", 0.0)], "q string, t string, score double")
    assert [(r.t, r.rank) for r in R.top_k(s, 2).orderBy("rank").collect()] == [("c", 1), ("a", 2)]
    x = s.limit(1).select(R.penalized(F.lit(1.0), F.lit(True), F.lit(True), F.lit(True)).alias("p")).collect()[0].p
    assert x == pytest.approx(0.5 * 0.5 * 0.25)
    assert R.pair_bound(10, 3) == 30 and R.pair_bound(4, 9) == 6 and R.pair_bound(1, 5) == 0
    assert R.scale_contract(10)["pairs"] > 0


def test_cosignals(spark):
    s = spark.createDataFrame([("c", "s1", "k1", "p", False, ["f1"], ["f0"]), ("c", "s2", "k1", "p", False, ["f2"], ["f0"]), ("c", "s3", "k2", "p", True, ["f3"], ["f0"]), ("c", "s4", "p", "p", False, ["f4"], ["f0"]), ("c", "s5", "k3", "p", False, ["f0"], ["f0"])], "candidate string, signal_id string, independence_key string, primary_key string, english boolean, feature_ids array<string>, primary_ids array<string>")
    assert rows(R.cosignals(s)) == [("c", "s1")]


def test_exact_knn(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((60, 8))
    v[7] = v[3]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(98, [0.0] * 8), (99, None)], "id bigint, v array<double>")
    got = {(r.q, r.rank): r.t for r in exact_knn(df, df, 3, 9).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -9)
    for q in range(60):
        best = sorted(range(60), key=lambda t: (-s[q, t], t))[:3]
        assert [got[q, k] for k in (1, 2, 3)] == best


# --- statistics


def test_bh_hand_values(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.002), (5, None)], "id int, p double")
    q = {r.id: r.q_value for r in T.benjamini_hochberg(df, "p", "id").collect()}
    assert [q[i] for i in (1, 2, 3, 4)] == pytest.approx([0.02, 0.04, 0.04, 0.008]) and q[5] is None


def test_null_counts_hand_values(spark):
    ob = spark.createDataFrame([(0.9,), (0.8,), (0.2,)], "score double")
    nu = spark.createDataFrame([(1, 0.7), (1, 0.1), (2, 0.9), (2, 0.85), (3, None)], "replicate int, score double")
    r = T.null_counts(ob, nu, spark.createDataFrame([(0.8,)], "t double")).collect()[0]
    assert (r.observed, r.mean_null, r.enrichment, r.tail, r.fdr) == (2, pytest.approx(2 / 3), pytest.approx(3), 0.5, pytest.approx(1 / 3))


def test_midrank_mad_auroc_bootstrap(spark):
    df = spark.createDataFrame([("g", x) for x in (1.0, 2.0, 2.0, 4.0)], "g string, v double")
    assert sorted({(r.v, r.percentile) for r in T.midrank(df, "v", ["g"]).collect()}) == [(1.0, 0.125), (2.0, 0.5), (4.0, 0.875)]
    m = T.mad(df, "v", ["g"]).collect()[0]
    assert (m.median, m.mad) == (2.0, 0.5)
    s = spark.createDataFrame([("g", 0.9, True), ("g", 0.5, True), ("g", 0.5, False), ("g", 0.1, False)], "g string, score double, positive boolean")
    assert T.auroc(s, ["g"]).collect()[0].auroc == pytest.approx((2 + 1.5) / 4)
    d = spark.createDataFrame([("g", float(i % 5), 1.0) for i in range(50)], "g string, a double, b double")
    r = T.paired_bootstrap(d, "a", "b", ["g"], 300, 3).collect()[0]
    assert r.mean == pytest.approx(1.0) and r.low < r.mean < r.high
    assert T.paired_bootstrap(d.repartition(7), "a", "b", ["g"], 300, 3).collect()[0] == r
    assert len(T.mersenne_bootstrap([1.0, 2.0], 5, 1)) == 5
    c = spark.createDataFrame([("x", 0.1, 0.5), ("x", 0.2, 0.1), ("y", 0.1, 0.1), ("y", 0.2, 0.3)], "family string, t double, fdr double")
    assert T.select_threshold(c, 2, 0.3).collect()[0].threshold == 0.2
    assert T.select_threshold(c, 3, 0.3).collect()[0].threshold == float("inf")


# --- nulls


def test_reassignment_and_synthetic(spark):
    rng = random.Random(2)
    o = spark.createDataFrame([("g", f"b{p % 2}", f"p{p}", i, rng.choice("uvwxyz")) for p in range(8) for i in range(1, rng.randrange(3, 9))], "genre string, book string, pid string, pos int, feature string")
    reps = spark.createDataFrame([(1,), (2,)], "replicate int")
    r = U.reassign_within_book(o, 5, reps)
    assert r.count() == 2 * o.count() and U.reassignment_violations(o, r).isEmpty()
    assert not r.filter("replicate = 1").drop("replicate", "book").exceptAll(o.drop("genre", "book")).isEmpty()
    assert rows(r) == rows(U.reassign_within_book(o.repartition(5), 5, reps))
    s = U.synthetic(o, 5, reps, 10)
    assert all(x.lengths_kept for x in U.synthetic_deviation(o, s).collect())
    broken = r.withColumn("feature", F.lit("zz"))
    assert not U.reassignment_violations(o, broken).isEmpty()


def test_detector_nulls(spark):
    s = spark.createDataFrame([("d", "s", "perm", i, float(i)) for i in range(50)], "detector string, stratum string, null_family string, pair bigint, score double")
    p = {r.pair: r.p_value for r in U.detector_nulls(s, 400, {"perm": 1}).collect()}
    assert p[49] < p[25] < p[0] == 1.0 and p[49] == pytest.approx(1 / 50, abs=0.02)
    assert {r.pair: r.p_value for r in U.detector_nulls(s.repartition(7), 400, {"perm": 1}).collect()} == p
    g = spark.createDataFrame([("s", i, i / 40, (i % 7) / 7) for i in range(40)], "stratum string, pair bigint, x double, y double")
    e = {r.t: r for r in U.ensemble_null(g, {"x": 1.0, "y": 1.0}, 50, 1, spark.createDataFrame([(0.2,), (0.9,)], "t double")).collect()}
    assert e[0.2].monotone_fdr >= e[0.9].monotone_fdr or e[0.2].monotone_fdr >= e[0.2].fdr


# --- evaluation


def test_metrics_hand_values(spark):
    ranked = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 2), ("q2", "x", 1), ("q2", "c", 2)], "q string, t string, rank int")
    rel = spark.createDataFrame([("q1", "a"), ("q2", "c"), ("q2", "c")], "q string, t string")
    qs = spark.createDataFrame([("q1", "h"), ("q2", "h"), ("q3", "g")], "q string, genre string")
    m = V.query_metrics(ranked, rel, qs)
    s = V.summarize(m).collect()[0]
    assert (s.recall_5, s.reciprocal_rank, s.precision_10, s.n_evaluated) == (1.0, 0.75, 0.1, 2)
    assert s.coverage == pytest.approx(2 / 3, abs=1e-8) and s.ndcg_20 == pytest.approx((1 + 1 / math.log2(3)) / 2, abs=1e-8)
    strata = spark.createDataFrame([("genre", "h"), ("genre", "none")], "dimension string, value string")
    assert {r.value: r.n_queries for r in V.summarize_strata(m, ["genre"], strata).collect()} == {"h": 2, "none": 0}


def test_expand_queries_and_controls(spark):
    links = spark.createDataFrame([("r", ["a", "b"], ["a"]), ("s", [], ["c"])], "relationship string, sources_a array<string>, sources_b array<string>")
    got = {(r.relationship, r.direction, r.q): (r.relevant, r.exclusion) for r in V.expand_queries(links).collect()}
    assert got["r", "a_to_b", "a"] == (None, "self_only") and got["r", "a_to_b", "b"] == (["a"], None) and got["r", "b_to_a", "a"] == (["b"], None) and got["s", "a_to_b", None][1] == "no_source"
    p = spark.createDataFrame([("a", "g", "b1", 5), ("b", "g", "b2", 5), ("c", "g", "b1", 5), ("d", "g", "b1", 9)], "pid string, genre string, book string, len int")
    c = p.filter("pid = 'a'").withColumn("control", F.lit("k"))
    assert V.matched_negatives(c, p, 1).collect()[0].negative == "c"
    with pytest.raises(Exception, match="limit"):
        V.candidate_universe(spark.createDataFrame([("q", "a"), ("q", "b")], "q string, t string"), 1).collect()


# --- benchmark


def test_overlap_groups(spark):
    i = [("b", 1, 3, "x"), ("b", 2, 5, "y"), ("b", 200, 201, "z"), ("c", 2, 2, "w"), ("b", 1, 300, "v")]
    got = {(r.book, r["at"], r.member) for r in B.overlap_groups(spark.createDataFrame(i, "book string, start int, end int, member string")).collect()}
    want = set()
    for bk, s, _, _ in i:
        act = {m for b2, s2, e2, m in i if b2 == bk and s2 <= s <= e2}
        want |= {(bk, s, m) for m in act} if len(act) > 1 else set()
    assert got == want


def test_components_and_conflicts(spark):
    chain = spark.createDataFrame([(f"r{i:03d}", f"k{i}") for i in range(60)] + [(f"r{i + 1:03d}", f"k{i}") for i in range(59)] + [("z", None)], "id string, k string")
    c = dict(rows(components(chain, "id", ["k"])))
    assert set(c.values()) == {"r000", "z"} and len(c) == 61
    a = spark.createDataFrame([("x", "train", None), ("y", "test", None), ("w", "train", None)], "relationship string, partition string, reason string")
    g = spark.createDataFrame([("t", "1", "x"), ("t", "1", "y"), ("t", "2", "x"), ("t", "2", "w")], "group_type string, group_id string, relationship string")
    out = dict((r.relationship, r.partition) for r in B.exclude_conflicts(a, g, ("t",)).collect())
    assert out == {"x": "excluded", "y": "excluded", "w": "train"}
    assert rows(V.partition_violations(a, g)) == [("t", "1", 2, 2)]


def test_presumed_negatives_contract(spark):
    p = spark.createDataFrame([(f"p{i}", f"b{i % 2}", "g", 10 + i % 4, i, "train" if i < 16 else "test") for i in range(20)], "pid string, book string, genre string, len int, ordinal int, partition string")
    t = spark.createDataFrame([(f"t{i}", f"p{i}", f"p{i + 1}") for i in range(6)], "template string, a string, b string")
    k, o = t.select("a", "b"), spark.createDataFrame([("p0", "p2")], "a string, b string")
    for strategy in B.NEGATIVE_STRATEGIES:
        n = B.presumed_negatives(p, t, k, o, strategy, 3).collect()
        pairs = {(r.a, r.b) for r in n}
        assert n and len(pairs) == len(n) and not pairs & ({(r.a, r.b) for r in k.collect()} | {("p0", "p2")})
        part = {r.pid: r.partition for r in p.collect()}
        assert all(part[r.a] == part[r.b] for r in n)


def test_split_cycle_and_hash(spark):
    g = spark.createDataFrame([(f"g{i}",) for i in range(50)], "g string")
    n = {r.split: r["count"] for r in B.split_cycle(g, "g", "s", {"train": 3, "test": 2}).groupBy("split").count().collect()}
    assert n == {"train": 30, "test": 20}


# --- candidates and ensemble


def test_rare_rule(spark):
    r = lambda fam, v, pos, rare, high=False: (fam, v, f"{fam}:{v}", pos, rare, high)
    kind = "pair string, rows array<struct<family:string,value:string,feature_id:string,positions:string,is_rare:boolean,is_high:boolean>>, seq_a array<string>, seq_b array<string>, pos_a array<string>, pos_b array<string>, set_score double, grammar_score double"
    data = [
        ("none", [], ["a"], ["a"], [], [], 0.0, 0.0),
        ("alone", [r("lemma", "x", "1;1", True), r("root", "x", "1;1", True)], ["x"], ["x"], [], [], 1.0, 0.0),
        ("two", [r("lemma", "x", "1;1", True), r("lemma", "y", "2;2", True)], ["x", "y"], ["x", "y"], [], [], 0.0, 0.0),
        ("phrase", [r("lemma", "x", "1;1", True), r("lemma", "z", "2;2", False), r("lemma_ngram", f"x{C.SEP}z", "1;1", False)], ["x", "z"], ["x", "z"], [], [], 1.0, 0.0),
    ]
    got = {x.pair: (x.co_signals, x.passed) for x in C.rare_rule(spark.createDataFrame(data, kind)).collect()}
    assert got == {"none": (0, True), "alone": (0, False), "two": (1, True), "phrase": (1, True)}


def test_review_queue_and_reasons(spark):
    df = spark.createDataFrame([(f"c{i:02d}", float(i % 5)) for i in range(30)], "candidate string, score double")
    want = [x.candidate for x in df.orderBy(F.desc("score"), "candidate").collect()]
    assert [x.candidate for x in C.review_queue(df).orderBy("rank").collect()] == want
    assert C.review_queue(df.limit(0)).count() == 0
    x = df.limit(1).select(C.eligibility({"a": F.lit(True), "b": F.lit(False), "c": F.lit(True)}).alias("r")).collect()[0].r
    assert x == "a,c"


def test_tiers_and_reconcile(spark):
    rows_ = [("p1", 0.9, 0.9, 0.1, 0.01, 3, False, False, False), ("p2", 0.9, 0.1, 0.1, 0.01, 3, False, False, False), ("p3", 0.95, 0.9, 0.1, 0.01, 3, True, False, False), ("p4", 0.2, 0.2, 1.0, 1.0, 1, False, True, False), ("p5", 0.3, 0.3, 1.0, 1.0, 1, False, False, True)]
    t = {r.pair: (r.tier, r.rank_b) for r in N.tiers(spark.createDataFrame(rows_, "pair string, score double, ablated_score double, fdr double, q_value double, n_families int, known boolean, excluded boolean, flagged boolean"), size_b=1).collect()}
    assert t == {"p1": ("A", None), "p2": ("B", 1), "p3": ("none", None), "p4": ("none", None), "p5": ("none", None)}
    s = spark.createDataFrame([("a", "known"), ("a", "unknown"), ("b", "unknown"), ("c", "odd")], "pair string, status string")
    assert dict(rows(N.reconcile(s))) == {"a": "conflict", "b": "unknown", "c": "unresolved"}


# --- streams, segmentation, validation


def test_reading_and_nearest(spark):
    t = spark.createDataFrame([(1, "v1", None, "g", "ketiv", "k"), (2, "v1", None, "g", "qere", "q"), (3, "v1", "c", None, None, "x"), (4, "v2", "c", "h", "ketiv", "only"), (5, "v2", "c", None, None, "y")], "position int, verse string, clause_id string, variant_group_id string, variant_type string, token_id string")
    got = {r.token_id: (r.verse_position, r.clause_position, r.stream_position) for r in M.select_reading(t, "qere").collect()}
    assert got == {"q": (1, None, 1), "x": (2, 1, 2), "only": (1, 2, 3), "y": (2, 3, 4)}
    e = spark.createDataFrame([("u", 1, "a"), ("u", 2, None), ("u", 3, "a"), ("u", 4, None), ("u", 5, "b")], "u string, o int, v string")
    n = {r.o: (r.before, r.after, r.agreed) for r in M.nearest_both_sides(e, "u", "o", "v").collect()}
    assert n[2] == ("a", "a", "a") and n[4] == ("a", "b", None) and n[1][0] is None
    with pytest.raises(Exception, match="repeated key"):
        M.unique_or_fail(spark.createDataFrame([(1,), (1,)], "k int"), ["k"], "t").collect()


def test_edges_windows(spark):
    v = spark.createDataFrame([("b", f"p{i}", f"B {c}:{n}", c, n, o) for i, (c, n, o) in enumerate([(1, 1, 1), (1, 2, 2), (1, 4, 3), (2, 1, 4), (2, 2, 6)])], "book string, passage_id string, reference string, chapter int, verse int, ordinal int")
    e = S.verse_edges(v, ["book"], "ordinal", F.col("chapter"), F.col("verse"), spark.createDataFrame([("B 1:1", "B 1:2", "break")], "reference_from string, reference_to string, relation string"))
    assert [(r.relation, r.continuous) for r in e.orderBy("o1").collect()] == [("break", False), ("reference_gap", True), ("chapter_transition", True), ("profile_exclusion", False)]
    w = S.windows(v, e, ["book"], "ordinal", 2)
    assert sorted(r.first_id for r in w.collect()) == ["p1", "p2"]
    assert rows(S.window_edges(w, ["book"])) == [("b", "p1", "p2")]


def test_mapping(spark):
    v = spark.createDataFrame([(p, "B", a, f"{p}{a}", False, False) for p, at in (("edition_complete", (1001, 1002, 1004)), ("critical_core", (1001,))) for a in at], "profile string, book string, at int, passage_id string, reference_gap boolean, disputed boolean")
    ep = spark.createDataFrame([("one", "B", 1002, 1002, False), ("range", "B", 1001, 1002, True), ("holes", "B", 1001, 1004, True), ("no", "B", 9001, 9001, False), ("bad", None, None, None, False)], "endpoint_id string, book string, lo int, hi int, is_range boolean")
    got = {(r.endpoint_id, r.profile): r.status for r in M.map_endpoints(ep, v).collect()}
    assert got["one", "edition_complete"] == "mapped_provisional" and got["one", "critical_core"] == "excluded_by_profile"
    assert got["range", "edition_complete"] == "mapped_provisional" and got["range", "critical_core"] == "mapped_partial"
    assert got["holes", "edition_complete"] == "mapped_partial" and got["no", "edition_complete"] == "unresolved_missing_target" and got["bad", "critical_core"] == "unresolved_reference"


def test_validation(spark):
    m = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 3)], "k string, p int")
    assert [r.k for r in K.broken_positions(m, "k", "p").collect()] == ["b"]
    assert K.repeated(m, ["k"]).count() == 2 and K.dangling(m, "k", m.filter("k = 'a'"), "k").count() == 2
    r = spark.createDataFrame([(0.125, 0.12), (0.135, 0.14), (0.5, 0.4), (None, None)], "x double, y double")
    assert K.misrounded(r, "x", "y", 2).count() == 1
    assert K.differences(m, m.limit(3)).count() == 1
    n = spark.createDataFrame([("s", 0.1, 5, 1.0, 0.2), ("s", 0.2, 7, 0.5, 0.1)], "scope string, t double, observed int, mean_null double, fdr double")
    assert {k: df.count() for k, df in K.null_table_checks(n).items()} == {"fdr_range": 0, "counts_range": 0, "observed_monotone": 1}
    assert K.review_records(spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a", "yes", 1), ("a", "no", 2)], "k string, decision string, decided_at int"), "k").orderBy("k").collect()[0].decision == "no"
