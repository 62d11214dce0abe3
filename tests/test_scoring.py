"""Scores, proposals and reranking against brute force over all features."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from passagelink.operators import detectors as D
from passagelink.operators import features as X
from passagelink.operators import scoring as S


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    t = {k: ["the"] * rng.randrange(1, 4) + [rng.choice(words) for _ in range(rng.randrange(1, 25))] for k in range(40)}
    t[41], t[42] = list(t[0]), ["the", "only"]
    return t


def _post(spark, texts):
    rows = [(k, w, n) for k, t in texts.items() for w, n in Counter(t).items()]
    return spark.createDataFrame(rows, "pid int, feature string, tf bigint")


def _plain(texts, q, t):
    n = len(texts)
    df = Counter(w for x in texts.values() for w in set(x))
    cf = Counter(w for x in texts.values() for w in x)
    idf = lambda w: math.log((1 + n) / (1 + df[w])) + 1
    a, b = Counter(texts[q]), Counter(texts[t])
    both = a.keys() & b.keys()
    unit = lambda c: math.sqrt(sum(((1 + math.log(x)) * idf(w)) ** 2 for w, x in c.items()))
    mean = sum(map(len, texts.values())) / n
    bm = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * len(texts[t]) / mean)) for w in both)
    return {
        "overlap": len(both), "jaccard": len(both) / len(a.keys() | b.keys()), "bm25": bm, "rare": sum(1 / cf[w] for w in both if cf[w] <= 3),
        "tfidf": sum((1 + math.log(a[w])) * (1 + math.log(b[w])) * idf(w) ** 2 for w in both) / unit(a) / unit(b),
        "count_cosine": sum(a[w] * b[w] for w in both) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())),
        "weighted_jaccard": sum(idf(w) * min(a[w], b[w]) for w in both) / sum(idf(w) * max(a[w], b[w]) for w in a.keys() | b.keys()),
    }


def test_scores_over_all_features(spark, texts):
    p = _post(spark, texts)
    n = p.agg(F.count_distinct("pid").alias("n"))
    prof = S.profiles(p, n)
    queries = spark.createDataFrame([(0,), (7,), (0,), (42,)], "pid int")
    got = {(r.q, r.t): r.asDict() for r in S.scores(prof, queries).collect()}
    assert got.keys() == {(q, t) for q in (0, 7, 42) for t in texts if t != q}  # all share a word
    for (q, t), r in got.items():
        for k, v in _plain(texts, q, t).items():
            assert math.isclose(r[k], v, abs_tol=1e-9), (q, t, k)
    some = spark.createDataFrame([(0, 41), (7, 3)], "q int, t int")
    part = {(r.q, r.t): r.asDict() for r in S.scores(prof, queries, pairs=some).collect()}
    assert part == {k: pytest.approx(got[k]) for k in ((0, 41), (7, 3))}
    # proposals leave out the word of all texts; what they propose is scored over all words
    up = S.propose(prof, queries, n, 5, 0.5)
    assert max(Counter(r.q for r in up.collect()).values()) <= 5 and (42, 1) not in {(r.q, r.t) for r in up.collect()}
    assert S.scores(prof.limit(0), queries).count() == 0


def test_rerank(spark, texts):
    p = _post(spark, texts)
    n = p.agg(F.count_distinct("pid").alias("n"))
    prof = S.profiles(p, n)
    seqs = spark.createDataFrame(list(texts.items()), "pid int, seq array<string>")
    sc = S.scores(prof, spark.createDataFrame([(0,)], "pid int")).withColumn("phrase", F.lit(None).cast("double"))
    ranked, best = S.rerank(sc, seqs, [F.transform("seq", lambda w: F.length(w).cast("string"))], prof.groupBy("feature").agg(F.first("idf").alias("idf")), align=4, keep=3)
    r = ranked.collect()
    lcs = {x.t: x.score for x in r if x.detector == "lcs"}
    assert lcs == {t: pytest.approx(v) for t in texts if t and (v := round(D.lcs(texts[0], texts[t]) / min(len(texts[0]), len(texts[t])), 9)) > 0}
    assert sum(x.detector == "alignment" for x in r) == 4 and not any(x.detector == "phrase" for x in r)
    assert [x.t for x in best.orderBy("rank").collect()][0] == 41 and best.count() == 3
    assert {x.families for x in best.collect()} <= set(range(1, 7))


def test_null_experiment(spark, texts):
    from passagelink.operators import nulls as U

    p = _post(spark, texts)
    n = p.agg(F.count_distinct("pid").alias("n"))
    stats = S.profiles(p, n).groupBy("feature").agg(F.first("idf").alias("idf"), F.first("cf").alias("cf"))
    occ = spark.createDataFrame([(r, k, w) for r in (1, 2) for k, t in texts.items() for w in (t if r == 1 else t[::2])], "replicate int, pid int, feature string")
    pairs = spark.createDataFrame([(0, 41), (3, 7), (5, 42)], "a int, b int")
    got = {(r.replicate, r.a, r.b): r.asDict() for r in U.replicate_scores(occ, pairs, stats).collect()}
    assert len(got) == 6
    for a, b in ((0, 41), (3, 7), (5, 42)):
        want = _plain(texts, a, b)
        for k in U.SCORED:
            assert math.isclose(got[1, a, b][k], want[k], abs_tol=1e-9), k
    # thresholds by hand: 4 observed pairs, two families of two replicates
    obs = spark.createDataFrame([(k, k + 10, "d", x) for k, x in enumerate((0.1, 0.5, 0.5, 0.9))], "a int, b int, detector string, score double")
    nulls = spark.createDataFrame([(f, r, "d", x) for f in "xy" for r in (1, 2) for x in (0.1, 0.2, 0.3, 0.5 if f == "y" and r == 2 else 0.0)], "family string, replicate int, detector string, score double")
    grid = spark.createDataFrame([(0.1,), (0.5,), (0.95,)], "t double")
    counts = U.replicate_counts(nulls, grid)
    assert counts.count() == 12 and {r.k for r in counts.filter("t = 0.95").collect()} == {0}
    c = {(r.family, r.t): r for r in U.calibrate_grid(obs, counts, grid, 0.2).collect()}
    assert (c["x", 0.5].mean_null, c["x", 0.5].fdr, c["y", 0.5].mean_null, c["y", 0.5].observed) == (0.0, 0.0, 0.5, 3)
    assert c["y", 0.5].fdr == pytest.approx(1 / 6) and c["y", 0.95].fdr is None and c["x", 0.1].tail == pytest.approx(1 / 3)
    assert [k for k, r in sorted(c.items()) if r.selected] == [("x", 0.5), ("y", 0.5)]
    ps = {(r.a, r.score): r.p for r in U.null_p_values(obs, nulls).collect()}
    assert ps == {(0, 0.1): pytest.approx(14 / 17), (1, 0.5): pytest.approx(2 / 17), (2, 0.5): pytest.approx(2 / 17), (3, 0.9): pytest.approx(1 / 17)}
