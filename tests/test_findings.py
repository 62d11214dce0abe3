"""Cases of the review of round 2: odd inputs and sizes that queries got wrong."""

import random
from collections import Counter

import __spark_entry__ as entry
import numpy as np
import pytest
from pyspark.sql import functions as F

from passagelink.llm import splits, vectors
from passagelink.operators import detectors as D
from passagelink.operators import nulls as U
from passagelink.operators import scoring as S
from tests import harness


def _folder(spark, where, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{where}/{name}.parquet")
    return str(where)


def test_pair_evidence_without_detectors(spark, tmp_path):
    """A pair whose evidence names no detector has null as its detectors; an empty name is a name."""
    evidence = [("p", "1", None), ("q", "2", "b"), ("q", "3", "a"), ("q", "4", None), ("q", "5", "b"), ("r", "6", ""), (None, "7", "a")]
    d = _folder(
        spark, tmp_path, candidate_pairs=([("p",), ("q",), ("r",), ("s",), (None,)], "candidate_pair_id string"),
        evidence_identity=(evidence, "candidate_pair_id string, evidence_id string, detector_id string"),
    )
    got = {tuple(r) for r in entry.queries()["pair_evidence"](spark, d).collect()}
    assert got == {("p", 1, None), ("q", 4, "a,b"), ("r", 1, "")}
    c = harness.duckdb.connect()
    for t in ("candidate_pairs", "evidence_identity"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    assert got == set(c.execute(entry.oracle_sql()["pair_evidence"]).fetchall())


def test_splits_do_not_depend_on_kinds(spark, monkeypatch):
    """The same components go to the same splits however many kinds of label vectors there are; every label keeps its shares."""
    rng = random.Random(3)
    rows = spark.createDataFrame([(f"c{i:04d}", f"g{rng.randrange(700)}", rng.choice("xxxyyz")) for i in range(3000)], "control_id string, g string, label string")
    comp = splits.components(rows, "control_id", ["g"])
    shares = {"train": 0.8, "development": 0.1, "test": 0.1}
    one = sorted(tuple(r) for r in splits.assign_splits(rows, comp, "control_id", "label", shares).collect())
    monkeypatch.setattr(splits, "KINDS", 3)
    assert one == sorted(tuple(r) for r in splits.assign_splits(rows.repartition(5), comp, "control_id", "label", shares).collect())
    label = {r.control_id: r.label for r in rows.collect()}
    assert len(one) == 3000 and len({c for _, c, _ in one}) == len({(c, s) for _, c, s in one})
    for k in "xyz":
        got = [s for i, _, s in one if label[i] == k]
        for s, x in shares.items():
            assert abs(got.count(s) / len(got) - x) < 0.02, (k, s)


def _postings(spark):
    """Postings of 90 texts of common and rare words, among them copies, so that scores tie, and one without identifier."""
    rng = random.Random(8)
    texts = {k: [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))] + ["z"] * (k % 3) + [f"r{rng.randrange(60)}"] for k in range(80)}
    texts |= {80 + k: texts[k] for k in range(10)} | {None: ["a", "b", "r1"]}
    return spark.createDataFrame([(k, w, t.count(w)) for k, t in texts.items() for w in sorted(set(t))], "pid bigint, feature string, tf bigint")


SCORES = ("overlap", "jaccard", "weighted_jaccard", "tfidf", "count_cosine", "bm25", "rare")


@pytest.mark.parametrize("ratio", [None, 0.3])
def test_best_partners_by_blocks(spark, ratio, monkeypatch):
    """Blocks of few passages and queries give what a row for every pair gives, without such rows."""
    post, asks = _postings(spark), F.col("pid") % 3 == 0
    n = post.agg(F.count_distinct("pid").alias("n"))
    prof = S.profiles(post, n)
    full = S.scores(prof, post.filter(asks), F.lit(True) if ratio is None else F.col("df") <= 90 * ratio)
    want = {(r.detector, r.q, r.rank): (r.t, r.score) for r in S.rank_by(full, SCORES, 4).collect()}
    assert len(want) > 250
    monkeypatch.setattr(S, "scores", None)
    for blocks in ({}, {"passages": 7, "queries": 5}):
        got = {(r.detector, r.q, r.rank): (r.t, r.score) for r in S.best_partners(post, asks, SCORES, 4, ratio=ratio, **blocks).collect()}
        assert got.keys() == want.keys()
        assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=2e-9) for k in want)
    assert S.best_partners(post.limit(0), asks, SCORES, 4).count() == 0


def test_top_queries_make_no_row_for_a_pair(spark, data, monkeypatch):
    """The queries that took a row for every pair of a query and a document don't build it any more."""
    monkeypatch.setattr(S, "scores", None)
    for name in ("jaccard_topk", "bm25_topk", "overlap_topk", "candidate_union", "directional_merge", "rrf_best_family"):
        assert entry.queries()[name](spark, data).count() > 0


def test_permutation_by_places():
    """One-to-one for every size, different by key, and all orders of three come up about equally often."""
    for size in (1, 2, 3, 4, 5, 16, 17, 1000, 4097):
        at = np.arange(size)
        one, two = (U.permuted(np.full(size, k), at, np.full(size, size)) for k in (7, -8))
        assert sorted(one) == sorted(two) == at.tolist() and (size < 1000 or (one != two).mean() > 0.9)
    key = np.repeat(np.arange(6000) * 977, 3)
    seen = Counter(map(tuple, U.permuted(key, np.tile(np.arange(3), 6000), np.full(18000, 3)).reshape(-1, 3)))
    assert len(seen) == 6 and all(800 < n < 1200 for n in seen.values())


def test_replicates_of_some_passages(spark):
    """Replicates of some passages hold what the whole ones hold for them, and nothing else is drawn."""
    rng = random.Random(2)
    occ = spark.createDataFrame([("g", f"b{p % 2}", p, i, rng.choice("uvwxyz")) for p in range(12) for i in range(1, rng.randrange(3, 9))], "genre string, book string, pid int, pos int, feature string")
    reps, only = spark.createDataFrame([(1,), (2,)], "replicate int"), spark.createDataFrame([(0,), (3,), (3,)], "pid int")
    for draw in (U.reassign_within_book, lambda o, s, r, only=None: U.synthetic(o, s, r, 10, only)):
        whole, part = draw(occ, 5, reps), draw(occ, 5, reps, only)
        assert sorted(map(tuple, part.collect())) == sorted(map(tuple, whole.filter("pid in (0, 3)").collect()))
        assert whole.count() == 2 * occ.count() and part.count() == 2 * occ.filter("pid in (0, 3)").count()


@pytest.mark.parametrize("head, passages", [(3, None), (40, 9)])
def test_best_partners_with_joined_features(spark, head, passages):
    """A passage is one row; features beyond the numbered ones are joined, counts above 255 and null identifiers stay exact."""
    post = _postings(spark).withColumn("tf", F.when(F.expr("pid = 5 and feature = 'z'"), F.lit(70_000)).when(F.expr("pid = 6 and feature like 'r%'"), F.lit(300)).otherwise(F.col("tf")).cast("bigint"))
    asks = F.col("pid") % 3 == 0
    full = S.scores(S.profiles(post, post.agg(F.count_distinct("pid").alias("n"))), post.filter(asks))
    want = {(r.detector, r.q, r.rank): (r.t, r.score) for r in S.rank_by(full, SCORES, 4).collect()}
    bags = post.groupBy("pid").agg(F.collect_list("feature").alias("words"), F.collect_list("tf").alias("tfs"))
    assert sorted(map(repr, S.unpacked(bags).collect())) == sorted(map(repr, post.collect()))
    got = {(r.detector, r.q, r.rank): (r.t, r.score) for r in S.best_partners(bags, asks, SCORES, 4, head=head, passages=passages).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=2e-9) for k in want)


def test_texts_of_one_identifier_are_one_document(spark, tmp_path):
    from passagelink.queries import lexical as L

    rows = [(1, "a b A"), (1, "b c"), (2, "1 2"), (3, None), (None, "c"), (None, "c d"), (4, "d")]
    d = _folder(spark, tmp_path, documents=(rows, "doc_id bigint, text string"))
    assert {(r.pid, r.feature, r.tf) for r in S.unpacked(L.bags(spark, d)).collect()} == {(r.pid, r.feature, r.tf) for r in L.post(spark, d).collect()}
    assert {r.pid: len(r.words) for r in L.bags(spark, d).collect()} == {1: 3, None: 2, 4: 1}


def test_draws_in_slices(spark, monkeypatch):
    """Sources dealt to many tasks draw what one task draws; every place gets a feature of its source, in about its share."""
    rng = random.Random(4)
    rows = [(f"g{p % 3}", f"b{p % 3}{p % 2}", p, i, rng.choice("uuuvwx") + str(p % 3)) for p in range(400) for i in range(1, rng.randrange(3, 30))]
    rows += [("g0", "few", 1000, 1, "only0"), ("g0", "few", None, 7, "u0")]
    occ = spark.createDataFrame(rows, "genre string, book string, pid int, pos int, feature string")
    reps = spark.createDataFrame([(1,), (2,)], "replicate int")
    one = sorted(map(repr, U.synthetic(occ, 5, reps, 100).collect()))
    monkeypatch.setattr(U, "SLICE", 50)
    got = U.synthetic(occ.repartition(7), 5, reps, 100).collect()
    assert one == sorted(map(repr, got))
    assert Counter((r.book, r.pid, r.pos) for r in got) == Counter({(b, p, i): 2 for _, b, p, i, _ in rows})
    of = {(b, p): g for g, b, p, _, _ in rows}
    assert all(r.feature[-1] == of[r.book, r.pid][-1] for r in got)
    share = Counter(r.feature[0] for r in got)
    assert abs(share["u"] / len(got) - 0.5) < 0.03 and len({r.feature for r in got if r.replicate == 1}) >= 12


def test_nearest_in_a_table_of_many_windows(spark):
    """Groups of near vectors are found among many others, where a window is a small part of the table."""
    rng = np.random.default_rng(6)
    near = np.repeat(rng.standard_normal((200, 64)), 5, 0) + 0.45 * rng.standard_normal((1000, 64))
    v = np.concatenate([near, rng.standard_normal((7000, 64))]).astype(np.float32)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T - 2 * np.eye(len(v), dtype=np.float32)
    want = {(q, t) for q, t in np.argwhere(s >= 0.8).tolist()}
    assert len(want) > 2000 and max(Counter(q for q, _ in want).values()) <= 5
    rows = spark.createDataFrame([(str(k), r) for k, r in enumerate(v.tolist())], "id string, v array<float>").withColumn("t", F.current_timestamp())
    got = {(int(r.query_id), int(r.target_id)) for r in vectors.nearest(rows, 5, 64, 0.8, window=200, tile=40).collect()}
    assert len(got & want) >= 0.95 * len(want)


@pytest.mark.parametrize("head", [3, 40])
def test_given_pairs_by_cells(spark, head):
    """Given pairs get the scores of a join of postings, features beyond the numbered ones included, without such a join."""
    post = _postings(spark)
    rng = random.Random(5)
    some = [(rng.randrange(90), rng.randrange(95)) for _ in range(300)] + [(4, 4), (None, 3), (3, None)]
    pairs = spark.createDataFrame(sorted(set(some), key=str), "q bigint, t bigint")
    full = S.scores(S.profiles(post, post.agg(F.count_distinct("pid").alias("n"))), post, pairs=pairs)
    want = {(r.q, r.t): [r[n] for n in SCORES] for r in full.collect()}
    bags = post.groupBy("pid").agg(F.collect_list("feature").alias("words"), F.collect_list("tf").alias("tfs"))
    got = {(r.q, r.t): [r[n] for n in SCORES] for r in S.pair_scores(bags, pairs, head=head).collect()}
    assert len(want) > 150 and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert S.pair_scores(bags, pairs.limit(0)).count() == 0


def test_alignments_at_once():
    """Pairs of any lengths, aligned together, score what each scores alone."""
    rng = random.Random(7)
    w = {c: rng.random() for c in "abcdefgh"} | {"z": 0.0}
    texts = [[rng.choice("abcdefghz") for _ in range(rng.choice((0, 1, 5, 40)))] for _ in range(600)] + [["z"], ["z"]]
    pairs = [(a, b, [w[c] for c in a], [w[c] for c in b]) for a, b in zip(texts[::2], texts[1::2])]
    assert D.local_alignments(pairs).tolist() == pytest.approx([D.local_alignment(a, b, w) for a, b, _, _ in pairs], abs=1e-12)


def test_retrieval_makes_no_row_for_a_word_of_a_pair(spark, data, monkeypatch):
    monkeypatch.setattr(S, "scores", None)
    assert entry.queries()["retrieval_fused"](spark, data).count() > 0
