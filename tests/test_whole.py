"""Small inputs on which a query that does less than its whole job shows it."""

import pytest

from passagelink.queries import lexical as L
from passagelink.queries import models as M


@pytest.fixture
def folder(spark, tmp_path):
    def write(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


DOCS = "doc_id bigint, text string, lang string, source string"


def words(*numbers: int) -> str:
    """Words of letters only, one for each number."""
    return " ".join("".join(chr(97 + int(c)) for c in f"{n:04d}") for n in numbers)


def test_near_duplicates_of_common_words(spark, folder):
    # every word stands in all of 60 documents but for the pair's differences
    docs = [(i, words(*range(20), *range(1000 + 40 * i, 1030 + 40 * i)), "en", "s") for i in range(60)]
    docs += [(100 + i, words(*range(20)), "en", "s") for i in range(3)] + [(200, words(*range(19)), "en", "s"), (201, None, "en", "s"), (202, None, "en", "s")]
    got = {(r.a, r.b): r.score for r in L.near_duplicates(spark, folder(documents=(docs, DOCS))).collect()}
    assert got == {(100, 101): 1.0, (100, 102): 1.0, (101, 102): 1.0, (100, 200): 0.95, (101, 200): 0.95, (102, 200): 0.95}


def test_evidence_reads_whole_texts(spark, folder):
    # two texts that agree up to word 450, where one goes on with two rare words of the other in the other order
    same, first, second = words(*range(450)), "abcdefghijkl", "mnopqrstuvwx"
    docs = [(1, f"{same} {first} {second} rarity", "en", "s"), (2, f"{same} {second} {first} rarity", "en", "s")]
    d = folder(documents=(docs, DOCS))
    s = M.structure_evidence(spark, d).collect()
    assert [(r.a, r.b, r.role_reversal) for r in s] == [(1, 2, True)] and s[0].structure_score < 1
    assert M.semantic_evidence(spark, d).first().sequence_score < 1
    assert M.grammar_evidence(spark, d).first().grammar_score < 1


def test_edit_distance_of_all_copies(spark, folder):
    # no word is rare; the last text differs by one of 20 words, repeated words count apart
    t = words(*range(19), 3)
    docs = [(i, t, "en", "s") for i in range(4)] + [(10 + i, words(*range(18), 3, 40 + i // 5), "en", "s") for i in range(5)] + [(20 + i, words(*range(30, 45)), "en", "s") for i in range(4)]
    rows = L.edit_distance_pairs(spark, folder(documents=(docs, DOCS))).collect()
    seqs = {i: x.split() for i, x, *_ in docs}
    want = {(a, b): L.D.edit_distance(seqs[a], seqs[b]) for a in seqs for b in seqs if a < b}
    want = {k: e for k, e in want.items() if 1 - e / max(len(seqs[k[0]]), len(seqs[k[1]])) >= 0.95}
    assert {(r.a, r.b): r.edits for r in rows if r.near_exact} == want and len(want) >= 22
    assert len(rows) == len({(r.a, r.b) for r in rows})


def test_negatives_share_no_common_token(spark, folder):
    # all verses but three hold one token, which is of far more than 200 passages
    n = 240
    passages = [(f"p{i:03d}", "HB", "Gen", "edition_complete", "", "verse", f"Gen 1:{i + 1}", f"Gen 1:{i + 1}", 10) for i in range(n)]
    member = [(f"p{i:03d}", "hot") for i in range(n) if i not in (3, 4, 5)] + [(f"p{i:03d}", f"own{i}") for i in range(n)]
    d = folder(
        passages=(passages, "passage_id string, corpus string, book string, analysis_profile string, analysis_reading string, granularity string, start_reference string, end_reference string, token_count bigint"),
        candidate_pairs=([("c", "p001", "p002"), ("d", "p006", "p007")], "candidate_pair_id string, passage_a_id string, passage_b_id string"),
        passage_membership=(member, "passage_id string, token_id string"),
    )
    for q in (M.presumed_negatives, M.nearby_negatives):
        got = q(spark, d).collect()
        assert len(got) == 2 and all({r.a, r.b} & {"p003", "p004", "p005"} for r in got)


def test_grammar_frequencies_of_all_documents(spark, folder):
    # the pair's annotations are those of ten more texts of other words, so none of its features is rare
    docs = [(1, "aab bbc rareword", "en", "s"), (2, "aab bbc rareword", "en", "s")]
    docs += [(10 + i, f"{c}ab {c}bc {c * 6}rd", "en", "s") for i, c in enumerate("efghijklmn")]
    got = M.grammar_evidence(spark, folder(documents=(docs, DOCS))).collect()
    assert [(r.a, r.b, r.rare_score) for r in got] == [(1, 2, 0.0)]


def test_set_classes_of_large_sets(spark):
    from passagelink.llm import setsim as S

    groups = {"a": range(20), "b": range(20), "c": range(1, 20), "d": range(18), "e": range(100, 112), "f": range(100, 112), "g": range(100, 111), "h": range(200, 203)}
    df = spark.createDataFrame([(r, f"v{v}") for r, vs in groups.items() for v in vs], "r string, v string")

    def classes(large: int) -> list:
        sets, wide = S.value_sets(df, "r", "v", 3, "x", large)
        return sorted(S.set_classes(sets, S.similar_sets(sets, 0.7), S.large_pairs(sets, wide, 0.7, large)).collect())

    want = classes(1000)
    assert [(x.rid, x.class_id, x.class_size, x.similar_classes) for x in want[:3]] == [("a", "a", 2, 2), ("b", "a", 2, 2), ("c", "c", 1, 2)]
    for large in (5, 11, 17, 18, 19):
        assert classes(large) == want


def test_hints_reject_nothing_that_the_patterns_accept():
    from passagelink.llm import pii

    for text, kind in (("signed Anna Bell", "person"), ("and Rev Thomas Hale", "person"), ("at 12 Mill St London", "address"), ("at 12 Mill\nRd in town", "address"), ("at 12 Mill\nDrive in town", "address"), ("at 12 Mill\tRd in town", "address"), ("i  met\tAnna Bell", "person"), ("mr\nThomas Hale", "person")):
        assert kind in [s.kind for s in pii.find(text)], text


def test_null_experiment_asks_with_every_document(spark, folder):
    from passagelink.queries import experiment as E

    # no identifier is divisible by 50; two pairs share words that no other text has
    docs = [(i, words(*range(100 * i, 100 * i + 6), *range(9000 + 10 * (i // 2), 9004 + 10 * (i // 2))), "en", "s") for i in range(2, 12)]
    d = folder(documents=(docs, DOCS))
    want = {(i, i + 1) for i in range(2, 12, 2)}
    assert {(r.a, r.b) for r in E.proposed(spark, d).collect()} == want
    assert {(r.a, r.b) for r in E.null_q_values(spark, d).collect()} == want


def test_null_experiment_scores_all_proposed_pairs(spark, folder):
    from passagelink.queries import experiment as E

    # 60 texts of one family of words each: all pairs within 2 families of 30 are proposed, more than 500
    docs = [(i, words(*range(100 * (i % 2), 100 * (i % 2) + 10), 5000 + i), "en", "s") for i in range(60)]
    docs += [(100 + i, words(7000 + i), "en", "s") for i in range(80)]  # a word of less than a quarter of the documents
    d = folder(documents=(docs, DOCS))
    pairs = E.proposed(spark, d).count()
    assert pairs > 500 and E.null_q_values(spark, d).count() == 4 * pairs
    k = E.null_replicate_counts(spark, d).collect()
    assert len(k) == 2 * E.REPLICATES * 4 * len(E.GRID) and max(r.k for r in k) > 500


def test_bag_scores_are_those_of_every_feature(spark):
    import random

    from pyspark.sql import functions as F

    from passagelink.operators import features as X
    from passagelink.operators import nulls as U

    rng = random.Random(5)
    rows = [("g", "b", p, k, rng.choice("abcdefghijklmnop") + (str(p) if rng.random() < 0.1 else "")) for p in range(30) for k in range(rng.randrange(1, 20))]
    occ = spark.createDataFrame(rows, "genre string, book string, pid int, pos int, feature string")
    freq = occ.groupBy("feature").agg(F.count_distinct("pid").alias("df"), F.count("*").alias("cf"))
    stats = freq.select("feature", X.smooth_idf(F.col("df"), F.lit(30)).alias("idf"), "cf")
    pairs = spark.createDataFrame([(a, b) for a in range(32) for b in range(a + 1, 32)], "a int, b int")  # two have no words
    reps = spark.createDataFrame([(1,), (2,)], "replicate int")
    lined = U.coded(occ, freq)
    want = {(r.replicate, r.a, r.b, r.detector): r.score for r in U.long_scores(U.replicate_scores(U.reassign_within_book(occ, 9, reps), pairs, stats, replicates=reps), "replicate").collect()}
    for block in (5, 1000):
        got = U.long_scores(U.bag_scores(U.reassign_within_book(lined, 9, reps), pairs, 30, reps, each=True, block=block), "replicate").collect()
        assert {(r.replicate, r.a, r.b, r.detector): r.score for r in got} == pytest.approx(want, abs=1e-9) and len(got) == len(want)
        tally = U.bag_scores(U.reassign_within_book(lined, 9, reps), pairs, 30, reps, block=block).groupBy("replicate", "detector").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("score")).alias("s")).collect()
        assert {(r.replicate, r.detector, r.n) for r in tally} == {(r, n, 496) for r in (1, 2) for n in U.SCORED}
        for r in tally:
            assert r.s == pytest.approx(sum(v for k, v in want.items() if (k[0], k[3]) == (r.replicate, r.detector)), abs=1e-5)


def test_packed_p_values_are_those_of_all_scores(spark):
    import random

    from passagelink.operators import nulls as U

    rng = random.Random(7)
    draw = lambda: rng.choice([0.0, 0.5, 1 / 3, 2.25, rng.random(), rng.random() / 1000])
    nulls = sorted((f, r, d, round(draw(), 9), rng.randrange(1, 4)) for f in "xy" for r in (1, 2) for d in ("j", "k") for _ in range(300))
    nulls = spark.createDataFrame(nulls, "family string, replicate int, detector string, score double, n bigint")
    obs = spark.createDataFrame([(i, i + 1, d, round(draw(), 9)) for i in range(200) for d in ("j", "k")], "a int, b int, detector string, score double")
    packed = U.packed_scores(nulls)
    assert sorted(map(tuple, U.unpacked_scores(packed).collect())) == sorted(map(tuple, nulls.collect()))
    want = {(r.a, r.detector): r.p for r in U.null_p_values(obs, nulls).collect()}
    assert {(r.a, r.detector): r.p for r in U.packed_p_values(obs, packed).collect()} == want and len(want) == 400
