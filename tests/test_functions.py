"""Text, identity and special functions on small inputs with values worked out by hand."""

import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from passagelink.functions import identity as I
from passagelink.functions import special as S
from passagelink.functions import text as X


def one(spark, value, col, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(col(F.col("v")).alias("r")).collect()[0].r


def test_hebrew_forms(spark):
    r = one(spark, " מֶ֖לֶךְ ͏ ", X.hebrew_forms)
    assert r.unpointed == "מלך" and "֖" not in r.normalized and "ֶ" in r.normalized
    assert one(spark, None, X.hebrew_forms) is None and one(spark, "", X.hebrew_forms) is None
    assert one(spark, "  ", X.hebrew_lemma) is None


@pytest.mark.parametrize("value,want", [("׃", True), ("«.", True), ("a.", False), ("", False), ("7", False)])
def test_punctuation(spark, value, want):
    assert one(spark, value, X.is_punctuation) is want


def test_greek(spark):
    r = one(spark, "(λόγος,", X.greek_forms)
    assert (r.leading, r.normalized, r.trailing) == ("(", unicodedata.normalize("NFC", "λόγος"), ",")
    assert r.folded == "λογοσ"
    assert one(spark, "...", X.greek_forms).normalized == "..."
    assert one(spark, "ἀλλ’", X.is_elided) is True and one(spark, "’", X.is_elided) is False
    assert one(spark, " δοῦλος  (II) ", X.greek_lemma) == "δοῦλος (II)"


@pytest.mark.parametrize("value,want", [("  Make, GOOD!  ", ["make", "good"]), (None, []), ("", []), ("don't - stop", ["don't", "-", "stop"]), ("ﬁne", ["fine"])])
def test_gloss(spark, value, want):
    assert one(spark, value, X.gloss_words) == want


@pytest.mark.parametrize("value,want", [('{"Tense":"Aorist","x":1,"case":"Dative"}', '{"case":"dative","tense":"aorist"}'), ('{"FormalTag":"N-NSM"}', '{"formaltag":"n-nsm"}'), ("[]", None), ("not json", None), (None, None), ("{}", None)])
def test_morphology(spark, value, want):
    assert one(spark, value, X.coarse_morphology) == want


BOOKS, CHAPTERS = {"Gen": "GEN", "John": "JHN"}, {"GEN": 50, "JHN": 21}


def parsed(spark, ref):
    m = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    return one(spark, ref, lambda c: X.parse_reference(c, m(BOOKS), m(CHAPTERS)))


@pytest.mark.parametrize(
    "ref,status",
    [("Gen.1.3", "parsed"), ("Gen.1.3-Gen.2.1", "parsed"), ("Gen.1.3-5", "parsed"), ("Gen.1.3-2.1", "parsed"), ("", "empty_reference"), (" Gen.1.1", "invalid_syntax"), ("Gen.1", "invalid_syntax"), ("Foo.1.1", "unknown_book"), ("Gen.51.1", "invalid_chapter"), ("Gen.1.0", "invalid_verse"),
     ("Gen.1.3-John.1.1", "cross_book_range"), ("Gen.1.3-Gen.1.3", "empty_range"), ("Gen.1.3-", "empty_range"), ("Gen.2.1-Gen.1.3", "backward_range"), ("Gen.1.1-2-3", "invalid_syntax"), ("Gen.1.1-x", "invalid_syntax")],
)
def test_references(spark, ref, status):
    assert parsed(spark, ref).status == status


def test_reference_parts_and_expansion(spark):
    r = parsed(spark, "Gen.1.30-2.2")
    assert (r.book, r.c1, r.v1, r.c2, r.v2, r.is_range) == ("GEN", 1, 30, 2, 2, True)
    assert parsed(spark, None) is None
    m = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    bounds = m({"GEN 1": 31, "GEN 2": 25})
    grow = lambda ref: one(spark, ref, lambda c: X.expand_reference(X.parse_reference(c, m(BOOKS), m(CHAPTERS)), bounds))
    assert grow("Gen.1.30-2.2") == ["GEN 1:30", "GEN 1:31", "GEN 2:1", "GEN 2:2"]
    assert grow("Gen.1.40") is None and grow("Gen.3.1") is None
    corpus = lambda ref: one(spark, ref, lambda c: X.reference_corpus(X.parse_reference(c, m(BOOKS), m(CHAPTERS)), ["GEN"], ["JHN"]))
    assert corpus("Gen.1.1") == "hebrew" and corpus("John.1.1") == "greek" and corpus("Gen.1.1-John.1.1") is None and corpus("x") is None


def test_reconstruct(spark):
    w = spark.createDataFrame([([("בְּ", ""), ("מֶלֶךְ", " "), ("עַל־", None), ("אוֹר", None), ("׃", None)],)], "w array<struct<text:string,after:string>>")
    assert w.select(X.reconstruct_hebrew(F.col("w"))).collect()[0][0] == "בְּמֶלֶךְ עַל־אוֹר׃"
    g = spark.createDataFrame([([("λόγος", False), (",", True), ("(", True), ("ἦν", False), (")", True), ("", False)],)], "w array<struct<text:string,punctuation:boolean>>")
    assert g.select(X.reconstruct_greek(F.col("w"))).collect()[0][0] == "λόγος, (ἦν)"


def test_buckets_and_ids(spark):
    df = spark.createDataFrame([("gen", 1, 2, 3)], "b string, c int, v int, p int")
    c = [F.col(x) for x in "bcvp"]
    assert df.select(I.token_id("HB", *c)).collect()[0][0] == "HB_GEN_001_002_0003"
    assert df.select(I.token_id("HB", *c, sub=F.lit(4))).collect()[0][0] == "HB_GEN_001_002_0003.04"
    assert df.select(I.token_id("HB", F.lit("g-n"), *c[1:])).collect()[0][0] is None
    assert one(spark, 5, X.length_bucket, "int") == "short" and one(spark, 16, X.length_bucket, "int") == "long"
    assert df.select(X.length_ratio_bucket(F.lit(4), F.lit(5))).collect()[0][0] == "close"


def test_unit_hash_matches_python(spark):
    import hashlib

    want = int.from_bytes(hashlib.sha256(b"7|abc").digest()[:8], "big") / 2**64
    assert one(spark, "abc", lambda c: I.unit_hash(7, c)) == pytest.approx(want, abs=1e-15)


def test_pair_ids(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a")], "x string, y string")
    r = [x[0] for x in df.select(I.pair_id("P_", F.col("x"), F.col("y"))).collect()]
    assert r[0] == r[1] and r[2] is None
    d = [x[0] for x in df.select(I.pair_id("P_", F.col("x"), F.col("y"), True)).collect()]
    assert d[0] != d[1]


def test_logical_hash(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "i int, s string")
    h = lambda df: I.logical_hash(df).collect()[0]
    assert h(a) == h(a.orderBy(F.desc("i")).repartition(3)) != h(a.distinct())


def test_special(spark):
    df = spark.createDataFrame([(5, 2, 2, 1)], "n int, a int, b int, k int")
    c = [F.col(x) for x in "nabk"]
    assert df.select(S.hypergeometric_tail(*c)).collect()[0][0] == pytest.approx(0.7)
    assert df.select(S.hypergeometric_expectation(*c[:3])).collect()[0][0] == pytest.approx(0.8)
    assert one(spark, 1.0, S.normal_cdf, "double") == pytest.approx(0.5 * (1 + math.erf(1 / math.sqrt(2))))
    assert df.select(S.log_choose(c[0], c[1])).collect()[0][0] == pytest.approx(math.log(10))
    assert df.select(S.normal_score(F.lit(1.0), F.lit(1.0), F.lit(0.0))).collect()[0][0] == 0.5
