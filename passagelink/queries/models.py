"""Text functions, null models, negatives and evidence on the stored tables.

Where tables hold no annotation, a stand-in is derived from the words and named in the query's docstring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagelink.functions import text as X
from passagelink.functions.identity import pair_id, token_id
from passagelink.operators import benchmark as B
from passagelink.operators import candidates as C
from passagelink.operators import detectors as D
from passagelink.operators import ensemble as N
from passagelink.operators import evaluation as V
from passagelink.operators import evidence as E
from passagelink.operators import nulls as U
from passagelink.operators import retrieval as R
from passagelink.operators.streams import pair_stratum
from passagelink.queries import register
from passagelink.queries import analysis as A
from passagelink.queries import lexical as L
from passagelink.session import materialize, table

_WORDS = f"WITH {L.TOK}, ws AS (SELECT DISTINCT word FROM tok)"


def _words(spark: SparkSession, d: str) -> DataFrame:
    return L.occ(spark, d).select(F.col("feature").alias("word")).distinct()


@register(_WORDS + r", n AS (SELECT word, replace(nfc_normalize(word), chr(847), '') AS b FROM ws WHERE regexp_matches(word, '[\x{05D0}-\x{05EA}]')) SELECT word, regexp_replace(b, '[\x{0591}-\x{05AF}\x{05BD}]', '', 'g') AS normalized, regexp_replace(b, '[\x{0591}-\x{05BD}\x{05BF}\x{05C1}\x{05C2}\x{05C4}\x{05C5}\x{05C7}]', '', 'g') AS unpointed FROM n")
def hebrew_forms(spark: SparkSession, d: str) -> DataFrame:
    w = _words(spark, d).filter(F.col("word").rlike("[א-ת]")).withColumn("f", X.hebrew_forms(F.col("word")))
    return w.select("word", "f.normalized", "f.unpointed")


@register()
def greek_forms(spark: SparkSession, d: str) -> DataFrame:
    """Normalized and folded forms of Greek words; case folding has no SQL twin, unit-tested instead."""
    w = _words(spark, d).filter(F.col("word").rlike("[Ͱ-Ͽἀ-῿]")).withColumn("f", X.greek_forms(F.col("word")))
    return w.select("word", "f.normalized", "f.folded")


@register("SELECT t AS token, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS t FROM documents WHERE text IS NOT NULL) WHERE regexp_full_match(t, '[\\p{P}\\p{Z}\\p{S}]+') GROUP BY t")
def punctuation_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter("text is not null").select(F.explode(F.split("text", " ")).alias("token"))
    return t.filter(X.is_punctuation(F.col("token"))).groupBy("token").agg(F.count("*").alias("n"))


@register()
def gloss_profile(spark: SparkSession, d: str) -> DataFrame:
    """Words of English texts after gloss normalization, with counts; compatibility folding has no SQL twin."""
    t = table(spark, d, "documents").filter("lang = 'en' and text is not null")
    return t.select(F.explode(X.gloss_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@register(r"SELECT DISTINCT passage_id, printf('HB_%s_%03d_%03d_%04d', upper(book), c, v, 1) AS token_id FROM (SELECT passage_id, book, CAST(regexp_extract(start_reference, ' ([0-9]+):', 1) AS INTEGER) AS c, CAST(regexp_extract(start_reference, ':([0-9]+)$', 1) AS INTEGER) AS v FROM passages WHERE granularity = 'verse') WHERE regexp_full_match(book, '[A-Za-z0-9]{1,16}') AND c >= 1 AND v >= 1")
def token_ids(spark: SparkSession, d: str) -> DataFrame:
    num = lambda p: F.regexp_extract("start_reference", p, 1).cast("int")
    p = table(spark, d, "passages").filter("granularity = 'verse'")
    out = p.select("passage_id", token_id("HB", F.col("book"), num(" ([0-9]+):"), num(":([0-9]+)$"), F.lit(1)).alias("token_id"))
    return out.filter("token_id is not null").distinct()


@register("SELECT DISTINCT passage_a_id AS a, passage_b_id AS b, 'CP_' || sha256(least(passage_a_id, passage_b_id) || '|' || greatest(passage_a_id, passage_b_id)) AS unordered_id, 'CD_' || sha256(passage_a_id || '|' || passage_b_id) AS directed_id FROM candidate_pairs WHERE passage_a_id <> passage_b_id")
def pair_identities(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidate_pairs").filter("passage_a_id <> passage_b_id")
    a, b = F.col("passage_a_id"), F.col("passage_b_id")
    return c.select(a.alias("a"), b.alias("b"), pair_id("CP_", a, b).alias("unordered_id"), pair_id("CD_", a, b, True).alias("directed_id")).distinct()


@register()
def parsed_references(spark: SparkSession, d: str) -> DataFrame:
    """References of positive controls in dotted form, parsed against the books and chapters of the passage table."""
    p = table(spark, d, "passages").select("book", F.regexp_extract("end_reference", " ([0-9]+):", 1).alias("c")).filter("c <> ''")
    top = p.groupBy("book").agg(F.max(F.col("c").cast("int")).alias("n")).collect()  # one row a book
    books = F.create_map(*[x for r in top for x in (F.lit(r.book), F.lit(r.book))])
    chapters = F.create_map(*[x for r in top for x in (F.lit(r.book), F.lit(r.n))])
    c = table(spark, d, "positive_controls").select(F.explode(F.array("reference_a", "reference_b")).alias("reference")).filter("reference is not null").distinct()
    dotted = F.regexp_replace(F.regexp_replace("reference", " ", "."), ":", ".")
    return c.withColumn("p", X.parse_reference(dotted, books, chapters)).select("reference", "p.status", "p.book", "p.c1", "p.v1", "p.c2", "p.v2")


_LEN = "l AS (SELECT passage_id, any_value(corpus) AS corpus, any_value(book) AS book, max(token_count) AS len FROM passages GROUP BY passage_id HAVING max(token_count) IS NOT NULL)"


@register(
    f"""WITH {_LEN} SELECT DISTINCT c.candidate_pair_id, CASE WHEN greatest(x.len, y.len) / CAST(greatest(least(x.len, y.len), 1) AS DOUBLE) <= 1.25 THEN 'close' WHEN greatest(x.len, y.len) / CAST(greatest(least(x.len, y.len), 1) AS DOUBLE) <= 2.0 THEN 'moderate' ELSE 'wide' END AS bucket,
    least(x.corpus, y.corpus) || '_' || greatest(x.corpus, y.corpus) || '|' || least(x.book, y.book) || '_' || greatest(x.book, y.book) || '|' || 'none_none|' || CASE WHEN greatest(x.len, y.len) / CAST(greatest(least(x.len, y.len), 1) AS DOUBLE) <= 1.25 THEN 'close' WHEN greatest(x.len, y.len) / CAST(greatest(least(x.len, y.len), 1) AS DOUBLE) <= 2.0 THEN 'moderate' ELSE 'wide' END AS stratum
    FROM candidate_pairs c JOIN l x ON x.passage_id = c.passage_a_id JOIN l y ON y.passage_id = c.passage_b_id"""
)
def pair_strata(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "passages").groupBy("passage_id").agg(F.any_value("corpus").alias("corpus"), F.any_value("book").alias("book"), F.max("token_count").alias("len")).filter("len is not null")
    side = lambda s: n.select(F.col("passage_id").alias(f"passage_{s}_id"), *[F.col(c).alias(f"{c}_{s}") for c in ("corpus", "book", "len")])
    j = table(spark, d, "candidate_pairs").select("candidate_pair_id", "passage_a_id", "passage_b_id").join(side("a"), "passage_a_id").join(side("b"), "passage_b_id")
    bucket = X.length_ratio_bucket(F.col("len_a"), F.col("len_b"))
    s = pair_stratum(F.col("corpus_a"), F.col("corpus_b"), F.col("book_a"), F.col("book_b"), F.lit("none"), F.lit("none"), bucket)
    return j.select("candidate_pair_id", bucket.alias("bucket"), s.alias("stratum")).distinct()


# --- null models (seeded; conservation is unit-tested)


def _occ(spark: SparkSession, d: str) -> DataFrame:
    """Words of documents with their source as book and language as genre, written once. Texts meet those before they are cut
    into words, and only where an identifier stands in several rows need they be joined."""
    docs = table(spark, d, "documents")
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        docs = docs.filter("text is not null and doc_id is not null").select(F.col("doc_id").alias("pid"), "text", F.coalesce("source", F.lit("")).alias("book"), F.coalesce("lang", F.lit("")).alias("genre"))
    else:
        docs = docs.filter("text is not null").select(F.col("doc_id").alias("pid"), "text").join(L._passages(spark, d), "pid")
    words = docs.select("book", "genre", "pid", F.posexplode(X.text_words(F.col("text"))).alias("p", "feature")).filter("feature <> ''")
    return materialize(words.select("pid", (F.col("p") + 1).alias("pos"), "feature", "book", "genre"))


@register()
def reassign_null(spark: SparkSession, d: str) -> DataFrame:
    """One replicate of words reassigned within their source."""
    return U.reassign_within_book(_occ(spark, d), 7101, spark.createDataFrame([(1,)], "replicate int"))


@register()
def freq_null(spark: SparkSession, d: str) -> DataFrame:
    """One replicate of synthetic documents with the word frequencies of their source, or of their language where it is small."""
    return U.synthetic(_occ(spark, d), 7102, spark.createDataFrame([(1,)], "replicate int"))


@register()
def reassign_audit(spark: SparkSession, d: str) -> DataFrame:
    """Violations of the reassigned replicate; none."""
    o = _occ(spark, d)
    return U.reassignment_violations(o, U.reassign_within_book(o, 7101, spark.createDataFrame([(1,)], "replicate int")))


@register()
def freq_null_audit(spark: SparkSession, d: str) -> DataFrame:
    o = _occ(spark, d)
    return U.synthetic_deviation(o, U.synthetic(o, 7102, spark.createDataFrame([(1,), (2,)], "replicate int")))


@register()
def perm_null(spark: SparkSession, d: str) -> DataFrame:
    """Empirical p-values of detector scores by 200 permutations within detector and corpus-sized strata."""
    e = A.evidence(spark, d).groupBy("detector", "pair").agg(F.max("score").alias("score"))
    s = e.select("detector", F.substring(F.sha2("pair", 256), 1, 1).alias("stratum"), F.lit("stratified_permutation").alias("null_family"), "pair", "score")
    return U.detector_nulls(s, 200, {"stratified_permutation": 9113})


@register()
def ensemble_null(spark: SparkSession, d: str) -> DataFrame:
    g = N.wide_groups(N.group_scores(A.calibrated(spark, d))).withColumn("stratum", F.substring(F.sha2("pair", 256), 1, 1))
    return U.ensemble_null(g, N.GROUP_WEIGHTS, 100, 9113, spark.createDataFrame([(0.1,), (0.2,), (0.3,), (0.4,)], "t double"))


@register("SELECT candidate_pair_id FROM (SELECT DISTINCT candidate_pair_id FROM candidate_pairs WHERE candidate_pair_id IS NOT NULL) ORDER BY sha256('7103|' || candidate_pair_id), candidate_pair_id LIMIT 100")
def calibration_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sampling operator: the 100 pairs of smallest seeded hash."""
    return U.sample_pairs(table(spark, d, "candidate_pairs").filter("candidate_pair_id is not null"), "candidate_pair_id", 7103, 100)


@register("SELECT s.corpus_pair, f.family, CAST(r AS INTEGER) AS replicate, CAST(('0x' || substr(sha256(f.base || '|' || s.corpus_pair || '|' || r), 1, 12)) AS BIGINT) AS seed FROM (SELECT DISTINCT corpus_pair FROM candidate_pairs) s, (SELECT unnest(['frequency_preserving_synthetic', 'within_book_reassignment']) AS family, unnest([7102, 7101]) AS base) f, (SELECT unnest(range(1, 101)) AS r)")
def replicate_plan(spark: SparkSession, d: str) -> DataFrame:
    return U.replicate_plan(table(spark, d, "candidate_pairs").select("corpus_pair").distinct(), {"within_book_reassignment": 7101, "frequency_preserving_synthetic": 7102}, 100)


# --- negatives and controls


def _negative_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Verses, templates, known links, and the distinct tokens of the verses."""
    from passagelink.functions.identity import hash_split
    from passagelink.queries.passages import verses

    v = verses(spark, d).filter("analysis_profile = 'edition_complete'")
    n = table(spark, d, "passages").groupBy("passage_id").agg(F.max("token_count").alias("len"))
    p = v.join(n, "passage_id").select(F.col("passage_id").alias("pid"), "book", F.col("corpus").alias("genre"), F.coalesce("len", F.lit(0)).alias("len"), "ordinal", hash_split(5, F.col("book"), 0.1, 0.1).alias("partition"))
    c = table(spark, d, "candidate_pairs").filter("passage_a_id <> passage_b_id")
    known = c.select(F.least("passage_a_id", "passage_b_id").alias("a"), F.greatest("passage_a_id", "passage_b_id").alias("b")).distinct()
    templates = known.join(p.select(F.col("pid").alias("a")), "a", "left_semi").join(p.select(F.col("pid").alias("b")), "b", "left_semi").select(pair_id("T_", F.col("a"), F.col("b")).alias("template"), "a", "b")
    m = table(spark, d, "passage_membership").select(F.col("passage_id").alias("pid"), F.col("token_id").alias("feature")).filter("feature is not null").distinct().join(p.select("pid"), "pid", "left_semi")
    return p, templates, known, m


@register()
def presumed_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Unlinked verses near in length, one for each template link, first in hash order; contract is unit-tested."""
    p, templates, known, m = _negative_inputs(spark, d)
    return B.presumed_negatives(p, templates, known, None, "length_matched_random_unlinked", 5, tokens=m)


@register()
def nearby_negatives(spark: SparkSession, d: str) -> DataFrame:
    p, templates, known, m = _negative_inputs(spark, d)
    return B.presumed_negatives(p, templates, known, None, "nearby_context_unlinked", 5, tokens=m)


@register()
def book_pair_negatives(spark: SparkSession, d: str) -> DataFrame:
    p, templates, known, m = _negative_inputs(spark, d)
    return B.presumed_negatives(p, templates, known, None, "same_book_pair_unlinked", 5, tokens=m)


@register("SELECT unnest(['length_matched_random_unlinked', 'same_book_unlinked', 'same_book_pair_unlinked', 'same_broad_genre_unlinked', 'nearby_context_unlinked']) AS strategy, 0::BIGINT AS n_sharing, 0::BIGINT AS n_linked, 0::BIGINT AS n_repeated")
def negative_violations(spark: SparkSession, d: str) -> DataFrame:
    """How many negatives of each strategy share a token, are known links or repeat: none."""
    p, templates, known, m = (materialize(x) for x in _negative_inputs(spark, d))
    out = None
    for s in B.NEGATIVE_STRATEGIES:
        n = materialize(B.presumed_negatives(p, templates, known, None, s, 5, tokens=m))
        shared = n.join(m.select(F.col("pid").alias("a"), "feature"), "a").join(m.select(F.col("pid").alias("b"), "feature"), ["b", "feature"]).select("a", "b").distinct()
        one = shared.agg(F.count("*").alias("n_sharing")).crossJoin(n.join(known, ["a", "b"], "left_semi").agg(F.count("*").alias("n_linked")))
        one = one.crossJoin(n.agg((F.count("*") - F.count_distinct("a", "b")).alias("n_repeated"))).select(F.lit(s).alias("strategy"), "n_sharing", "n_linked", "n_repeated")
        out = one if out is None else out.unionByName(one)
    return out


@register()
def matched_negative(spark: SparkSession, d: str) -> DataFrame:
    """For every passage that is a known link's first end the passage of its corpus that is nearest in length."""
    p, templates, _, _ = _negative_inputs(spark, d)
    c = templates.select(F.col("template").alias("control"), F.col("a").alias("pid")).join(p.select("pid", "genre", "book", "len"), "pid")
    return V.matched_negatives(c, p, 17)


# --- candidates


@register()
def rare_rule(spark: SparkSession, d: str) -> DataFrame:
    """The rare-evidence rule for pairs that share a rare word. Words stand in for lemmas, word-length classes for parts of speech."""
    o = L.occ(spark, d)
    post = o.groupBy("pid", "feature").agg(F.count("*").alias("tf"))
    stats = post.groupBy("feature").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    pairs = L.proposed_pairs(spark, d, L.SETTINGS.rerank_k, 2)
    ev = D.shared_evidence(o, pairs).join(stats, "feature").crossJoin(F.broadcast(L.n_docs(post)))
    sig = F.concat_ws(",", F.transform("pos_a", lambda x: F.lpad(x.cast("string"), 9, "0")), F.lit(";"), F.transform("pos_b", lambda x: F.lpad(x.cast("string"), 9, "0")))
    row = F.struct(F.lit("lemma").alias("family"), F.col("feature").alias("value"), F.sha2("feature", 256).alias("feature_id"), sig.alias("positions"), (F.col("cf") <= 3).alias("is_rare"), (F.col("df") >= F.col("n") * L.SETTINGS.high_df_ratio).alias("is_high"))
    rows = ev.groupBy("a", "b").agg(F.collect_list(row).alias("rows"))
    s = L.seqs(spark, d)
    pos = F.transform("seq", lambda w: F.least(F.length(w), F.lit(9)).cast("string"))
    side = lambda n: s.select(F.col("pid").alias(n), F.col("seq").alias(f"seq_{n}"), pos.alias(f"pos_{n}"))
    x = rows.join(side("a"), "a").join(side("b"), "b")
    x = x.select(F.concat_ws("|", F.col("a").cast("string"), F.col("b").cast("string")).alias("pair"), "rows", "seq_a", "seq_b", "pos_a", "pos_b", F.lit(1.0).alias("set_score"), F.lit(0.0).alias("grammar_score"))
    return C.rare_rule(x)


def _ranked_candidates(spark: SparkSession, d: str) -> DataFrame:
    r = L.rankings(spark, d)
    return r.select(F.concat_ws("|", F.least("q", "t").cast("string"), F.greatest("q", "t").cast("string")).alias("candidate"), F.when(F.col("q") < F.col("t"), "f").otherwise("b").alias("direction"), "detector", "rank", F.least("q", "t").alias("lo"))


@register(
    L._RANKS
    + """, c AS (SELECT least(q, t) || '|' || greatest(q, t) AS candidate, CASE WHEN q < t THEN 'f' ELSE 'b' END AS direction, detector, rank, least(q, t) AS lo FROM rk),
    s AS (SELECT candidate, direction, sum(1.0::DOUBLE / (60 + rank)) AS f, coalesce(sum(1.0::DOUBLE / (60 + rank)) FILTER (detector <> 'tfidf'), 0) AS t, coalesce(sum(1.0::DOUBLE / (60 + rank)) FILTER (detector <> 'rare'), 0) AS r, coalesce(sum(1.0::DOUBLE / (60 + rank)) FILTER (detector <> 'bm25'), 0) AS b FROM c GROUP BY ALL),
    m AS (SELECT candidate, max(f) AS f, max(t) AS t, max(r) AS r, max(b) AS b FROM s GROUP BY candidate), st AS (SELECT DISTINCT candidate, CASE WHEN lo % 3 = 0 THEN 0.5 ELSE 1 END AS pf, CASE WHEN lo % 5 = 0 THEN 0.5 ELSE 1 END AS pl, CASE WHEN lo % 7 = 0 THEN 0.25 ELSE 1 END AS ps FROM c)
    SELECT candidate, ablation, round(score, 9) AS score FROM (SELECT candidate, unnest(['full', 'remove_tfidf', 'remove_bm25', 'remove_rare_evidence', 'remove_phrase_evidence', 'remove_ordered_sequence', 'remove_formulaic_penalty', 'remove_local_context_penalty', 'remove_all_english_derived_features']) AS ablation,
     unnest([f * pf * pl * ps, t * pf * pl * ps, b * pf * pl * ps, r * pf * pl * ps, f * pf * pl * ps, f * pf * pl * ps, f * pl * ps, f * pf * ps, f * pf * pl * ps]) AS score FROM m JOIN st USING (candidate))"""
)
def candidate_ablations(spark: SparkSession, d: str) -> DataFrame:
    """Adjusted fused scores of all candidates in full and under every ablation. Document ids stand in for the penalties' causes."""
    c = _ranked_candidates(spark, d)
    state = c.select("candidate", (F.col("lo") % 3 == 0).alias("formulaic"), (F.col("lo") % 5 == 0).alias("local"), (F.col("lo") % 7 == 0).alias("short")).distinct()
    return C.ablation_scores(c, state).withColumn("score", F.round("score", 9))


@register()
def candidate_ablation_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of all candidates before and after each ablation; the scores have a SQL twin above."""
    s = candidate_ablations(spark, d)
    return C.ablation_ranks(s, s.select("candidate", F.lit("all").alias("corpus_pair")).distinct())


@register("SELECT o_custkey AS candidate, detector, round(score, 6) AS score FROM (SELECT o_custkey, max(o_totalprice) AS price, count(*)::DOUBLE AS orders FROM orders GROUP BY o_custkey) UNPIVOT (score FOR detector IN (price, orders))")
def detector_rows(spark: SparkSession, d: str) -> DataFrame:
    """Wide scores of customers as one row per detector."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("candidate")).agg(F.max("o_totalprice").alias("price"), F.count("*").cast("double").alias("orders"))
    return C.detector_rows(o, ["price", "orders"]).select("candidate", "detector", F.round("score", 6).alias("score"))


# --- evidence


def _annotations(seq: Column) -> dict[str, Column]:
    """Stand-in annotations of a text's words: word-length classes (pos), last letters (morph, domain), words as lemmas, stems of four letters as roots."""
    pos, tail = F.transform(seq, lambda w: F.concat(F.lit("L"), F.least(F.length(w), F.lit(9)).cast("string"))), F.transform(seq, lambda w: F.right(w, F.lit(2)))
    return {"pos": pos, "morph": tail, "domains": F.array_distinct(tail), "lemmas": seq, "roots": F.transform(seq, lambda w: F.left(w, F.lit(4))), "frames": F.transform(seq, lambda w: F.concat(F.lit("event:"), F.left(w, F.lit(1)))), "participants": F.filter(seq, lambda w: F.length(w) >= 9), "entities": F.filter(seq, lambda w: F.length(w) >= 11)}


def _annotated(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents with stand-in annotations of their whole texts, of any length."""
    # words are joined and annotated afterwards, as annotations are several times their size
    s = L.seqs(spark, d)
    pairs = L.proposed_pairs(spark, d, 5, 1)
    used = pairs.select(F.explode(F.array("a", "b")).alias("pid")).distinct()
    s = materialize(s.join(used, "pid", "left_semi"))
    side = lambda n: s.select(F.col("pid").alias(n), F.col("seq").alias(f"seq_{n}"))
    x = pairs.join(side("a"), "a").join(side("b"), "b")
    return x.select("a", "b", *[c.alias(f"{k}_{n}") for n in "ab" for k, c in _annotations(F.col(f"seq_{n}")).items()])


@register()
def structure_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Structural evidence of proposed pairs over stand-in annotations of their words."""
    return E.structure_evidence(_annotated(spark, d)).select("a", "b", F.round("structure_score", 9).alias("structure_score"), "role_reversal")


@register()
def semantic_evidence(spark: SparkSession, d: str) -> DataFrame:
    x = _annotated(spark, d).withColumn("vector_a", F.lit(None).cast("array<float>")).withColumn("vector_b", F.lit(None).cast("array<float>"))
    return E.semantic_evidence(x).select("a", "b", F.round("domain_score", 9).alias("domain_score"), F.round("sequence_score", 9).alias("sequence_score"))


@register()
def grammar_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Grammatical evidence of proposed pairs; a feature is rare by its frequency over all documents."""
    x, every = _annotated(spark, d), _annotations(F.col("seq"))
    freq = E.grammar_frequencies(L.seqs(spark, d).select("pid", every["pos"].alias("pos"), every["morph"].alias("morph")))
    return E.grammar_evidence(x, freq, 3).select("a", "b", F.round("grammar_score", 9).alias("grammar_score"), F.round("rare_score", 9).alias("rare_score"))


@register(
    A._ENS
    + """, f AS (SELECT pair, grp AS family, score AS s FROM g), sp AS (SELECT pair, round(stddev_pop(s), 12) AS spread, substr(sha256(pair), 1, 1) AS stratum FROM f GROUP BY pair HAVING count(*) >= 2), md AS (SELECT stratum, median(spread) AS m FROM sp GROUP BY stratum)
    SELECT sp.stratum, count(*) AS n, round(max(m), 9) AS median, round(median(abs(spread - m)), 9) AS mad FROM sp JOIN md USING (stratum) GROUP BY sp.stratum"""
)
def anomaly_strata(spark: SparkSession, d: str) -> DataFrame:
    from passagelink.operators.statistics import mad

    g = N.group_scores(A.calibrated(spark, d))
    s = g.groupBy("pair").agg(F.round(F.stddev_pop("score"), 12).alias("spread"), F.count("*").alias("n")).filter("n >= 2").withColumn("stratum", F.substring(F.sha2("pair", 256), 1, 1))
    return mad(s, "spread", ["stratum"]).select("stratum", "n", F.round("median", 9).alias("median"), F.round("mad", 9).alias("mad"))


@register()
def anomaly_scores(spark: SparkSession, d: str) -> DataFrame:
    """Robust anomaly score of each pair within its stratum; erf has no SQL twin, the strata have."""
    e = A.calibrated(spark, d).select("pair", N.group_of(F.col("detector")).alias("family"), "normalized", F.lit(False).alias("formulaic")).filter("family is not null")
    strata = e.select("pair", F.substring(F.sha2("pair", 256), 1, 1).alias("stratum")).distinct()
    return N.anomalies(e, strata).select("pair", "stratum", F.round("score", 9).alias("score"))


@register("SELECT pair, CASE WHEN bool_or(k) AND bool_or(NOT k) THEN 'conflict' WHEN bool_or(k) THEN 'known' ELSE 'unknown' END AS status FROM (SELECT lower(trim(candidate_pair_id)) AS pair, known_link_status = 'represented_in_openbible_snapshot' AS k FROM candidate_pairs) GROUP BY pair")
def knownness_reconciled(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidate_pairs")
    s = c.select(F.lower(F.trim("candidate_pair_id")).alias("pair"), F.when(F.col("known_link_status") == "represented_in_openbible_snapshot", "known").otherwise("unknown").alias("status"))
    return N.reconcile(s)


@register("SELECT c.candidate_pair_id AS pair, coalesce(bool_or(p.reference_gap), false) AS reference_gap, coalesce(bool_or(p.disputed_passage_flag), false) AS disputed_passage_flag, coalesce(bool_or(p.ketiv_structural_uncertainty), false) AS ketiv_structural_uncertainty FROM (SELECT candidate_pair_id, passage_a_id AS p FROM candidate_pairs UNION ALL SELECT candidate_pair_id, passage_b_id FROM candidate_pairs) c JOIN passages p ON p.passage_id = c.p GROUP BY c.candidate_pair_id")
def quality_flags(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidate_pairs").select(F.col("candidate_pair_id").alias("pair"), F.explode(F.array("passage_a_id", "passage_b_id")).alias("passage_id"))
    names = ["reference_gap", "disputed_passage_flag", "ketiv_structural_uncertainty"]
    return N.merge_quality(c.join(table(spark, d, "passages").select("passage_id", *names), "passage_id"), names)
