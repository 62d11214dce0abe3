"""Streams, segmentation, evaluation and validation operators on the stored tables, one query each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagelink.operators import detectors as D
from passagelink.operators import evaluation as V
from passagelink.operators import evidence as E
from passagelink.operators import retrieval as R
from passagelink.operators import segment as S
from passagelink.operators import streams as M
from passagelink.operators import validation as J
from passagelink.queries import lexical as L
from passagelink.queries import passages as P
from passagelink.queries import register
from passagelink.session import table

_VS = f"WITH {P.VERSES}"

# --- streams


@register(_VS + " SELECT corpus, analysis_profile, analysis_reading, book, passage_id, ordinal FROM vs WHERE ordinal NOT BETWEEN 2 AND 4")
def profile_stream(spark: SparkSession, d: str) -> DataFrame:
    """Verses of every book outside a configured range of ordinals."""
    v = P.verses(spark, d)
    ranges = v.select("book").distinct().select("book", F.lit(2).alias("lo"), F.lit(4).alias("hi"))  # one row a book
    return M.outside_ranges(v, ranges, "book", F.col("ordinal")).select(*P.KEYS, "passage_id", "ordinal")


@register(_VS + " SELECT DISTINCT book || '/' || chapter AS unit FROM vs GROUP BY book, chapter HAVING count(DISTINCT ordinal BETWEEN 2 AND 4) > 1")
def straddled_chapters(spark: SparkSession, d: str) -> DataFrame:
    """Chapters that an excluded range of ordinals would cut through."""
    v = P.verses(spark, d).withColumn("unit", F.concat_ws("/", "book", F.col("chapter").cast("string")))
    return M.straddling_units(v, F.col("ordinal").between(2, 4), "unit")


@register(_VS + " SELECT corpus, analysis_profile, analysis_reading, book, reference, CAST(row_number() OVER (PARTITION BY corpus, analysis_profile, analysis_reading, book ORDER BY f, reference) AS INTEGER) AS ordinal FROM (SELECT corpus, analysis_profile, analysis_reading, book, reference, min(chapter * 1000 + verse) AS f FROM vs GROUP BY ALL)")
def dense_verse_ordinals(spark: SparkSession, d: str) -> DataFrame:
    v = P.verses(spark, d).withColumn("at", F.col("chapter") * 1000 + F.col("verse"))
    return M.verse_ordinals(v, P.KEYS, "reference", "at")


@register(_VS + ", u AS (SELECT corpus || '|' || analysis_profile || '|' || analysis_reading || '|' || book AS unit, passage_id, ordinal FROM vs) SELECT unit, passage_id, CAST(row_number() OVER (ORDER BY unit, ordinal) AS BIGINT) AS stream_position FROM u")
def stream_positions(spark: SparkSession, d: str) -> DataFrame:
    """A running number over all verses, book after book."""
    v = P.verses(spark, d).withColumn("unit", F.concat_ws("|", *P.KEYS)).withColumn("at", F.concat("unit", F.lpad(F.col("ordinal").cast("string"), 9, "0")))
    return M.with_stream_position(v.select("unit", "passage_id", "at"), "unit", "at").select("unit", "passage_id", "stream_position")


@register("SELECT DISTINCT passage_id, token_id, position_in_passage AS slot FROM passage_membership WHERE token_id IS NOT NULL")
def word_slots(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "passage_membership").filter("token_id is not null").select("passage_id", "token_id", "position_in_passage").distinct()
    word = F.concat("token_id", F.lit("!"), F.col("position_in_passage").cast("string"))
    return m.select("passage_id", "token_id", M.word_slot(word).cast("bigint").alias("slot"))


@register(
    f"""WITH {L.TOK}, seven AS (SELECT doc_id, word, pos, pos AS slot, pos AS key FROM tok), st AS (SELECT doc_id, word, slot FROM seven WHERE slot % 7 <> 0 UNION ALL SELECT doc_id, 'supplied', slot FROM seven WHERE slot % 7 = 0)
    SELECT doc_id, word, slot, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY slot) AS INTEGER) AS unit_position FROM st"""
)
def supplemented_stream(spark: SparkSession, d: str) -> DataFrame:
    """Word streams in which every seventh word is replaced by a supplement and the rest keeps its slots."""
    o = L.occ(spark, d).select(F.col("pid").alias("doc_id"), F.col("feature").alias("word"), F.col("pos").alias("slot"))
    o = o.withColumn("key", F.concat_ws("-", F.col("doc_id").cast("string"), F.col("slot").cast("string")))
    gone = o.filter("slot % 7 = 0")
    return M.supplement_reading(o, gone.select("key"), gone.withColumn("word", F.lit("supplied")), "key", "doc_id", "slot").select("doc_id", "word", "slot", "unit_position")


# --- segmentation


@register(
    f"""WITH {L.TOK}, t AS (SELECT doc_id, pos, CASE WHEN length(word) >= 4 THEN pos // 10 END AS unit, sum(CASE WHEN length(word) >= 4 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS loose FROM tok)
    SELECT doc_id, unit, CAST(min(pos) AS BIGINT) AS "start", CAST(max(pos) AS BIGINT) AS "end", count(*) AS n_tokens, CAST(max(loose) - min(loose) AS BIGINT) AS n_unattached FROM t WHERE unit IS NOT NULL GROUP BY doc_id, unit"""
)
def unit_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages of ten words; words of fewer than four letters belong to none and are counted inside an extent."""
    o = L.occ(spark, d).withColumn("unit", F.when(F.length("feature") >= 4, F.floor(F.col("pos") / 10)))
    u = S.unit_passages(o, ["pid"], "unit", "pos").withColumnRenamed("pid", "doc_id")
    return u.select("doc_id", "unit", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "n_tokens", "n_unattached")


@register(_VS + ", rf AS (SELECT x.reference AS reference_from, y.reference AS reference_to FROM ed JOIN vs x ON x.passage_id = ed.from_id AND x.ordinal = ed.o1 JOIN vs y ON y.passage_id = ed.to_id AND y.ordinal = ed.o1 + 1 WHERE 1 = 0) SELECT corpus, analysis_profile, analysis_reading, book, from_id, to_id, o1, CASE WHEN chapter = 1 AND verse = 1 AND c2 = 1 AND v2 = 2 THEN 'declared' WHEN chapter <> c2 THEN 'chapter_transition' WHEN v2 > verse + 1 THEN 'reference_gap' ELSE 'source_order' END AS relation, NOT (chapter = 1 AND verse = 1 AND c2 = 1 AND v2 = 2) AS continuous, chapter = c2 AND v2 > verse + 1 AS reference_gap FROM (SELECT *, passage_id AS from_id, ordinal AS o1 FROM nx) WHERE to_id IS NOT NULL")
def declared_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges between verses with declared boundaries: between the first two verses of every book."""
    v = P.verses(spark, d)
    b = v.select("book").distinct().select(F.concat("book", F.lit(" 1:1")).alias("reference_from"), F.concat("book", F.lit(" 1:2")).alias("reference_to"), F.lit("declared").alias("relation"))
    return S.verse_edges(v, P.KEYS, "ordinal", F.col("chapter"), F.col("verse"), b)


# --- pairs


_SIDES = _VS + ", e AS (SELECT DISTINCT from_id AS a, to_id AS b FROM ed), m AS (SELECT DISTINCT passage_id, position_in_passage AS p, token_id FROM passage_membership WHERE token_id IS NOT NULL)"


def _sides(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive verses with the ordered tokens of both."""
    e = P.edges(spark, d).select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).distinct()
    m = table(spark, d, "passage_membership").filter("token_id is not null").select("passage_id", F.col("position_in_passage").alias("p"), "token_id").distinct()
    own = m.groupBy("passage_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "token_id"))), lambda x: x["token_id"]).alias("tokens"))
    side = lambda n: own.select(F.col("passage_id").alias(n), F.col("tokens").alias(f"tokens_{n}"))
    return e.join(side("a"), "a").join(side("b"), "b")


@register(_SIDES + " SELECT a, b, EXISTS (SELECT 1 FROM m x JOIN m y ON x.token_id = y.token_id WHERE x.passage_id = a AND y.passage_id = b) AS overlapping FROM e WHERE a IN (SELECT passage_id FROM m) AND b IN (SELECT passage_id FROM m)")
def overlap_flags(spark: SparkSession, d: str) -> DataFrame:
    return _sides(spark, d).select("a", "b", D.overlaps(F.col("tokens_a"), F.col("tokens_b")).alias("overlapping"))


_NUMBERED = ", nm AS (SELECT passage_id, token_id, row_number() OVER (PARTITION BY passage_id ORDER BY p, token_id) AS k FROM m), v AS (SELECT passage_id, token_id, string_agg(k, ',' ORDER BY k) AS ks FROM nm GROUP BY ALL)"


@register(_SIDES + _NUMBERED + " SELECT a, b, x.token_id AS value, x.ks AS pos_a, y.ks AS pos_b FROM e JOIN v x ON x.passage_id = a JOIN v y ON y.passage_id = b AND y.token_id = x.token_id")
def matched_values(spark: SparkSession, d: str) -> DataFrame:
    """Tokens that consecutive verses share, with their places on both sides."""
    s = _sides(spark, d).select("a", "b", F.col("tokens_a").alias("values_a"), "tokens_a", F.col("tokens_b").alias("values_b"), "tokens_b")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return E.matched_trace(s).select("a", "b", "value", text("pos_a"), text("pos_b"))


@register(
    """SELECT candidate, signal_id FROM (SELECT candidate_pair_id AS candidate, evidence_id AS signal_id, row_number() OVER (PARTITION BY candidate_pair_id, detector_id ORDER BY evidence_id) AS r
    FROM (SELECT DISTINCT candidate_pair_id, evidence_id, detector_id, source_artifact_id FROM evidence_identity WHERE candidate_pair_id IS NOT NULL AND evidence_id IS NOT NULL AND source_artifact_id IS NOT NULL AND detector_id IS NOT NULL)
    WHERE NOT contains(detector_id, 'english') AND detector_id <> 'm7_lexical_rrf' AND source_artifact_id <> 'artifact-00-0') WHERE r = 1"""
)
def independent_signals(spark: SparkSession, d: str) -> DataFrame:
    """The evidence of a candidate that is independent of its primary detector: one row a detector; artifacts stand in for features."""
    e = table(spark, d, "evidence_identity").select("candidate_pair_id", "evidence_id", "detector_id", "source_artifact_id").distinct().na.drop()
    return R.cosignals(e.select(
        F.col("candidate_pair_id").alias("candidate"), F.col("evidence_id").alias("signal_id"), F.col("detector_id").alias("independence_key"), F.lit("m7_lexical_rrf").alias("primary_key"),
        F.col("detector_id").contains("english").alias("english"), F.array("source_artifact_id").alias("feature_ids"), F.array(F.lit("artifact-00-0")).alias("primary_ids"),
    ))


@register(_VS + " SELECT book, reference, passage_id, CAST(row_number() OVER (PARTITION BY book ORDER BY passage_id) AS INTEGER) AS ordinal FROM (SELECT DISTINCT book, reference, passage_id FROM vs)")
def book_ordinals(spark: SparkSession, d: str) -> DataFrame:
    return R.book_ordinal(P.verses(spark, d).select("book", "reference", "passage_id").distinct(), "book", "passage_id")


@register("WITH n AS (SELECT count(DISTINCT passage_id) AS n FROM passages), b AS (SELECT n, CASE WHEN n > 1 THEN least(n * (n - 1) // 2, n * least(16, n - 1)) ELSE 0 END AS p FROM n) SELECT n AS passages, 3 * p + 100000 AS pairs, (3 * p + 100000) * 9 AS evidence FROM b")
def scale_bound(spark: SparkSession, d: str) -> DataFrame:
    """Most pairs and evidence rows that the stored passages can lead to."""
    n = table(spark, d, "passages").agg(F.count_distinct("passage_id")).collect()[0][0]  # one number
    c = R.scale_contract(n)
    return spark.createDataFrame([(c["passages"], c["pairs"], c["evidence"])], "passages bigint, pairs bigint, evidence bigint")


# --- evaluation


@register(
    """WITH c AS (SELECT coalesce(corpus_pair, '') AS corpus_pair, count(DISTINCT passage_a_id) AS n_queries, count(*) AS n_relationships, avg(detector_support_count) - 2 AS low_random, avg(detector_support_count) - 3 AS low_overlap FROM candidate_pairs GROUP BY ALL)
    SELECT corpus_pair, n_queries, n_relationships, CASE WHEN n_queries < 100 OR n_relationships < 100 THEN 'no_claim' WHEN low_random > 0 AND low_overlap > 0 THEN 'passed' ELSE 'failed' END AS decision FROM c"""
)
def recovery_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The gate's decision for every corpus pair; mean support above two and three stands in for the bounds of the intervals."""
    c = table(spark, d, "candidate_pairs").groupBy(F.coalesce("corpus_pair", F.lit("")).alias("corpus_pair")).agg(
        F.count_distinct("passage_a_id").alias("n_queries"), F.count("*").alias("n_relationships"), (F.avg("detector_support_count") - 2).alias("low_random"), (F.avg("detector_support_count") - 3).alias("low_overlap"),
    )
    return V.recovery_gate(c).select("corpus_pair", "n_queries", "n_relationships", "decision")


@register(
    """WITH l AS (SELECT canonical_unordered_pair_id AS relationship, list(DISTINCT passage_a_id ORDER BY passage_a_id) FILTER (passage_a_id IS NOT NULL) AS a, list(DISTINCT passage_b_id ORDER BY passage_b_id) FILTER (passage_b_id IS NOT NULL) AS b FROM candidate_pairs WHERE canonical_unordered_pair_id IS NOT NULL GROUP BY ALL),
    u AS (SELECT relationship, 'a_to_b' AS direction, unnest(a) AS q, b AS t FROM l UNION ALL SELECT relationship, 'b_to_a', unnest(b), a FROM l), r AS (SELECT *, list_sort(list_filter(t, lambda x: x <> q)) AS rel FROM u)
    SELECT relationship, direction, q, CASE WHEN len(t) > 0 AND len(rel) > 0 THEN array_to_string(rel, ',') END AS relevant, CASE WHEN coalesce(len(t), 0) = 0 THEN 'no_target' WHEN len(rel) = 0 THEN 'self_only' END AS exclusion FROM r"""
)
def expanded_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every link as queries in both directions."""
    c = table(spark, d, "candidate_pairs").filter("canonical_unordered_pair_id is not null")
    links = c.groupBy(F.col("canonical_unordered_pair_id").alias("relationship")).agg(F.sort_array(F.collect_set("passage_a_id")).alias("sources_a"), F.sort_array(F.collect_set("passage_b_id")).alias("sources_b"))
    return V.expand_queries(links).withColumn("relevant", F.array_join("relevant", ",")).filter("q is not null")


@register("SELECT query_id AS q, string_agg(DISTINCT target_id, ',' ORDER BY target_id) AS targets FROM neighbor WHERE query_id IS NOT NULL AND target_id IS NOT NULL GROUP BY query_id")
def query_universe(spark: SparkSession, d: str) -> DataFrame:
    """The candidates of every query; none may be cut off."""
    n = table(spark, d, "neighbor").filter("query_id is not null and target_id is not null").select(F.col("query_id").alias("q"), F.col("target_id").alias("t"))
    return V.candidate_universe(n, 10**9).withColumn("targets", F.array_join("targets", ","))


_CONTROLS = """WITH c AS (SELECT DISTINCT control_id AS control, coalesce(lower(trim(split)), '') AS split, reference_a || '|' || reference_b AS pair, reference_b || '|' || reference_a AS other FROM positive_controls WHERE control_id IS NOT NULL AND reference_a IS NOT NULL AND reference_b IS NOT NULL),
me AS (SELECT unnest(['length', 'letter']) AS method)"""


@register(
    _CONTROLS
    + """, s AS (SELECT method, control, split, CASE method WHEN 'length' THEN length(pair) ELSE ascii(pair) END AS pos, CASE method WHEN 'length' THEN length(other) ELSE ascii(other) END AS neg FROM c, me),
    b AS (SELECT method, control, max(pos) AS pos, max(neg) AS neg FROM s GROUP BY ALL), k AS (SELECT DISTINCT control, split FROM c)
    SELECT method, split, count(*) AS n_controls, count(*) FILTER (pos > neg) AS n_recovered, count(*) FILTER (pos > neg) / count(*)::DOUBLE AS rate FROM b JOIN k USING (control) GROUP BY ALL"""
)
def recovered_controls(spark: SparkSession, d: str) -> DataFrame:
    """How many controls beat their negative by two toy scores; the reversed pair stands in for the negative."""
    c = table(spark, d, "positive_controls").filter("control_id is not null and reference_a is not null and reference_b is not null")
    split = F.coalesce(F.lower(F.trim("split")), F.lit(""))
    c = c.select(F.col("control_id").alias("control"), split.alias("split"), F.concat_ws("|", "reference_a", "reference_b").alias("pair"), F.concat_ws("|", "reference_b", "reference_a").alias("other")).distinct()
    every = c.select("pair").union(c.select("other")).distinct()
    scores = every.select(F.lit("length").alias("method"), "pair", F.length("pair").cast("double").alias("score")).unionByName(every.select(F.lit("letter").alias("method"), "pair", F.ascii("pair").cast("double").alias("score")))
    return V.control_recovery(c.select("control", "split", "pair"), scores, c.select("control", F.col("other").alias("pair")))


# --- validation


@register("SELECT 'first' AS side, query_id, target_id FROM (SELECT query_id, target_id FROM neighbor EXCEPT ALL SELECT query_id, target_id FROM neighbor WHERE rank IS NOT NULL)")
def run_differences(spark: SparkSession, d: str) -> DataFrame:
    """Rows that one run has and the other lacks, repeats counted; the second run lacks what has no rank."""
    n = table(spark, d, "neighbor")
    return J.differences(n.select("query_id", "target_id"), n.filter("rank is not null").select("query_id", "target_id")).select("side", "query_id", "target_id")


@register()
def misrounded_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores whose stored form, cut after three decimals, isn't the half-even rounding of the raw one. Engines differ on
    ties that binary numbers only approach, so there is no SQL; tested on exact ones."""
    n = table(spark, d, "neighbor").filter("cosine_similarity is not null and not isnan(cosine_similarity)")
    x = n.select("query_id", "target_id", F.col("cosine_similarity").alias("raw"), (F.floor(F.col("cosine_similarity") * 1000) / 1000.0).alias("stored"))
    return J.misrounded(x, "raw", "stored", 3)


@register("WITH l AS (SELECT candidate_pair_id, max(recorded_at) AS t FROM evidence_identity WHERE recorded_at IS NOT NULL GROUP BY ALL), e AS (SELECT candidate_pair_id, max(detector_id) AS decision FROM evidence_identity JOIN l USING (candidate_pair_id) WHERE recorded_at = t GROUP BY ALL) SELECT c.candidate_pair_id, coalesce(e.decision, 'not_reviewed') AS decision FROM (SELECT DISTINCT candidate_pair_id FROM candidate_pairs WHERE candidate_pair_id IS NOT NULL) c LEFT JOIN e USING (candidate_pair_id)")
def review_state(spark: SparkSession, d: str) -> DataFrame:
    """What was decided last about every candidate pair; detectors stand in for decisions."""
    e = table(spark, d, "evidence_identity").filter("recorded_at is not null").groupBy("candidate_pair_id", "recorded_at").agg(F.max("detector_id").alias("decision"))
    c = table(spark, d, "candidate_pairs").select("candidate_pair_id").filter("candidate_pair_id is not null").distinct()
    return J.review_records(c, e.withColumnRenamed("recorded_at", "decided_at"), "candidate_pair_id").select("candidate_pair_id", "decision")


@register(
    """WITH p AS (SELECT DISTINCT passage_id, start_stream_position_in_corpus AS s, token_count AS n, end_reference FROM passages), m AS (SELECT DISTINCT passage_id, position_in_passage AS pos FROM passage_membership),
    g AS (SELECT passage_id, count(*) AS n, min(pos) AS lo, max(pos) AS hi FROM m GROUP BY passage_id)
    SELECT 'members_without_passage' AS "check", count(*) AS n_violations FROM (SELECT DISTINCT passage_id FROM m) WHERE passage_id NOT IN (SELECT passage_id FROM p)
    UNION ALL SELECT 'no_end_reference', count(*) FROM p WHERE end_reference IS NULL UNION ALL SELECT 'negative_or_no_count', count(*) FROM p WHERE n IS NULL OR n < 1
    UNION ALL SELECT 'positions_with_gaps', count(*) FROM g WHERE lo <> 1 OR hi <> n UNION ALL SELECT 'repeated_passages', count(*) FROM (SELECT passage_id FROM passages GROUP BY passage_id HAVING count(*) > 1)
    UNION ALL SELECT 'count_differs', count(*) FROM (SELECT DISTINCT passage_id, n FROM p WHERE n IS NOT NULL) x JOIN g USING (passage_id) WHERE x.n <> g.n
    UNION ALL SELECT 'unknown_granularity', count(*) FROM passages WHERE coalesce(granularity, '') NOT IN ('clause', 'sentence', 'verse', 'two_verse', 'five_verse')"""
)
def segmentation_violations(spark: SparkSession, d: str) -> DataFrame:
    """Checks of the segmented corpus: keys, extents, counts and positions."""
    raw = table(spark, d, "passages")
    p = raw.select("passage_id", F.col("token_count").alias("n"), "end_reference", F.col("start_stream_position_in_corpus").alias("s")).distinct()
    m = table(spark, d, "passage_membership").select("passage_id", F.col("position_in_passage").alias("pos")).distinct()
    g = m.groupBy("passage_id").agg(F.count("*").alias("k"))
    return J.violations({
        "members_without_passage": J.dangling(m.select("passage_id").distinct(), "passage_id", p, "passage_id"), "no_end_reference": J.breaks(p, F.col("end_reference").isNotNull()),
        "negative_or_no_count": J.breaks(p, F.col("n") >= 1), "positions_with_gaps": J.broken_positions(m, "passage_id", "pos"), "repeated_passages": J.repeated(raw, ["passage_id"]),
        "count_differs": p.filter("n is not null").select("passage_id", "n").distinct().join(g, "passage_id").filter("n <> k"),
        "unknown_granularity": J.breaks(raw, F.col("granularity").isin("clause", "sentence", "verse", "two_verse", "five_verse")),
    })


@register(
    """WITH c AS (SELECT * FROM candidate_pairs), e AS (SELECT DISTINCT evidence_id, candidate_pair_id, detector_id, recorded_at FROM evidence_identity), k AS (SELECT DISTINCT candidate_pair_id FROM c WHERE candidate_pair_id IS NOT NULL)
    SELECT 'self_pairs' AS "check", count(*) AS n_violations FROM c WHERE NOT coalesce(passage_a_id <> passage_b_id, false) UNION ALL SELECT 'withdrawn_before_registered', count(*) FROM c WHERE deleted_at < registered_at
    UNION ALL SELECT 'repeated_candidates', count(*) FROM (SELECT candidate_pair_id FROM c GROUP BY candidate_pair_id HAVING count(*) > 1) UNION ALL SELECT 'dangling_evidence', count(*) FROM e WHERE candidate_pair_id IS NOT NULL AND candidate_pair_id NOT IN (SELECT candidate_pair_id FROM k)
    UNION ALL SELECT 'candidates_without_evidence', count(*) FROM k WHERE candidate_pair_id NOT IN (SELECT candidate_pair_id FROM e WHERE candidate_pair_id IS NOT NULL) UNION ALL SELECT 'unknown_passages', count(*) FROM c WHERE passage_a_id IS NOT NULL AND passage_a_id NOT IN (SELECT passage_id FROM passages)
    UNION ALL SELECT 'support_out_of_range', count(*) FROM c WHERE NOT coalesce(detector_support_count BETWEEN 0 AND 9, false) UNION ALL SELECT 'evidence_without_time', count(*) FROM e WHERE recorded_at IS NULL
    UNION ALL SELECT 'evidence_of_two_detectors', count(*) FROM (SELECT evidence_id FROM e GROUP BY evidence_id HAVING count(DISTINCT detector_id) > 1)"""
)
def ledger_violations(spark: SparkSession, d: str) -> DataFrame:
    """Checks of the ledger: pairs, times, references between candidates, evidence and passages."""
    c = table(spark, d, "candidate_pairs")
    e = table(spark, d, "evidence_identity").select("evidence_id", "candidate_pair_id", "detector_id", "recorded_at").distinct()
    k = c.select("candidate_pair_id").filter("candidate_pair_id is not null").distinct()
    return J.violations({
        "self_pairs": J.breaks(c, F.col("passage_a_id") != F.col("passage_b_id")), "withdrawn_before_registered": c.filter("deleted_at < registered_at"), "repeated_candidates": J.repeated(c, ["candidate_pair_id"]),
        "dangling_evidence": J.dangling(e, "candidate_pair_id", c, "candidate_pair_id"), "candidates_without_evidence": J.dangling(k, "candidate_pair_id", e, "candidate_pair_id"),
        "unknown_passages": J.dangling(c, "passage_a_id", table(spark, d, "passages"), "passage_id"), "support_out_of_range": J.breaks(c, F.col("detector_support_count").between(0, 9)),
        "evidence_without_time": J.breaks(e, F.col("recorded_at").isNotNull()), "evidence_of_two_detectors": e.groupBy("evidence_id").agg(F.count_distinct("detector_id").alias("n")).filter("n > 1"),
    })


@register(
    """WITH n AS (SELECT * FROM neighbor), s AS (SELECT DISTINCT query_id, target_id, cosine_similarity FROM n WHERE query_id IS NOT NULL AND target_id IS NOT NULL)
    SELECT 'cosine_out_of_range' AS "check", count(*) AS n_violations FROM n WHERE NOT coalesce(cosine_similarity BETWEEN -1 AND 1 AND NOT isnan(cosine_similarity), false) UNION ALL SELECT 'no_identifier', count(*) FROM n WHERE query_id IS NULL OR target_id IS NULL
    UNION ALL SELECT 'self_rows', count(*) FROM n WHERE query_id = target_id UNION ALL SELECT 'rank_below_one', count(*) FROM n WHERE rank < 1 UNION ALL SELECT 'several_scores', count(*) FROM (SELECT query_id, target_id FROM s GROUP BY ALL HAVING count(*) > 1)"""
)
def ranking_violations(spark: SparkSession, d: str) -> DataFrame:
    """Checks of the directional rankings."""
    n = table(spark, d, "neighbor")
    s = n.filter("query_id is not null and target_id is not null").select("query_id", "target_id", "cosine_similarity").distinct()
    return J.violations({
        "cosine_out_of_range": J.breaks(n, F.col("cosine_similarity").between(-1, 1) & ~F.isnan("cosine_similarity")), "no_identifier": J.breaks(n, F.col("query_id").isNotNull() & F.col("target_id").isNotNull()),
        "self_rows": n.filter("query_id = target_id"), "rank_below_one": n.filter("rank < 1"), "several_scores": J.repeated(s, ["query_id", "target_id"]),
    })
