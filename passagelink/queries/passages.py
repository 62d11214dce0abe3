"""Segmentation and streams over the passage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagelink.functions.identity import logical_hash, unit_hash
from passagelink.operators import segment as S
from passagelink.operators import streams as M
from passagelink.queries import register
from passagelink.session import table

KEYS = ["corpus", "analysis_profile", "analysis_reading", "book"]
# distinct verses in stream order; order of a book is by chapter and verse of the reference
VERSES = r"""
vs AS (SELECT *, CAST(row_number() OVER (PARTITION BY corpus, analysis_profile, analysis_reading, book ORDER BY chapter, verse, passage_id) AS INTEGER) AS ordinal FROM (
  SELECT DISTINCT corpus, analysis_profile, coalesce(analysis_reading, '') AS analysis_reading, book, passage_id, start_reference AS reference,
    CAST(regexp_extract(start_reference, ' ([0-9]+):', 1) AS INTEGER) AS chapter, CAST(regexp_extract(start_reference, ':([0-9]+)$', 1) AS INTEGER) AS verse FROM passages WHERE granularity = 'verse')),
nx AS (SELECT *, lead(passage_id) OVER w AS to_id, lead(chapter) OVER w AS c2, lead(verse) OVER w AS v2 FROM vs WINDOW w AS (PARTITION BY corpus, analysis_profile, analysis_reading, book ORDER BY ordinal)),
ed AS (SELECT corpus, analysis_profile, analysis_reading, book, passage_id AS from_id, to_id, ordinal AS o1,
  CASE WHEN chapter <> c2 THEN 'chapter_transition' WHEN v2 > verse + 1 THEN 'reference_gap' ELSE 'source_order' END AS relation, true AS continuous, chapter = c2 AND v2 > verse + 1 AS reference_gap FROM nx WHERE to_id IS NOT NULL)
"""


def verses(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "passages").filter("granularity = 'verse'").withColumn("analysis_reading", F.coalesce("analysis_reading", F.lit("")))
    num = lambda r: F.regexp_extract("start_reference", r, 1).cast("int")
    v = p.select(*KEYS, "passage_id", F.col("start_reference").alias("reference"), num(" ([0-9]+):").alias("chapter"), num(":([0-9]+)$").alias("verse")).distinct()
    from pyspark.sql import Window

    return v.withColumn("ordinal", F.row_number().over(Window.partitionBy(*KEYS).orderBy("chapter", "verse", "passage_id")))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return S.verse_edges(verses(spark, d), KEYS, "ordinal", F.col("chapter"), F.col("verse"))


@register(f"WITH {VERSES} SELECT * FROM ed")
def continuity_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d)


def _window_sql(n: int) -> str:
    lead = ", ".join(f"lead(passage_id, {i}) OVER w AS p{i}" for i in range(1, n))
    joined = " || ',' || ".join(["passage_id"] + [f"p{i}" for i in range(1, n)])
    return (
        f"WITH {VERSES} SELECT corpus, analysis_profile, analysis_reading, book, passage_id AS first_id, ordinal AS start, {joined} AS constituents FROM (SELECT *, {lead} FROM vs "
        f"WINDOW w AS (PARTITION BY corpus, analysis_profile, analysis_reading, book ORDER BY ordinal)) WHERE p{n - 1} IS NOT NULL"
    )


@register(_window_sql(2))
def window2(spark: SparkSession, d: str) -> DataFrame:
    return S.windows(verses(spark, d), edges(spark, d), KEYS, "ordinal", 2).withColumn("constituents", F.array_join("constituents", ","))


@register(_window_sql(5))
def window5(spark: SparkSession, d: str) -> DataFrame:
    return S.windows(verses(spark, d), edges(spark, d), KEYS, "ordinal", 5).withColumn("constituents", F.array_join("constituents", ","))


@register(f"WITH {VERSES}, w AS (SELECT *, lead(passage_id) OVER w AS p1 FROM vs WINDOW w AS (PARTITION BY corpus, analysis_profile, analysis_reading, book ORDER BY ordinal)) SELECT corpus, analysis_profile, analysis_reading, book, from_id, to_id FROM (SELECT *, lag(passage_id) OVER (PARTITION BY corpus, analysis_profile, analysis_reading, book ORDER BY ordinal) AS from_id, passage_id AS to_id FROM w WHERE p1 IS NOT NULL) WHERE from_id IS NOT NULL")
def window_links(spark: SparkSession, d: str) -> DataFrame:
    return S.window_edges(S.windows(verses(spark, d), edges(spark, d), KEYS, "ordinal", 2), KEYS)


@register(
    f"""WITH {VERSES}, m AS (SELECT DISTINCT passage_id, token_id FROM passage_membership), nb AS (SELECT passage_id, lag(passage_id) OVER w AS previous_id, lead(passage_id) OVER w AS next_id FROM vs WINDOW w AS (PARTITION BY corpus, analysis_profile, analysis_reading, book ORDER BY ordinal)),
    sh AS (SELECT nb.passage_id, count(*) AS k FROM nb JOIN m x ON x.passage_id = nb.passage_id JOIN m y ON y.passage_id = nb.next_id AND y.token_id = x.token_id GROUP BY nb.passage_id)
    SELECT nb.passage_id, previous_id, next_id, coalesce(k, 0) AS shared_tokens FROM nb LEFT JOIN sh ON sh.passage_id = nb.passage_id"""
)
def neighbor_links(spark: SparkSession, d: str) -> DataFrame:
    return S.neighbours(verses(spark, d), table(spark, d, "passage_membership"), KEYS, ["ordinal"])


@register("SELECT passage_id, string_agg(coalesce(token_id, '␀'), ',' ORDER BY position_in_passage, token_id NULLS FIRST) AS tokens, count(*) AS n FROM (SELECT DISTINCT passage_id, position_in_passage, token_id FROM passage_membership) GROUP BY passage_id")
def token_sequences(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "passage_membership").select("passage_id", "position_in_passage", F.coalesce("token_id", F.lit("␀")).alias("token_id")).distinct()
    # the stand-in for null sorts after letters, the oracle's null before them
    m = m.withColumn("token_id", F.when(F.col("token_id") != "␀", F.col("token_id")))
    s = S.token_sequences(m)
    return s.select("passage_id", F.array_join("tokens", ",", "␀").alias("tokens"), F.size("tokens").cast("bigint").alias("n"))


@register("SELECT passage_id, CAST(row_number() OVER (PARTITION BY passage_id ORDER BY position_in_passage, token_id NULLS FIRST) AS INTEGER) AS position, token_id FROM (SELECT DISTINCT passage_id, position_in_passage, token_id FROM passage_membership)")
def membership_positions(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "passage_membership").select("passage_id", "position_in_passage", "token_id").distinct()
    return S.membership(S.token_sequences(m), "tokens")


@register("SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS ordinal, s AS sentence FROM (SELECT doc_id, trim(s, ' ') AS s, i FROM (SELECT doc_id, unnest(w) AS s, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '[\\n.!?]') AS w FROM documents WHERE text IS NOT NULL))) WHERE s <> ''")
def sentence_segments(spark: SparkSession, d: str) -> DataFrame:
    return S.sentences(table(spark, d, "documents").filter("text is not null"), "doc_id", "text")


@register(
    """WITH t AS (SELECT DISTINCT passage_id, position_in_passage AS pos, token_id, variant_type FROM passage_membership WHERE token_id IS NOT NULL),
    pr AS (SELECT passage_id, pos FROM t WHERE variant_type IS NOT NULL GROUP BY ALL HAVING count(DISTINCT variant_type) = 2)
    SELECT t.passage_id, t.pos, t.token_id FROM t LEFT JOIN pr ON pr.passage_id = t.passage_id AND pr.pos = t.pos WHERE pr.pos IS NULL OR t.variant_type = 'qere'"""
)
def reading_select(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "passage_membership").filter("token_id is not null").select("passage_id", F.col("position_in_passage").alias("pos"), "token_id", "variant_type").distinct()
    m = m.withColumn("g", F.when(F.col("variant_type").isNotNull(), F.concat_ws("|", "passage_id", "pos"))).withColumn("clause", F.lit(None).cast("string")).withColumn("o", F.struct("passage_id", "pos", "token_id"))
    return M.select_reading(m, "qere", "g", "variant_type", "o", "passage_id", "clause").select("passage_id", "pos", "token_id")


@register("SELECT membership_basis, variant_type, count(*) AS n_rows, count(DISTINCT passage_id) AS n_passages, count(DISTINCT token_id) AS n_tokens FROM passage_membership GROUP BY ALL")
def membership_profile(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "passage_membership")
    return m.groupBy("membership_basis", "variant_type").agg(F.count("*").alias("n_rows"), F.count_distinct("passage_id").alias("n_passages"), F.count_distinct("token_id").alias("n_tokens"))


@register(
    """SELECT p.passage_id, m.position_in_passage AS position, CASE WHEN p.granularity IN ('two_verse', 'five_verse') THEN 'window_composition' WHEN p.corpus = 'greek' THEN 'source_native'
    WHEN p.analysis_reading = 'ketiv' AND m.variant_type = 'ketiv' THEN CASE p.granularity WHEN 'clause' THEN 'ketiv_clause_alignment' WHEN 'sentence' THEN 'ketiv_sentence_alignment' ELSE 'ketiv_verse_stream' END ELSE 'qere_primary' END AS basis
    FROM (SELECT DISTINCT passage_id, corpus, analysis_reading, granularity FROM passages) p JOIN (SELECT DISTINCT passage_id, position_in_passage, variant_type FROM passage_membership) m USING (passage_id)"""
)
def membership_basis(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "passages").select("passage_id", "corpus", "analysis_reading", "granularity").distinct()
    m = table(spark, d, "passage_membership").select("passage_id", "position_in_passage", "variant_type").distinct()
    basis = S.membership_basis(F.col("corpus"), F.coalesce("analysis_reading", F.lit("")), F.col("granularity"), F.coalesce(F.col("variant_type") == "ketiv", F.lit(False)))
    return p.join(m, "passage_id").select("passage_id", F.col("position_in_passage").alias("position"), basis.alias("basis"))


@register("SELECT corpus, granularity, count(*) AS n_passages, count(DISTINCT passage_id) AS n_distinct, CAST(sum(token_count) AS BIGINT) AS n_tokens, quantile_cont(token_count, 0.25) AS q25, quantile_cont(token_count, 0.5) AS q50, quantile_cont(token_count, 0.75) AS q75, quantile_cont(token_count, 0.95) AS q95 FROM passages GROUP BY ALL")
def corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    return S.passage_summary(table(spark, d, "passages"), ["corpus", "granularity"])


@register(
    """WITH w AS (SELECT DISTINCT passage_id, book, corpus, start_stream_position_in_corpus AS s, start_stream_position_in_corpus + token_count - 1 AS e FROM passages WHERE granularity = 'sentence' AND analysis_profile = 'edition_complete' AND token_count > 0),
    c AS (SELECT DISTINCT passage_id, corpus, start_stream_position_in_corpus AS p FROM passages WHERE granularity = 'clause' AND analysis_profile = 'edition_complete')
    SELECT c.corpus, c.p AS position, string_agg(DISTINCT w.passage_id, ',' ORDER BY w.passage_id) AS inside FROM c JOIN w ON w.corpus = c.corpus AND c.p BETWEEN w.s AND w.e GROUP BY ALL"""
)
def clause_enclosures(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "passages").filter("analysis_profile = 'edition_complete'")
    units = p.filter("granularity = 'sentence' and token_count > 0").select("corpus", F.col("passage_id").alias("unit"), F.col("start_stream_position_in_corpus").alias("start"), (F.col("start_stream_position_in_corpus") + F.col("token_count") - 1).alias("end")).distinct()
    t = p.filter("granularity = 'clause'").select("corpus", F.col("start_stream_position_in_corpus").alias("position")).distinct()
    return S.enclosing_units(t, units, ["corpus"], "position").withColumn("inside", F.array_join("inside", ","))


@register(
    """WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'purchase' THEN value END AS v FROM events)
    SELECT user_id, event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
      first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM e"""
)
def nearest_anchor(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("o"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("v"))
    return M.nearest_both_sides(e, "user_id", "o", "v").select("user_id", "event_id", "before", "after")


@register(
    """WITH k AS (SELECT DISTINCT candidate_pair_id, passage_a_id AS x, passage_b_id AS y, highest_openbible_vote AS vote, mapping_quality AS quality FROM candidate_pairs WHERE passage_a_id IS NOT NULL AND passage_b_id IS NOT NULL AND known_link_status = 'represented_in_openbible_snapshot' AND passage_a_id <> passage_b_id)
    SELECT least(x, y) AS a, greatest(x, y) AS b, string_agg(DISTINCT candidate_pair_id, ',' ORDER BY candidate_pair_id) AS relationships, max(vote) AS highest_vote, max(quality) AS worst_quality FROM k GROUP BY ALL"""
)
def known_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidate_pairs").filter("known_link_status = 'represented_in_openbible_snapshot'")
    sides = F.array(F.struct(F.lit("a").alias("side"), F.col("passage_a_id").alias("passage")), F.struct(F.lit("b").alias("side"), F.col("passage_b_id").alias("passage")))
    links = c.select(F.col("candidate_pair_id").alias("relationship"), F.explode(sides).alias("s"), F.col("highest_openbible_vote").alias("vote"), F.col("mapping_quality").alias("quality")).select("relationship", "s.side", "s.passage", "vote", "quality").filter("passage is not null").distinct()
    return M.known_pairs(links).withColumn("relationships", F.array_join("relationships", ","))


@register(
    """WITH k AS (SELECT DISTINCT passage_a_id AS src, passage_b_id AS dst FROM candidate_pairs WHERE known_link_status = 'represented_in_openbible_snapshot'), s AS (SELECT DISTINCT passage_a_id AS a, passage_b_id AS b FROM selected_m7_pairs WHERE passage_a_id IS NOT NULL AND passage_b_id IS NOT NULL)
    SELECT a, b, CASE WHEN f.src IS NOT NULL AND r.src IS NOT NULL THEN 'both' WHEN f.src IS NOT NULL THEN 'forward' WHEN r.src IS NOT NULL THEN 'reverse' ELSE 'unknown' END AS status FROM s LEFT JOIN k f ON f.src = a AND f.dst = b LEFT JOIN k r ON r.src = b AND r.dst = a"""
)
def knownness_status(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "candidate_pairs").filter("known_link_status = 'represented_in_openbible_snapshot'").select(F.col("passage_a_id").alias("src"), F.col("passage_b_id").alias("dst"))
    s = table(spark, d, "selected_m7_pairs").select(F.col("passage_a_id").alias("a"), F.col("passage_b_id").alias("b")).filter("a is not null and b is not null").distinct()
    return M.knownness(s, k)


_MAPPED = (
    f"WITH {VERSES},"
    + r"""
ep AS (SELECT DISTINCT reference_a AS endpoint_id, regexp_extract(reference_a, '^([A-Z0-9]+) ', 1) AS book, CAST(regexp_extract(reference_a, ' ([0-9]+):', 1) AS INTEGER) * 1000 + CAST(regexp_extract(reference_a, ':([0-9]+)', 1) AS INTEGER) AS at1 FROM positive_controls WHERE regexp_matches(reference_a, '^[A-Z0-9]+ [0-9]+:[0-9]+$')),
v AS (SELECT analysis_profile AS profile, book, chapter * 1000 + verse AS pos, passage_id FROM vs WHERE analysis_reading IN ('qere', 'source')),
n AS (SELECT endpoint_id, p.profile, count(v.passage_id) AS n_targets, count(DISTINCT v.pos) AS n_pos FROM ep CROSS JOIN (SELECT unnest(['edition_complete', 'critical_core']) AS profile) p LEFT JOIN v ON v.profile = p.profile AND v.book = ep.book AND v.pos = ep.at1 GROUP BY ALL)
SELECT n.endpoint_id, n.profile, n.n_targets, CASE WHEN n.n_targets = 0 AND n.profile = 'critical_core' AND e.n_targets > 0 THEN 'excluded_by_profile' WHEN n.n_targets = 0 THEN 'unresolved_missing_target' ELSE 'mapped_provisional' END AS status
FROM n JOIN n e ON e.endpoint_id = n.endpoint_id AND e.profile = 'edition_complete'
"""
)


@register(_MAPPED)
def endpoint_range_map(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "positive_controls").select(F.col("reference_a").alias("endpoint_id")).filter(F.col("endpoint_id").rlike("^[A-Z0-9]+ [0-9]+:[0-9]+$")).distinct()
    at = F.regexp_extract("endpoint_id", " ([0-9]+):", 1).cast("int") * 1000 + F.regexp_extract("endpoint_id", ":([0-9]+)$", 1).cast("int")
    ep = c.select("endpoint_id", F.regexp_extract("endpoint_id", "^([A-Z0-9]+) ", 1).alias("book"), at.alias("lo"), at.alias("hi"), F.lit(False).alias("is_range"))
    v = verses(spark, d).filter(F.col("analysis_reading").isin("qere", "source")).select(F.col("analysis_profile").alias("profile"), "book", (F.col("chapter") * 1000 + F.col("verse")).alias("at"), "passage_id", F.lit(False).alias("reference_gap"), F.lit(False).alias("disputed"))
    return M.map_endpoints(ep, v).select("endpoint_id", "profile", "n_targets", "status")


@register()
def passage_logical_hash(spark: SparkSession, d: str) -> DataFrame:
    """Row count and order-independent hash of the passage table by corpus: equal runs give equal rows."""
    return logical_hash(table(spark, d, "passages").distinct(), ["corpus"])


@register("SELECT passage_id, CASE WHEN u < 0.1 THEN 'test' WHEN u < 0.2 THEN 'development' ELSE 'train' END AS partition FROM (SELECT DISTINCT passage_id, CAST(('0x' || substr(sha256('7101|' || passage_id), 1, 16)) AS UBIGINT)::DOUBLE / 18446744073709551616.0 AS u FROM passages)")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "passages").select("passage_id").distinct()
    u = unit_hash(7101, F.col("passage_id"))
    return p.select("passage_id", F.when(u < 0.1, "test").when(u < 0.2, "development").otherwise("train").alias("partition"))
