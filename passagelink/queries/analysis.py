"""Statistics, evaluation, ensemble, benchmark and validation over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagelink.operators import benchmark as B
from passagelink.operators import candidates as C
from passagelink.operators import ensemble as N
from passagelink.operators import evaluation as V
from passagelink.operators import retrieval as R
from passagelink.operators import statistics as T
from passagelink.operators import validation as K
from passagelink.operators.graph import components
from passagelink.functions.special import hypergeometric_tail, normal_cdf
from passagelink.queries import register
from passagelink.session import table

NB = """nb AS (SELECT query_id AS q, target_id AS t, max(cosine_similarity) AS score FROM neighbor WHERE query_id <> target_id AND cosine_similarity BETWEEN -1 AND 1 AND NOT isnan(cosine_similarity) GROUP BY ALL)"""


def neighbors(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "neighbor").filter("query_id <> target_id and cosine_similarity between -1 and 1")
    return n.groupBy(F.col("query_id").alias("q"), F.col("target_id").alias("t")).agg(F.max("cosine_similarity").alias("score"))


# --- multiple testing and ranks

_PV = f"WITH {NB}, pv AS (SELECT q || '|' || t AS id, q, round((1 - score) / 2, 9) AS p, split_part(q, '_', 2) AS family FROM nb)"


def pvalues(spark: SparkSession, d: str) -> DataFrame:
    return neighbors(spark, d).select(F.concat_ws("|", "q", "t").alias("id"), "q", F.round((1 - F.col("score")) / 2, 9).alias("p"), F.split_part("q", F.lit("_"), F.lit(2)).alias("family"))


def _bh_sql(part: str) -> str:
    return (
        _PV + f", r AS (SELECT *, row_number() OVER ({part} ORDER BY p, id) AS r, count(*) OVER ({part}) AS n FROM pv) SELECT id, family, round(least(1.0, min(p * n / r) OVER ({part} ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS q_value FROM r"
    )


@register(_bh_sql(""))
def bh_qvalues(spark: SparkSession, d: str) -> DataFrame:
    return T.benjamini_hochberg(pvalues(spark, d), "p", "id").select("id", "family", F.round("q_value", 9).alias("q_value"))


@register(_bh_sql("PARTITION BY family"))
def bh_by_family(spark: SparkSession, d: str) -> DataFrame:
    return T.benjamini_hochberg(pvalues(spark, d), "p", "id", ["family"]).select("id", "family", F.round("q_value", 9).alias("q_value"))


@register(_PV + " SELECT id, round(((rank() OVER (PARTITION BY q ORDER BY p) - 1) + 0.5 * count(*) OVER (PARTITION BY q, p)) / count(*) OVER (PARTITION BY q), 9) AS percentile FROM pv")
def midrank_percentile(spark: SparkSession, d: str) -> DataFrame:
    return T.midrank(pvalues(spark, d), "p", ["q"]).select("id", F.round("percentile", 9).alias("percentile"))


@register(f"WITH {NB}, m AS (SELECT q, median(score) AS med FROM nb GROUP BY q) SELECT nb.q, round(max(med), 9) AS median, round(median(abs(score - med)), 9) AS mad, count(*) AS n FROM nb JOIN m USING (q) GROUP BY nb.q")
def mad_anomaly(spark: SparkSession, d: str) -> DataFrame:
    return T.mad(neighbors(spark, d), "score", ["q"]).select("q", F.round("median", 9).alias("median"), F.round("mad", 9).alias("mad"), "n")


@register()
def zscore_cdf(spark: SparkSession, d: str) -> DataFrame:
    """Normal probability of each score within its query; erf has no SQL twin, unit-tested instead."""
    n = neighbors(spark, d)
    s = n.groupBy("q").agg(F.avg("score").alias("m"), F.var_pop("score").alias("v"))
    z = F.when(F.col("v") > 1e-15, normal_cdf((F.col("score") - F.col("m")) / F.sqrt("v"))).otherwise(0.5)
    return n.join(s, "q").select("q", "t", F.round(z, 9).alias("p"))


@register(
    """SELECT c_custkey, round(CASE WHEN k <= greatest(0, a + b - n) THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(greatest(k, a + b - n), least(a, b) + 1), lambda i:
      exp(lgamma(a + 1.0) - lgamma(i + 1.0) - lgamma(a - i + 1.0) + lgamma(n - a + 1.0) - lgamma(b - i + 1.0) - lgamma(n - a - b + i + 1.0) - (lgamma(n + 1.0) - lgamma(b + 1.0) - lgamma(n - b + 1.0)))))) END, 9) AS p
    FROM (SELECT c_custkey, 40 AS n, 5 + c_nationkey % 10 AS a, 6 + c_custkey % 9 AS b, 1 + c_custkey % 4 AS k FROM customer)"""
)
def hypergeom_tail(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    p = hypergeometric_tail(F.lit(40), 5 + F.col("c_nationkey") % 10, (6 + F.col("c_custkey") % 9).cast("int"), (1 + F.col("c_custkey") % 4).cast("int"))
    return c.select("c_custkey", F.round(p, 9).alias("p"))


_NULLS = """ob AS (SELECT value AS score FROM events WHERE event_type = 'purchase'), nu AS (SELECT event_type AS family, user_id % 20 AS replicate, value AS score FROM events WHERE event_type IN ('click', 'view')),
th AS (SELECT unnest([10.0, 20.0, 40.0, 80.0, 160.0]::DOUBLE[]) AS t), o AS (SELECT t, count(*) FILTER (score >= t) AS observed FROM ob, th GROUP BY t),
pr AS (SELECT family, t, replicate, count(*) FILTER (score >= t) AS k FROM nu, th GROUP BY ALL)"""


def _null_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = table(spark, d, "events")
    ob = e.filter("event_type = 'purchase'").select(F.col("value").alias("score"))
    nu = e.filter("event_type in ('click', 'view')").select(F.col("event_type").alias("family"), (F.col("user_id") % 20).alias("replicate"), F.col("value").alias("score"))
    return ob, nu, spark.createDataFrame([(t,) for t in (10.0, 20.0, 40.0, 80.0, 160.0)], "t double")


@register(
    f"""WITH {_NULLS} SELECT t, observed, round(avg(k), 9) AS mean_null, round(stddev_samp(k), 9) AS sd_null, CASE WHEN avg(k) > 0 THEN round(observed / avg(k), 9) END AS enrichment, round((1.0 + count(*) FILTER (k >= observed)) / (1 + count(*)), 9) AS tail,
    round(CASE WHEN observed > 0 THEN least(1.0, avg(k) / observed) ELSE 1.0 END, 9) AS fdr FROM pr JOIN o USING (t) WHERE family = 'click' GROUP BY t, observed"""
)
def null_threshold_counts(spark: SparkSession, d: str) -> DataFrame:
    ob, nu, th = _null_inputs(spark, d)
    r = T.null_counts(ob, nu.filter("family = 'click'"), th)
    return r.select("t", "observed", *[F.round(c, 9).alias(c) for c in ("mean_null", "sd_null", "enrichment", "tail", "fdr")])


@register(
    f"""WITH {_NULLS}, f AS (SELECT family, t, CASE WHEN observed > 0 THEN least(1.0, avg(k) / observed) ELSE 1.0 END AS fdr FROM pr JOIN o USING (t) GROUP BY family, t, observed)
    SELECT coalesce(min(t), 'inf'::DOUBLE) AS threshold FROM (SELECT t FROM f GROUP BY t HAVING max(fdr) <= 0.9)"""
)
def threshold_select(spark: SparkSession, d: str) -> DataFrame:
    ob, nu, th = _null_inputs(spark, d)
    one = lambda f: T.null_counts(ob, nu.filter(F.col("family") == f), th).select(F.lit(f).alias("family"), "t", "fdr")
    return T.select_threshold(one("click").unionByName(one("view")), 2, 0.9)


@register(
    f"""WITH {NB}, s AS (SELECT split_part(q, '_', 2) AS corpus, score, split_part(t, '_', 2) = split_part(q, '_', 2) AS pos FROM nb),
    b AS (SELECT corpus, score, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n FROM s GROUP BY ALL), w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY corpus ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b)
    SELECT corpus, CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN round(CAST(sum(p * (below + n / 2.0)) AS DOUBLE) / (sum(p) * sum(n)), 9) END AS auroc, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg FROM w GROUP BY corpus"""
)
def negative_auroc(spark: SparkSession, d: str) -> DataFrame:
    part = lambda c: F.split_part(c, F.lit("_"), F.lit(2))
    s = neighbors(spark, d).select(part("q").alias("corpus"), "score", (part("t") == part("q")).alias("positive"))
    return T.auroc(s, ["corpus"]).withColumn("auroc", F.round("auroc", 9))


@register()
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """Bootstrap interval of the mean score above the query's median, per corpus; seeded, tested against numpy."""
    n = neighbors(spark, d)
    m = n.join(n.groupBy("q").agg(F.median("score").alias("base")), "q").withColumn("corpus", F.split_part("q", F.lit("_"), F.lit(2)))
    return T.paired_bootstrap(m, "score", "base", ["corpus"], 500)


# --- evaluation

_RK = f"""{NB}, rk AS (SELECT q, t, score, CAST(row_number() OVER (PARTITION BY q ORDER BY round(score, 12) DESC, t) AS INTEGER) AS rank FROM nb), top AS (SELECT * FROM rk WHERE rank <= 100),
rel AS (SELECT passage_a_id AS q, passage_b_id AS t FROM candidate_pairs UNION SELECT passage_b_id, passage_a_id FROM candidate_pairs), qs AS (SELECT DISTINCT q, split_part(q, '_', 2) AS corpus, split_part(q, '_', 3) AS book FROM nb),
n AS (SELECT q, count(*) AS n FROM rel GROUP BY q), h AS (SELECT q, rank FROM top JOIN rel USING (q, t)),
a AS (SELECT q, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS h10, count(*) FILTER (rank <= 20) AS h20, min(rank) AS f, sum(CASE WHEN rank <= 20 THEN 1 / log2(rank + 1.0) ELSE 0 END) AS dcg FROM h GROUP BY q),
mt AS (SELECT qs.q, corpus, book, coalesce(n.n, 0) AS n_relevant, CASE WHEN n.n > 0 THEN coalesce(h5, 0) / CAST(n.n AS DOUBLE) END AS recall_5, CASE WHEN n.n > 0 THEN coalesce(h10, 0) / CAST(n.n AS DOUBLE) END AS recall_10, CASE WHEN n.n > 0 THEN coalesce(h20, 0) / CAST(n.n AS DOUBLE) END AS recall_20,
  CASE WHEN n.n > 0 THEN coalesce(h10, 0) / 10.0::DOUBLE END AS precision_10, CASE WHEN n.n > 0 THEN coalesce(1.0::DOUBLE / f, 0) END AS reciprocal_rank,
  CASE WHEN n.n > 0 THEN coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n.n, 20) + 1), lambda i: 1 / log2(i + 1.0))) END AS ndcg_20, f IS NOT NULL AS covered FROM qs LEFT JOIN n USING (q) LEFT JOIN a USING (q))
"""
_MEANS = ", ".join(f"round(avg({m}), 9) AS {m}" for m in V.METRICS)
_SUMMARY = f"count(*) AS n_queries, count(*) FILTER (n_relevant > 0) AS n_evaluated, {_MEANS}, round(avg(CASE WHEN covered THEN 1.0 ELSE 0.0 END), 9) AS coverage"


def ranked(spark: SparkSession, d: str) -> DataFrame:
    return R.top_k(neighbors(spark, d).filter("round(score, 12) > 0"), 100)


def metrics(spark: SparkSession, d: str) -> DataFrame:
    n = neighbors(spark, d)
    c = table(spark, d, "candidate_pairs")
    rel = c.select(F.col("passage_a_id").alias("q"), F.col("passage_b_id").alias("t")).unionByName(c.select(F.col("passage_b_id").alias("q"), F.col("passage_a_id").alias("t")))
    qs = n.select("q", F.split_part("q", F.lit("_"), F.lit(2)).alias("corpus"), F.split_part("q", F.lit("_"), F.lit(3)).alias("book")).distinct()
    return V.query_metrics(ranked(spark, d), rel, qs)


_RKP = _RK.replace("FROM nb), top", "FROM nb WHERE round(score, 12) > 0), top")


@register(f"WITH {_RKP} SELECT q, corpus, book, n_relevant, " + ", ".join(f"round({m}, 9) AS {m}" for m in V.METRICS) + ", covered FROM mt")
def query_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = metrics(spark, d)
    return m.withColumns({c: F.round(c, 9) for c in V.METRICS})


@register(f"WITH {_RKP} SELECT {_SUMMARY} FROM mt")
def recall_metrics(spark: SparkSession, d: str) -> DataFrame:
    return V.summarize(metrics(spark, d))


@register(f"WITH {_RKP} SELECT 'corpus' AS dimension, corpus AS value, {_SUMMARY} FROM mt GROUP BY corpus UNION ALL SELECT 'book', book, {_SUMMARY} FROM mt GROUP BY book")
def metrics_by_stratum(spark: SparkSession, d: str) -> DataFrame:
    return V.summarize_strata(metrics(spark, d), ["corpus", "book"])


@register(f"WITH {NB} SELECT q, t, CAST(r AS INTEGER) AS rank FROM (SELECT q, t, row_number() OVER (PARTITION BY q ORDER BY sha256('7|' || q || '|' || t), t) AS r FROM nb) WHERE r <= 5")
def baseline_random(spark: SparkSession, d: str) -> DataFrame:
    n = neighbors(spark, d)
    return V.random_ranking(n.select("q").distinct(), n.select("q", "t"), 7, 5)


@register(
    f"""WITH {NB}, l AS (SELECT passage_id, max(token_count) AS len FROM passages GROUP BY passage_id HAVING max(token_count) IS NOT NULL)
    SELECT q, t, delta, CAST(r AS INTEGER) AS rank FROM (SELECT q, t, abs(x.len - y.len) AS delta, row_number() OVER (PARTITION BY q ORDER BY abs(x.len - y.len), t) AS r FROM nb JOIN l x ON x.passage_id = q JOIN l y ON y.passage_id = t) WHERE r <= 5"""
)
def baseline_length(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "passages").groupBy(F.col("passage_id").alias("pid")).agg(F.max("token_count").alias("len")).filter("len is not null")
    return V.length_ranking(neighbors(spark, d).select("q", "t"), n, 5)


@register(f"WITH {NB} SELECT q, t, round(score, 9) AS score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, t) AS r FROM nb) WHERE r <= 5")
def baseline_overlap(spark: SparkSession, d: str) -> DataFrame:
    return V.overlap_ranking(neighbors(spark, d), 5).withColumn("score", F.round("score", 9))


@register(
    f"""WITH {NB}, b AS (SELECT q, t, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, t) AS INTEGER) AS rank FROM nb WHERE round(score, 6) > 0), bb AS (SELECT * FROM b WHERE rank <= 10),
    cx AS (SELECT q, t, round(score + CASE WHEN split_part(q, '_', 2) = split_part(t, '_', 2) THEN 0.004 ELSE 0 END, 6) AS score FROM nb), c AS (SELECT q, t, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, t) AS INTEGER) AS rank FROM cx WHERE score > 0), cc AS (SELECT * FROM c WHERE rank <= 10),
    j AS (SELECT coalesce(bb.q, cc.q) AS q, coalesce(bb.t, cc.t) AS t, bb.score AS sb, cc.score AS sc, bb.rank AS rb, cc.rank AS rc FROM bb FULL OUTER JOIN cc ON bb.q = cc.q AND bb.t = cc.t)
    SELECT q, t, round(sc - sb, 6) AS score_delta, rc - rb AS rank_delta, count(*) FILTER (rb <= 5 AND rc <= 5) OVER (PARTITION BY q) AS overlap_at_k, CASE WHEN rb IS NULL THEN 'only_comparison' WHEN rc IS NULL THEN 'only_baseline' END AS exclusion FROM j"""
)
def sensitivity_delta(spark: SparkSession, d: str) -> DataFrame:
    from passagelink.operators.streams import sensitivity

    n = neighbors(spark, d)
    same = F.split_part("q", F.lit("_"), F.lit(2)) == F.split_part("t", F.lit("_"), F.lit(2))
    other = n.withColumn("score", F.col("score") + F.when(same, 0.004).otherwise(0.0))
    return sensitivity(R.top_k(n, 10, 6), R.top_k(other, 10, 6), 5).withColumn("score_delta", F.round("score_delta", 6))


# --- benchmark

_REL = r"""rl AS (SELECT DISTINCT control_id AS relationship, reference_a AS endpoint_a, reference_b AS endpoint_b, split_part(reference_a, ' ', 1) AS book_a, split_part(reference_b, ' ', 1) AS book_b, source_tradition AS genre_a, corpus_pair AS genre_b, verification_status = 'verified' AS eligible
 FROM positive_controls WHERE control_id IS NOT NULL AND reference_a IS NOT NULL AND reference_b IS NOT NULL)"""


def relationships(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "positive_controls").filter("control_id is not null and reference_a is not null and reference_b is not null")
    book = lambda x: F.split_part(x, F.lit(" "), F.lit(1))
    return c.select(
        F.col("control_id").alias("relationship"), F.col("reference_a").alias("endpoint_a"), F.col("reference_b").alias("endpoint_b"), book("reference_a").alias("book_a"), book("reference_b").alias("book_b"), F.col("source_tradition").alias("genre_a"), F.col("corpus_pair").alias("genre_b"),
        (F.col("verification_status") == "verified").alias("eligible"),
    ).distinct()


def _links(spark: SparkSession, d: str) -> DataFrame:
    r = relationships(spark, d).withColumn("one", F.row_number().over(Window.partitionBy("relationship").orderBy("endpoint_a", "endpoint_b"))).filter("one = 1")
    at = lambda c, p: F.coalesce(F.try_to_number(F.regexp_extract(c, p, 1), F.lit("99999")).cast("int"), F.lit(0))
    lo = lambda c: at(c, " ([0-9]+):") * 1000 + at(c, ":([0-9]+)")
    return r.select(
        "relationship", F.concat_ws(">", "endpoint_a", "endpoint_b").alias("directed_id"), F.concat_ws("|", F.least("endpoint_a", "endpoint_b"), F.greatest("endpoint_a", "endpoint_b")).alias("unordered_id"), "book_a", "book_b",
        lo("endpoint_a").alias("start_a"), lo("endpoint_a").alias("end_a"), lo("endpoint_b").alias("start_b"), (lo("endpoint_b") + 1).alias("end_b"), "endpoint_a", "endpoint_b", F.lit(None).cast("string").alias("family"),
        F.array().cast("array<string>").alias("provenance"), F.array().cast("array<string>").alias("duplicates"), F.array().cast("array<struct<passage_id:string,book:string,start:int,end:int>>").alias("targets"), "eligible", "genre_a", "genre_b",
    )


_LK = (
    f"WITH {_REL},"
    + r"""lk AS (SELECT *, CAST(regexp_extract(endpoint_a, ' ([0-9]+):', 1) AS INTEGER) * 1000 + CAST(regexp_extract(endpoint_a, ':([0-9]+)', 1) AS INTEGER) AS sa, CAST(regexp_extract(endpoint_b, ' ([0-9]+):', 1) AS INTEGER) * 1000 + CAST(regexp_extract(endpoint_b, ':([0-9]+)', 1) AS INTEGER) AS sb
 FROM (SELECT *, row_number() OVER (PARTITION BY relationship ORDER BY endpoint_a, endpoint_b) AS one FROM rl) WHERE one = 1),
iv AS (SELECT DISTINCT book_a AS book, sa AS s, sa AS e, relationship AS m FROM lk UNION SELECT book_b, sb, sb + 1, relationship FROM lk),
ov AS (SELECT DISTINCT x.book, x.s AS pos, y.m FROM iv x JOIN iv y ON x.book = y.book AND x.s BETWEEN y.s AND y.e),
og AS (SELECT 'overlapping_endpoint_range' AS group_type, book || ':' || pos AS group_id, m AS relationship FROM ov WHERE (book, pos) IN (SELECT (book, pos) FROM ov GROUP BY book, pos HAVING count(*) > 1)),
se AS (SELECT endpoint_a AS g, relationship FROM lk UNION SELECT endpoint_b, relationship FROM lk),
gr AS (SELECT 'exact_directed_pair' AS group_type, endpoint_a || '>' || endpoint_b AS group_id, relationship FROM lk UNION SELECT 'exact_unordered_pair', least(endpoint_a, endpoint_b) || '|' || greatest(endpoint_a, endpoint_b), relationship FROM lk
 UNION SELECT 'canonical_book_pair', least(book_a, book_b) || '|' || greatest(book_a, book_b), relationship FROM lk UNION SELECT 'shared_endpoint', g, relationship FROM se WHERE g IN (SELECT g FROM se GROUP BY g HAVING count(*) > 1) UNION SELECT * FROM og)
"""
)


@register(_LK + "SELECT * FROM gr")
def leakage_groups(spark: SparkSession, d: str) -> DataFrame:
    return B.leakage_groups(_links(spark, d))


@register(_LK + "SELECT book, pos AS at_ordinal, m AS member FROM ov WHERE (book, pos) IN (SELECT (book, pos) FROM ov GROUP BY book, pos HAVING count(*) > 1)")
def interval_overlap_groups(spark: SparkSession, d: str) -> DataFrame:
    k = _links(spark, d)
    i = k.select(F.col("book_a").alias("book"), F.col("start_a").alias("start"), F.col("end_a").alias("end"), F.col("relationship").alias("member")).unionByName(k.select(F.col("book_b").alias("book"), F.col("start_b").alias("start"), F.col("end_b").alias("end"), F.col("relationship").alias("member")))
    return B.overlap_groups(i).withColumnRenamed("at", "at_ordinal")


def _h(seed: int, c: str) -> str:
    u = f"CAST(('0x' || substr(sha256('{seed}|' || {c}), 1, 16)) AS UBIGINT)::DOUBLE / 18446744073709551616.0"
    return f"(CASE WHEN {u} < 0.1 THEN 'test' WHEN {u} < 0.2 THEN 'development' ELSE 'train' END)"


def _prio(a: str, b: str) -> str:
    return f"CASE WHEN 'test' IN ({_h(11, a)}, {_h(11, b)}) THEN 'test' WHEN 'development' IN ({_h(11, a)}, {_h(11, b)}) THEN 'development' ELSE 'train' END"


_STRAT = (
    _LK
    + f""", s AS (SELECT 'held_out_book' AS strategy, relationship, eligible, {_prio('book_a', 'book_b')} AS partition, NULL AS reason FROM lk
 UNION ALL SELECT 'held_out_book_pair', relationship, eligible, {_h(11, "least(book_a, book_b) || '|' || greatest(book_a, book_b)")}, NULL FROM lk
 UNION ALL SELECT 'held_out_source_passage', relationship, eligible, {_h(11, 'endpoint_a')}, CASE WHEN contains(endpoint_a, '-') OR contains(endpoint_b, '-') THEN 'range_overlap_guard' WHEN {_h(11, 'endpoint_a')} <> {_h(11, 'endpoint_b')} THEN 'endpoint_partition_conflict' END FROM lk
 UNION ALL SELECT 'held_out_genre', relationship, eligible, {_prio('genre_a', 'genre_b')}, NULL FROM lk UNION ALL SELECT 'held_out_relationship_family', relationship, eligible, 'excluded', 'relationship_family_unavailable' FROM lk),
st AS (SELECT strategy, relationship, CASE WHEN NOT eligible OR reason IS NOT NULL THEN 'excluded' ELSE partition END AS partition, CASE WHEN NOT eligible THEN 'mapping_ineligible' ELSE reason END AS reason FROM s)
"""
)


@register(_STRAT + "SELECT * FROM st")
def split_strategies(spark: SparkSession, d: str) -> DataFrame:
    return B.split_strategies(_links(spark, d), 11, 0.1, 0.1)


@register(_STRAT + ", j AS (SELECT gr.*, partition FROM gr JOIN st USING (relationship) WHERE strategy = 'held_out_book_pair' AND partition <> 'excluded') SELECT group_type, group_id, count(DISTINCT partition) AS n_partitions, count(DISTINCT relationship) AS n_relationships FROM j GROUP BY group_type, group_id HAVING count(DISTINCT partition) > 1")
def leakage_violations(spark: SparkSession, d: str) -> DataFrame:
    k = _links(spark, d)
    a = B.split_strategies(k, 11, 0.1, 0.1).filter("strategy = 'held_out_book_pair'")
    return V.partition_violations(a, B.leakage_groups(k))


@register(
    _STRAT
    + """, a AS (SELECT * FROM st WHERE strategy = 'held_out_book_pair'), j AS (SELECT gr.*, partition FROM gr JOIN a USING (relationship) WHERE partition <> 'excluded' AND group_type IN ('shared_endpoint', 'overlapping_endpoint_range')),
    bad AS (SELECT group_type, group_id FROM j GROUP BY ALL HAVING count(DISTINCT partition) > 1), f AS (SELECT relationship, min(group_type) AS gt FROM j WHERE (group_type, group_id) IN (SELECT (group_type, group_id) FROM bad) GROUP BY relationship)
    SELECT a.relationship, CASE WHEN gt IS NOT NULL THEN 'excluded' ELSE partition END AS partition, CASE WHEN gt IS NOT NULL THEN 'leakage_group_partition_conflict:' || gt ELSE reason END AS reason FROM a LEFT JOIN f USING (relationship)"""
)
def split_conflicts(spark: SparkSession, d: str) -> DataFrame:
    k = _links(spark, d)
    a = B.split_strategies(k, 11, 0.1, 0.1).filter("strategy = 'held_out_book_pair'").drop("strategy")
    return B.exclude_conflicts(a, B.leakage_groups(k), ("shared_endpoint", "overlapping_endpoint_range"))


@register(
    f"""WITH RECURSIVE {_REL}, e AS (SELECT DISTINCT x.relationship AS u, y.relationship AS v FROM (SELECT endpoint_a AS g, relationship FROM rl UNION SELECT endpoint_b, relationship FROM rl) x JOIN (SELECT endpoint_a AS g, relationship FROM rl UNION SELECT endpoint_b, relationship FROM rl) y USING (g)),
    w AS (SELECT DISTINCT relationship AS s, relationship AS c FROM rl UNION SELECT w.s, e.v FROM w JOIN e ON e.u = w.c) SELECT s AS relationship, min(c) AS component_id FROM w GROUP BY s"""
)
def components_of_links(spark: SparkSession, d: str) -> DataFrame:
    r = relationships(spark, d)
    both = r.select("relationship", F.explode(F.array("endpoint_a", "endpoint_b")).alias("key")).distinct()
    return components(both, "relationship", ["key"])


@register(_LK + f", z AS (SELECT DISTINCT group_id FROM gr WHERE group_type = 'shared_endpoint'), n AS (SELECT group_id, row_number() OVER (ORDER BY sha256('cyc|' || group_id), group_id) - 1 AS i FROM z) SELECT group_id, ['train', 'train', 'train', 'development', 'test'][i % 5 + 1] AS split FROM n")
def control_split_cycle(spark: SparkSession, d: str) -> DataFrame:
    g = B.leakage_groups(_links(spark, d)).filter("group_type = 'shared_endpoint'")
    return B.split_cycle(g, "group_id", "cyc", {"train": 3, "development": 1, "test": 1})


# --- ensemble and tiers

_EV = """ev AS (SELECT DISTINCT evidence_id, lower(trim(candidate_pair_id)) AS pair, detector_id AS detector, CAST(('0x' || substr(sha256('s|' || evidence_id), 1, 8)) AS UBIGINT) % 1000 / 1000.0::DOUBLE AS score FROM evidence_identity WHERE length(trim(candidate_pair_id)) > 0 AND evidence_id IS NOT NULL AND detector_id IS NOT NULL),
cal AS (SELECT *, ((rank() OVER (PARTITION BY detector ORDER BY score) - 1) + 0.5 * count(*) OVER (PARTITION BY detector, score)) / count(*) OVER (PARTITION BY detector) AS normalized FROM ev)"""
_GRP = "CASE detector " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in N.DETECTOR_GROUP.items()) + " END"
_WGT = "CASE grp " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in N.GROUP_WEIGHTS.items()) + " END"
_ENS = f"WITH {_EV}, g AS (SELECT pair, {_GRP} AS grp, max(normalized) AS score FROM cal WHERE {_GRP} IS NOT NULL GROUP BY pair, {_GRP}), en AS (SELECT pair, sum({_WGT} * score) / {sum(N.GROUP_WEIGHTS.values())!r} AS score, count(*) AS n_groups FROM g GROUP BY pair)"


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """Stored evidence with a score; the tables hold none, so it is made of the evidence id."""
    e = table(spark, d, "evidence_identity").filter("length(trim(candidate_pair_id)) > 0 and evidence_id is not null and detector_id is not null")
    s = F.conv(F.substring(F.sha2(F.concat(F.lit("s|"), "evidence_id"), 256), 1, 8), 16, 10).cast("bigint") % 1000 / 1000.0
    return e.select("evidence_id", F.lower(F.trim("candidate_pair_id")).alias("pair"), F.col("detector_id").alias("detector"), s.alias("score")).distinct()


def calibrated(spark: SparkSession, d: str) -> DataFrame:
    return N.calibrate(evidence(spark, d), ["detector"])


@register(f"WITH {_EV} SELECT evidence_id, pair, detector, round(normalized, 9) AS normalized FROM cal")
def detector_calibration(spark: SparkSession, d: str) -> DataFrame:
    return calibrated(spark, d).select("evidence_id", "pair", "detector", F.round("normalized", 9).alias("normalized"))


@register(_ENS + " SELECT pair, grp, round(score, 9) AS score FROM g")
def group_max_ensemble(spark: SparkSession, d: str) -> DataFrame:
    return N.group_scores(calibrated(spark, d)).withColumn("score", F.round("score", 9))


@register(_ENS + " SELECT pair, round(score, 9) AS score, n_groups FROM en")
def ensemble_score(spark: SparkSession, d: str) -> DataFrame:
    return N.ensemble_scores(N.group_scores(calibrated(spark, d))).withColumn("score", F.round("score", 9))


@register(_ENS + " SELECT pair, " + ", ".join(f"coalesce(round(max(CASE WHEN grp = '{g}' THEN score END), 9), 0.0) AS {g}" for g in sorted(N.GROUP_WEIGHTS)) + " FROM g GROUP BY pair")
def ensemble_matrix(spark: SparkSession, d: str) -> DataFrame:
    w = N.wide_groups(N.group_scores(calibrated(spark, d)))
    return w.select("pair", *[F.round(g, 9).alias(g) for g in sorted(N.GROUP_WEIGHTS)])


_TIER = (
    _ENS
    + """, c AS (SELECT lower(trim(candidate_pair_id)) AS pair, bool_or(known_link_status = 'represented_in_openbible_snapshot') AS known, bool_or(eligibility_reason = 'direct_adjacency') AS excluded, bool_or(same_book) AS flagged FROM candidate_pairs GROUP BY ALL),
    t AS (SELECT pair, score, known, excluded, NOT known AND NOT excluded AND NOT flagged AND round(score, 9) >= 0.3 AND n_groups >= 2 AS a FROM en JOIN c USING (pair)), b AS (SELECT pair, row_number() OVER (ORDER BY round(score, 9) DESC, pair) AS r FROM t WHERE NOT known AND NOT excluded AND NOT a)
    SELECT t.pair, round(score, 9) AS score, CASE WHEN a THEN 'A' WHEN r <= 20 THEN 'B' ELSE 'none' END AS tier, CASE WHEN r <= 20 THEN CAST(r AS INTEGER) END AS rank_b FROM t LEFT JOIN b USING (pair)"""
)


@register(_TIER)
def tiering(spark: SparkSession, d: str) -> DataFrame:
    en = N.ensemble_scores(N.group_scores(calibrated(spark, d))).withColumn("score", F.round("score", 9))
    q = lambda e, n: F.bool_or(e).alias(n)
    c = table(spark, d, "candidate_pairs").groupBy(F.lower(F.trim("candidate_pair_id")).alias("pair")).agg(q(F.col("known_link_status") == "represented_in_openbible_snapshot", "known"), q(F.col("eligibility_reason") == "direct_adjacency", "excluded"), q(F.col("same_book"), "flagged"))
    x = en.join(c, "pair").select("pair", "score", F.col("score").alias("ablated_score"), F.lit(0.0).alias("fdr"), F.lit(0.0).alias("q_value"), F.col("n_groups").alias("n_families"), "known", "excluded", "flagged")
    return N.tiers(x, least=0.3, size_b=20)


@register(_ENS + " SELECT pair, round(score, 9) AS score, n_groups, row_number() OVER (ORDER BY round(score, 9) DESC, pair) AS rank FROM en")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    en = N.ensemble_scores(N.group_scores(calibrated(spark, d))).withColumn("score", F.round("score", 9))
    return C.review_queue(en, "score", "pair")


@register(f"WITH {_EV} SELECT * FROM (SELECT pair, evidence_id, score, CAST(row_number() OVER (PARTITION BY pair ORDER BY score DESC, evidence_id) AS INTEGER) AS rank FROM ev) WHERE rank <= 12")
def top_evidence_window(spark: SparkSession, d: str) -> DataFrame:
    return C.top_evidence(evidence(spark, d).select("pair", "evidence_id", "score"), "pair", "score", "evidence_id")


@register(_ENS + ", top AS (SELECT pair, round(score, 9) AS score FROM en ORDER BY 2 DESC, pair LIMIT 50), rq AS (SELECT DISTINCT lower(trim(source_candidate_id)) AS pair FROM selected_m7_pairs) SELECT pair, round(score, 9) AS score, pair IN (SELECT pair FROM rq WHERE pair IS NOT NULL) AS required FROM en WHERE pair IN (SELECT pair FROM top) OR pair IN (SELECT pair FROM rq WHERE pair IS NOT NULL)")
def required_pairs(spark: SparkSession, d: str) -> DataFrame:
    en = N.ensemble_scores(N.group_scores(calibrated(spark, d))).withColumn("score", F.round("score", 9))
    return C.select_pairs(en, table(spark, d, "selected_m7_pairs").select(F.lower(F.trim("source_candidate_id")).alias("pair")), 50)


@register(
    """WITH x AS (SELECT 'membership_positions' AS c, passage_id FROM passage_membership GROUP BY passage_id HAVING min(position_in_passage) <> 1 OR max(position_in_passage) <> count(*) OR count(DISTINCT position_in_passage) <> count(*)),
    r AS (SELECT candidate_pair_id FROM candidate_pairs GROUP BY ALL HAVING count(*) > 1), dg AS (SELECT passage_a_id FROM candidate_pairs WHERE passage_a_id IS NOT NULL AND passage_a_id NOT IN (SELECT passage_id FROM passages WHERE passage_id IS NOT NULL)), t AS (SELECT 1 FROM passages WHERE NOT coalesce(token_count > 0, false))
    SELECT 'dangling_passages' AS "check", (SELECT count(*) FROM dg) AS n_violations UNION ALL SELECT 'membership_positions', (SELECT count(*) FROM x) UNION ALL SELECT 'repeated_pairs', (SELECT count(*) FROM r) UNION ALL SELECT 'token_count', (SELECT count(*) FROM t)"""
)
def violations_report(spark: SparkSession, d: str) -> DataFrame:
    p, c = table(spark, d, "passages"), table(spark, d, "candidate_pairs")
    return K.violations({
        "dangling_passages": K.dangling(c, "passage_a_id", p, "passage_id"), "membership_positions": K.broken_positions(table(spark, d, "passage_membership"), "passage_id", "position_in_passage"),
        "repeated_pairs": K.repeated(c, ["candidate_pair_id"]), "token_count": K.breaks(p, F.col("token_count") > 0),
    })


@register("WITH a AS (SELECT DISTINCT lower(trim(candidate_pair_id)) AS k FROM candidate_pairs), b AS (SELECT DISTINCT lower(trim(source_candidate_id)) AS k FROM selected_m7_pairs WHERE length(trim(source_candidate_id)) > 0) SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'only_record' ELSE 'only_candidate' END AS problem FROM a FULL OUTER JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def review_traceability(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "candidate_pairs").select(F.lower(F.trim("candidate_pair_id")).alias("k"))
    b = table(spark, d, "selected_m7_pairs").select(F.lower(F.trim("source_candidate_id")).alias("k")).filter("length(k) > 0")
    return K.traceable(a, b, "k")


@register("SELECT DISTINCT row_identity, json_extract_string(row_json, '$.direction') AS direction, CAST(json_extract(row_json, '$.raw_score') AS DOUBLE) AS raw_score, u AS shared_id FROM (SELECT row_identity, row_json, unnest(CAST(from_json(expected_shared_ids_json, '[\"VARCHAR\"]') AS VARCHAR[])) AS u FROM selected_m7_pairs)")
def json_evidence(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "selected_m7_pairs")
    x = s.select("row_identity", F.from_json("row_json", "raw_score double, direction string").alias("r"), F.explode(F.from_json("expected_shared_ids_json", "array<string>")).alias("shared_id"))
    return x.select("row_identity", "r.direction", "r.raw_score", "shared_id").distinct()


@register("SELECT DISTINCT x.vec_id AS a, y.vec_id AS b, round(list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) / (sqrt(list_dot_product(x.embedding::DOUBLE[], x.embedding::DOUBLE[])) * sqrt(list_dot_product(y.embedding::DOUBLE[], y.embedding::DOUBLE[]))), 6) AS score FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1")
def embedding_pair_score(spark: SparkSession, d: str) -> DataFrame:
    from passagelink.operators.detectors import cosine

    e = table(spark, d, "embeddings")
    x, y = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("u")), e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("v"))
    return x.join(y, "a").select("a", "b", F.round(cosine(F.col("u"), F.col("v")), 6).alias("score"))


@register("SELECT q, t, score, rank FROM (SELECT x.vec_id AS q, y.vec_id AS t, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS score, CAST(row_number() OVER (PARTITION BY x.vec_id ORDER BY round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) DESC, y.vec_id) AS INTEGER) AS rank FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id WHERE x.vec_id % 50 = 0) WHERE rank <= 10")
def embedding_knn(spark: SparkSession, d: str) -> DataFrame:
    """Exact neighbours of every fiftieth vector against all, the stated query set: blocks of queries visit every vector."""
    from passagelink.operators.dense import exact_knn

    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return exact_knn(e.filter("id % 50 = 0"), e, 10, 6)
