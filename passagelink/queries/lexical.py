"""Lexical features, detectors and retrieval over the words of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagelink.config import Settings
from passagelink.functions.text import length_bucket, text_words
from passagelink.operators import detectors as D
from passagelink.operators import features as X
from passagelink.operators import retrieval as R
from passagelink.operators import scoring as S
from passagelink.queries import register
from passagelink.session import materialize, table

#: Best partners of a query that are kept, least count of a phrase, and which documents are queries: one in so many, against all.
TOP, MIN_COUNT, EVERY = 10, 5, 50
SETTINGS = Settings()

TOK = r"""
tok AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\p{L}\p{M}]+') AS w FROM documents WHERE text IS NOT NULL)),
post AS (SELECT doc_id, word, count(*) AS tf FROM tok GROUP BY doc_id, word),
dfs AS (SELECT word, count(*) AS df, sum(tf) AS cf FROM post GROUP BY word),
nd AS (SELECT count(DISTINCT doc_id) AS n FROM post)
"""
SEQ = ", seq AS (SELECT doc_id, list(word ORDER BY pos) AS s FROM tok GROUP BY doc_id)"


def occ(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text is not null")
    return X.occurrences(docs.select("doc_id", F.posexplode(text_words(F.col("text"))).alias("p", "word")).withColumn("pos", F.col("p") + 1), "doc_id", "pos", "word")


def post(spark: SparkSession, d: str) -> DataFrame:
    return X.postings(occ(spark, d))


def bags(spark: SparkSession, d: str) -> DataFrame:
    """The words of every document with their counts: pid, words, tfs. Texts with the same identifier are one document."""
    docs = table(spark, d, "documents")
    s = docs.filter("text is not null").select(F.col("doc_id").alias("pid"), text_words(F.col("text")).alias("seq"))
    if not docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        s = s.groupBy("pid").agg(F.flatten(F.collect_list("seq")).alias("seq"))
    return S.bags_of(s)


def n_docs(p: DataFrame) -> DataFrame:
    return p.agg(F.count_distinct("pid").alias("n"))


def seqs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text is not null")
    return docs.select(F.col("doc_id").alias("pid"), text_words(F.col("text")).alias("seq")).filter(F.size("seq") > 0)


def _named(df: DataFrame, **names: str) -> DataFrame:
    return df.withColumnsRenamed(names)


@register(f"WITH {TOK} SELECT word, df, CAST(cf AS BIGINT) AS cf, round(ln((1.0 + n) / (1 + df)) + 1, 9) AS idf FROM dfs, nd")
def doc_frequency(spark: SparkSession, d: str) -> DataFrame:
    p = post(spark, d)
    df = p.groupBy(F.col("feature").alias("word")).agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    return df.crossJoin(F.broadcast(n_docs(p))).select("word", "df", "cf", F.round(X.smooth_idf(F.col("df"), F.col("n")), 9).alias("idf"))


_VOCAB = f"""WITH {TOK},
m AS (SELECT doc_id, coalesce(source, '') AS book, coalesce(lang, '') AS genre FROM documents),
v AS (SELECT word AS feature, count(*) AS corpus_frequency, count(DISTINCT tok.doc_id) AS document_frequency, count(DISTINCT book) AS book_frequency, count(DISTINCT genre) AS genre_frequency FROM tok JOIN m USING (doc_id) GROUP BY word),
vf AS (SELECT v.*, round(ln((1.0 + n) / (1 + document_frequency)) + 1, 9) AS idf, corpus_frequency <= 3 AS is_rare, document_frequency / CAST(n AS DOUBLE) >= 0.1 AS is_high_frequency,
  document_frequency / CAST(n AS DOUBLE) >= 0.05 AND corpus_frequency >= 20 AS is_formulaic FROM v, (SELECT count(*) AS n FROM m) nm)
"""


def _passages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("pid"), F.coalesce("source", F.lit("")).alias("book"), F.coalesce("lang", F.lit("")).alias("genre"))


@register(_VOCAB + "SELECT * FROM vf")
def feature_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return X.vocabulary(occ(spark, d), _passages(spark, d)).withColumn("idf", F.round("idf", 9))


@register(_VOCAB + "SELECT is_rare, is_high_frequency, is_formulaic, count(*) AS n_features, CAST(sum(corpus_frequency) AS BIGINT) AS n_tokens FROM vf GROUP BY ALL")
def vocab_flags(spark: SparkSession, d: str) -> DataFrame:
    v = X.vocabulary(occ(spark, d), _passages(spark, d))
    return v.groupBy("is_rare", "is_high_frequency", "is_formulaic").agg(F.count("*").alias("n_features"), F.sum("corpus_frequency").alias("n_tokens"))


@register(
    _VOCAB
    + """SELECT doc_id, count(DISTINCT word) AS distinct_features, count(*) AS sequence_length, count(DISTINCT CASE WHEN is_rare THEN word END) AS rare_features,
    count(DISTINCT CASE WHEN is_formulaic THEN word END) AS formulaic_features, sha256(string_agg(word, '␟' ORDER BY pos)) AS sequence_digest
    FROM tok JOIN vf ON vf.feature = tok.word GROUP BY doc_id"""
)
def passage_feature_stats(spark: SparkSession, d: str) -> DataFrame:
    o = occ(spark, d)
    return _named(X.feature_statistics(o, X.vocabulary(o, _passages(spark, d))), pid="doc_id")


@register(
    f"""WITH {TOK}, x AS (SELECT d.lang, count(*) AS n_tokens, count(DISTINCT word) AS n_types FROM tok JOIN documents d USING (doc_id) GROUP BY d.lang),
    h AS (SELECT d.lang, count(DISTINCT word) AS n_hapax FROM tok JOIN dfs USING (word) JOIN documents d USING (doc_id) WHERE cf = 1 GROUP BY d.lang)
    SELECT coalesce(x.lang, '') AS lang, n_tokens, n_types, coalesce(n_hapax, 0) AS n_hapax FROM x LEFT JOIN h ON x.lang IS NOT DISTINCT FROM h.lang"""
)
def hapax_profile(spark: SparkSession, d: str) -> DataFrame:
    o = occ(spark, d)
    hapax = o.groupBy("feature").agg(F.count("*").alias("cf"))
    lang = table(spark, d, "documents").select(F.col("doc_id").alias("pid"), F.coalesce("lang", F.lit("")).alias("lang"))
    j = o.join(hapax, "feature").join(lang, "pid")
    return j.groupBy("lang").agg(F.count("*").alias("n_tokens"), F.count_distinct("feature").alias("n_types"), F.count_distinct(F.when(F.col("cf") == 1, F.col("feature"))).alias("n_hapax"))


@register(
    f"""WITH {TOK}, l AS (SELECT doc_id, count(*) AS len FROM tok GROUP BY doc_id)
    SELECT coalesce(d.source, '') AS source, count(*) AS n_docs, quantile_cont(len, 0.25) AS q25, quantile_cont(len, 0.5) AS q50, quantile_cont(len, 0.75) AS q75, quantile_cont(len, 0.95) AS q95
    FROM l JOIN documents d USING (doc_id) GROUP BY ALL"""
)
def length_quantiles(spark: SparkSession, d: str) -> DataFrame:
    s = seqs(spark, d).select("pid", F.size("seq").alias("len")).join(_passages(spark, d), "pid")
    q = lambda p: F.percentile("len", F.lit(p)).alias(f"q{int(p * 100)}")
    return s.groupBy(F.col("book").alias("source")).agg(F.count("*").alias("n_docs"), q(0.25), q(0.5), q(0.75), q(0.95))


@register(f"WITH {TOK} SELECT CASE WHEN len <= 5 THEN 'short' WHEN len <= 15 THEN 'medium' ELSE 'long' END AS bucket, count(*) AS n_docs FROM (SELECT doc_id, count(*) AS len FROM tok GROUP BY doc_id) GROUP BY ALL")
def length_buckets(spark: SparkSession, d: str) -> DataFrame:
    return seqs(spark, d).groupBy(length_bucket(F.size("seq")).alias("bucket")).agg(F.count("*").alias("n_docs"))


_GRAMS = (
    f"WITH {TOK}{SEQ},"
    + """ g AS (SELECT doc_id, 2 AS size, unnest(list_transform(range(1, len(s)), lambda i: s[i] || '␟' || s[i + 1])) AS phrase FROM seq
  UNION ALL SELECT doc_id, 3, unnest(list_transform(range(1, len(s) - 1), lambda i: s[i] || '␟' || s[i + 1] || '␟' || s[i + 2])) FROM seq),
gc AS (SELECT size, phrase, count(*) AS count, count(DISTINCT doc_id) AS df FROM g GROUP BY ALL)
"""
)


@register(_GRAMS + f"SELECT size, phrase, count, df FROM gc WHERE count >= {MIN_COUNT}")
def ngram_counts(spark: SparkSession, d: str) -> DataFrame:
    return X.phrase_counts(seqs(spark, d)).filter(F.col("count") >= MIN_COUNT)


@register(
    f"WITH {TOK}{SEQ},"
    + f"""g AS (SELECT doc_id, unnest(list_transform(range(1, len(s) - 1), lambda i: s[i] || '␟' || s[i + 2])) AS phrase FROM seq
    UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(s) - 2), lambda i: s[i] || '␟' || s[i + 3])) FROM seq)
    SELECT phrase, count(*) AS count, count(DISTINCT doc_id) AS df, 1.0::DOUBLE / count(*) AS weight FROM g GROUP BY phrase HAVING count(*) >= {MIN_COUNT}"""
)
def skipgram_counts(spark: SparkSession, d: str) -> DataFrame:
    return X.skipgram_weights(seqs(spark, d), 2, MIN_COUNT)


_ASSOC = _GRAMS + (
    f""", u AS (SELECT word, count(*) AS c FROM tok GROUP BY word), tot AS (SELECT CAST(sum(len(s)) AS DOUBLE) AS total, CAST(sum(len(s) - 1) AS DOUBLE) AS slots FROM seq),
f1 AS (SELECT s AS word, count(*) AS c FROM (SELECT unnest(s[1:len(s) - 1]) AS s FROM seq) GROUP BY s), f2 AS (SELECT s AS word, count(*) AS c FROM (SELECT unnest(s[2:]) AS s FROM seq) GROUP BY s),
p AS (SELECT gc.*, string_split(phrase, '␟') AS f FROM gc WHERE count >= {MIN_COUNT}),
q AS (SELECT p.*, least(log2(p.count::DOUBLE) + (size - 1) * log2(total) - log2(a.c::DOUBLE) - log2(b.c::DOUBLE) - coalesce(log2(t.c::DOUBLE), 0), 16.0) AS pmi, x.c::DOUBLE AS r, y.c::DOUBLE AS k, slots AS m
  FROM p CROSS JOIN tot JOIN u a ON a.word = f[1] JOIN u b ON b.word = f[2] LEFT JOIN u t ON t.word = f[3] LEFT JOIN f1 x ON x.word = f[1] LEFT JOIN f2 y ON y.word = f[2]),
g2 AS (SELECT *, CASE WHEN size = 2 THEN greatest(0.0, (CASE WHEN count >= r * k / m THEN 2 ELSE -2 END) * (count * ln(count / (r * k / m))
   + CASE WHEN r - count > 0 THEN (r - count) * ln((r - count) / (r * (m - k) / m)) ELSE 0 END + CASE WHEN k - count > 0 THEN (k - count) * ln((k - count) / ((m - r) * k / m)) ELSE 0 END
   + CASE WHEN m - r - k + count > 0 THEN (m - r - k + count) * ln((m - r - k + count) / ((m - r) * (m - k) / m)) ELSE 0 END)) ELSE 0.0 END AS g2 FROM q)
"""
)


@register(_ASSOC + "SELECT phrase, count, round(pmi, 6) AS pmi FROM g2 WHERE size = 2")
def bigram_pmi(spark: SparkSession, d: str) -> DataFrame:
    return X.phrase_weights(seqs(spark, d), (2, 3), MIN_COUNT).filter("size = 2").select("phrase", "count", F.round("pmi", 6).alias("pmi"))


@register(_ASSOC + "SELECT phrase, count, round(g2, 4) AS g2 FROM g2 WHERE size = 2")
def bigram_g2(spark: SparkSession, d: str) -> DataFrame:
    return X.phrase_weights(seqs(spark, d), (2, 3), MIN_COUNT).filter("size = 2").select("phrase", "count", F.round("g2", 4).alias("g2"))


@register(_ASSOC + "SELECT size, phrase, count, df, round((greatest(0.0, pmi) + ln(1 + g2)) / (1 + ln(count)), 6) AS weight FROM g2")
def phrase_weights(spark: SparkSession, d: str) -> DataFrame:
    return X.phrase_weights(seqs(spark, d), (2, 3), MIN_COUNT).select("size", "phrase", "count", "df", F.round("weight", 6).alias("weight"))


@register(
    _GRAMS
    + """, t AS (SELECT greatest(5, ceil(count(*) * 0.01)) AS least FROM seq), hi AS (SELECT phrase FROM gc, t WHERE df >= least), own AS (SELECT DISTINCT doc_id, phrase FROM g),
    c AS (SELECT doc_id, count(*) AS n_features, count(hi.phrase) AS n_common FROM own LEFT JOIN hi USING (phrase) GROUP BY doc_id)
    SELECT seq.doc_id, coalesce(n_features, 0) AS n_features, coalesce(n_common, 0) AS n_common, coalesce(n_common >= 1 AND n_common >= 0.2 * n_features, false) AS is_formulaic FROM seq LEFT JOIN c USING (doc_id)"""
)
def formulaic_docs(spark: SparkSession, d: str) -> DataFrame:
    return _named(X.formulaic_passages(seqs(spark, d), min_count=5), pid="doc_id")


# --- detectors: every query document against all documents, over all words

_PROF = (
    f"WITH {TOK.replace('post AS (', 'post AS MATERIALIZED (')}"
    """, f AS MATERIALIZED (SELECT word, df, cf, ln((1.0 + n) / (1 + df)) + 1 AS idf, ln(1 + (n - df + 0.5) / (df + 0.5)) AS bidf FROM dfs, nd),
l AS (SELECT doc_id, sum(tf)::DOUBLE AS len FROM post GROUP BY doc_id), al AS (SELECT avg(len) AS avg_len FROM l),
pf AS MATERIALIZED (SELECT p.doc_id, word, tf, df, cf, idf, (1 + ln(tf)) * idf / sqrt(sum(((1 + ln(tf)) * idf) * ((1 + ln(tf)) * idf)) OVER (PARTITION BY p.doc_id)) AS w,
  tf / sqrt(sum(tf * tf) OVER (PARTITION BY p.doc_id)) AS c, bidf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)) AS bm FROM post p JOIN f USING (word) JOIN l USING (doc_id), al),
sz AS (SELECT doc_id, count(*) AS n, sum(idf * tf) AS s FROM pf GROUP BY doc_id)
"""
)


def _scores(name: str, source: str = "pf") -> str:
    """SQL of the scores of all query documents, as the relation ``name``."""
    return f""", {name}_m AS (SELECT x.doc_id AS q, y.doc_id AS t, count(*) AS k, sum(x.w * y.w) AS tfidf, sum(x.c * y.c) AS count_cosine, sum(y.bm) AS bm25,
  coalesce(sum(1.0::DOUBLE / x.cf) FILTER (x.cf <= 3), 0) AS rare, sum(x.idf * least(x.tf, y.tf)) AS low FROM {source} x JOIN {source} y ON x.word = y.word AND x.doc_id <> y.doc_id WHERE x.doc_id % {EVERY} = 0 GROUP BY ALL),
{name} AS (SELECT q, t, k::DOUBLE AS overlap, tfidf, count_cosine, bm25, rare, k / CAST(a.n + b.n - k AS DOUBLE) AS jaccard, low / (a.s + b.s - low) AS weighted_jaccard FROM {name}_m JOIN sz a ON a.doc_id = q JOIN sz b ON b.doc_id = t)
"""


DECIMALS = {"bm25": 6, "phrase": 6}


def _ranked(score: str, source: str = "sc", k: int = TOP) -> str:
    d = DECIMALS.get(score, 9)
    return f"SELECT q, t, score, rank FROM (SELECT q, t, round({score}, {d}) AS score, CAST(row_number() OVER (PARTITION BY q ORDER BY round({score}, {d}) DESC, t) AS INTEGER) AS rank FROM {source} WHERE round({score}, {d}) > 0) WHERE rank <= {k}"


def asks() -> Column:
    """Whether a document is a query."""
    return F.col("pid") % EVERY == 0


def query_docs(p: DataFrame) -> DataFrame:
    """The documents that are queries: those whose id is divisible by EVERY."""
    return p.filter(asks()).select("pid").distinct()


def profiled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings with weights, the number of documents, and the queries; the texts are read and counted once."""
    p = materialize(post(spark, d))
    return S.profiles(p, n_docs(p), SETTINGS.bm25_k1, SETTINGS.bm25_b), n_docs(p), query_docs(p)


def _best(spark: SparkSession, d: str, score: str) -> DataFrame:
    return S.best_partners(bags(spark, d), asks(), (score,), TOP, DECIMALS, k1=SETTINGS.bm25_k1, b=SETTINGS.bm25_b).drop("detector")


_TOPS = {"jaccard_topk": "jaccard", "weighted_jaccard_topk": "weighted_jaccard", "tfidf_topk": "tfidf", "bm25_topk": "bm25", "rare_overlap_topk": "rare", "overlap_topk": "overlap", "count_cosine_topk": "count_cosine"}


def _register_tops() -> None:
    def one(score: str):
        def run(spark: SparkSession, d: str) -> DataFrame:
            return _best(spark, d, score)

        run.__doc__ = f"The best partners of every query document among all documents by {score}, over all words."
        return run

    for name, score in _TOPS.items():
        register(_PROF + _scores("sc") + _ranked(score), name)(one(score))


_register_tops()


@register(_PROF + "SELECT doc_id, word, round(w, 9) AS w FROM pf")
def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    prof, _, _ = profiled(spark, d)
    return prof.select(F.col("pid").alias("doc_id"), F.col("feature").alias("word"), F.round("w", 9).alias("w"))


_OWN = """, ow AS MATERIALIZED (SELECT DISTINCT g.doc_id, phrase, (greatest(0.0, pmi) + ln(1 + g2)) / (1 + ln(count)) AS w FROM g JOIN g2 USING (phrase))"""


def phrases(s: DataFrame) -> DataFrame:
    """The weighted phrases of every document: pid, phrase, weight, distinct."""
    w = X.phrase_weights(s, (2, 3), MIN_COUNT).select("phrase", "weight")
    return s.select("pid", F.explode(F.array_distinct(F.concat(X.ngrams(F.col("seq"), 2), X.ngrams(F.col("seq"), 3)))).alias("phrase")).join(w, "phrase")


@register(
    _ASSOC
    + _OWN
    + f""", pr AS (SELECT x.doc_id AS q, y.doc_id AS t, sum(x.w) AS phrase FROM ow x JOIN ow y ON x.phrase = y.phrase AND x.doc_id <> y.doc_id WHERE x.doc_id % {EVERY} = 0 GROUP BY ALL) """
    + _ranked("phrase", "pr")
)
def phrase_overlap_topk(spark: SparkSession, d: str) -> DataFrame:
    own = materialize(phrases(materialize(seqs(spark, d))))
    x = own.filter(F.col("pid") % EVERY == 0).select(F.col("pid").alias("q"), "phrase", "weight")
    both = x.join(own.select(F.col("pid").alias("t"), "phrase"), "phrase").filter("q <> t").groupBy("q", "t").agg(F.sum("weight").alias("score"))
    return R.top_k(both, TOP, 6)


_PROPOSED = _scores("cp", "cf") + (
    ", rp AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS detector, * FROM ({_ranked(n, 'cp', SETTINGS.proposal_k)})" for n in S.PROPOSERS)
    + f"""), up AS (SELECT q, t, rrf, proposals FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rrf DESC, t) AS r FROM (SELECT q, t, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, count(*) AS proposals FROM rp GROUP BY q, t)) WHERE r <= {SETTINGS.proposal_k})
"""
)
_CF = f", cf AS (SELECT pf.* FROM pf, nd WHERE df <= n * {SETTINGS.proposal_df_ratio})"


def _proposals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Proposed partners, postings with weights, computed where they are used, and the queries."""
    b = materialize(bags(spark, d))
    p = S.unpacked(b)
    prof = S.profiles(p, n_docs(p), SETTINGS.bm25_k1, SETTINGS.bm25_b)
    return materialize(S.propose(b, asks(), n_docs(p), SETTINGS.proposal_k, SETTINGS.proposal_df_ratio, DECIMALS)), prof, query_docs(p)


@register(_PROF + _CF + _PROPOSED + _scores("sc") + "SELECT q, t, rrf, proposals, round(jaccard, 9) AS jaccard, round(weighted_jaccard, 9) AS weighted_jaccard, round(tfidf, 9) AS tfidf, round(bm25, 6) AS bm25, round(rare, 9) AS rare FROM up JOIN sc USING (q, t)")
def proposed_scores(spark: SparkSession, d: str) -> DataFrame:
    """The proposed partners of every query, proposed by words of at most a quarter of the documents and scored over all words."""
    up, prof, queries = _proposals(spark, d)
    sc = S.scores(prof, queries, pairs=up)
    return up.join(sc, ["q", "t"]).select("q", "t", "rrf", "proposals", *[F.round(n, DECIMALS.get(n, 9)).alias(n) for n in ("jaccard", "weighted_jaccard", "tfidf", "bm25", "rare")])


def reranked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Ranks by nine detectors and their fusion for every query. Word lengths and last letters stand in for parts of speech and forms."""
    b = materialize(bags(spark, d))
    up = materialize(S.propose(b, asks(), n_docs(b), SETTINGS.proposal_k, SETTINGS.proposal_df_ratio, DECIMALS))
    s = materialize(seqs(spark, d))
    own = materialize(phrases(s))
    pairs = S.pair_scores(b, up, SETTINGS.bm25_k1, SETTINGS.bm25_b).join(S.phrase_scores(up, own), ["q", "t"], "left")
    layers = [F.transform("seq", lambda w: F.least(F.length(w), F.lit(9)).cast("string")), F.transform("seq", lambda w: F.right(w, F.lit(1)))]
    df = S.unpacked(b).groupBy("feature").agg(F.count("*").alias("df"))
    idf = df.crossJoin(X.one_row(n_docs(b))).select("feature", X.smooth_idf(F.col("df"), F.col("n")).alias("idf"))
    return S.rerank(pairs, s, layers, idf, SETTINGS.rerank_k, SETTINGS.persisted_k, SETTINGS.rerank_k)


@register()
def retrieval_fused(spark: SparkSession, d: str) -> DataFrame:
    """The best partners of every query by fusion of nine detectors, one a family. Alignments aren't SQL; tested on small texts."""
    return reranked(spark, d)[1]


@register()
def retrieval_ranks(spark: SparkSession, d: str) -> DataFrame:
    """The rank of every proposed partner by each of the nine detectors."""
    return reranked(spark, d)[0]


# --- fusion

_RANKS = _PROF + _scores("sc") + ", rk AS (" + " UNION ALL ".join(f"SELECT '{n}' AS detector, * FROM ({_ranked(n)})" for n in S.PROPOSERS) + ")\n"


def rankings(spark: SparkSession, d: str) -> DataFrame:
    """The rankings of every query document by the four proposing detectors, over all words, from one join."""
    return materialize(S.best_partners(bags(spark, d), asks(), S.PROPOSERS, TOP, DECIMALS, k1=SETTINGS.bm25_k1, b=SETTINGS.bm25_b))


FAMILY = {n: S.FAMILIES[n] for n in S.PROPOSERS}


@register(_RANKS + "SELECT q, t, count(*) AS n_detectors, string_agg(detector, ',' ORDER BY detector) AS detectors, CAST(min(rank) AS INTEGER) AS best_rank FROM rk GROUP BY q, t")
def candidate_union(spark: SparkSession, d: str) -> DataFrame:
    r = rankings(spark, d)
    return r.groupBy("q", "t").agg(F.count("*").alias("n_detectors"), F.array_join(F.sort_array(F.collect_list("detector")), ",").alias("detectors"), F.min("rank").alias("best_rank"))


@register(_RANKS + "SELECT q, t, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, count(*) AS detectors FROM rk GROUP BY q, t")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return R.fuse(rankings(spark, d)).withColumn("score", F.round("score", 9))


@register(
    _RANKS
    + """SELECT q, t, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, count(*) AS detectors FROM (SELECT *, row_number() OVER (PARTITION BY q, t, CASE detector WHEN 'rare' THEN 'rare' WHEN 'overlap' THEN 'set' ELSE 'vector' END ORDER BY rank, detector) AS f FROM rk) WHERE f = 1 GROUP BY q, t"""
)
def rrf_best_family(spark: SparkSession, d: str) -> DataFrame:
    return R.fuse(rankings(spark, d), families=FAMILY, best_of_family=True).withColumn("score", F.round("score", 9))


@register(_RANKS + "SELECT q, t, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, count(*) AS detectors FROM rk WHERE detector <> 'tfidf' GROUP BY q, t")
def rrf_ablation(spark: SparkSession, d: str) -> DataFrame:
    return R.fuse(rankings(spark, d), without=("tfidf",)).withColumn("score", F.round("score", 9))


_ABL = {"remove_tfidf": ("tfidf",), "remove_rare_evidence": ("rare",)}


@register(
    _RANKS
    + """, fu AS (SELECT q, t, CAST(row_number() OVER (PARTITION BY q ORDER BY round(s, 12) DESC, t) AS INTEGER) AS full_rank FROM (SELECT q, t, sum(1.0::DOUBLE / (60 + rank)) AS s FROM rk GROUP BY q, t)),
    a1 AS (SELECT 'remove_tfidf' AS ablation, q, t, CAST(row_number() OVER (PARTITION BY q ORDER BY round(s, 12) DESC, t) AS INTEGER) AS ablated_rank FROM (SELECT q, t, sum(1.0::DOUBLE / (60 + rank)) AS s FROM rk WHERE detector <> 'tfidf' GROUP BY q, t)),
    a2 AS (SELECT 'remove_rare_evidence' AS ablation, q, t, CAST(row_number() OVER (PARTITION BY q ORDER BY round(s, 12) DESC, t) AS INTEGER) AS ablated_rank FROM (SELECT q, t, sum(1.0::DOUBLE / (60 + rank)) AS s FROM rk WHERE detector <> 'rare' GROUP BY q, t)),
    ab AS (SELECT unnest(['remove_tfidf', 'remove_rare_evidence']) AS ablation)
    SELECT ab.ablation, fu.q, fu.t, full_rank, x.ablated_rank, full_rank IS DISTINCT FROM x.ablated_rank AS changed FROM fu CROSS JOIN ab LEFT JOIN (SELECT * FROM a1 UNION ALL SELECT * FROM a2) x ON x.ablation = ab.ablation AND x.q = fu.q AND x.t = fu.t"""
)
def rank_ablation(spark: SparkSession, d: str) -> DataFrame:
    return R.rank_ablations(rankings(spark, d), _ABL)


@register(_RANKS + "SELECT DISTINCT least(q, t) AS a, greatest(q, t) AS b FROM rk WHERE q <> t")
def canonical_pairs(spark: SparkSession, d: str) -> DataFrame:
    return R.neighbour_pairs(rankings(spark, d))


@register(
    _RANKS
    + """, fz AS (SELECT q, t, sum(1.0::DOUBLE / (60 + rank)) AS s FROM rk GROUP BY q, t)
    SELECT least(q, t) AS a, greatest(q, t) AS b, round(max(s), 9) AS best, round(max(CASE WHEN q < t THEN s END), 9) AS forward, round(max(CASE WHEN q > t THEN s END), 9) AS backward FROM fz GROUP BY ALL"""
)
def directional_merge(spark: SparkSession, d: str) -> DataFrame:
    m = R.merge_directions(R.fuse(rankings(spark, d)))
    return m.select("a", "b", *[F.round(c, 9).alias(c) for c in ("best", "forward", "backward")])


_RARE = f"WITH {TOK}, c AS (SELECT p.*, cf FROM post p JOIN dfs USING (word) WHERE cf <= 3), pr AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(1.0::DOUBLE / x.cf) AS score FROM c x JOIN c y ON x.word = y.word AND x.doc_id < y.doc_id GROUP BY ALL)"


@register(
    _RARE
    + """, ow AS MATERIALIZED (SELECT doc_id, word, list(pos ORDER BY pos) AS p FROM tok GROUP BY doc_id, word), top AS MATERIALIZED (SELECT a, b FROM pr WHERE score >= 1.0),
    left_side AS MATERIALIZED (SELECT a, b, x.word, x.p FROM top JOIN ow x ON x.doc_id = a)
    SELECT a, b, x.word AS feature, array_to_string(x.p, ',') AS pos_a, array_to_string(y.p, ',') AS pos_b FROM left_side x JOIN ow y ON y.doc_id = b AND y.word = x.word"""
)
def shared_evidence(spark: SparkSession, d: str) -> DataFrame:
    o = occ(spark, d)
    pairs = D.rare_pairs(X.postings(o)).filter("score >= 1.0")
    e = D.shared_evidence(o, pairs)
    return e.select("a", "b", "feature", F.array_join(F.transform("pos_a", lambda x: x.cast("string")), ",").alias("pos_a"), F.array_join(F.transform("pos_b", lambda x: x.cast("string")), ",").alias("pos_b"))


_ALL_JACCARD = (
    f"WITH {TOK}, sz AS (SELECT doc_id, count(*) AS n FROM post GROUP BY doc_id),"
    " pr AS (SELECT a, b, k / CAST(x.n + y.n - k AS DOUBLE) AS score FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM post x JOIN post y ON x.word = y.word AND x.doc_id < y.doc_id GROUP BY ALL) JOIN sz x ON x.doc_id = a JOIN sz y ON y.doc_id = b)"
)


def _classes(s: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Documents with equal arrays ``key`` as one: members(pid, cls), and the rows of ``s`` whose pid stands for its class.
    Both are written once, as the words of a text are dear."""
    s = materialize(s.withColumn("h", F.sha2(F.array_join(key, X.SEP), 256)))
    members = materialize(s.join(s.groupBy("h").agg(F.min("pid").alias("cls")), "h").select("pid", "cls"))
    return members, s.join(members.filter("pid = cls").select("pid"), "pid", "left_semi").drop("h")


@register(_ALL_JACCARD + "SELECT a, b, round(score, 9) AS score FROM pr WHERE score >= 0.8")
def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of documents whose word sets have a Jaccard similarity of at least 0.8, over all words. Equal sets are
    one class; classes are joined by prefixes without a limit on document frequency and verified on the whole sets."""
    s = seqs(spark, d).select("pid", F.array_sort(F.array_distinct("seq")).alias("tokens"))
    members, sets = _classes(s, "tokens")
    pairs = D.similar_sets(sets, 0.8).withColumn("score", F.round("score", 9))
    return D.expand_classes(members, pairs, score=F.lit(1.0))


@register("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id, count(*) OVER (PARTITION BY text) AS class_size FROM documents WHERE text IS NOT NULL")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """One row per document: the smallest document with the same text, and how many there are. Classes are counted by
    partial aggregation, then joined back, so a class of any size is no one task's group."""
    t = table(spark, d, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    cls = t.groupBy("h").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return t.join(cls, "h").select("doc_id", "class_id", "class_size")


def proposed_pairs(spark: SparkSession, d: str, k: int, rare: int) -> DataFrame:
    """The unordered pairs of every query and its ``k`` best proposed partners, and of every document and the ``rare`` best
    of those it shares rare words with: a, b."""
    up, prof, _ = _proposals(spark, d)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("rrf"), "t"))
    near = up.withColumn("r", rank).filter(F.col("r") <= k).select("q", "t")
    if rare:
        near = near.unionByName(R.top_k(R.both_ways(D.rare_pairs(prof.select("pid", "feature", "tf"))), rare).select("q", "t"))
    return materialize(R.neighbour_pairs(near))


def _proposed(spark: SparkSession, d: str, k: int, rare: int) -> DataFrame:
    """Proposed pairs with both sequences, for detectors that need them."""
    pairs = proposed_pairs(spark, d, k, rare)
    s = seqs(spark, d)
    return pairs.join(s.select(F.col("pid").alias("a"), F.col("seq").alias("sa")), "a").join(s.select(F.col("pid").alias("b"), F.col("seq").alias("sb")), "b")


@register()
def lcs_rerank(spark: SparkSession, d: str) -> DataFrame:
    """All proposed partners of every query, reranked by longest common subsequence. Python UDF: tested against brute force."""
    x = _proposed(spark, d, SETTINGS.proposal_k, 5).withColumn("n", D.lcs_length("sa", "sb")).withColumn("score", D.lcs_score(F.col("n"), F.col("sa"), F.col("sb")))
    return R.top_k(R.both_ways(x), TOP, 9)


@register()
def edit_distance_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Proposed pairs and all near-exact copies, with their token edit distance and whether they are near-exact copies.

    The copies come from an exact join of whole texts, equal texts being one class; no proposal is asked for them.
    """
    members, texts = _classes(seqs(spark, d), "seq")
    found = D.expand_classes(members, D.similar_sequences(texts, 0.95), edits=F.lit(0)).withColumn("near_exact", F.lit(True))
    x = _proposed(spark, d, 5, 5).withColumn("edits", D.token_edits("sa", "sb"))
    x = x.select("a", "b", "edits", D.near_exact(F.col("edits"), F.col("sa"), F.col("sb")).alias("near_exact"))
    return found.unionByName(x.filter("not near_exact"))


@register()
def alignment_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The best proposed partners of every query with the global alignment similarity of their words."""
    return _proposed(spark, d, SETTINGS.rerank_k, 3).select("a", "b", F.round(D.aligned_similarity("sa", "sb"), 9).alias("score"))


@register(
    "SELECT c_custkey AS a, n_nationkey AS b, round(1.0::DOUBLE * CASE WHEN c_acctbal < 0 THEN 0.5 ELSE 1 END * CASE WHEN n_regionkey = 0 THEN 0.5 ELSE 1 END * CASE WHEN length(c_name) < 5 THEN 0.25 ELSE 1 END, 9) AS score FROM customer JOIN nation ON c_nationkey = n_nationkey"
)
def penalties(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    s = R.penalized(F.lit(1.0), F.col("c_acctbal") < 0, F.col("n_regionkey") == 0, F.length("c_name") < 5)
    return j.select(F.col("c_custkey").alias("a"), F.col("n_nationkey").alias("b"), F.round(s, 9).alias("score"))
