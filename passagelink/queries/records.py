"""Identities of records, forms of words, and round trips through the sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagelink.functions import text as X
from passagelink.functions.identity import content_id
from passagelink.operators import benchmark as B
from passagelink.operators import features as W
from passagelink.queries import lexical as L
from passagelink.queries import register
from passagelink.session import shared_dir, table
from passagelink.sources import files, sinks

# --- identities: name, prefix, table, fields of the payload

_IDENTITIES: dict[str, tuple[str, str, dict[str, str]]] = {
    "record_ids": ("R_", "positive_controls", {"locator": "source_record_locator", "reference_a": "reference_a", "reference_b": "reference_b", "source": "source_id", "version": "source_version"}),
    "relationship_ids": ("L_", "positive_controls", {"class": "relationship_class", "from": "reference_a", "to": "reference_b"}),
    "endpoint_ids": ("E_", "candidate_pairs", {"pair": "canonical_unordered_pair_id", "passage": "passage_a_id"}),
    "mapping_ids": ("M_", "candidate_pairs", {"passage": "passage_b_id", "profile": "analysis_profile", "quality": "mapping_quality"}),
    "representation_ids": ("S_", "candidate_pairs", {"corpus_pair": "corpus_pair", "granularity": "granularity", "profile": "analysis_profile"}),
    "ranking_ids": ("K_", "neighbor", {"query": "query_id", "target": "target_id"}),
    "evidence_ids": ("V_", "evidence_identity", {"artifact": "source_artifact_sha256", "detector": "detector_id", "pair": "candidate_pair_id"}),
}


def _register_identities() -> None:
    def one(prefix: str, source: str, fields: dict[str, str]):
        def run(spark: SparkSession, d: str) -> DataFrame:
            return table(spark, d, source).select(*fields.values()).distinct().select(*fields.values(), content_id(prefix, {k: F.col(c) for k, c in fields.items()}).alias("identity"))

        run.__doc__ = f"The content identity of every distinct ({', '.join(fields.values())}) of {source}; nulls are part of it."
        return run

    for name, (prefix, source, fields) in _IDENTITIES.items():
        payload = "{" + ", ".join(f"'{k}': {fields[k]}" for k in sorted(fields)) + "}"
        cols = ", ".join(fields.values())
        register(f"SELECT {cols}, '{prefix}' || sha256(CAST(to_json({payload}) AS VARCHAR)) AS identity FROM (SELECT DISTINCT {cols} FROM {source})", name)(one(prefix, source, fields))


_register_identities()


@register(
    """WITH m AS (SELECT DISTINCT passage_id, position_in_passage AS position, coalesce(token_id, '') AS token_id FROM passage_membership), t AS (SELECT passage_id, list(token_id ORDER BY position, token_id) AS tokens FROM m GROUP BY passage_id),
    p AS (SELECT DISTINCT passage_id, corpus, analysis_profile, granularity FROM passages)
    SELECT passage_id, corpus, analysis_profile, granularity, 'P_' || sha256(CAST(to_json({'corpus': corpus, 'granularity': granularity, 'profile': analysis_profile, 'tokens': tokens}) AS VARCHAR)) AS identity FROM p JOIN t USING (passage_id)"""
)
def passage_ids(spark: SparkSession, d: str) -> DataFrame:
    """The content identity of every passage from its scope and ordered tokens; null tokens count as empty."""
    m = table(spark, d, "passage_membership").select("passage_id", F.col("position_in_passage").alias("position"), F.coalesce("token_id", F.lit("")).alias("token_id")).distinct()
    t = m.groupBy("passage_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "token_id"))), lambda x: x["token_id"]).alias("tokens"))
    p = table(spark, d, "passages").select("passage_id", "corpus", "analysis_profile", "granularity").distinct()
    fields = {"corpus": F.col("corpus"), "granularity": F.col("granularity"), "profile": F.col("analysis_profile"), "tokens": F.col("tokens")}
    return p.join(t, "passage_id").select("passage_id", "corpus", "analysis_profile", "granularity", content_id("P_", fields).alias("identity"))


_WS = f"WITH {L.TOK}, ws AS (SELECT DISTINCT word FROM tok)"


def _words(spark: SparkSession, d: str) -> DataFrame:
    return L.occ(spark, d).select(F.col("feature").alias("word")).distinct()


@register(_WS + " SELECT word, 'F_' || sha256(CAST(to_json({'family': 'lemma', 'value': word}) AS VARCHAR)) AS identity, 'documents:lemma:' || word AS namespaced FROM ws")
def feature_ids(spark: SparkSession, d: str) -> DataFrame:
    """Identity and namespaced name of every word as a feature."""
    return _words(spark, d).select("word", content_id("F_", {"family": F.lit("lemma"), "value": F.col("word")}).alias("identity"), X.namespaced("documents", "lemma", F.col("word")).alias("namespaced"))


# --- forms of words


@register(_WS + r" SELECT word, replace(nfc_normalize(word), chr(847), '') AS lemma FROM ws WHERE regexp_matches(word, '[\x{05D0}-\x{05EA}]')")
def hebrew_lemmas(spark: SparkSession, d: str) -> DataFrame:
    return _words(spark, d).filter(F.col("word").rlike("[א-ת]")).select("word", X.hebrew_lemma(F.col("word")).alias("lemma"))


@register(_WS + r" SELECT word, nfc_normalize(word) AS lemma FROM ws WHERE regexp_matches(word, '[\x{0370}-\x{03FF}]')")
def greek_lemmas(spark: SparkSession, d: str) -> DataFrame:
    return _words(spark, d).filter(F.col("word").rlike("[Ͱ-Ͽ]")).select("word", X.greek_lemma(F.col("word")).alias("lemma"))


@register("""SELECT doc_id, CASE WHEN lang <> '' THEN '{"gender":"' || lower(lang) || '","type":"' || lower(doc_kind) || '"}' ELSE '{"type":"' || lower(doc_kind) || '"}' END AS morphology FROM documents WHERE doc_kind IS NOT NULL""")
def morphology_json(spark: SparkSession, d: str) -> DataFrame:
    """Coarse morphology of a JSON object; language and kind of a document stand in for two of its keys, and a third key isn't one."""
    t = table(spark, d, "documents").filter("doc_kind is not null")
    raw = F.to_json(F.struct(F.col("doc_kind").alias("Type"), F.col("lang").alias("Gender"), F.lit("x").alias("other")))
    return t.select("doc_id", X.coarse_morphology(raw).alias("morphology"))


@register("SELECT passage_id, start_reference, corpus FROM (SELECT DISTINCT passage_id, start_reference, corpus FROM passages WHERE start_reference IS NOT NULL)")
def reference_corpora(spark: SparkSession, d: str) -> DataFrame:
    """The corpus of every passage as its reference tells it, from the books of the two corpora."""
    p = table(spark, d, "passages")
    books = {r.book: r.corpus for r in p.select("book", "corpus").distinct().collect()}  # one row a book
    names = F.create_map(*[F.lit(b) for b in sorted(books) for _ in range(2)])
    chapters = F.create_map(*[x for b in sorted(books) for x in (F.lit(b), F.lit(10**6))])
    q = p.select("passage_id", "start_reference").filter("start_reference is not null").distinct()
    parsed = X.parse_reference(F.translate("start_reference", " :", ".."), names, chapters)
    by = lambda c: [b for b, x in books.items() if x == c]
    return q.withColumn("p", parsed).select("passage_id", "start_reference", X.reference_corpus(F.col("p"), by("hebrew"), by("greek")).alias("corpus"))


_GREEK = r"SELECT doc_id, regexp_replace(trim(regexp_replace(regexp_replace(text, '[^A-Za-z.,;:!?]+', ' ', 'g'), '([.,;:!?]+)', ' \1 ', 'g')), ' +', ' ', 'g') AS line FROM documents WHERE text IS NOT NULL"


@register(f"SELECT doc_id, regexp_replace(line, ' ([.,;:!?]+)', '\\1', 'g') AS text FROM ({_GREEK}) WHERE line <> ''")
def reconstructed_greek(spark: SparkSession, d: str) -> DataFrame:
    """Texts put together again from their words and punctuation by the Greek rule; letters of other scripts are blanks."""
    t = table(spark, d, "documents").filter("text is not null")
    line = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace("text", "[^A-Za-z.,;:!?]+", " "), "([.,;:!?]+)", " $1 ")), " +", " ")
    words = F.transform(F.split("line", " "), lambda w: F.struct(w.alias("text"), F.lit(None).cast("string").alias("after"), w.rlike("^[.,;:!?]+$").alias("punctuation")))
    return t.select("doc_id", line.alias("line")).filter("line <> ''").select("doc_id", X.reconstruct(F.lit("greek"), words).alias("text"))


@register(f"SELECT doc_id, regexp_replace(line, ' ([.,;:!?]+)', '\\1', 'g') AS text FROM ({_GREEK}) WHERE line <> ''")
def reconstructed_hebrew(spark: SparkSession, d: str) -> DataFrame:
    """The same by the Hebrew rule: separators are null, so blanks stand but before closing punctuation."""
    t = table(spark, d, "documents").filter("text is not null")
    line = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace("text", "[^A-Za-z.,;:!?]+", " "), "([.,;:!?]+)", " $1 ")), " +", " ")
    words = F.transform(F.split("line", " "), lambda w: F.struct(w.alias("text"), F.lit(None).cast("string").alias("after"), F.lit(False).alias("punctuation")))
    return t.select("doc_id", line.alias("line")).filter("line <> ''").select("doc_id", X.reconstruct(F.lit("hebrew"), words).alias("text"))


# --- vocabularies of several families


_FAMILIES = L._GRAMS + """, bk AS (SELECT doc_id, coalesce(source, '') AS book, coalesce(lang, '') AS genre FROM documents),
every AS (SELECT 'lemma' AS family, word AS feature, doc_id FROM tok UNION ALL SELECT CASE WHEN size = 2 THEN 'lemma_bigram' ELSE 'lemma_trigram' END, phrase, doc_id FROM g)
"""


@register(_FAMILIES + "SELECT family, feature, count(*) AS corpus_frequency, count(DISTINCT every.doc_id) AS document_frequency, count(DISTINCT book) AS book_frequency, count(DISTINCT genre) AS genre_frequency FROM every JOIN bk USING (doc_id) GROUP BY family, feature HAVING family = 'lemma' OR count(*) >= 5")
def all_vocabularies(spark: SparkSession, d: str) -> DataFrame:
    """The vocabularies of words, bigrams and trigrams in one table; phrases of at least MIN_COUNT occurrences."""
    s, p = L.seqs(spark, d), L._passages(spark, d)
    gram = lambda n: s.select("pid", F.explode(W.ngrams(F.col("seq"), n)).alias("feature"))
    parts = {"lemma": L.occ(spark, d).select("pid", "feature"), "lemma_bigram": gram(2), "lemma_trigram": gram(3)}
    every = None
    for family, o in parts.items():
        one = o.withColumn("family", F.lit(family))
        every = one if every is None else every.unionByName(one)
    return W.family_vocabulary(every, p).filter((F.col("family") == "lemma") | (F.col("corpus_frequency") >= L.MIN_COUNT))


@register(
    f"""WITH {L.TOK}, b AS (SELECT word, count(*) AS n_before FROM tok GROUP BY word), a AS (SELECT word, count(*) AS n_after FROM tok WHERE pos > 5 OR length(word) < 4 GROUP BY word)
    SELECT b.word AS feature, n_before, coalesce(n_after, 0) AS n_after, coalesce(n_after, 0) - n_before AS change FROM b LEFT JOIN a USING (word) WHERE coalesce(n_after, 0) <> n_before ORDER BY abs(change) DESC, feature LIMIT 25"""
)
def frequency_changes(spark: SparkSession, d: str) -> DataFrame:
    """The 25 words whose counts differ most between two readings of the same texts; the second lacks the long ones of the first five words."""
    o = L.occ(spark, d)
    # a text that loses all its words stays a text of the second reading
    return W.frequency_change(o, o.filter((F.col("pos") > 5) | (F.length("feature") < 4)), 25, same=False)


# --- sources and sinks: what is written comes back


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register("SELECT evidence_id, candidate_pair_id, detector_id, source_artifact_id, source_artifact_sha256, CAST(recorded_at AS VARCHAR) AS recorded_at FROM evidence_identity")
def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Evidence rows written as canonical JSON lines and read with their type; a line that isn't canonical would fail the query."""
    e = table(spark, d, "evidence_identity")
    t = e.select("evidence_id", "candidate_pair_id", "detector_id", "source_artifact_id", "source_artifact_sha256", F.regexp_replace(F.col("recorded_at").cast("string"), r"(\.\d+?)0+$", "$1").alias("recorded_at"))
    where = _place(spark, "lines")
    sinks.write_jsonl(t, where, ["evidence_id"])
    rows, broken = files.canonical_jsonl(spark, where, t.schema)
    if not broken.isEmpty():
        raise ValueError("lines aren't canonical")
    return rows


@register("SELECT candidate_pair_id, passage_a_id, passage_b_id, detector_support_count, highest_openbible_vote FROM candidate_pairs")
def artifact_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Candidate pairs staged, promoted and read back as a Parquet artifact."""
    t = table(spark, d, "candidate_pairs").select("candidate_pair_id", "passage_a_id", "passage_b_id", "detector_support_count", "highest_openbible_vote")
    where = _place(spark, "artifact")
    sinks.write_artifact(t, where, order=["candidate_pair_id"])
    return files.artifact(spark, where, t.schema)


_LINKS = "SELECT DISTINCT replace(replace(reference_a, ' ', '.'), ':', '.') AS ref_a, replace(replace(reference_b, ' ', '.'), ':', '.') AS ref_b FROM positive_controls WHERE reference_a IS NOT NULL AND reference_b IS NOT NULL"
_STATUS = r"CASE WHEN regexp_full_match(ref_a, '[1-3]?[A-Za-z]+\.\d+\.\d+(-([1-3]?[A-Za-z]+\.)?(\d+\.)?\d+)?') AND regexp_full_match(ref_b, '[1-3]?[A-Za-z]+\.\d+\.\d+(-([1-3]?[A-Za-z]+\.)?(\d+\.)?\d+)?') THEN 'parsed' WHEN ref_a = '' OR ref_b = '' THEN 'invalid_empty_reference' ELSE 'invalid_reference_syntax' END"


def _cross_references(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "positive_controls").filter("reference_a is not null and reference_b is not null")
    dots = lambda x: F.translate(x, " :", "..")
    t = c.select(dots("reference_a").alias("a"), dots("reference_b").alias("b")).distinct()
    line = F.concat_ws("\t", "a", "b", F.length(F.concat("a", "b")).cast("string"))
    where = _place(spark, "references")
    lines = spark.range(1).select(F.lit(0).alias("o"), F.lit("From Verse\tTo Verse\tVotes").alias("value")).unionByName(t.select(F.lit(1).alias("o"), line.alias("value")))
    lines.repartition(1).sortWithinPartitions("o", "value").select("value").write.text(where)
    return files.cross_references(spark, where)


@register(f"SELECT ref_a, ref_b, CAST(length(ref_a || ref_b) AS BIGINT) AS votes, {_STATUS} AS parse_status, sha256(ref_a || chr(9) || ref_b || chr(9) || length(ref_a || ref_b)) AS record_hash FROM ({_LINKS})")
def cross_reference_rows(spark: SparkSession, d: str) -> DataFrame:
    """Links written as cross-reference text and scanned: every line with its status and hash."""
    return _cross_references(spark, d).select("ref_a", "ref_b", "votes", "parse_status", "record_hash")


@register(
    f"""WITH r AS (SELECT *, CAST(length(ref_a || ref_b) AS BIGINT) AS votes, {_STATUS} AS s FROM ({_LINKS})), ok AS (SELECT * FROM r WHERE s = 'parsed')
    SELECT (SELECT count(*) FROM r) AS n_rows, (SELECT count(*) FROM ok) AS n_parsed, 0::BIGINT AS duplicates, (SELECT count(*) FROM ok x JOIN ok y ON x.ref_a = y.ref_b AND x.ref_b = y.ref_a WHERE x.ref_a < x.ref_b) AS reverse_pairs,
    (SELECT quantile_disc(votes, 0.25) FROM ok) AS q25, (SELECT quantile_disc(votes, 0.5) FROM ok) AS q50, (SELECT quantile_disc(votes, 0.75) FROM ok) AS q75"""
)
def cross_reference_audit(spark: SparkSession, d: str) -> DataFrame:
    return B.source_audit(_cross_references(spark, d))


@register("SELECT CAST(name_id AS BIGINT) AS name_id, name_part, name_role FROM name_lexicon")
def strict_csv_rows(spark: SparkSession, d: str) -> DataFrame:
    """A fixed list written as CSV and read under its exact header, types and number of rows."""
    t = table(spark, d, "name_lexicon")
    where = _place(spark, "csv")
    t.write.csv(where, header=True)
    return files.strict_csv(spark, where, t.schema, t.count())


@register("SELECT 'region.parquet' AS name, 1::BIGINT AS n_files UNION ALL SELECT 'nation.parquet', 1::BIGINT")
def file_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Two tables of the folder in an inventory of files with sizes and hashes."""
    i = files.inventory(spark, d, "{region,nation}.parquet").filter((F.col("bytes") > 0) & (F.length("sha256") == 64))
    return i.groupBy(F.element_at(F.split("path", "/"), -1).alias("name")).agg(F.count("*").alias("n_files"))


@register(
    """WITH p AS (SELECT DISTINCT candidate_pair_id FROM candidate_pairs WHERE candidate_pair_id IS NOT NULL), e AS (SELECT candidate_pair_id, count(*) AS n, string_agg(DISTINCT detector_id, ',' ORDER BY detector_id) AS detectors FROM evidence_identity WHERE candidate_pair_id IS NOT NULL GROUP BY candidate_pair_id)
    SELECT candidate_pair_id, n AS n_evidence, detectors FROM p JOIN e USING (candidate_pair_id)"""
)
def pair_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Candidate pairs with all their evidence in one row."""
    p = table(spark, d, "candidate_pairs").select("candidate_pair_id").filter("candidate_pair_id is not null").distinct()
    e = table(spark, d, "evidence_identity").filter("candidate_pair_id is not null").select("candidate_pair_id", "evidence_id", "detector_id")
    rows, _ = files.pair_projection(p, e, "candidate_pair_id")
    names = F.array_sort(F.array_distinct(F.array_compact("evidence.detector_id")))
    # a pair whose evidence names no detector has null, not an empty list of them
    return rows.select("candidate_pair_id", F.size("evidence").cast("bigint").alias("n_evidence"), F.when(F.size(names) > 0, F.array_join(names, ",")).alias("detectors"))


@register("SELECT candidate_pair_id, count(*) AS n_details FROM evidence_identity WHERE candidate_pair_id IN (SELECT source_candidate_id FROM selected_m7_pairs) GROUP BY candidate_pair_id")
def hydrated_selection(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of the selected pairs only."""
    s = table(spark, d, "selected_m7_pairs").select(F.col("source_candidate_id").alias("candidate_pair_id"))
    return files.hydrate(table(spark, d, "evidence_identity").select("candidate_pair_id", "evidence_id", "detector_id"), s, "candidate_pair_id").select("candidate_pair_id", F.size("details").cast("bigint").alias("n_details"))


@register(f"WITH {L.TOK} SELECT doc_id, word, tf FROM post")
def stored_postings(spark: SparkSession, d: str) -> DataFrame:
    """A sparse index written under a representation and loaded after its checks."""
    where = _place(spark, "postings")
    sinks.write_postings(L.post(spark, d), where, "documents:lemma")
    return sinks.load_postings(spark, where, "documents:lemma").select(F.col("pid").alias("doc_id"), F.col("feature").alias("word"), "tf")
