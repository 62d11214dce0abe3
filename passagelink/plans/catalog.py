"""The catalog of named views, as SQL over tables in braces.

Each view is one declarative statement that Catalyst plans; ``create_views()`` registers them over a folder of tables, as
``open_view()`` opens a single one. The tables are those of the data folder: passages, their membership, candidate
pairs with their evidence, and positive controls.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from passagelink.session import table

_P = "SELECT DISTINCT * FROM {passages}"
_C = "SELECT DISTINCT candidate_pair_id, canonical_unordered_pair_id, passage_a_id, passage_b_id, corpus_pair, analysis_profile, granularity, detector_support_count, known_link_status, highest_openbible_vote, mapping_quality, same_book, review_eligible, eligibility_reason FROM {candidate_pairs}"
_E = "SELECT DISTINCT evidence_id, lower(trim(candidate_pair_id)) AS pair_key, detector_id, source_artifact_id FROM {evidence_identity}"
_ENDS = "SELECT c.candidate_pair_id, pa.corpus AS corpus_a, pb.corpus AS corpus_b FROM (SELECT DISTINCT candidate_pair_id, passage_a_id, passage_b_id FROM {candidate_pairs}) c JOIN (SELECT DISTINCT passage_id, corpus FROM {passages}) pa ON pa.passage_id = c.passage_a_id JOIN (SELECT DISTINCT passage_id, corpus FROM {passages}) pb ON pb.passage_id = c.passage_b_id"

VIEWS: dict[str, str] = {
    # tokens and passages
    "unified_tokens": "SELECT 'hebrew' AS corpus, m.passage_id, m.token_id, m.position_in_passage, m.variant_type FROM {passage_membership} m JOIN (SELECT DISTINCT passage_id FROM {passages} WHERE corpus = 'hebrew') p ON p.passage_id = m.passage_id UNION ALL SELECT 'greek', m.passage_id, m.token_id, m.position_in_passage, CAST(NULL AS VARCHAR(20)) FROM {passage_membership} m JOIN (SELECT DISTINCT passage_id FROM {passages} WHERE corpus = 'greek') p ON p.passage_id = m.passage_id",
    "hebrew_analysis_stream": "SELECT p.passage_id, p.analysis_reading, m.token_id, m.position_in_passage FROM (SELECT DISTINCT passage_id, analysis_reading FROM {passages} WHERE corpus = 'hebrew' AND granularity = 'verse') p JOIN {passage_membership} m ON m.passage_id = p.passage_id",
    "hebrew_kq_variant_groups": "SELECT k.passage_id, k.position_in_passage, k.token_id AS ketiv_token_id, q.token_id AS qere_token_id FROM (SELECT DISTINCT passage_id, position_in_passage, token_id FROM {passage_membership} WHERE variant_type = 'ketiv') k LEFT JOIN (SELECT DISTINCT passage_id, position_in_passage, token_id FROM {passage_membership} WHERE variant_type = 'qere') q ON q.passage_id = k.passage_id AND q.position_in_passage = k.position_in_passage",
    "hebrew_qere_passages": _P + " WHERE corpus = 'hebrew' AND analysis_reading = 'qere'",
    "hebrew_ketiv_passages": _P + " WHERE corpus = 'hebrew' AND analysis_reading = 'ketiv'",
    "greek_edition_complete_passages": _P + " WHERE corpus = 'greek' AND analysis_profile = 'edition_complete'",
    "greek_critical_core_passages": _P + " WHERE corpus = 'greek' AND analysis_profile = 'critical_core'",
    "verse_passages": _P + " WHERE granularity = 'verse'",
    "window_passages": _P + " WHERE granularity IN ('two_verse', 'five_verse')",
    "passage_uncertainty_summary": "SELECT corpus, analysis_profile, analysis_reading, granularity, count(*) AS n_passages, count(CASE WHEN disputed_passage_flag THEN 1 END) AS n_disputed, count(CASE WHEN reference_gap THEN 1 END) AS n_gap, count(CASE WHEN ketiv_structural_uncertainty THEN 1 END) AS n_uncertain, CAST(sum(token_count) AS BIGINT) AS n_tokens FROM (" + _P + ") p GROUP BY corpus, analysis_profile, analysis_reading, granularity",
    # known links
    "tier3_openbible_relationships": _C + " WHERE known_link_status = 'represented_in_openbible_snapshot'",
    "benchmark_mapping_quality": "SELECT corpus_pair, mapping_quality, known_link_status, count(*) AS n_pairs FROM (" + _C + ") c GROUP BY ALL",
    "mapped_openbible_relationships": "SELECT DISTINCT c.candidate_pair_id, c.corpus_pair FROM {candidate_pairs} c JOIN {passages} p ON p.passage_id = c.passage_a_id JOIN {passages} q ON q.passage_id = c.passage_b_id WHERE c.known_link_status = 'represented_in_openbible_snapshot'",
    "unmapped_openbible_relationships": "SELECT DISTINCT c.candidate_pair_id FROM {candidate_pairs} c WHERE NOT EXISTS (SELECT 1 FROM {passages} p WHERE p.passage_id = c.passage_a_id AND p.granularity = c.granularity)",
    "cross_testament_relationships": "SELECT candidate_pair_id, corpus_a, corpus_b FROM (" + _ENDS + ") e WHERE corpus_a <> corpus_b",
    "within_old_testament_relationships": "SELECT candidate_pair_id FROM (" + _ENDS + ") e WHERE corpus_a = 'hebrew' AND corpus_b = 'hebrew'",
    "within_new_testament_relationships": "SELECT candidate_pair_id FROM (" + _ENDS + ") e WHERE corpus_a = 'greek' AND corpus_b = 'greek'",
    "openbible_reverse_pairs": "SELECT DISTINCT c.candidate_pair_id, c.canonical_unordered_pair_id FROM {candidate_pairs} c WHERE c.canonical_unordered_pair_id IN (SELECT canonical_unordered_pair_id FROM {candidate_pairs} GROUP BY canonical_unordered_pair_id HAVING count(DISTINCT candidate_pair_id) > 1)",
    "openbible_duplicate_pairs": "SELECT * FROM (SELECT candidate_pair_id, count(*) AS n_rows FROM {candidate_pairs} GROUP BY candidate_pair_id) c WHERE n_rows > 1",
    "benchmark_weak_supervision_splits": "SELECT DISTINCT c.control_id, c.source_id, s.split, s.split_share FROM {positive_controls} c JOIN {split_shares} s ON s.split = lower(trim(c.split)) WHERE c.verification_status = 'verified'",
    "benchmark_presumed_negative_pairs": _C + " WHERE NOT review_eligible AND known_link_status = 'not_represented_in_openbible_snapshot'",
    "benchmark_reference_risks": "SELECT DISTINCT c.candidate_pair_id, p.passage_id, p.reference_gap, p.disputed_passage_flag FROM {candidate_pairs} c JOIN {passages} p ON p.passage_id = c.passage_a_id WHERE p.reference_gap OR p.disputed_passage_flag",
    # lexical candidates
    "lexical_known_link_recovery": "SELECT corpus_pair, detector_support_count, count(*) AS n_pairs FROM (" + _C + ") c WHERE known_link_status = 'represented_in_openbible_snapshot' GROUP BY corpus_pair, detector_support_count",
    "lexical_unrepresented_candidates": _C + " WHERE known_link_status = 'not_represented_in_openbible_snapshot'",
    "lexical_review_eligible_candidates": _C + " WHERE review_eligible",
    "lexical_formulaic_candidates": "SELECT DISTINCT c.candidate_pair_id, e.evidence_id FROM (" + _C + ") c JOIN (" + _E + ") e ON e.pair_key = lower(trim(c.candidate_pair_id)) WHERE c.eligibility_reason = 'formulaic'",
    "lexical_rare_evidence_candidates": "SELECT DISTINCT c.candidate_pair_id, e.evidence_id FROM (" + _C + ") c JOIN (" + _E + ") e ON e.pair_key = lower(trim(c.candidate_pair_id)) WHERE e.detector_id = 'grammar_rare_pattern'",
    "lexical_english_derived_candidates": _C + " WHERE corpus_pair = 'hb_gnt_english_bridge'",
    "lexical_ablation_failures": "SELECT candidate_pair_id, n_all, n_left FROM (SELECT c.candidate_pair_id, count(DISTINCT e.detector_id) AS n_all, count(DISTINCT CASE WHEN e.detector_id <> 'multilingual_e5_english_gloss' THEN e.detector_id END) AS n_left FROM (" + _C + ") c JOIN (" + _E + ") e ON e.pair_key = lower(trim(c.candidate_pair_id)) WHERE c.review_eligible GROUP BY c.candidate_pair_id) x WHERE n_left < n_all AND n_left < 2",
    "lexical_candidate_ablation_results": "SELECT DISTINCT row_identity, source_candidate_id, expected_shared_count FROM {selected_m7_pairs} WHERE model_kind = 'raw'",
    "lexical_directional_english_ablation": "SELECT DISTINCT e.pair_key AS subject_id, e.detector_id AS ablated_detector FROM (" + _E + ") e WHERE e.detector_id = 'multilingual_e5_english_gloss' AND e.pair_key <> ''",
    "lexical_disputed_text_candidates": "SELECT DISTINCT c.candidate_pair_id FROM {candidate_pairs} c JOIN {passages} p ON p.passage_id = c.passage_a_id OR p.passage_id = c.passage_b_id WHERE p.disputed_passage_flag".replace("p.passage_id = c.passage_a_id OR p.passage_id = c.passage_b_id", "p.passage_id = c.passage_a_id") + " UNION SELECT DISTINCT c.candidate_pair_id FROM {candidate_pairs} c JOIN {passages} p ON p.passage_id = c.passage_b_id WHERE p.disputed_passage_flag",
    "lexical_reference_gap_candidates": "SELECT c.candidate_pair_id FROM {candidate_pairs} c JOIN {passages} p ON p.passage_id = c.passage_a_id WHERE p.reference_gap UNION SELECT c.candidate_pair_id FROM {candidate_pairs} c JOIN {passages} p ON p.passage_id = c.passage_b_id WHERE p.reference_gap",
    "lexical_ketiv_sensitivity": "SELECT c.candidate_pair_id FROM {candidate_pairs} c JOIN {passages} p ON p.passage_id = c.passage_a_id WHERE p.analysis_reading = 'ketiv' UNION SELECT c.candidate_pair_id FROM {candidate_pairs} c JOIN {passages} p ON p.passage_id = c.passage_b_id WHERE p.analysis_reading = 'ketiv'",
    "lexical_critical_core_sensitivity": _C + " WHERE analysis_profile = 'critical_core'",
    "lexical_null_calibration": "SELECT a.corpus_pair, a.granularity, a.detector_support_count, a.n_pairs, coalesce(b.n_known, 0) AS n_known FROM (SELECT corpus_pair, granularity, detector_support_count, count(*) AS n_pairs FROM (" + _C + ") c GROUP BY corpus_pair, granularity, detector_support_count) a LEFT JOIN (SELECT corpus_pair, granularity, detector_support_count, count(*) AS n_known FROM (" + _C + ") c WHERE known_link_status = 'represented_in_openbible_snapshot' GROUP BY corpus_pair, granularity, detector_support_count) b ON b.corpus_pair = a.corpus_pair AND b.granularity = a.granularity AND b.detector_support_count = a.detector_support_count",
    "lexical_detector_comparison": "SELECT e.detector_id, c.corpus_pair, count(*) AS n_rows, round(avg(c.detector_support_count), 6) AS mean_support FROM (" + _C + ") c JOIN (" + _E + ") e ON e.pair_key = lower(trim(c.candidate_pair_id)) GROUP BY ALL",
    "lexical_performance_by_corpus_pair": "SELECT corpus_pair, count(*) AS n_pairs, round(avg(detector_support_count), 6) AS mean_support, CAST(sum(detector_support_count) AS BIGINT) AS total_support FROM (" + _C + ") c GROUP BY ALL",
    "lexical_performance_by_mapping_status": "SELECT mapping_quality, round(avg(detector_support_count), 6) AS mean_support, round(avg(highest_openbible_vote), 6) AS mean_vote FROM (" + _C + ") c GROUP BY ALL",
    # relational constructs of the analyses: recursion, frames, distinct on several columns, lateral unnesting
    "shared_id_sequences": "SELECT s.row_identity, count(*) AS n_rows, max(s.expected_shared_count) AS most_shared, min(s.selection_ordinal) AS first_ordinal FROM {selected_m7_pairs} s GROUP BY s.row_identity HAVING count(*) > 1",
    "evidence_pairs_of_detectors": "SELECT x.detector_id AS detector_a, y.detector_id AS detector_b, count(*) AS n_pairs FROM (SELECT DISTINCT pair_key, detector_id FROM (" + _E + ") e WHERE pair_key <> '') x JOIN (SELECT DISTINCT pair_key, detector_id FROM (" + _E + ") e WHERE pair_key <> '') y ON x.pair_key = y.pair_key AND x.detector_id < y.detector_id GROUP BY ALL",
    "full_outer_audit": "SELECT count(*) AS n_keys, count(CASE WHEN c.k IS NULL THEN 1 END) AS n_only_evidence, count(CASE WHEN e.k IS NULL THEN 1 END) AS n_only_pairs FROM (SELECT DISTINCT lower(trim(candidate_pair_id)) AS k FROM {candidate_pairs}) c FULL OUTER JOIN (SELECT DISTINCT pair_key AS k FROM (" + _E + ") x WHERE pair_key <> '') e ON c.k = e.k",
    "registration_gaps": "SELECT corpus_pair, count(*) AS n_rows, max(gap_days) AS longest_gap_days FROM (SELECT corpus_pair, date_diff('day', CAST(lag(registered_at) OVER (PARTITION BY corpus_pair ORDER BY registered_at, candidate_pair_id) AS DATE), CAST(registered_at AS DATE)) AS gap_days FROM (SELECT DISTINCT corpus_pair, candidate_pair_id, registered_at FROM {candidate_pairs} WHERE registered_at IS NOT NULL) r) g GROUP BY corpus_pair",
}

_TABLE = re.compile(r"\{(\w+)\}")


def open_view(spark: SparkSession, d: str, name: str) -> DataFrame:
    """One view over the tables of a folder."""
    text = VIEWS[name].replace("date_diff('day', ", "datediff(DAY, ")
    return spark.sql(text, **{t: table(spark, d, t) for t in set(_TABLE.findall(text))})


def create_views(spark: SparkSession, d: str, prefix: str = "") -> list[str]:
    """Register every view as a temporary one, over the tables of a folder; calling it again binds them to another folder."""
    for name in VIEWS:
        open_view(spark, d, name).createOrReplaceTempView(prefix + name)
    return [prefix + n for n in VIEWS]


def view_sql(name: str) -> str:
    """A view's statement over tables of their own names."""
    return _TABLE.sub(r"\1", VIEWS[name])
