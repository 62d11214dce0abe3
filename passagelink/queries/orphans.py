"""References that do not resolve."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passagelink.operators.references import orphan_counts, orphan_references, references
from passagelink.queries import register
from passagelink.session import table

#: Blanks trimmed from loose keys, as in operators.references.BLANK.
_KEY = r"lower(regexp_replace({0}, '^[\s   ﻿]+|[\s   ﻿]+$', '', 'g'))"

_CTE = f"""
WITH r AS (
  SELECT DISTINCT 'evidence_identity' AS ref_table, evidence_id AS record_id, {_KEY.format('candidate_pair_id')} AS k, recorded_at AS seen FROM evidence_identity
  UNION SELECT DISTINCT 'selected_m7_pairs', row_identity, {_KEY.format('source_candidate_id')}, selected_at FROM selected_m7_pairs),
refs AS (SELECT * FROM r WHERE length(k) > 0),
p AS (SELECT {_KEY.format('candidate_pair_id')} AS k, coalesce(registered_at, TIMESTAMP '0001-01-01') AS s, coalesce(deleted_at, TIMESTAMP '9999-12-31') AS e FROM candidate_pairs),
g AS (SELECT k, min(s) AS f FROM p GROUP BY k),
x AS (SELECT refs.*, CASE WHEN g.k IS NULL THEN 'missing' WHEN seen IS NULL THEN NULL WHEN seen < f THEN 'late'
        WHEN NOT EXISTS (SELECT 1 FROM p WHERE p.k = refs.k AND p.s <= refs.seen AND refs.seen < p.e) THEN 'deleted' END AS reason
      FROM refs LEFT JOIN g ON g.k = refs.k),
o AS (SELECT ref_table, record_id, coalesce(strftime(seen, '%Y-%m'), 'unknown') AS ref_month, reason FROM x)
"""


def _refs(spark: SparkSession, d: str) -> DataFrame:
    a = references(table(spark, d, "evidence_identity"), "evidence_identity", "evidence_id", "candidate_pair_id", "recorded_at")
    return a.unionByName(references(table(spark, d, "selected_m7_pairs"), "selected_m7_pairs", "row_identity", "source_candidate_id", "selected_at"))


def _orphans(spark: SparkSession, d: str, refs: DataFrame) -> DataFrame:
    return orphan_references(refs, table(spark, d, "candidate_pairs"), "candidate_pair_id", "registered_at", "deleted_at")


@register(_CTE + "SELECT * FROM o WHERE reason IS NOT NULL")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d, _refs(spark, d))


@register(
    _CTE
    + """SELECT ref_table, ref_month, count(*) FILTER (reason = 'missing') AS n_missing, count(*) FILTER (reason = 'late') AS n_late,
    count(*) FILTER (reason = 'deleted') AS n_deleted, count(*) AS n_references FROM o GROUP BY ref_table, ref_month"""
)
def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    refs = _refs(spark, d)
    return orphan_counts(_orphans(spark, d, refs), refs)
