"""SQL twins of the training-data queries that SQL can express on whole tables."""

SQL: dict[str, str] = {
    "p5_found": """
SELECT query_id, target_id, CAST(top_rank AS INTEGER) AS top_rank FROM (
  SELECT query_id, target_id, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, target_id) AS top_rank FROM (
    SELECT query_id, target_id, max(cosine_similarity) AS c FROM neighbor
    WHERE query_id <> target_id AND cosine_similarity BETWEEN -1 AND 1 AND NOT isnan(cosine_similarity) GROUP BY query_id, target_id))
WHERE top_rank <= 5
""",
    "p2_found": r"""
WITH RECURSIVE raw AS (
  SELECT control_id AS c, lower(trim(leakage_group_id)) AS l, lower(trim(relationship_family_id)) AS f, lower(trim(split)) AS s FROM positive_controls WHERE control_id IS NOT NULL),
r AS (SELECT c, CASE WHEN l NOT IN ('', 'unknown', 'n/a', 'none', '-') THEN 'l' || l END AS l, CASE WHEN f NOT IN ('', 'unknown', 'n/a', 'none', '-') THEN 'f' || f END AS f,
  CASE WHEN s IN ('dev', 'validation') THEN 'development' WHEN s <> '' THEN s END AS s FROM raw),
k AS (SELECT DISTINCT c, l AS g FROM r WHERE l IS NOT NULL UNION SELECT DISTINCT c, f FROM r WHERE f IS NOT NULL),
star AS (SELECT DISTINCT k.c AS v, m.c AS u FROM k JOIN (SELECT g, min(c) AS c FROM k GROUP BY g) m USING (g)),
e AS (SELECT u, v FROM star UNION SELECT v, u FROM star),
walk AS (SELECT DISTINCT c AS start, c AS at FROM r UNION SELECT walk.start, e.v FROM walk JOIN e ON e.u = walk.at),
comp AS (SELECT start AS control_id, min("at") AS component_id FROM walk GROUP BY start),
torn AS (SELECT component_id FROM comp JOIN r ON r.c = comp.control_id GROUP BY component_id HAVING count(DISTINCT s) >= 2)
SELECT control_id, component_id FROM comp WHERE component_id IN (SELECT component_id FROM torn)
""",
}
