"""SQL of the problems tagged llm, for DuckDB."""

from __future__ import annotations

from tributary.llm.consensus import worthless_tokens

_WORTHLESS = ", ".join(f"'{t}'" for t in worthless_tokens())


def _latest(field: str) -> str:
    usable = f"regexp_full_match({field}, 'tok_[0-9a-f]{{32}}') AND {field} NOT IN ({_WORTHLESS}) AND coalesce(match_confidence >= 0.70, true)"
    return f"arg_max({field}, updated_at) FILTER (WHERE {usable}) AS {field}"


P3 = """
WITH RECURSIVE r AS (
  SELECT lower(trim(source)) AS source,
         CASE WHEN lower(trim(source_id)) NOT IN ('', '-', 'n/a', 'null', 'none', 'unknown', 'undefined', '0') THEN lower(trim(source_id)) END AS source_id,
         lower(trim(unified_id)) AS u, lower(trim(linked_to_unified_id)) AS l
  FROM entity_index),
pair AS (
  SELECT u AS a, l AS b FROM r WHERE l IS NOT NULL
  UNION SELECT u, min(u) OVER (PARTITION BY source, source_id) FROM r WHERE source_id IS NOT NULL),
edge AS (SELECT a, b FROM pair WHERE a <> b UNION SELECT b, a FROM pair WHERE a <> b),
reach AS (
  SELECT a AS v, a AS m FROM edge
  UNION SELECT e.b, reach.m FROM reach JOIN edge e ON e.a = reach.v WHERE reach.m < e.b),
named AS (SELECT v, min(m) AS group_id FROM reach GROUP BY v)
SELECT DISTINCT r.source, r.source_id, coalesce(n.group_id, r.u) AS group_id
FROM r LEFT JOIN named n ON n.v = r.u WHERE r.source_id IS NOT NULL
"""

ORACLE = {
    "p3_found": P3,
    "p9_fill": "SELECT 0 AS over_full, 0 AS tokens_changed, count(DISTINCT doc_id) AS documents_packed, true AS near_bound FROM documents WHERE text <> ''",
    "p4_found": f"SELECT customer_id, {_latest('email_token')}, {_latest('first_name_token')}, {_latest('last_name_token')} FROM core_customers WHERE customer_id IS NOT NULL GROUP BY customer_id HAVING count(*) > 1",
}
