"""SQL of the queries in entities.py, for DuckDB. entity_pipeline has none: SQL lacks soundex; fuzzy_by_zip shows the score."""

from tributary.operators.entity import ADDRESS_WORDS
from tributary.plans.entities import ROADS, SYLLABLES, THRESHOLD
from tributary.plans.tables_sql import _sessions


def _pick(values: tuple[str, ...], n: str) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], CAST({n} AS INT) + 1)"


def _address(c: str) -> str:
    out = f"lower({c})"
    for word, short in ADDRESS_WORDS.items():
        out = f"replace({out}, '{word}', '{short}')"
    return f"trim(regexp_replace(translate({out}, '.,#-', '    '), '\\s+', ' ', 'g'))"


def _source(name: str, k: str, n: str) -> str:
    road = _pick(ROADS, f"{k} % 6")
    last = f"{_pick(SYLLABLES, f'{k} % 20')} || {_pick(SYLLABLES, f'({k} // 20) % 20')} || substr(md5(CAST({k} AS VARCHAR)), 1, 1)"
    return f"""SELECT '{name}' AS source, CAST({k} AS VARCHAR) AS source_id, CASE WHEN {k} % 10 <> 0 THEN {n} || '-' || ({k} % 100) ELSE ' ' END AS email_token,
CASE WHEN {k} % 4 = 0 THEN 'tok' || ({k} % 1000) ELSE 'short' END AS phone_token, 'kim ' || {last} AS full_name, {last} AS last_name,
({k} % 90) || ' ' || {road if name == 'customer' else f'lower({road})'} || ', No. ' || ({k} % 7) AS address, lpad(CAST({k} % 1000 AS VARCHAR), 5, '0') AS zip, {k} AS staged_at FROM {name}"""


PEOPLE = f"{_source('customer', 'c_custkey', 'c_nationkey')} UNION ALL {_source('supplier', 's_suppkey', 's_nationkey')}"
INDEX = f"""SELECT unified_id, source, source_id, CASE WHEN row_number() OVER (PARTITION BY unified_id ORDER BY staged_at, source, source_id) = 1 THEN 'new_entity' ELSE 'exact_email' END AS match_type
FROM (SELECT *, 'U-' || substr(sha256(CASE WHEN trim(email_token) = '' THEN source || '|' || source_id ELSE trim(email_token) END), 1, 32) AS unified_id FROM ({PEOPLE}) WHERE source = 'customer' OR trim(email_token) <> '')"""
_PREFIX = "CASE WHEN left(a, 1) <> left(b, 1) THEN 0 WHEN left(a, 2) <> left(b, 2) THEN 1 WHEN left(a, 3) <> left(b, 3) THEN 2 WHEN left(a, 4) <> left(b, 4) THEN 3 ELSE 4 END"
_PIVOT = f"SELECT unified_id, max(source_id) FILTER (WHERE source = 'customer') AS customer_id, max(source_id) FILTER (WHERE source = 'supplier') AS supplier_id, count(DISTINCT source) AS source_count FROM ({INDEX}) GROUP BY 1"

ORACLE = {
    "entity_unresolved": f"SELECT source, source_id FROM ({PEOPLE}) WHERE source = 'supplier' AND trim(email_token) = ''",
    "entity_existing": f"SELECT DISTINCT unified_id, upper(full_name[1]) || full_name[2:4] || upper(full_name[5]) || full_name[6:] AS full_name, zip, {_address('address')} AS address FROM ({INDEX}) JOIN ({PEOPLE}) USING (source, source_id)",
    "fuzzy_by_zip": f"""WITH p AS (SELECT *, source || ':' || source_id AS record, {_address('address')} AS addr FROM ({PEOPLE})), i AS ({INDEX}),
c AS (SELECT l.record AS l_id, r.record AS r_id, i.unified_id, l.full_name AS a, r.full_name AS b, l.addr AS x, r.addr AS y FROM p l JOIN p r ON l.zip = r.zip AND l.source = 'supplier' AND trim(l.email_token) = '' JOIN i ON i.source = r.source AND i.source_id = r.source_id),
j AS (SELECT *, jaro_similarity(a, b) AS j, 1 - levenshtein(x, y) / greatest(length(x), length(y)) AS s, {_PREFIX} AS n FROM c),
t AS (SELECT *, round(0.7 * (j + n * 0.1 * (1 - j)) + 0.3 * s, 6) AS score FROM j)
SELECT l_id, arg_min(unified_id, (-score, r_id)) AS unified_id, arg_min(r_id, (-score, r_id)) AS matched_id, max(score) AS score FROM t WHERE score >= {THRESHOLD} GROUP BY 1""",
    "blocking_rebuilt": f"""WITH e AS (SELECT unified_id, p.* FROM ({INDEX}) JOIN ({PEOPLE}) p USING (source, source_id))
SELECT DISTINCT 'email:' || trim(email_token) AS blocking_key, 'email' AS blocking_key_type, unified_id, true AS is_primary FROM e WHERE trim(email_token) <> ''
UNION SELECT 'phone:' || phone_token, 'phone', unified_id, false FROM e WHERE length(phone_token) >= 6 UNION SELECT 'name_zip:' || lower(last_name[1:3]) || '_' || zip, 'name_zip', unified_id, false FROM e""",
    "entity_pivot": _PIVOT,
    "unified_customers": f"""SELECT unified_id, customer_id, supplier_id, source_count, coalesce(s_name, c_name) AS name, least(c_acctbal, s_acctbal) AS low_balance, greatest(c_acctbal, s_acctbal) AS high_balance
FROM ({_PIVOT}) LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = customer_id LEFT JOIN supplier ON CAST(s_suppkey AS VARCHAR) = supplier_id""",
    "orders_unified": f"SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS customer_id, unified_id FROM orders LEFT JOIN (SELECT * FROM ({INDEX}) WHERE source = 'customer') ON source_id = CAST(o_custkey AS VARCHAR)",
    "profile_sessions": f"SELECT user_id, sess_num, session_start, session_end, events FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY session_start DESC, sess_num DESC) AS rn FROM ({_sessions(1800)})) WHERE rn = 1",
    "entity_methods": f"SELECT match_type, count(*) AS rows, count(DISTINCT unified_id) AS entities FROM ({INDEX}) GROUP BY 1",
    "repeated_records": "SELECT source, source_id, count(DISTINCT unified_id) AS n_ids, string_agg(DISTINCT unified_id, ',' ORDER BY unified_id) AS ids FROM entity_index WHERE source IS NOT NULL AND source_id IS NOT NULL AND unified_id IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT unified_id) > 1",
    "cross_source_entities": "SELECT unified_id, count(DISTINCT source) AS n_sources, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM entity_index WHERE source IS NOT NULL AND unified_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) > 1",
}
