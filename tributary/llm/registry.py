"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from tributary.llm import queries, sql
from tributary.session import Query

QUERIES: dict[str, Query] = {
    "p2_found": queries.p2_found,
    "p2_matches": queries.p2_matches,
    "p3_found": queries.p3_found,
    "p4_found": queries.p4_found,
    "p4_consensus": queries.p4_consensus,
    "p8_ids": queries.p8_ids,
    "p8_reuse": queries.p8_reuse,
    "p9_containers": queries.p9_containers,
    "p9_fill": queries.p9_fill,
    "p10_found": queries.p10_found,
    "p10_kinds": queries.p10_kinds,
    "p10_corpus": queries.p10_corpus,
}

ORACLE: dict[str, str] = {**sql.ORACLE}
