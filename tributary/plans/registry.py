"""All queries of the core by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from tributary.plans import core_problems as core
from tributary.plans import core_sql, entities, entities_sql, serving, serving_sql, staged, staged_sql, streams, tables, tables_sql
from tributary.session import Query

FLAGSHIP = "order_summary"

QUERIES: dict[str, Query] = {
    "p1_found": core.p1_found,
    "p5_found": core.p5_found,
    "p5_report": core.p5_report,
    "p6_found": core.p6_found,
    "p6_undeclared": core.p6_undeclared,
    "p6_accuracy": core.p6_accuracy,
    "p7_found": core.p7_found,
    "p7_messages": core.p7_messages,
    "p7_shopify_customers": core.p7_shopify_customers,
    "p7_mailchimp_subscribers": core.p7_mailchimp_subscribers,
    "p7_incremental_watermarks": core.p7_incremental_watermarks,
    **tables.QUERIES,
    **staged.QUERIES,
    **entities.QUERIES,
    **serving.QUERIES,
    **streams.QUERIES,
}

ORACLE: dict[str, str] = {**core_sql.ORACLE, **tables_sql.ORACLE, **staged_sql.ORACLE, **entities_sql.ORACLE, **serving_sql.ORACLE, **streams.ORACLE}
