"""Metric samples, their text exposition, and alert rules over them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sample:
    name: str
    value: float
    labels: dict[str, str] = field(default_factory=dict)


#: Metric name -> help text; samples of other names are refused.
REGISTERED = {
    "table_rows": "Rows of a table",
    "table_files": "Data files of a table",
    "table_snapshots": "Snapshots kept of a table",
    "entity_coverage_percent": "Share of a source's records that have an entity",
    "entity_duplicate_records": "Records under several entities",
    "column_null_rate": "Share of nulls in a column",
    "vault_entries": "Tokens in the vault by class",
    "job_success": "1 if the job's last run succeeded",
    "job_duration_seconds": "Duration of the job's last run",
    "job_last_success": "Time of the job's last success",
    "job_last_failure": "Time of the job's last failure",
}


def _escaped(v: str) -> str:
    return v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")


def exposition(samples: list[Sample]) -> str:
    """Prometheus text format: samples grouped by name, labels in order, one HELP and TYPE a name, a final line end."""
    by_name: dict[str, list[str]] = {}
    for s in samples:
        if s.name not in REGISTERED:
            raise ValueError(f"metric {s.name} is not registered")
        labels = ",".join(f'{k}="{_escaped(str(s.labels[k]))}"' for k in sorted(s.labels))
        by_name.setdefault(s.name, [f"# HELP {s.name} {REGISTERED[s.name]}", f"# TYPE {s.name} gauge"]).append(f"{s.name}{'{' + labels + '}' if labels else ''} {s.value:g}")
    return "".join(f"{line}\n" for lines in by_name.values() for line in lines)


#: Words of the query language that are no metrics; those of CLAUSES are followed by labels in brackets.
OPERATORS = {"and", "or", "unless", "bool", "offset", "inf", "nan"}
CLAUSES = {"by", "without", "on", "ignoring", "group_left", "group_right"}


def metric_names(expression: str) -> set[str]:
    """Metric names in a query expression: identifiers that are no function, keyword, label or duration.

    A scan over the characters with a stack of brackets: names count at depth of calls only, not inside braces,
    squares or the brackets of a clause."""
    found: set[str] = set()
    stack: list[str] = []
    i, n, clause = 0, len(expression), False
    while i < n:
        c = expression[i]
        if c in "\"'":
            i += 1
            while i < n and expression[i] != c:
                i += 2 if expression[i] == "\\" else 1
        elif c in "([{":
            stack.append("labels" if clause or c != "(" else "call")
            clause = False
        elif c in ")]}":
            if stack:
                stack.pop()
        elif c.isdigit() or c == ".":
            while i + 1 < n and (expression[i + 1].isalnum() or expression[i + 1] == "."):
                i += 1
        elif c.isalpha() or c in "_:":
            j = i
            while j < n and (expression[j].isalnum() or expression[j] in "_:"):
                j += 1
            word, rest = expression[i:j], expression[j:].lstrip()
            if word in CLAUSES:
                clause = rest.startswith("(")
            elif "labels" not in stack and word not in OPERATORS and not rest.startswith("(") and not _is_function_with_clause(word, rest):
                found.add(word)
            i = j - 1
        i += 1
    return found


def _is_function_with_clause(word: str, rest: str) -> bool:
    """`sum by (x) (...)`: an aggregation whose clause stands before its argument."""
    return any(rest.startswith(c) and not rest[len(c) : len(c) + 1].isalnum() for c in ("by", "without"))


def frame(spark: SparkSession, samples: list[Sample]) -> DataFrame:
    """Samples as rows (name, labels, value)."""
    return spark.createDataFrame([(s.name, s.labels, float(s.value)) for s in samples], "name string, labels map<string,string>, value double").select("name", F.array_join(F.array_sort(F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("labels"), "value")


def table_gauges(layer: str, name: str, table) -> list[Sample]:
    """Rows, files and snapshots of a table of the store, from its log; none for a table that does not exist."""
    if not table.exists():
        return []
    labels = {"layer": layer, "table": name}
    return [Sample("table_rows", table.snapshot().rows, labels), Sample("table_files", len(table.files()), labels), Sample("table_snapshots", len(table.versions()), labels)]


def outcome_gauges(job: str, started: float, ended: float, succeeded: bool) -> list[Sample]:
    """What a job leaves behind when it ends."""
    last = "job_last_success" if succeeded else "job_last_failure"
    return [Sample("job_success", float(succeeded), {"job": job}), Sample("job_duration_seconds", ended - started, {"job": job}), Sample(last, ended, {"job": job})]


@dataclass(frozen=True)
class Rule:
    """An alert: a metric against a limit; minus or over: the same labels' value of another metric taken off first, or
    divided by (samples without it, or with a zero, raise nothing)."""

    alert: str
    metric: str
    test: str
    limit: float
    minus: str | None = None
    over: str | None = None


TESTS = {">": lambda c, v: c > v, "<": lambda c, v: c < v, ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v, "==": lambda c, v: c == v}
#: The alerts of the platform's own gauges.
RULES = [
    Rule("pipeline failed", "job_last_failure", ">", 0, minus="job_last_success"),
    Rule("pipeline slow", "job_duration_seconds", ">", 600),
    Rule("pipeline stale", "job_age_seconds", ">", 21_600),
    Rule("no new rows", "table_rows_increase", "==", 0),
    Rule("staging behind", "staging_lag_share", ">", 0.1),
    Rule("coverage low", "entity_coverage_percent", "<", 90),
    Rule("records under several entities", "entity_duplicate_records", ">", 0),
    Rule("service down", "service_up", "==", 0),
    Rule("consumer behind", "consumer_lag", ">", 10_000),
    Rule("storage nearly full", "storage_free_bytes", "<", 0.15, over="storage_total_bytes"),
    Rule("too many files", "table_files", ">", 100),
    Rule("too many snapshots", "table_snapshots", ">", 50),
]


def firing(samples: DataFrame, rules: list[Rule]) -> DataFrame:
    """(alert, name, labels, value) of samples (name, labels, value) that break a rule; value is what was compared."""
    text = F.to_json("labels") if dict(samples.dtypes)["labels"].startswith("map") else F.col("labels")
    keyed = samples.withColumn("_at", text)
    others = sorted({x for r in rules for x in (r.minus, r.over) if x})
    if others:
        beside = keyed.where(F.col("name").isin(others)).groupBy("_at").agg(*[F.max(F.when(F.col("name") == o, F.col("value"))).alias(f"_{o}") for o in others])
        keyed = keyed.join(beside, "_at", "left")
    hits = []
    for r in rules:
        value = F.col("value") - F.col(f"_{r.minus}") if r.minus else F.try_divide("value", F.col(f"_{r.over}")) if r.over else F.col("value")
        hits.append(F.when((F.col("name") == r.metric) & TESTS[r.test](value, r.limit), F.struct(F.lit(r.alert).alias("alert"), value.alias("value"))))
    hit = F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("hit")
    return keyed.select("name", "labels", hit).select("hit.alert", "name", "labels", "hit.value")
