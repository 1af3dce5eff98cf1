"""Incremental processing: watermarks, touched partitions, and specs that tie write mode to read scope."""

from __future__ import annotations

import graphlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.sources.lake import LakeTable


class Watermarks:
    """Control table (target, source, value): the largest source value processed, advanced after the write commits."""

    SCHEMA = "target string, source string, value timestamp, updated_at timestamp"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, LakeTable(spark, path)

    def get(self, target: str, source: str):
        if not self.table.exists():
            return None
        row = self.table.read().where((F.col("target") == target) & (F.col("source") == source)).agg(F.max("value")).first()
        return row[0]

    def set(self, target: str, source: str, value, run_ts) -> None:
        self.table.merge_upsert(self.spark.createDataFrame([(target, source, value, run_ts)], self.SCHEMA), ["target", "source"])


def since(df: DataFrame, column: str, watermark) -> DataFrame:
    """Rows after the watermark (all without one); the filter reaches the scan."""
    return df if watermark is None else df.where(F.col(column) > F.lit(watermark))


def recompute_touched(source: DataFrame, changed: DataFrame, partition: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """build() over all source rows of the partitions that have changed rows: what a dynamic overwrite may write."""
    touched = changed.select(partition).distinct()
    return build(source.join(touched, partition, "left_semi"))


@dataclass(frozen=True)
class TableSpec:
    """A derived table. A filtered read may only append or overwrite the partitions it recomputes; an unfiltered read
    must replace or merge. Anything else duplicates or loses rows, and is refused when the spec is made."""

    name: str
    build: Callable
    read_scope: str  # "all", "new" or "touched"
    write_mode: str  # "replace", "merge", "append", "insert" or "overwrite"
    keys: tuple[str, ...] = ()
    depends_on: tuple[str, ...] = field(default=())

    ALLOWED = {"all": {"replace", "merge"}, "new": {"append", "insert"}, "touched": {"overwrite"}}

    def __post_init__(self):
        if self.write_mode not in self.ALLOWED.get(self.read_scope, set()):
            raise ValueError(f"{self.name}: reading {self.read_scope} rows and writing by {self.write_mode} is not idempotent")
        if self.write_mode in ("merge", "insert") and not self.keys:
            raise ValueError(f"{self.name}: {self.write_mode} needs keys")

    def write(self, table: LakeTable, df: DataFrame):
        how = {"replace": table.replace, "append": table.append, "overwrite": table.overwrite_partitions}
        if self.write_mode in how:
            return how[self.write_mode](df)
        return (table.merge_upsert if self.write_mode == "merge" else table.merge_insert)(df, list(self.keys))


def run(spec: TableSpec, table: LakeTable, read: Callable[[str], DataFrame], mode: str, dry_run: bool = False):
    """Runs one table: `full` reads all and replaces; `incremental` reads the spec's scope and writes by its mode, or
    does as `full` for a table that does not exist yet. read gives the source rows of a scope. dry_run: the rows that
    would be written are returned, and nothing is."""
    if mode not in ("full", "incremental"):
        raise ValueError(f"unknown mode {mode!r}")
    whole = mode == "full" or not table.exists()
    rows = spec.build(read("all" if whole else spec.read_scope))
    if dry_run:
        return rows
    return table.replace(rows) if whole else spec.write(table, rows)


def run_all(specs: list[TableSpec], run_one: Callable[[TableSpec], object], only: list[str] | None = None) -> dict[str, str]:
    """Runs the specs in order; a table whose dependency failed is skipped, and the others go on. name -> done, failed
    or skipped. only: these tables alone, taken to depend on nothing that is not among them."""
    by_name = {s.name: s for s in specs if only is None or s.name in only}
    outcome: dict[str, str] = {}
    for name in run_order(list(by_name.values())):
        if any(outcome.get(d, "done") != "done" for d in by_name[name].depends_on):
            outcome[name] = "skipped"
            continue
        try:
            run_one(by_name[name])
            outcome[name] = "done"
        except Exception:  # noqa: BLE001 - one table's failure is no other's
            outcome[name] = "failed"
    return outcome


def rebuild(specs: list[TableSpec], tables: dict[str, LakeTable], run_one: Callable[[TableSpec], object]) -> dict[str, str]:
    """Purges the tables, those that depend on others first, and runs all of them anew."""
    for name in reversed(run_order(specs)):
        tables[name].purge()
    return run_all(specs, run_one)


def sql_lineage(statements: dict[str, str]) -> dict[str, set[str]]:
    """Target -> tables it reads, of SQL statements by name: names after FROM and JOIN that are no common table
    expressions; the target is the name after INSERT INTO or TABLE, else the statement's."""
    out = {}
    for name, text in statements.items():
        words = re.findall(r"[A-Za-z_][\w.]*|[(),]", re.sub(r"--[^\n]*|'(?:[^']|'')*'", " ", text))
        upper = [w.upper() for w in words]
        ctes = {words[i - 1].lower() for i in range(1, len(words) - 1) if upper[i] == "AS" and words[i + 1] == "("}
        reads = {words[i + 1] for i in range(len(words) - 1) if upper[i] in ("FROM", "JOIN") and words[i + 1] != "("}
        target = next((words[i + 1] for i in range(len(words) - 1) if upper[i] in ("INTO", "TABLE") and upper[i + 1] not in ("IF",)), name)
        out[target] = {r for r in reads if r.lower() not in ctes and r != target}
    return out


def sql_order(statements: dict[str, str]) -> list[str]:
    """Targets of SQL statements in an order in which every one follows what it reads; a cycle raises."""
    lineage = sql_lineage(statements)
    return [n for n in graphlib.TopologicalSorter({t: {r for r in reads if r in lineage} for t, reads in lineage.items()}).static_order()]


def run_order(specs: list[TableSpec]) -> list[str]:
    """Names in an order in which every table follows what it depends on; a cycle raises."""
    return [n for n in graphlib.TopologicalSorter({s.name: set(s.depends_on) for s in specs}).static_order() if n in {s.name for s in specs}]
