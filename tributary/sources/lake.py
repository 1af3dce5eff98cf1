"""A snapshotting table over Parquet: a folder of data files and a log of manifests.

Every write puts its files into a new folder and commits by creating the next numbered manifest, which fails if
another writer has created it; readers take the newest manifest, so they see a write whole or not at all. A manifest
lists data folders, each with its partition, or single files of a folder whose other files a merge has rewritten;
nothing that a reader may be using is ever overwritten. A writer commits on the version that it has read, so what came
in between is a conflict and never lost.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.session import forget, saved


class CommitConflict(RuntimeError):
    pass


class CardinalityViolation(ValueError):
    """Several source rows of one key in a merge."""


@dataclass(frozen=True)
class Snapshot:
    version: int
    committed_at: float
    operation: str
    rows: int
    folders: dict[str, list[str]]
    schema: str
    #: Files that a merge had to rewrite.
    rewritten: int = 0


class LakeTable:
    """A table at a path; partition names an optional column whose values are the units of overwriting."""

    def __init__(self, spark: SparkSession, path: str, partition: str | None = None):
        self.spark, self.path, self.partition = spark, path.rstrip("/"), partition

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    # -- log -----------------------------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/log")
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))

    def snapshot(self, version: int | None = None) -> Snapshot | None:
        known = self.versions()
        if not known:
            return None
        v = known[-1] if version is None else version
        if v not in known:
            raise ValueError(f"{self.path} has no version {v}")
        fs, p = self._fs(f"{self.path}/log/{v:010d}.json")
        stream = fs.open(p)
        try:
            return Snapshot(**json.loads(bytes(stream.readAllBytes()).decode()))
        finally:
            stream.close()

    def snapshots(self) -> list[Snapshot]:
        return [self.snapshot(v) for v in self.versions()]

    def _commit(self, folders: dict[str, list[str]], schema: str, rows: int, operation: str, base: int, rewritten: int = 0) -> Snapshot:
        snap = Snapshot(base + 1, time.time(), operation, rows, folders, schema, rewritten)
        fs, p = self._fs(f"{self.path}/log/{snap.version:010d}.json")
        try:
            out = fs.create(p, False)
        except Exception as e:
            raise CommitConflict(f"version {snap.version} of {self.path} was committed by another writer") from e
        out.write(json.dumps(snap.__dict__).encode())
        out.close()
        return snap

    # -- reading -------------------------------------------------------------------------------------------------

    def exists(self) -> bool:
        return bool(self.versions())

    def read(self, version: int | None = None, partitions: list[str] | None = None) -> DataFrame:
        snap = self.snapshot(version)
        if snap is None:
            raise ValueError(f"{self.path} is no table")
        at = sorted(f"{self.path}/{f}" for k, fs in snap.folders.items() if partitions is None or k in partitions for f in fs)
        schema = T.StructType.fromJson(json.loads(snap.schema))
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    # -- writing -------------------------------------------------------------------------------------------------

    def _write(self, df: DataFrame) -> tuple[dict[str, list[str]], int]:
        """Writes the rows to a new folder; partition -> folders, and the number of rows (observed on the way)."""
        from pyspark.sql import Observation

        seen, folder = Observation(), f"data/{uuid.uuid4().hex}"
        df = df.observe(seen, F.count(F.lit(1)).alias("n"))
        if not self.partition:
            df.write.parquet(f"{self.path}/{folder}")
            return {"": [folder]}, seen.get["n"]
        df.withColumn("_p", self._place()).write.partitionBy("_p").parquet(f"{self.path}/{folder}")
        fs, p = self._fs(f"{self.path}/{folder}")
        unescape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
        return {unescape(n.removeprefix("_p=")): [f"{folder}/{n}"] for n in names}, seen.get["n"]

    def _place(self):
        return F.coalesce(F.col(self.partition).cast("string"), F.lit("null")) if self.partition else F.lit("")

    def _head(self) -> tuple[int, dict[str, list[str]], int]:
        snap = self.snapshot()
        return (snap.version, snap.folders, snap.rows) if snap else (0, {}, 0)

    def append(self, df: DataFrame, base: int | None = None) -> Snapshot:
        """Adds rows. base: the version that df was made from, if that must still be the latest."""
        version, old, n = self._head()
        base = version if base is None else base
        new, rows = self._write(df)
        return self._commit({k: [*old.get(k, []), *new.get(k, [])] for k in {**old, **new}}, df.schema.json(), n + rows, "append", base)

    def replace(self, df: DataFrame) -> Snapshot:
        base, _, _ = self._head()
        new, rows = self._write(df)
        return self._commit(new, df.schema.json(), rows, "replace", base)

    def overwrite_partitions(self, df: DataFrame) -> Snapshot:
        """Replaces just the partitions that occur in df; the others keep their folders."""
        if not self.partition:
            raise ValueError("the table has no partition column")
        base, old, _ = self._head()
        new, rows = self._write(df)
        folders = {**old, **new}
        kept = [f"{self.path}/{f}" for k, fs in folders.items() if k not in new for f in fs]
        others = self.spark.read.schema(df.schema).parquet(*kept).count() if kept else 0
        return self._commit(folders, df.schema.json(), rows + others, "overwrite", base)

    def truncate(self) -> Snapshot:
        snap = self.snapshot()
        return self._commit({}, snap.schema, 0, "truncate", snap.version)

    def swap_partitions(self, df: DataFrame, gone: list[str], base: int, before: Callable[[DataFrame], object] | None = None) -> Snapshot:
        """Removes some partitions and adds the rows of df to what is left, in one step on version `base`. before is
        given the rows as written, when nobody else sees them yet."""
        snap = self.snapshot(base) if base else None
        old = {k: fs for k, fs in (snap.folders if snap else {}).items() if k not in gone}
        lost = self.read(base, gone).count() if snap and gone else 0
        new, rows = self._write(df)
        if before and rows:
            before(self.spark.read.schema(df.schema).parquet(*[f"{self.path}/{f}" for fs in new.values() for f in fs]))
        folders = {k: [*old.get(k, []), *new.get(k, [])] for k in {**old, **new}}
        return self._commit(folders, df.schema.json(), (snap.rows if snap else 0) - lost + rows, "swap", base, len(gone))

    def _paths(self, at: str) -> list[str]:
        """The data files of a manifest's entry, itself if it is a file."""
        if at.endswith(".parquet"):
            return [at]
        fs, p = self._fs(f"{self.path}/{at}")
        return [f"{at}/{s.getPath().getName()}" for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet")]

    def merge_upsert(self, df: DataFrame, keys: list[str]) -> Snapshot:
        """Rows of df replace the target's rows of the same key or are added. Several rows of a key raise.

        Only files that hold a key of df are rewritten, and of the others not even the rows are read, just the keys;
        `rewritten` of the snapshot is their number. Null keys match nothing."""
        delta = saved(df, "merge-delta")
        if not delta.groupBy(*keys).count().where("count > 1").isEmpty():
            raise CardinalityViolation(f"source rows repeat a key of {keys}")
        if not self.exists():
            return self.replace(delta)
        base, folders, n = self._head()
        named = self.read(base).select(*keys, F.input_file_name().alias("_file"))
        hit = {unquote(r[0]).split(f"{self.path.rsplit('/', 1)[-1]}/data/", 1)[1] for r in named.join(delta.select(*keys), keys, "left_semi").select("_file").distinct().collect()}
        kept: dict[str, list[str]] = {}
        touched: list[str] = []
        uuids = {h.split("/")[0] for h in hit}
        for place, entries in folders.items():
            for entry in entries:
                files = self._paths(entry) if entry.split("/")[1] in uuids else []
                mine = [f for f in files if f.removeprefix("data/") in hit]
                touched += mine
                kept.setdefault(place, []).extend([entry] if not mine else [f for f in files if f not in mine])
        old = self.spark.read.schema(T.StructType.fromJson(json.loads(self.snapshot(base).schema))).parquet(*[f"{self.path}/{f}" for f in touched]) if touched else None
        rows = delta if old is None else old.join(delta.select(*keys), keys, "left_anti").select(*delta.columns).unionByName(delta)
        new, written = self._write(rows)
        merged = {k: [*kept.get(k, []), *new.get(k, [])] for k in {**kept, **new}}
        forget(delta)
        return self._commit({k: v for k, v in merged.items() if v}, df.schema.json(), n - (old.count() if old is not None else 0) + written, "merge", base, len(touched))

    def merge_insert(self, df: DataFrame, keys: list[str]) -> Snapshot:
        """Appends the rows of df whose key the target lacks; existing rows are never rewritten. Of several rows of a
        key the one with the smallest other columns (nulls first) is taken, so that a second run takes the same."""
        rest = [c for c in df.columns if c not in keys]
        once = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*keys, "_row.*").select(*df.columns) if rest else df.distinct()
        base, _, _ = self._head()
        return self.append(once.join(self.read(base).select(*keys), keys, "left_anti") if base else once, base)

    # -- maintenance ---------------------------------------------------------------------------------------------

    def files(self, version: int | None = None) -> list[tuple[str, int]]:
        """(path, bytes) of the data files of a version."""
        out = []
        snap = self.snapshot(version)
        for f in sorted(f for fs in (snap.folders if snap else {}).values() for f in fs):
            fs, p = self._fs(f"{self.path}/{f}")
            out += [(str(s.getPath()), s.getLen()) for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet")]  # of a file: itself
        return out

    def file_rows(self, version: int | None = None) -> DataFrame:
        """(path, rows) of the data files of a version that hold any rows."""
        return self.read(version).groupBy(F.input_file_name().alias("path")).agg(F.count(F.lit(1)).alias("rows"))

    def compact(self, target_bytes: int = 128 << 20, least_files: int = 5, dry_run: bool = False) -> int:
        """Rewrites the table in files of about target_bytes; skipped (0) below least_files. Files saved."""
        files = self.files()
        want = max(1, -(-sum(n for _, n in files) // target_bytes))
        if len(files) < least_files or want >= len(files):
            return 0
        if dry_run:
            return len(files) - want
        base, _, rows = self._head()
        df = self.read()
        new, _ = self._write(df.repartition(want, F.col(self.partition)) if self.partition else df.coalesce(want))
        self._commit(new, df.schema.json(), rows, "compact", base)
        return len(files) - len(self.files())

    def expire(self, older_than: float, retain_last: int = 3, dry_run: bool = False) -> list[int]:
        """Drops manifests committed before older_than, but the last retain_last (1 at least). Versions dropped."""
        keep = max(1, retain_last)
        gone = [s.version for s in self.snapshots()[:-keep] if s.committed_at < older_than]
        for v in [] if dry_run else gone:
            fs, p = self._fs(f"{self.path}/log/{v:010d}.json")
            fs.delete(p, False)
        return gone

    def remove_orphans(self, older_than: float, dry_run: bool = False) -> list[str]:
        """Deletes data folders that no manifest names and that were written before older_than."""
        used = {f.split("/")[1] for s in self.snapshots() for fs in s.folders.values() for f in fs}
        fs, p = self._fs(f"{self.path}/data")
        if not fs.exists(p):
            return []
        gone = [s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName() not in used and s.getModificationTime() < older_than * 1000]
        for n in [] if dry_run else gone:
            _, q = self._fs(f"{self.path}/data/{n}")
            fs.delete(q, True)
        return gone

    def rollback(self, version: int) -> Snapshot:
        """A new version with the contents of an old one."""
        old = self.snapshot(version)
        return self._commit(old.folders, old.schema, old.rows, "rollback", self.versions()[-1])

    def purge(self) -> None:
        fs, p = self._fs(self.path)
        fs.delete(p, True)
