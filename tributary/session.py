"""Session construction, table access and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "tributary", cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the engine expects: UTC, AQE and ANSI arithmetic."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in {**base, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where it is set; only without one, and only where driver
    and executors are one machine (tests, a laptop), is a temporary folder made and set."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="tributary-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    sc.setCheckpointDir(local)
    return f"file://{local}"


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage like a reliable checkpoint, but columnar and with
    statistics for the planner. The rows stay until forget(), or as long as the shared folder does."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Deletes what saved() wrote for these frames, once nothing that is still to be computed reads them."""
    for df in frames:
        path = df.__dict__.pop("_saved_at", None)
        if path:
            drop_path(df.sparkSession, path)


def saved_rows(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """saved(), and the number of its rows, counted on the way."""
    seen = Observation()
    out = saved(df.observe(seen, F.count(F.lit(1)).alias("n")), label)
    return out, seen.get["n"]


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


Query = Callable[[SparkSession, str], DataFrame]
