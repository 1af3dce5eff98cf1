"""Scans with declared schemas, and the routing of landed events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_events(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON-lines folder: missing fields are null, records that do not parse are dropped."""
    s = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    wide = T.StructType([*s.fields, T.StructField("_corrupt", T.StringType())])
    rows = spark.read.schema(wide).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("_corrupt is null").drop("_corrupt")


def json_event_stream(spark: SparkSession, path: str, schema: str, event_time: str, delay: str = "5 seconds") -> DataFrame:
    """The same folder as a stream, with a watermark on its event time."""
    return spark.readStream.schema(schema).json(path).withWatermark(event_time, delay)


def kafka_stream(spark: SparkSession, servers: str, topic: str, schema: str, delay: str = "5 seconds") -> DataFrame:
    """A JSON topic from its earliest offset; the event time is the record's. Needs the Kafka connector jar."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()
    parsed = raw.select(F.from_json(F.col("value").cast("string"), schema, {"mode": "PERMISSIVE"}).alias("r"), F.col("timestamp").alias("event_time"))
    return parsed.where("r is not null").select("r.*", "event_time").withWatermark("event_time", delay)


def or_typed_nulls(df: DataFrame | None, key: str, base: DataFrame, columns: dict[str, str]) -> DataFrame:
    """base with the columns of an optional source joined on key; typed nulls where the source does not exist."""
    if df is None:
        return base.select("*", *[F.lit(None).cast(t).alias(c) for c, t in columns.items()])
    return base.join(df.select(key, *columns), key, "left")


def table_or(spark: SparkSession, name: str, fallback: DataFrame) -> DataFrame:
    """A catalog table if it exists, else the fallback; any other failure is raised."""
    return spark.table(name) if spark.catalog.tableExists(name) else fallback


def routed(event_type: Column, topics: dict[str, str], other: str | None = "events") -> Column:
    """Topic of an event type; `other` (null: drop) for unknown ones."""
    known = F.create_map(*[F.lit(x) for kv in topics.items() for x in kv])
    return F.coalesce(F.try_element_at(known, event_type), F.lit(other))


def enveloped(df: DataFrame, source: str, event_type: Column, received_at: str) -> DataFrame:
    """df with the landing envelope."""
    return df.select("*", F.lit(received_at).cast("timestamp").alias("_webhook_received_at"), F.lit(source).alias("_source"), event_type.alias("_event_type"))


def text_stream(spark: SparkSession, path: str) -> DataFrame:
    """A folder of text files as a stream of raw payloads."""
    return spark.readStream.text(path).withColumnRenamed("value", "payload")


def register_views(spark: SparkSession, folder: str, prefix: str = "") -> list[str]:
    """A temporary view over each Parquet table of a folder; their names in order. Views are made anew if they exist."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName().removesuffix(".parquet") for s in fs.listStatus(root) if s.getPath().getName().endswith(".parquet"))
    for n in names:
        spark.read.parquet(f"{folder}/{n}.parquet").createOrReplaceTempView(f"{prefix}{n}")
    return names


def listed_tables(spark: SparkSession, namespaces: list[str]) -> list[str]:
    """Qualified names of the tables of some namespaces; namespaces that do not exist are passed over."""
    return [f"{n}.{t.name}" for n in namespaces if spark.catalog.databaseExists(n) for t in spark.catalog.listTables(n) if not t.isTemporary]


def write_files(df: DataFrame, path: str, kind: str) -> str:
    """Rows as files: json (lines), csv or parquet, replacing what is there."""
    if kind not in ("json", "csv", "parquet"):
        raise ValueError(f"unknown format {kind!r}")
    df.write.mode("overwrite").format(kind).save(path)
    return path


#: What generated people are called.
FIRST_NAMES = ("Ada", "Ben", "Cleo", "Dan", "Eva", "Finn", "Gus", "Hal")
#: Columns a generated source has besides person, email and name, as SQL over n (the row) and h (a number from a digest).
GENERATED = {
    "shop": {"orders_count": "h % 9", "total_spent": "cast(h % 100000 as decimal(18,2)) / 100"},
    "mail": {"open_rate": "cast(h % 101 as double) / 100", "status": "if(h % 7 = 0, 'unsubscribed', 'subscribed')"},
    "payments": {"amount": "h % 50000", "currency": "if(h % 3 = 0, 'EUR', 'USD')"},
    "crm": {"lifecycle": "elt(1 + h % 3, 'lead', 'customer', 'other')"},
    "web": {"page_views": "h % 40", "medium": "elt(1 + h % 4, 'organic', 'cpc', 'email', 'referral')"},
}


def generate_people(spark: SparkSession, source: str, rows: int, pool: int, seed: int = 42) -> DataFrame:
    """Synthetic rows of a source whose people are drawn from a pool shared by all sources, the same for one seed
    whatever the partitions: every value follows from a digest of seed, source and row."""
    digest = lambda salt: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit(source), F.lit(salt), "n")), 1, 12), 16, 10).cast("bigint")
    base = spark.range(rows).select(F.col("id").alias("n"), (digest("person") % pool).alias("person"), digest("value").alias("h"))
    named = base.withColumns({"email": F.concat(F.lit("p"), "person", F.lit("@pool.example")), "name": F.element_at(F.array(*map(F.lit, FIRST_NAMES)), (F.col("person") % len(FIRST_NAMES) + 1).cast("int"))})
    return named.select("n", "person", "email", "name", *[F.expr(e).alias(c) for c, e in GENERATED[source].items()])
