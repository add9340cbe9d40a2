"""Reading and writing the stored tables: logs, alerts, threat indicators, baselines, profiles."""

from __future__ import annotations

import uuid
from datetime import datetime
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from emberwatch.functions import predicates as P
from emberwatch.functions.fields import json_map
from emberwatch.schema import ALERT_SCHEMA, BASELINE_SCHEMA, LOG_SCHEMA, THREAT_INTEL_SCHEMA

# The columns that logs can be filtered by.
FILTER_COLUMNS = ("appname", "host", "hostname", "source_type", "file")


def timestamp(t: datetime | str | Column) -> Column:
    return t if isinstance(t, Column) else F.lit(t).cast("timestamp")


# --- shared folder -------------------------------------------------------------------------


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, or one in the session's warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return (folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch").rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def partition_values(spark: SparkSession, path: str, column: str) -> list[str]:
    """The values of a table's first partition column, by one listing of its folder; none where it doesn't exist."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    return [n.partition("=")[2] for n in names if n.startswith(f"{column}=")]


#: Rows of a given table that one task parses.
SPREAD_ROWS = 50_000


def spread(scan: DataFrame) -> DataFrame:
    """A frame straight from a scan, redistributed if its table has fewer files than it needs tasks: one a core, and one
    for each ``SPREAD_ROWS`` rows, so that the longest task does not grow with the table.

    A file may be cut into as many partitions as there are cores, but all rows of a row group come in one of these, and a
    file of a gigabyte may have a single row group. Tables of many files are left as they are. The count reads no column.
    """
    tasks = max(scan.sparkSession.sparkContext.defaultParallelism, -(-scan.count() // SPREAD_ROWS))
    return scan.repartition(max(tasks, scan.rdd.getNumPartitions())) if len(scan.inputFiles()) < tasks else scan


#: Bytes of a row group in intermediate tables: the least that a reading task can be given.
ROW_GROUP = 16 << 20


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write once to the shared folder and read back: a table that survives lost executors, whose
    columns are pruned per query and whose definition no optimiser rule can inline again."""
    path = path or new_folder(df.sparkSession, name)
    df.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- logs ----------------------------------------------------------------------------------


def log_filters(filters: dict[str, Any] | None) -> Column:
    ok = F.lit(True)
    for name, wanted in (filters or {}).items():
        if name not in FILTER_COLUMNS:
            raise ValueError(f"logs cannot be filtered by {name!r}; use one of {FILTER_COLUMNS}")
        ok = ok & (F.col(name) == wanted)
    return ok


def time_range(column: str, start=None, end=None) -> Column:
    """Inclusive at both ends; pushed down to the Parquet scan."""
    ok = F.lit(True)
    if start is not None:
        ok = ok & (F.col(column) >= timestamp(start))
    if end is not None:
        ok = ok & (F.col(column) <= timestamp(end))
    return ok


def scan_logs(
    logs: DataFrame,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    filters: dict[str, Any] | None = None,
    search: str | None = None,
) -> DataFrame:
    """Filtered log rows; for a page of them, newest first, see ``newest``."""
    found = logs.filter(time_range("ingestion_time", start, end)).filter(log_filters(filters))
    return found.filter(P.text_search(search)) if search else found


def newest(df: DataFrame, limit: int, offset: int = 0, time: str = "ingestion_time") -> DataFrame:
    """One page in a total order: the id breaks ties, so pages neither overlap nor lose rows."""
    ordered = df.orderBy(F.desc(time), "id")
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def recent_logs(logs: DataFrame, as_of: datetime | str, minutes: int = 1) -> DataFrame:
    now = timestamp(as_of)
    return logs.filter(F.col("ingestion_time").between(now - F.expr(f"INTERVAL {minutes} MINUTES"), now))


def logs_by_ids(logs: DataFrame, ids: list[str] | DataFrame) -> DataFrame:
    """A short list becomes a pushed-down IN filter; a frame of ids is joined by its size."""
    if isinstance(ids, DataFrame):
        return logs.join(ids.select("id"), "id", "left_semi")
    return logs.filter(F.col("id").isin(*ids))


def count_logs(logs: DataFrame, start=None, end=None, filters: dict[str, Any] | None = None) -> DataFrame:
    return scan_logs(logs, start, end, filters).agg(F.count(F.lit(1)).alias("n"))


def logs_since(logs: DataFrame, checkpoint: datetime | str | None, as_of: datetime | str, interval_seconds: int = 60):
    """Rows after the checkpoint; without one, those of the last interval. No row cap."""
    if checkpoint is None:
        start = timestamp(as_of) - F.expr(f"INTERVAL {interval_seconds} SECONDS")
        return logs.filter(F.col("ingestion_time").between(start, timestamp(as_of)))
    return logs.filter((F.col("ingestion_time") > timestamp(checkpoint)) & (F.col("ingestion_time") <= timestamp(as_of)))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).parquet(path)


def append_logs(logs: DataFrame, path: str) -> None:
    """Missing ingestion times become now; partitioned by ingestion date for pruning."""
    rows = logs.withColumn("ingestion_time", F.coalesce("ingestion_time", F.current_timestamp()))
    rows.withColumn("ingest_date", F.to_date("ingestion_time")).write.mode("append").partitionBy("ingest_date").parquet(path)


def route_open_schema(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON objects of any shape to log rows: known keys become columns, all others metadata."""
    known = [f.name for f in LOG_SCHEMA if f.name not in ("metadata", "ingestion_time")]
    m = F.col("m")
    rest = F.map_filter(m, lambda k, _: ~k.isin(*known))
    parsed = lines.select(json_map(column).alias("m")).filter("m IS NOT NULL")
    return parsed.select(
        *[m[f.name].try_cast(f.dataType).alias(f.name) for f in LOG_SCHEMA if f.name in known],
        F.to_json(rest).alias("metadata"),
        m["ingestion_time"].try_cast("timestamp").alias("ingestion_time"),
    )


def flatten_log(logs: DataFrame) -> DataFrame:
    """(id, record): each log as one map, metadata keys laid over the columns."""
    names = [f.name for f in LOG_SCHEMA if f.name != "metadata"]
    columns = F.map_from_arrays(
        F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("string") for n in names])
    )
    extra = F.coalesce(json_map("metadata"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(columns, lambda k, _: ~F.map_contains_key(extra, k))
    return logs.select("id", F.map_concat(kept, extra).alias("record"))


def export_view(logs: DataFrame) -> DataFrame:
    """The six export columns of a prepared log frame."""
    text = F.coalesce(F.nullif("message", F.lit("")), "raw", F.lit(""))
    return logs.select(
        F.col("timestamp").alias("Timestamp"),
        F.coalesce("host", F.lit("")).alias("Host"),
        F.coalesce("appname", F.lit("")).alias("Application"),
        text.alias("Message"),
        F.coalesce("source_ip", F.lit("")).alias("Source IP"),
        F.coalesce("user", F.lit("")).alias("User"),
    )


def export_csv(logs: DataFrame, path: str) -> None:
    """Quotes inside values are doubled, as spreadsheet programs expect."""
    export_view(logs).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option(
        "quoteAll", True
    ).csv(path)


# --- alerts --------------------------------------------------------------------------------


def scan_alerts(
    alerts: DataFrame, start=None, end=None, severity: str | None = None, acknowledged: bool | None = None
) -> DataFrame:
    found = alerts.filter(time_range("created_at", start, end))
    if severity is not None:
        found = found.filter(F.col("severity") == severity)
    if acknowledged is not None:
        found = found.filter(F.col("acknowledged") == acknowledged)
    return found


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ALERT_SCHEMA).parquet(path)


def _stored_form(alerts: DataFrame) -> DataFrame:
    empty = F.col("metadata").isNull() | (F.col("metadata") == "{}")
    return alerts.withColumn("metadata", F.when(~empty, F.col("metadata"))).withColumn(
        "created_date", F.to_date("created_at")
    )


def append_alerts(alerts: DataFrame, path: str) -> int:
    """Append the alerts that aren't stored yet and return how many were; a retry appends nothing.

    The detectors run once: their alerts are written first, then compared with the ids stored for the same dates.
    """
    spark = alerts.sparkSession
    given = materialise(_stored_form(alerts).dropDuplicates(["id"]), "alerts")
    fresh, count = given, Observation()
    try:
        stored = spark.read.schema(StructType([*ALERT_SCHEMA.fields, StructField("created_date", DateType())])).parquet(path)
    except AnalysisException:  # nothing is stored yet
        stored = None
    if stored is not None:
        dates = given.select("created_date").distinct()
        stored = stored.join(dates, "created_date", "left_semi").select("id")
        fresh = given.join(stored, "id", "left_anti")
    fresh = fresh.observe(count, F.count(F.lit(1)).alias("n"))
    fresh.write.mode("append").partitionBy("created_date").parquet(path)
    return count.get["n"]


def replace_cycles(alerts: DataFrame, cycles: list[datetime], path: str) -> None:
    """Replace the alerts of these cycles, also by none: a row without id stands for each cycle."""
    spark = alerts.sparkSession
    marks = spark.createDataFrame([(c,) for c in cycles], "created_at timestamp")
    key = F.unix_timestamp("created_at").alias("cycle_end")
    rows = _stored_form(alerts).drop("created_date").unionByName(marks, allowMissingColumns=True)
    rows = rows.select("*", key).hint("rebalance", F.col("cycle_end"))  # a cycle of many alerts is split
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cycle_end").parquet(path)


def read_cycle_alerts(spark: SparkSession, path: str) -> DataFrame:
    """The alerts of all streams that wrote here; an alert that several found occurs once."""
    rows = spark.read.schema(ALERT_SCHEMA).option("recursiveFileLookup", True).parquet(path)
    return rows.where("id IS NOT NULL").dropDuplicates(["id"])


# --- threat indicators ---------------------------------------------------------------------


def scan_threat_intel(
    intel: DataFrame, as_of: datetime | str, indicator_type: str | None = None, value: str | None = None
) -> DataFrame:
    found = intel.filter(P.not_expired(F.col("expires_at"), timestamp(as_of)))
    if indicator_type is not None:
        found = found.filter(F.col("indicator_type") == indicator_type)
    if value is not None:
        found = found.filter(F.lower("indicator_value") == value.lower())
    return found


def new_indicators(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming indicators whose (type, value) is not stored yet: of several the most confident, then the newest."""
    key = [F.col("indicator_type").alias("k_type"), F.lower(F.trim("indicator_value")).alias("k_value")]
    rank = Window.partitionBy("k_type", "k_value").orderBy(F.desc("confidence"), F.desc("created_at"), "id")
    fresh = incoming.select("*", *key).withColumn("place", F.row_number().over(rank)).where("place = 1")
    return fresh.join(existing.select(*key), ["k_type", "k_value"], "left_anti").drop("k_type", "k_value", "place")


def upsert_threat_intel(incoming: DataFrame, path: str) -> None:
    spark = incoming.sparkSession
    existing = spark.read.schema(THREAT_INTEL_SCHEMA).parquet(path)
    new_indicators(existing, incoming).write.mode("append").parquet(path)


# --- baselines, rules, ad-hoc SQL ----------------------------------------------------------


def save_table(df: DataFrame, path: str) -> None:
    """Replace a stored table (baselines, profiles) that may be built from its own old content."""
    materialise(df, "replacement").write.mode("overwrite").parquet(path)


def read_baselines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BASELINE_SCHEMA).parquet(path)


def query(spark: SparkSession, text: str, args: dict[str, Any] | None = None, **frames: DataFrame) -> DataFrame:
    """Ad-hoc SQL with named parameters (``:name``) and frames (``{name}``)."""
    return spark.sql(text, args=args, **frames) if args else spark.sql(text, **frames)


def create_tables(spark: SparkSession, root: str) -> None:
    """Empty tables with the contract schemas, where none exist yet."""
    from emberwatch import schema as S

    layout = {
        "logs": S.LOG_SCHEMA,
        "alerts": S.ALERT_SCHEMA,
        "threat_intel": S.THREAT_INTEL_SCHEMA,
        "detection_rules": S.RULE_SCHEMA,
        "baselines": S.BASELINE_SCHEMA,
        "profiles": S.PROFILE_SCHEMA,
    }
    for name, schema in layout.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/{name}")
