"""Inputs of the registered queries, for Spark and as SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.functions import fields as X
from emberwatch.sources import event_log as E
from emberwatch.sources.tables import materialise

AS_OF = "2024-01-31 00:00:00"
MIDDLE = "2024-01-16 00:00:00"
DAY = 86400
HOUR = 3600

_prepared: dict[tuple, DataFrame] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Materialised tables are shared by the queries of a session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _prepared:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        _prepared[key] = materialise(build(), name)
    return _prepared[key]


def logs(spark: SparkSession, sf_dir: str, cycle: int | None = DAY) -> DataFrame:
    """The prepared event log in cycles."""
    table = _once(spark, sf_dir, "logs", lambda: X.prepare(E.event_logs(spark, sf_dir)))
    return X.in_cycles(table, AS_OF, cycle)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages as prepared logs, one cycle."""
    table = _once(spark, sf_dir, "texts", lambda: X.prepare(E.text_logs(spark, sf_dir)))
    return X.in_cycles(table, AS_OF)


def raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return E.event_logs(spark, sf_dir)


def shared(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    return _once(spark, sf_dir, name, build)


def stamp(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def at(t: str) -> datetime:
    return datetime.fromisoformat(t)


# --- SQL side ------------------------------------------------------------------------------

IP = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
W = r"[\p{L}\p{M}\p{N}_]"
S = r"[\s\x0b\x{85}\p{Z}]"


def js(key: str) -> str:
    return f"json_extract_string(normalized, '$.{key}')"


def has(key: str) -> str:
    return f"coalesce(json_exists(normalized, '$.{key}'), false)"


def user_sql(message: str) -> str:
    forms = [f"nullif(regexp_extract({message}, '{w}{S}+({W}+)', 1), '')" for w in ("user", "User", "for")]
    return f"coalesce({', '.join(forms)})"


def sql_stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


_PREPARED = f"""SELECT *, coalesce(lower(message), '') AS msg,
  coalesce(try_cast("timestamp" AS TIMESTAMP), try_cast({js('timestamp')} AS TIMESTAMP)) AS ts,
  CASE WHEN {has('source_ip')} THEN {js('source_ip')} WHEN {has('src_ip')} THEN {js('src_ip')}
       ELSE nullif(regexp_extract(message, '{IP}'), '') END AS source_ip,
  CASE WHEN {has('user')} THEN {js('user')} ELSE {user_sql('message')} END AS "user"
"""


def sql(body: str, cycle: int | None = DAY, extra: str = "") -> str:
    """``body`` over the CTE ``x``: the prepared event log in cycles."""
    end = (
        f"time_bucket(INTERVAL '{cycle} seconds', ingestion_time) + INTERVAL '{cycle} seconds'"
        if cycle
        else f"TIMESTAMP '{AS_OF}'"
    )
    return f"""WITH raw_logs AS ({E.EVENT_LOG_SQL}),
p AS MATERIALIZED ({_PREPARED} FROM raw_logs),
c AS (SELECT *, {end} AS cycle FROM p),
x AS MATERIALIZED (SELECT *, coalesce(ts, cycle) AS ets FROM c){',' if extra else ''}
{extra}
{body}"""


def text_sql(body: str, extra: str = "") -> str:
    """``body`` over the CTE ``x``: documents and pages as prepared logs."""
    return f"""WITH raw_logs AS ({E.DOCUMENT_LOG_SQL} UNION ALL {E.PAGE_LOG_SQL}),
p AS MATERIALIZED ({_PREPARED} FROM raw_logs),
c AS (SELECT *, TIMESTAMP '{AS_OF}' AS cycle FROM p),
x AS MATERIALIZED (SELECT *, coalesce(ts, cycle) AS ets FROM c){',' if extra else ''}
{extra}
{body}"""


def any_word(text: str, words) -> str:
    quoted = [w.replace("'", "''") for w in words]
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in quoted) + ")"
