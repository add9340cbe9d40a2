"""Registered queries: each name has a Spark plan over the tables and, mostly, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberwatch.checks import detector_sql as D
from emberwatch.checks import views as V
from emberwatch.functions import fields as X
from emberwatch.functions import predicates as P
from emberwatch.operators import baselines as B
from emberwatch.operators import bursts as BU
from emberwatch.operators import profiles as PR
from emberwatch.operators import sequences as SQ
from emberwatch.operators import sliding as SL
from emberwatch.operators.alerts import meta
from emberwatch.operators.bursts import Burst, burst_alerts
from emberwatch.operators.intel import active_indicators, log_indicators, threat_intel_alerts, threat_intel_as_of
from emberwatch.operators.rules import Rule, rule_alerts
from emberwatch.operators.signatures import blocked_ip_alerts, catalog_frame, filter_catalog, hash_alerts, signature_alerts
from emberwatch.plans import anomaly, detect, heuristic, network, reports
from emberwatch.sources import event_log as E
from emberwatch.sources import tables as T
from emberwatch.sources.default_rules import DEFAULT_RULES
from emberwatch.sources.default_signatures import DEFAULT_SIGNATURES
from emberwatch.streaming import cycles as C

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DAY, AS_OF, MIDDLE = V.DAY, V.AS_OF, V.MIDDLE


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# The test data is sparse (minutes between events, hours per user), so windows are days here.
BURSTS: dict[str, tuple[Burst | Callable[[], Burst], str]] = {
    "brute_force_attempt": (lambda: anomaly.brute_force_attempt(5), D.brute_force_attempt(5)),
    "port_scan_detected": (lambda: anomaly.port_scan_detected(10), D.port_scan_detected(10)),
    "lateral_movement": (lambda: heuristic.lateral_movement(3, DAY), D.lateral_movement(3, DAY)),
    "data_exfiltration": (lambda: heuristic.data_exfiltration(20_000_000, DAY), D.data_exfiltration(20_000_000, DAY)),
    "rapid_file_access": (lambda: heuristic.rapid_file_access(2, DAY), D.rapid_file_access(2, DAY)),
    "suspicious_command_sequence": (
        lambda: heuristic.suspicious_command_sequence(2, DAY),
        D.suspicious_command_sequence(2, DAY),
    ),
    "port_scan": (lambda: network.port_scan(8, DAY), D.port_scan(8, DAY)),
    "ddos_attack": (lambda: network.ddos_attack(4, DAY), D.ddos_attack(4, DAY)),
    "dns_tunneling": (lambda: network.dns_tunneling(3, DAY), D.dns_tunneling(3, DAY)),
    "bandwidth_anomaly": (lambda: network.bandwidth_anomaly(20_000_000, DAY), D.bandwidth_anomaly(20_000_000, DAY)),
}
RATE_LIMITS = {"login_frequency": 0.5, "failed_login_rate": 0.5, "error_rate": 0.5, "command_execution_rate": 0.5}

SHOWN = ["id", "alert_type", "detection_method", "severity", "log_id", "source_ip", "dest_ip", "user", "host"]


def shown(alerts: DataFrame, description: bool = True, **more: Column) -> DataFrame:
    columns = [*SHOWN, "description"] if description else SHOWN
    return alerts.select(*columns, V.stamp("created_at").alias("created"), *[c.alias(k) for k, c in more.items()])


def alert_rows(body: str) -> str:
    parts = [f"coalesce({c}, '')" for c in ("method", "alert_type", "rule", "log_id", "source_ip", "dest_ip", '"user"', "CAST(cycle AS VARCHAR)")]
    return f"""SELECT sha256(concat_ws('|', {', '.join(f'length({c})' for c in parts)}, {', '.join(parts)})) AS id,
  method AS detection_method, {V.sql_stamp('cycle')} AS created, * EXCLUDE (rule, method, cycle) FROM ({body})"""


def plain_rows(body: str) -> str:
    return f"SELECT * EXCLUDE (description) FROM ({alert_rows(body)})"


# --- scans and fields ----------------------------------------------------------------------


@register(
    "log_scan_filter",
    f"""SELECT id, host, appname, {V.sql_stamp('ingestion_time')} AS at FROM ({E.EVENT_LOG_SQL})
WHERE ingestion_time BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-09 00:00:00'
AND appname = 'error' AND host = 'server-3'""",
)
def log_scan_filter(spark, sf):
    rows = T.scan_logs(
        V.raw_logs(spark, sf), "2024-01-05 00:00:00", "2024-01-09 00:00:00", {"appname": "error", "host": "server-3"}
    )
    return rows.select("id", "host", "appname", V.stamp("ingestion_time").alias("at"))


@register(
    "log_search",
    V.sql("""SELECT id, "timestamp", raw, appname, host, message, source_ip, "user", normalized, metadata FROM x
WHERE contains(lower(coalesce(message, '')), 'port 53') OR contains(lower(coalesce(raw, '')), 'wget')"""),
)
def log_search(spark, sf):
    logs = V.logs(spark, sf)
    found = logs.filter(P.text_search("Port 53") | P.text_search("WGET"))
    return reports.log_view(found)


@register(
    "log_page",
    f"SELECT id, message FROM ({E.EVENT_LOG_SQL}) ORDER BY ingestion_time DESC, id LIMIT 50 OFFSET 100",
)
def log_page(spark, sf):
    return T.newest(V.raw_logs(spark, sf), limit=50, offset=100).select("id", "message")


@register(
    "log_lookup",
    f"SELECT id, message, host FROM ({E.EVENT_LOG_SQL}) WHERE id IN (SELECT concat('log-', event_id) FROM events WHERE value > 150)",
)
def log_lookup(spark, sf):
    wanted = E.table(spark, sf, "events").filter("value > 150").selectExpr("concat('log-', event_id) AS id")
    return T.logs_by_ids(V.raw_logs(spark, sf), wanted).select("id", "message", "host")


@register(
    "recent_logs",
    f"""SELECT id FROM ({E.EVENT_LOG_SQL}) WHERE ingestion_time
BETWEEN TIMESTAMP '2024-01-29 12:00:00' AND TIMESTAMP '2024-01-30 12:00:00'""",
)
def recent_logs(spark, sf):
    return T.recent_logs(V.raw_logs(spark, sf), "2024-01-30 12:00:00", minutes=1440).select("id")


@register(
    "logs_since_checkpoint",
    f"""SELECT id FROM ({E.EVENT_LOG_SQL}) WHERE ingestion_time > TIMESTAMP '{MIDDLE}'
AND ingestion_time <= TIMESTAMP '2024-01-20 00:00:00'""",
)
def logs_since_checkpoint(spark, sf):
    return T.logs_since(V.raw_logs(spark, sf), MIDDLE, "2024-01-20 00:00:00").select("id")


@register(
    "log_count",
    f"SELECT count(*) AS n FROM ({E.EVENT_LOG_SQL}) WHERE ingestion_time >= TIMESTAMP '{MIDDLE}' AND appname = 'click'",
)
def log_count(spark, sf):
    return T.count_logs(V.raw_logs(spark, sf), start=MIDDLE, filters={"appname": "click"})


@register(
    "adhoc_sql",
    f"SELECT appname, count(*) AS n FROM ({E.EVENT_LOG_SQL}) WHERE procid >= 1050 GROUP BY appname",
)
def adhoc_sql(spark, sf):
    text = "SELECT appname, count(*) AS n FROM {logs} WHERE procid >= :least GROUP BY appname"
    return T.query(spark, text, {"least": 1050}, logs=V.raw_logs(spark, sf))


@register("distinct_hosts", f"SELECT DISTINCT host FROM ({E.EVENT_LOG_SQL}) WHERE host IS NOT NULL")
def distinct_hosts(spark, sf):
    return reports.distinct_values(V.raw_logs(spark, sf), "host")


@register("distinct_appnames", f"SELECT DISTINCT appname FROM ({E.EVENT_LOG_SQL}) WHERE appname IS NOT NULL")
def distinct_appnames(spark, sf):
    return reports.distinct_values(V.raw_logs(spark, sf), "appname")


@register(
    "field_extraction",
    V.sql(
        f"""SELECT id, {V.sql_stamp('ts')} AS event_time, source_ip, "user", {D.EVENT_TYPE} AS event_type,
  {D.ERROR_CATEGORY} AS error_category, {D.DEST} AS dest_ip, {D.PORT} AS dest_port, {D.BYTES} AS size,
  CAST(hour(ts) AS INT) AS hour, CAST(isodow(ts) - 1 AS INT) AS weekday, {V.sql_stamp("date_trunc('hour', ts)")} AS hour_start,
  json_extract_string(metadata, '$.region') AS region FROM x"""
    ),
)
def field_extraction(spark, sf):
    msg = F.col("msg")
    return V.logs(spark, sf).select(
        "id",
        V.stamp("ts").alias("event_time"),
        "source_ip",
        "user",
        X.event_type(msg).alias("event_type"),
        X.error_category(msg).alias("error_category"),
        "dest_ip",
        "dest_port",
        F.col("transfer_bytes").alias("size"),
        F.hour("ts").alias("hour"),
        F.weekday("ts").alias("weekday"),
        V.stamp(F.date_trunc("hour", "ts")).alias("hour_start"),
        X.path_value("metadata.region").alias("region"),
    )


@register(
    "text_field_extraction",
    V.text_sql('SELECT id, source_ip, "user" FROM x'),
)
def text_field_extraction(spark, sf):
    return V.texts(spark, sf).select("id", "source_ip", "user")


@register("ioc_extract", V.sql(f"SELECT id, type, value FROM ({D.indicator_sql()})"))
def ioc_extract(spark, sf):
    return log_indicators(V.logs(spark, sf)).select("id", "type", "value")


@register("text_ioc_extract", V.text_sql(f"SELECT id, type, value FROM ({D.indicator_sql()})"))
def text_ioc_extract(spark, sf):
    return log_indicators(V.texts(spark, sf)).select("id", "type", "value")


@register(
    "text_hashes",
    V.text_sql("""SELECT id, h AS hash FROM (SELECT id, unnest(regexp_extract_all(message, '\\b[a-fA-F0-9]{32}\\b')) AS h FROM x
UNION ALL SELECT id, unnest(regexp_extract_all(message, '\\b[a-fA-F0-9]{40}\\b')) FROM x
UNION ALL SELECT id, unnest(regexp_extract_all(message, '\\b[a-fA-F0-9]{64}\\b')) FROM x)"""),
)
def text_hashes(spark, sf):
    return V.texts(spark, sf).select("id", F.explode(X.text_hashes(F.col("message"))).alias("hash"))


@register(
    "csv_export_view",
    V.sql("""SELECT "timestamp" AS "Timestamp", coalesce(host, '') AS "Host", coalesce(appname, '') AS "Application",
  coalesce(nullif(message, ''), raw, '') AS "Message", coalesce(source_ip, '') AS "Source IP", coalesce("user", '') AS "User" FROM x"""),
)
def csv_export_view(spark, sf):
    return T.export_view(V.logs(spark, sf))


@register(
    "open_schema_routing",
    """SELECT CAST(event_id AS VARCHAR) AS id, event_type AS appname, CAST(NULL AS VARCHAR) AS host,
  CAST(user_id AS VARCHAR) AS user_id, props AS props FROM events""",
)
def open_schema_routing(spark, sf):
    lines = E.table(spark, sf, "events").select(
        F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("appname"), "user_id", "props")).alias("value")
    )
    return T.route_open_schema(lines).select(
        "id",
        "appname",
        "host",
        F.get_json_object("metadata", "$.user_id").alias("user_id"),
        F.get_json_object("metadata", "$.props").alias("props"),
    )


@register(
    "flatten_record",
    V.sql("""SELECT id, host, appname, json_extract_string(metadata, '$.region') AS region,
  json_extract_string(metadata, '$.environment') AS environment, CAST(14 AS INT) AS n_keys FROM x"""),
)
def flatten_record(spark, sf):
    r = F.col("record")
    return T.flatten_log(V.raw_logs(spark, sf)).select(
        "id", r["host"].alias("host"), r["appname"].alias("appname"), r["region"].alias("region"),
        r["environment"].alias("environment"), F.size(r).alias("n_keys"),
    )


# --- signatures and indicators -------------------------------------------------------------


def dimension(spark: SparkSession, sf: str, name: str, source: str, query: str) -> DataFrame:
    """A small table that SQL text derives from one of the given tables."""
    return T.query(spark, query.replace(f"FROM {source}", "FROM {src}"), src=E.table(spark, sf, source))


def blocked(spark, sf):
    return dimension(spark, sf, "blocked", "nation", D.BLOCKED)


def hashes(spark, sf):
    return dimension(spark, sf, "hashes", "part", D.HASHES)


def intel(spark, sf):
    return dimension(spark, sf, "intel", "supplier", D.INTEL)


@register("blocked_ip_alerts", V.sql(alert_rows(D.blocked_ips())))
def blocked_ips(spark, sf):
    return shown(blocked_ip_alerts(V.logs(spark, sf), blocked(spark, sf)))


@register("hash_alerts", V.sql(alert_rows(D.known_hashes())))
def hash_matches(spark, sf):
    return shown(hash_alerts(V.logs(spark, sf), hashes(spark, sf)))


@register("threat_intel_alerts", V.sql(alert_rows(D.threat_intel(AS_OF))))
def threat_intel(spark, sf):
    return shown(threat_intel_alerts(V.logs(spark, sf), intel(spark, sf), AS_OF))


@register("threat_intel_as_of", V.sql(alert_rows(D.threat_intel_as_of(MIDDLE))))
def threat_intel_at_its_time(spark, sf):
    """Indicators without an end of their own end in the middle of the period."""
    feed = intel(spark, sf).withColumn("expires_at", F.coalesce("expires_at", F.lit(MIDDLE).cast("timestamp")))
    return shown(threat_intel_as_of(V.logs(spark, sf), feed))


@register(
    "threat_intel_scan",
    f"""SELECT id, indicator_value FROM ({D.INTEL}) WHERE indicator_type = 'domain'
AND (expires_at IS NULL OR expires_at > TIMESTAMP '{AS_OF}')""",
)
def threat_intel_scan(spark, sf):
    return T.scan_threat_intel(intel(spark, sf), AS_OF, indicator_type="domain").select("id", "indicator_value")


@register(
    "active_indicators",
    f"""SELECT type, value, intel_id FROM (SELECT indicator_type AS type, lower(trim(indicator_value)) AS value, id AS intel_id,
  row_number() OVER (PARTITION BY indicator_type, lower(trim(indicator_value)) ORDER BY confidence DESC NULLS LAST, created_at DESC, id) AS place
  FROM ({D.INTEL}) WHERE expires_at IS NULL OR expires_at > TIMESTAMP '{AS_OF}') WHERE place = 1""",
)
def indicators_active(spark, sf):
    return active_indicators(intel(spark, sf), AS_OF).select("type", "value", "intel_id")


@register(
    "new_indicators",
    f"""SELECT id, indicator_type, value, threat_type, CAST(confidence AS DOUBLE) AS confidence, source FROM (
  SELECT *, lower(trim(indicator_value)) AS value, row_number() OVER (PARTITION BY indicator_type, lower(trim(indicator_value))
    ORDER BY confidence DESC NULLS LAST, created_at DESC, id) AS place FROM ({D.INTEL}) WHERE expires_at IS NULL) i
WHERE place = 1 AND NOT EXISTS (SELECT 1 FROM ({D.INTEL}) e WHERE e.expires_at IS NOT NULL
  AND e.indicator_type = i.indicator_type AND lower(trim(e.indicator_value)) = i.value)""",
)
def indicators_new(spark, sf):
    all_ = intel(spark, sf)
    fresh = T.new_indicators(all_.filter("expires_at IS NOT NULL"), all_.filter("expires_at IS NULL"))
    value = F.lower(F.trim("indicator_value")).alias("value")
    return fresh.select("id", "indicator_type", value, "threat_type", F.col("confidence").cast("double").alias("confidence"), "source")


@register("signature_text_alerts", V.text_sql(alert_rows(D.signatures(DEFAULT_SIGNATURES))))
def signature_text_alerts(spark, sf):
    return shown(signature_alerts(V.texts(spark, sf), DEFAULT_SIGNATURES))


@register("signature_event_alerts", V.sql(alert_rows(D.signatures(DEFAULT_SIGNATURES))))
def signature_event_alerts(spark, sf):
    return shown(signature_alerts(V.logs(spark, sf), DEFAULT_SIGNATURES))


@register(
    "signature_category_counts",
    V.text_sql(f"SELECT alert_type AS category, severity, count(*) AS n FROM ({D.signatures(DEFAULT_SIGNATURES)}) GROUP BY 1, 2"),
)
def signature_category_counts(spark, sf):
    hits = signature_alerts(V.texts(spark, sf), DEFAULT_SIGNATURES)
    return hits.groupBy(F.col("alert_type").alias("category"), "severity").agg(F.count(F.lit(1)).alias("n"))


_WANTED = [s for s in DEFAULT_SIGNATURES if "injection" in f"{s.name} {s.description} {s.id}".lower() and s.severity == "critical"]


@register(
    "catalog_search",
    V.text_sql(f"""SELECT k.id, k.name, k.category, count(a.rule) AS n FROM (VALUES {", ".join(f"('{s.id}', '{s.name}', '{s.category}')" for s in _WANTED)})
  k(id, name, category) LEFT JOIN ({D.signatures(DEFAULT_SIGNATURES)}) a ON a.rule = k.id GROUP BY 1, 2, 3"""),
)
def catalog_search(spark, sf):
    """Critical signatures about injection, and how often each fires on the texts."""
    wanted = filter_catalog(catalog_frame(spark, DEFAULT_SIGNATURES), search="Injection", severity="critical")
    hits = signature_alerts(V.texts(spark, sf), DEFAULT_SIGNATURES).groupBy(meta("signature_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(hits, "id", "left").select("id", "name", "category", F.coalesce("n", F.lit(0)).alias("n"))


# --- baselines and anomalies ---------------------------------------------------------------

_BASE_CTE = f"b AS MATERIALIZED ({D.baselines_sql(D.metric_values_sql())})"
_BASE_COLUMNS = ("mean", "std", "median", "q1", "q3", "iqr", "min", "max")


def base(spark, sf):
    return V.shared(spark, sf, "baselines", lambda: B.baselines(V.logs(spark, sf), AS_OF, days=31))


@register("metric_values", V.sql(D.metric_values_sql()))
def metric_values(spark, sf):
    return B.metric_values(V.logs(spark, sf))


@register(
    "baselines",
    V.sql(f"SELECT metric, count, {', '.join(f'round({c}, 6) AS {c}' for c in _BASE_COLUMNS)} FROM b", extra=_BASE_CTE),
)
def baseline_table(spark, sf):
    rows = B.baselines(V.logs(spark, sf), AS_OF, days=31)
    return rows.select("metric", "count", *[F.round(c, 6).alias(c) for c in _BASE_COLUMNS])


@register(
    "refreshed_baselines",
    V.sql(f"SELECT metric, count, {', '.join(f'round({c}, 6) AS {c}' for c in _BASE_COLUMNS)} FROM b", extra=_BASE_CTE),
)
def refreshed_baselines(spark, sf):
    """Stored from half of the period, then refreshed from all of it."""
    path = T.new_folder(spark, "baselines")
    detect.refresh_baselines(V.logs(spark, sf), path, MIDDLE, days=31)
    rows = detect.refresh_baselines(V.logs(spark, sf), path, AS_OF, days=31)
    return rows.select("metric", "count", *[F.round(c, 6).alias(c) for c in _BASE_COLUMNS])


@register(
    "initial_baselines",
    V.sql(
        f"SELECT metric, count, round(mean, 6) AS mean FROM ({D.baselines_sql(D.metric_values_sql())})".replace(
            "FROM x WHERE", f"FROM x WHERE ingestion_time BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS AND TIMESTAMP '{AS_OF}' AND"
        )
    ),
)
def initial_baselines(spark, sf):
    rows = B.initial_baselines(V.logs(spark, sf), AS_OF)
    return rows.select("metric", "count", F.round("mean", 6).alias("mean"))


@register("rate_anomalies", V.sql(plain_rows(D.rate_anomalies(RATE_LIMITS)), V.HOUR, _BASE_CTE))
def rate_anomalies(spark, sf):
    alerts = anomaly.rate_anomalies(V.logs(spark, sf, V.HOUR), base(spark, sf), RATE_LIMITS)
    value = F.coalesce(*[meta(m) for m in ("current_value", "error_count", "command_count")])
    return shown(alerts, False, value=value.cast("bigint"), z=F.round(meta("z_score").cast("double"), 6))


@register("request_rate_anomaly", V.sql(plain_rows(D.request_anomalies(0.3)), DAY, _BASE_CTE))
def request_rate_anomaly(spark, sf):
    alerts = anomaly.request_anomalies(V.logs(spark, sf), base(spark, sf), 0.3)
    return shown(
        alerts, False, value=meta("request_count").cast("bigint"), z=F.round(meta("z_score").cast("double"), 6)
    )


@register("high_request_rate", V.sql(alert_rows(D.request_anomalies(0, None, 20))))
def high_request_rate(spark, sf):
    alerts = anomaly.request_anomalies(V.logs(spark, sf), None, plain_limit=20)
    return shown(alerts, value=meta("request_count").cast("bigint"), z=meta("z_score").cast("double"))


@register(
    "iqr_outliers",
    V.sql(
        f"""SELECT v.metric, key, value, round(q1 - 0.5 * iqr, 6) AS lower_bound, round(q3 + 0.5 * iqr, 6) AS upper_bound
FROM ({D.metric_values_sql()}) v JOIN b ON b.metric = v.metric WHERE value < q1 - 0.5 * iqr OR value > q3 + 0.5 * iqr""",
        extra=_BASE_CTE,
    ),
)
def iqr_outliers(spark, sf):
    rows = B.iqr_outliers(B.metric_values(V.logs(spark, sf)), base(spark, sf), k=0.5)
    return rows.select("metric", "key", "value", *[F.round(c, 6).alias(c) for c in ("lower_bound", "upper_bound")])


@register(
    "moving_average_outliers",
    V.sql(f"""SELECT metric, key, value, round((value - m) / s, 6) AS z FROM (
  SELECT *, avg(value) OVER w AS m, nullif(stddev_pop(value) OVER w, 0) AS s FROM ({D.metric_values_sql()})
  WHERE metric IN ('failed_login_rate', 'error_rate')
  WINDOW w AS (PARTITION BY metric ORDER BY key ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)) WHERE abs(round((value - m) / s, 9)) > 1.5"""),
)
def moving_average_outliers(spark, sf):
    values = B.metric_values(V.logs(spark, sf), metrics=["failed_login_rate", "error_rate"])
    rows = B.moving_average_outliers(values, width=24, threshold=1.5)
    return rows.select("metric", "key", "value", F.round("z", 6).alias("z"))


@register("suspicious_commands", V.sql(alert_rows(D.suspicious_commands())))
def suspicious_commands(spark, sf):
    return shown(anomaly.suspicious_commands(V.logs(spark, sf)))


@register(
    "suspicious_command_samples",
    V.sql(f"""SELECT {V.sql_stamp('cycle')} AS created, count(*) AS n,
  array_to_string(list_slice(list(message ORDER BY ets, id), 1, 10), ';') AS commands
FROM x WHERE {D.COMMAND} AND {D.SUSPICIOUS} GROUP BY cycle"""),
)
def suspicious_command_samples(spark, sf):
    rows = anomaly.suspicious_command_samples(V.logs(spark, sf))
    return rows.select(V.stamp("cycle").alias("created"), "n", F.array_join("commands", ";").alias("commands"))


@register(
    "suspicious_command_lines",
    V.sql(f"SELECT {V.sql_stamp('cycle')} AS created, id, message AS line FROM x WHERE {D.COMMAND} AND {D.SUSPICIOUS}"),
)
def suspicious_command_lines(spark, sf):
    return anomaly.suspicious_command_lines(V.logs(spark, sf)).select(V.stamp("cycle").alias("created"), "id", "line")


@register(
    "top_failed_ips",
    V.sql(f"""SELECT {V.sql_stamp('cycle')} AS created, source_ip, n FROM (SELECT cycle, source_ip, count(*) AS n,
  row_number() OVER (PARTITION BY cycle ORDER BY count(*) DESC, source_ip) AS place
  FROM x WHERE {D.FAILED} AND {D.IP} IS NOT NULL GROUP BY 1, 2) WHERE place <= 5"""),
)
def top_failed_ips(spark, sf):
    rows = anomaly.top_failed_ips(V.logs(spark, sf))
    return rows.select(V.stamp("cycle").alias("created"), F.explode("top_ips").alias("source_ip", "n"))


@register(
    "error_breakdown",
    V.sql(f"SELECT {V.sql_stamp('cycle')} AS created, {D.ERROR_CATEGORY} AS category, count(*) AS n FROM x WHERE {D.ERROR} GROUP BY 1, 2"),
)
def error_breakdown(spark, sf):
    counts = anomaly.cycle_counts(V.logs(spark, sf))
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("n")) for c in anomaly.ERROR_CATEGORIES])
    return counts.select(V.stamp("cycle").alias("created"), F.inline(pairs)).filter("n > 0")


# --- bursts, sequences, row detectors ------------------------------------------------------


def _burst_query(make: Callable[[], Burst]) -> Query:
    return lambda spark, sf: shown(burst_alerts(V.logs(spark, sf), [make()]))


for _name, (_make, _sql) in BURSTS.items():
    register(_name, V.sql(alert_rows(_sql)))(_burst_query(_make))


@register("all_bursts", V.sql(alert_rows(" UNION ALL ".join(s for _, s in BURSTS.values()))))
def all_bursts(spark, sf):
    return shown(burst_alerts(V.logs(spark, sf), [make() for make, _ in BURSTS.values()]))


@register(
    "burst_lists",
    V.sql(f"""SELECT {V.sql_stamp('cycle')} AS created, k1 AS source_ip, count(DISTINCT value) AS n_ports,
  array_to_string(list_slice(list_sort(list(DISTINCT value)), 1, 5), ',') AS ports
FROM (SELECT cycle, {D.IP} AS k1, {D.PORT} AS value FROM x WHERE {D.NETWORK})
WHERE k1 IS NOT NULL AND value IS NOT NULL GROUP BY cycle, k1 HAVING count(DISTINCT value) >= 3"""),
)
def burst_lists(spark, sf):
    from dataclasses import replace

    alerts = burst_alerts(V.logs(spark, sf), [replace(network.port_scan(3, DAY), list_limit=5)])
    ports = F.array_join(F.from_json(meta("ports"), "array<string>"), ",")
    return alerts.select(
        V.stamp("created_at").alias("created"), "source_ip", meta("unique_ports").cast("bigint").alias("n_ports"), ports.alias("ports")
    )


@register(
    "burst_members",
    V.sql(f"""SELECT {V.sql_stamp('cycle')} AS created, k1 AS source_ip, value AS port, n FROM (
  SELECT *, count(*) OVER (PARTITION BY cycle, k1) AS ports FROM (
    SELECT cycle, k1, CAST(value AS VARCHAR) AS value, count(*) AS n, FROM (SELECT cycle, {D.IP} AS k1, {D.PORT} AS value FROM x WHERE {D.NETWORK})
    WHERE k1 IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2, 3)) WHERE ports >= 3"""),
)
def burst_members(spark, sf):
    members = BU.burst_members(V.logs(spark, sf), [network.port_scan(3, DAY)])
    return members.select(V.stamp("cycle").alias("created"), F.col("k1").alias("source_ip"), F.col("value").alias("port"), "n")


@register("all_burst_members", V.sql(f"SELECT * REPLACE ({V.sql_stamp('cycle')} AS cycle) FROM ({D.all_members()})"))
def all_burst_members(spark, sf):
    """What every listing detector's alerts hold, however long; the alerts themselves list the first values."""
    members = BU.burst_members(V.logs(spark, sf), [make() for make, _ in BURSTS.values()])
    return members.withColumn("cycle", V.stamp("cycle"))


# Bursts in event time. The same thresholds over windows that slide, so that cycles play no part.
SLIDING = {
    "port_scan": (lambda: network.port_scan(5, DAY), D.sliding("port_scan", f"{D.NETWORK} AND {D.PORT} IS NOT NULL", D.IP, 5, "distinct", DAY, value=D.PORT)),
    "data_exfiltration": (
        lambda: heuristic.data_exfiltration(15_000_000, DAY),
        D.sliding("data_exfiltration", f"({D.BYTES}) > 0", D.IP, 15_000_000, "amount", DAY, amount=D.BYTES),
    ),
    "lateral_movement": (
        lambda: heuristic.lateral_movement(3, DAY),
        D.sliding("lateral_movement", f"({D.IP} IS NOT NULL OR {D.USER} IS NOT NULL)", f"coalesce({D.IP}, 'unknown')", 3, "distinct", DAY,
                  k2=f"coalesce({D.USER}, 'unknown')", value="nullif(host, '')"),
    ),
    "ddos_attack": (
        lambda: network.ddos_attack(4, DAY),
        D.sliding("ddos_attack", D.NETWORK, f"nullif({V.js('dest_ip')}, '')", 4, "rows", DAY),
    ),
}
_STRETCH = f"SELECT kind, k1, k2, {V.sql_stamp('started')} AS started, {V.sql_stamp('ended')} AS ended, peak, points, log_id FROM"


def _stretches(spark: SparkSession, sf: str, *names: str) -> DataFrame:
    found = SL.episodes(V.logs(spark, sf), [SLIDING[n][0]() for n in names])
    return found.withColumns({c: V.stamp(c) for c in ("started", "ended")}).select("kind", "k1", "k2", "started", "ended", "peak", "points", "log_id")


@register("port_scan_sliding", V.sql(f"{_STRETCH} ({SLIDING['port_scan'][1]})"))
def port_scan_sliding(spark, sf):
    return _stretches(spark, sf, "port_scan")


@register("data_exfiltration_sliding", V.sql(f"{_STRETCH} ({SLIDING['data_exfiltration'][1]})"))
def data_exfiltration_sliding(spark, sf):
    return _stretches(spark, sf, "data_exfiltration")


@register("all_bursts_sliding", V.sql(f"{_STRETCH} ({' UNION ALL '.join(s for _, s in SLIDING.values())})"))
def all_bursts_sliding(spark, sf):
    """Rows, distinct values and amounts in one pass."""
    return _stretches(spark, sf, *SLIDING)


@register(
    "sliding_burst_alerts",
    V.sql(f"""SELECT alert_type, severity, source_ip, log_id, {V.sql_stamp('started')} AS created, peak,
  (SELECT array_to_string(list_slice(list_sort(list(DISTINCT {D.PORT})), 1, 20), ',') FROM x
   WHERE {D.NETWORK} AND {D.PORT} IS NOT NULL AND {D.IP} = k1 AND ets BETWEEN started - INTERVAL {DAY} SECONDS AND ended) AS ports
FROM (SELECT kind AS alert_type, 'high' AS severity, k1, k1 AS source_ip, log_id, started, ended, peak FROM ({SLIDING['port_scan'][1]}))"""),
)
def sliding_burst_alerts(spark, sf):
    found = SL.sliding_alerts(V.logs(spark, sf), [SLIDING["port_scan"][0]()])
    ports = F.array_join(F.from_json(meta("ports"), "array<string>"), ",")
    return found.select("alert_type", "severity", "source_ip", "log_id", V.stamp("created_at").alias("created"), meta("unique_ports").cast("bigint").alias("peak"), ports.alias("ports"))


@register("port_scan_tumbling", V.sql(alert_rows(D.port_scan(5, 12 * 3600).replace("FROM x", f"""FROM (
  SELECT * REPLACE (time_bucket(INTERVAL '{12 * 3600} seconds', ets) + INTERVAL '{12 * 3600} seconds' AS cycle) FROM x) AS x"""))))
def port_scan_tumbling(spark, sf):
    return shown(SL.tumbling_alerts(V.logs(spark, sf), [network.port_scan(5, 12 * 3600)]))


@register("brute_force_success", V.sql(alert_rows(D.brute_force_success(2, 2 * DAY)), None))
def brute_force_success(spark, sf):
    return shown(SQ.brute_force_success(V.logs(spark, sf, None), 2, 2 * DAY, slice_seconds=3 * DAY))


@register("privilege_escalation", V.sql(alert_rows(D.privilege_escalation(12 * 3600))))
def privilege_escalation(spark, sf):
    alerts = SQ.privilege_escalation(V.logs(spark, sf), 12 * 3600, slice_seconds=4 * 3600)
    return shown(alerts, time_since_login=F.round(meta("time_since_login").cast("double"), 3))


@register("privilege_escalation_rearm", V.sql(alert_rows(D.privilege_escalation(12 * 3600, True)), None))
def privilege_escalation_rearm(spark, sf):
    alerts = SQ.privilege_escalation(V.logs(spark, sf, None), 12 * 3600, rearm=True, slice_seconds=5 * DAY)
    return shown(alerts, time_since_login=F.round(meta("time_since_login").cast("double"), 3))


@register("beaconing", V.sql(alert_rows(D.beaconing(5, 0.9)), None))
def beaconing(spark, sf):
    alerts = network.beaconing(V.logs(spark, sf, None), 5, 0.9, slice_seconds=2 * DAY)
    number = {k: meta(m).cast("double") for k, m in (("mean_interval", "mean_interval_seconds"), ("variation", "coefficient_of_variation"))}
    return shown(
        alerts,
        connection_count=meta("connection_count").cast("bigint"),
        mean_interval=F.round(number["mean_interval"], 3),
        variation=F.round(number["variation"], 6),
    )


@register("off_hours_activity", V.sql(alert_rows(D.off_hours_activity())))
def off_hours_activity(spark, sf):
    return shown(heuristic.off_hours_activity(V.logs(spark, sf)))


@register("protocol_anomaly", V.sql(alert_rows(D.protocol_anomaly())))
def protocol_anomaly(spark, sf):
    return shown(network.protocol_anomaly(V.logs(spark, sf)))


@register(
    "protocol_counts",
    V.sql(f"SELECT {V.js('protocol')} AS protocol, count(*) AS n FROM x WHERE {D.NETWORK} AND nullif({V.js('protocol')}, '') IS NOT NULL GROUP BY 1"),
)
def protocol_counts(spark, sf):
    return network.protocol_counts(V.logs(spark, sf))


# --- behaviour -----------------------------------------------------------------------------

_PROFILE_CTES = D.profile_ctes(MIDDLE, hours=3)


def profiles(spark, sf):
    return V.shared(
        spark, sf, "profiles", lambda: PR.build_profiles(V.logs(spark, sf).filter(F.col("ts") < F.lit(MIDDLE).cast("timestamp")))
    )


@register("user_profiles", V.sql(D.profile_sql()))
def user_profiles(spark, sf):
    return PR.build_profiles(V.logs(spark, sf))


@register("merged_profiles", V.sql(D.profile_sql()))
def merged_profiles(spark, sf):
    logs, cut = V.logs(spark, sf), F.col("ingestion_time") < F.lit(MIDDLE).cast("timestamp")
    return PR.merge_profiles(PR.build_profiles(logs.filter(cut)), PR.build_profiles(logs.filter(~cut)))


@register(
    "hour_shares",
    V.sql(
        """SELECT "user", CAST(item AS INT) AS hour, round(n / sum(n) OVER (PARTITION BY "user"), 6) AS share
FROM prof WHERE facet = 'login_hour'""",
        extra=_PROFILE_CTES,
    ),
)
def hour_shares(spark, sf):
    return PR.hour_shares(profiles(spark, sf)).withColumn("share", F.round("share", 6))


@register("unusual_login_time", V.sql(alert_rows(D.unusual_login_time(0.2)), extra=_PROFILE_CTES))
def unusual_login_time(spark, sf):
    return shown(PR.unusual_login_time(V.logs(spark, sf), profiles(spark, sf), min_share=0.2, min_login_hours=3))


@register("unusual_source_ip", V.sql(alert_rows(D.unusual_source_ip()), extra=_PROFILE_CTES))
def unusual_source_ip(spark, sf):
    return shown(PR.unusual_source_ip(V.logs(spark, sf), profiles(spark, sf), min_login_hours=3))


@register("unusual_resource_access", V.sql(alert_rows(D.unusual_resource_access()), extra=_PROFILE_CTES))
def unusual_resource_access(spark, sf):
    return shown(PR.unusual_resource_access(V.logs(spark, sf), profiles(spark, sf), min_login_hours=3))


# --- rules ---------------------------------------------------------------------------------


def _rules(count: int, connections: int) -> list[Rule]:
    """The shipped rules with thresholds that fit the sparse test data."""
    found = []
    for d in DEFAULT_RULES:
        logic = dict(d["logic"])
        if "count" in logic:
            logic["count"] = {**logic["count"], "threshold": count, "timeframe": "20h"}
        if "frequency" in logic:
            logic["frequency"] = {**logic["frequency"], "min_connections": connections, "timeframe": "1d"}
        found.append(Rule.from_dict({**d, "logic": logic}))
    return found


RULES = _rules(3, 2)
RULE_SQL = [
    D.rule_valid_accounts(DEFAULT_RULES[0]),
    D.rule_brute_force(DEFAULT_RULES[1], 3, 20 * 3600),
    D.rule_c2(DEFAULT_RULES[2], 2, DAY),
    D.rule_credentials(DEFAULT_RULES[3]),
]


def _rule_query(rule: Rule) -> Query:
    return lambda spark, sf: shown(rule_alerts(V.logs(spark, sf), [rule]))


for _name, _rule, _sql in zip(
    ("rule_valid_accounts", "rule_brute_force", "rule_c2", "rule_credential_dumping"), RULES, RULE_SQL
):
    register(_name, V.sql(alert_rows(_sql)))(_rule_query(_rule))


# Thresholds in event time: a look back over earlier cycles.


def _rolling_rule(least: int, timeframe: str) -> Rule:
    d = DEFAULT_RULES[1]
    count = {**d["logic"]["count"], "threshold": least, "timeframe": timeframe}
    return Rule.from_dict({**d, "logic": {**d["logic"], "count": count}})


@register("rule_brute_force_rolling", V.sql(alert_rows(D.rule_brute_force_rolling(DEFAULT_RULES[1], 3, 20 * V.HOUR)), V.HOUR))
def rule_brute_force_rolling(spark, sf):
    return shown(rule_alerts(V.logs(spark, sf, V.HOUR), [_rolling_rule(3, "20h")], rolling=True))


@register("rule_brute_force_minutes", V.sql(alert_rows(D.rule_brute_force_rolling(DEFAULT_RULES[1], 4, 3 * DAY)), 60))
def rule_brute_force_minutes(spark, sf):
    """Cycles of a minute under a timeframe of three days."""
    return shown(rule_alerts(V.logs(spark, sf, 60), [_rolling_rule(4, "3d")], rolling=True))


# --- the whole cycle and the reports on it --------------------------------------------------

_ALL = [
    *[s for _, s in BURSTS.values()],
    D.request_anomalies(0.3),
    D.suspicious_commands(),
    D.brute_force_success(2, 12 * 3600),
    D.privilege_escalation(12 * 3600),
    D.off_hours_activity(),
    D.beaconing(5, 0.9),
    D.protocol_anomaly(),
    D.rate_anomalies(RATE_LIMITS),
    D.signatures(DEFAULT_SIGNATURES),
    D.known_hashes(),
    D.blocked_ips(),
    D.unusual_login_time(0.2),
    D.unusual_source_ip(),
    D.unusual_resource_access(),
    *RULE_SQL,
    D.threat_intel(AS_OF),
]
_COMMON = 'rule, alert_type, method, severity, description, log_id, source_ip, dest_ip, "user", host, cycle'
_UNION = " UNION ALL ".join(f"SELECT {_COMMON} FROM ({s})" for s in _ALL)
_WEIGHT = "CAST(CASE severity WHEN 'critical' THEN 100 WHEN 'high' THEN 75 WHEN 'medium' THEN 50 WHEN 'low' THEN 25 WHEN 'info' THEN 10 ELSE 50 END AS DOUBLE)"
_METHODS = "[" + ", ".join(f"'{m}'" for m in detect.METHOD_ORDER) + "]"
_ALERT_CTES = f"""{_BASE_CTE}, {_PROFILE_CTES},
found AS MATERIALIZED (SELECT *, {_WEIGHT} AS priority_score FROM ({alert_rows(_UNION)})),
alerts AS MATERIALIZED (SELECT * EXCLUDE (place), CAST(created AS TIMESTAMP) AS created_at FROM (SELECT *, row_number() OVER (
  PARTITION BY created, alert_type, host, source_ip, "user"
  ORDER BY priority_score DESC, list_position({_METHODS}, detection_method), log_id NULLS FIRST, id) AS place FROM found) WHERE place = 1)"""


def _cycle_sql(body: str, more: str = "") -> str:
    return V.sql(body, extra=f"{_ALERT_CTES},\n{more}" if more else _ALERT_CTES)


def detector_plans(spark: SparkSession, sf: str) -> dict[str, detect.Detector]:
    """The detectors of a full cycle, set up for the test data."""
    b, prof = base(spark, sf), profiles(spark, sf)
    known = detect.Knowledge(
        as_of=AS_OF,
        signatures=DEFAULT_SIGNATURES,
        rules=RULES,
        blocked_ips=blocked(spark, sf),
        baselines=b,
        profiles=prof,
        intel=intel(spark, sf),
        bursts=[make() for make, _ in BURSTS.values()],
    )
    return {
        **detect.detectors(known),
        "requests": lambda logs: anomaly.request_anomalies(logs, b, 0.3),
        "rates": lambda logs: anomaly.rate_anomalies(logs, b, RATE_LIMITS),
        "brute_force_success": lambda logs: SQ.brute_force_success(logs, 2, 12 * 3600),
        "privilege_escalation": lambda logs: SQ.privilege_escalation(logs, 12 * 3600),
        "beaconing": lambda logs: network.beaconing(logs, 5, 0.9),
        "hashes": lambda logs: hash_alerts(logs, hashes(spark, sf)),
        "behaviour": lambda logs: PR.union_alerts(
            [
                PR.unusual_login_time(logs, prof, min_share=0.2, min_login_hours=3),
                PR.unusual_source_ip(logs, prof, min_login_hours=3),
                PR.unusual_resource_access(logs, prof, min_login_hours=3),
            ]
        ),
    }


def run_cycle(spark: SparkSession, sf: str) -> DataFrame:
    logs = V.logs(spark, sf)
    parts = [d(logs) for d in detector_plans(spark, sf).values()]
    return detect.deduplicate(detect.prioritise(PR.union_alerts(parts)))


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    """The stored alerts of a full cycle run, which the reports read."""
    return V.shared(spark, sf, "alerts", lambda: run_cycle(spark, sf))


@register(
    "alert_pipeline",
    _cycle_sql('SELECT id, alert_type, detection_method, severity, log_id, source_ip, dest_ip, "user", host, created, priority_score FROM alerts'),
)
def alert_pipeline(spark, sf):
    return shown(run_cycle(spark, sf), False, priority_score=F.col("priority_score"))


@register(
    "alert_scan",
    _cycle_sql(f"""SELECT id, alert_type, severity, created FROM alerts WHERE created_at BETWEEN TIMESTAMP '{MIDDLE}'
AND TIMESTAMP '2024-01-20 00:00:00' AND severity = 'critical' ORDER BY created_at DESC, id LIMIT 200"""),
)
def alert_scan(spark, sf):
    found = T.scan_alerts(alerts(spark, sf), MIDDLE, "2024-01-20 00:00:00", severity="critical", acknowledged=False)
    return T.newest(found, 200, time="created_at").select("id", "alert_type", "severity", V.stamp("created_at").alias("created"))


@register(
    "alerts_of_method",
    _cycle_sql("SELECT id, alert_type, created FROM alerts WHERE detection_method = 'heuristic_analyzer'"),
)
def alerts_of_method(spark, sf):
    found = alerts(spark, sf).filter(detect.detection_method_is("heuristic_analyzer"))
    return found.select("id", "alert_type", V.stamp("created_at").alias("created"))


_NOW = f"TIMESTAMP '{AS_OF}'"


@register(
    "dashboard_stats",
    _cycle_sql(f"""SELECT (SELECT count(*) FROM x) AS total_logs,
  (SELECT count(*) FROM x WHERE ingestion_time >= {_NOW} - INTERVAL 1 HOUR) AS logs_last_hour, count(*) AS total_alerts,
  count(*) FILTER (severity = 'critical') AS critical_alerts, count(*) FILTER (severity = 'high') AS high_alerts,
  count(*) FILTER (severity = 'medium') AS medium_alerts, count(*) FILTER (severity = 'low') AS low_alerts,
  count(*) FILTER (created_at >= {_NOW} - INTERVAL 1 HOUR) AS alerts_last_hour,
  count(*) FILTER (detection_method = 'anomaly_detection') AS anomaly_alerts,
  count(*) FILTER (detection_method = 'anomaly_detection' AND created_at >= {_NOW} - INTERVAL 1 HOUR) AS anomaly_alerts_last_hour FROM alerts"""),
)
def dashboard_stats(spark, sf):
    return reports.dashboard(V.logs(spark, sf), alerts(spark, sf), AS_OF)


@register(
    "alert_stats",
    _cycle_sql(f"""SELECT count(*) AS total_alerts, count(*) FILTER (created_at >= {_NOW} - INTERVAL 24 HOURS) AS alerts_24h,
  count(*) FILTER (created_at >= {_NOW} - INTERVAL 7 DAYS) AS alerts_7d,
  count(*) FILTER (detection_method = 'anomaly_detection') AS total_anomalies,
  count(*) FILTER (detection_method = 'anomaly_detection' AND created_at >= {_NOW} - INTERVAL 24 HOURS) AS anomalies_24h,
  count(*) FILTER (detection_method = 'anomaly_detection' AND created_at >= {_NOW} - INTERVAL 7 DAYS) AS anomalies_7d,
  round(100.0 * count(*) FILTER (detection_method = 'anomaly_detection') / count(*), 6) AS percentage_of_total FROM alerts"""),
)
def alert_stats(spark, sf):
    return reports.alert_totals(alerts(spark, sf), AS_OF).withColumn("percentage_of_total", F.round("percentage_of_total", 6))


def _top_sql(source: str, column: str, k: int, where: str = "true") -> str:
    return (
        f"SELECT coalesce(nullif({column}, ''), 'unknown') AS {column}, count(*) AS n FROM {source} WHERE {where} "
        f"GROUP BY 1 ORDER BY n DESC, 1 LIMIT {k}"
    )


@register("top_hosts", V.sql(_top_sql("x", "host", 5)))
def top_hosts(spark, sf):
    return reports.top_counts(V.logs(spark, sf), "host", 5)


@register(
    "top_hosts_recent",
    V.sql(_top_sql(f"(SELECT * FROM x WHERE ingestion_time >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS)", "host", 5)),
)
def top_hosts_recent(spark, sf):
    since = F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 24 HOURS")
    return reports.top_counts(T.scan_logs(V.logs(spark, sf), start=since), "host", 5)


@register("top_source_ips", V.sql(_top_sql("x", "source_ip", 5)))
def top_source_ips(spark, sf):
    return reports.top_counts(V.logs(spark, sf), "source_ip", 5)


@register("top_alert_types", _cycle_sql(_top_sql("alerts", "alert_type", 10)))
def top_alert_types(spark, sf):
    return reports.top_counts(alerts(spark, sf), "alert_type", 10)


@register("top_anomaly_types", _cycle_sql(_top_sql("alerts", "alert_type", 8, "detection_method = 'anomaly_detection'")))
def top_anomaly_types(spark, sf):
    return reports.top_counts(reports.anomalies(alerts(spark, sf)), "alert_type", 8)


@register("method_counts", _cycle_sql("SELECT detection_method, count(*) AS n FROM alerts GROUP BY 1"))
def method_counts(spark, sf):
    return reports.group_counts(alerts(spark, sf), "detection_method")


@register(
    "anomaly_severity_counts",
    _cycle_sql("SELECT severity, count(*) AS n FROM alerts WHERE detection_method = 'anomaly_detection' GROUP BY 1"),
)
def anomaly_severity_counts(spark, sf):
    return reports.group_counts(reports.anomalies(alerts(spark, sf)), "severity")


@register(
    "severity_shares",
    _cycle_sql("""SELECT severity, n, round(n / max(n) OVER (), 6) AS of_top, round(100.0 * n / sum(n) OVER (), 6) AS percent
FROM (SELECT severity, count(*) AS n FROM alerts GROUP BY 1)"""),
)
def severity_shares(spark, sf):
    rows = reports.source_shares(alerts(spark, sf), "severity")
    return rows.select("severity", "n", F.round("of_top", 6).alias("of_top"), F.round("percent", 6).alias("percent"))


@register(
    "anomaly_trend",
    _cycle_sql(f"""SELECT {V.sql_stamp('t')} AS time, count(a.id) AS n
FROM (SELECT unnest(range(date_trunc('hour', {_NOW} - INTERVAL 168 HOURS), {_NOW} + INTERVAL 1 SECOND, INTERVAL 1 HOUR)) AS t)
LEFT JOIN (SELECT * FROM alerts WHERE detection_method = 'anomaly_detection' AND created_at >= {_NOW} - INTERVAL 168 HOURS) a
ON date_trunc('hour', a.created_at) = t GROUP BY t"""),
)
def anomaly_trend(spark, sf):
    return reports.hourly_trend(alerts(spark, sf), AS_OF, 168).select(V.stamp("time").alias("time"), "n")


@register(
    "alerts_with_log",
    _cycle_sql("""SELECT a.id, a.alert_type, l."timestamp" AS log_timestamp, l.message AS log_message, l.host AS log_host,
  l.appname AS log_appname, l.raw AS log_raw FROM alerts a LEFT JOIN x l ON l.id = a.log_id"""),
)
def alerts_with_log(spark, sf):
    rows = reports.with_log(alerts(spark, sf), V.logs(spark, sf))
    return rows.select("id", "alert_type", "log_timestamp", "log_message", "log_host", "log_appname", "log_raw")


@register(
    "causation",
    _cycle_sql("""SELECT id, detection_method, alert_type,
  CASE WHEN detection_method = 'signature_detector' AND alert_type NOT IN ('malicious_hash_detected', 'blocked_ip_detected') THEN alert_type END AS category,
  CASE alert_type WHEN 'brute_force_success' THEN 'HEUR-001' WHEN 'privilege_escalation' THEN 'HEUR-002'
    WHEN 'lateral_movement' THEN 'HEUR-003' WHEN 'data_exfiltration' THEN 'HEUR-004' WHEN 'off_hours_activity' THEN 'HEUR-005'
    WHEN 'rapid_file_access' THEN 'HEUR-006' WHEN 'suspicious_command_sequence' THEN 'HEUR-007'
    WHEN 'T1078 - Valid Accounts' THEN 'RULE-001' WHEN 'T1110 - Brute Force' THEN 'RULE-002'
    WHEN 'T1071 - Application Layer Protocol (C2)' THEN 'RULE-003' WHEN 'T1003 - Credential Dumping' THEN 'RULE-004' END AS rule_id,
  CASE alert_type WHEN 'unusual_login_time' THEN 'time' WHEN 'unusual_source_ip' THEN 'location'
    WHEN 'unusual_resource_access' THEN 'resource' END AS deviation_type,
  CASE WHEN detection_method = 'threat_intel_matcher' THEN replace(alert_type, 'threat_intel_', '') END AS indicator_type FROM alerts"""),
)
def causation(spark, sf):
    rows = alerts(spark, sf).withColumn("c", reports.causation())
    part = {k: F.get_json_object("c", f"$.{k}").alias(k) for k in ("category", "rule_id", "deviation_type", "indicator_type")}
    return rows.select("id", "detection_method", "alert_type", *part.values())


@register(
    "alert_details",
    _cycle_sql("""SELECT a.id, a.severity, l.message AS log_message FROM alerts a LEFT JOIN x l ON l.id = a.log_id
WHERE a.id = (SELECT min(id) FROM alerts)"""),
)
def alert_details(spark, sf):
    found = alerts(spark, sf)
    wanted = found.join(found.agg(F.min("id").alias("id")), "id", "left_semi")
    return reports.with_log(wanted, V.logs(spark, sf)).select("id", "severity", "log_message")


@register(
    "cycle_metrics",
    _cycle_sql(f"""SELECT {V.sql_stamp('cycle')} AS cycle, logs, coalesce(n, 0) AS alerts FROM (SELECT cycle, count(*) AS logs FROM x GROUP BY 1)
LEFT JOIN (SELECT created_at, count(*) AS n FROM alerts GROUP BY 1) ON created_at = cycle"""),
)
def cycle_metrics(spark, sf):
    rows = reports.cycle_metrics(alerts(spark, sf), V.logs(spark, sf))
    return rows.withColumn("cycle", V.stamp("cycle"))


@register(
    "cycle_totals",
    _cycle_sql("""SELECT count(*) AS cycles, sum(logs) AS total_logs, sum(alerts) AS total_alerts, avg(logs) AS mean_logs, avg(alerts) AS mean_alerts
FROM (SELECT cycle, logs, coalesce(n, 0) AS alerts FROM (SELECT cycle, count(*) AS logs FROM x GROUP BY 1)
LEFT JOIN (SELECT created_at, count(*) AS n FROM alerts GROUP BY 1) ON created_at = cycle)"""),
)
def cycle_totals(spark, sf):
    return reports.cycle_totals(reports.cycle_metrics(alerts(spark, sf), V.logs(spark, sf)))


_BY_PRIORITY = "SELECT id, priority_score, created, row_number() OVER (ORDER BY priority_score DESC, created_at, id) AS place FROM alerts"


@register("alerts_by_priority", _cycle_sql(_BY_PRIORITY))
def alerts_by_priority(spark, sf):
    """Every alert with its place in the order in which alerts are shown."""
    return detect.with_place(alerts(spark, sf)).select("id", "priority_score", V.stamp("created_at").alias("created"), "place")


@register("alert_page", _cycle_sql(f"{_BY_PRIORITY} QUALIFY place <= 500"))
def alert_page(spark, sf):
    """The first page of 500."""
    page = detect.by_priority(alerts(spark, sf)).limit(500)
    order = Window.orderBy(F.desc("priority_score"), "created_at", "id")  # over the page only
    return page.select("id", "priority_score", V.stamp("created_at").alias("created"), F.row_number().over(order).alias("place"))


# --- streams: the events table read as a stream until its end -------------------------------


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = E.table(spark, sf, "events").schema
    return E.logs_from_events(C.read_stream(spark, sf, schema, glob="events.parquet"))


def _in_parts(spark: SparkSession, sf: str, out: str) -> DataFrame:
    """The events as a stream of three parts, cut inside a day, of which two come in the first micro-batch.

    A part is one file, or one for each ``SPREAD_ROWS`` rows.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = E.table(spark, sf, "events")
    parts = ("ts < '2024-01-11 07:00:00'", "ts >= '2024-01-11 07:00:00' AND ts < '2024-01-20 13:00:00'", "ts >= '2024-01-20 13:00:00'")
    for i, part in enumerate(parts):
        rows = events.where(part)
        files = -(-rows.count() // T.SPREAD_ROWS)
        (rows.repartition(files) if files > 1 else rows.coalesce(1)).write.parquet(f"{out}/in/part={i}")
    first = spark.read.schema(events.schema).parquet(f"{out}/in/part=0", f"{out}/in/part=1").inputFiles()
    return E.logs_from_events(C.read_stream(spark, f"{out}/in/*", events.schema, max_files=len(first)))


@register(
    "stream_cycle_alerts",
    _cycle_sql('SELECT id, alert_type, detection_method, severity, log_id, source_ip, dest_ip, "user", host, created FROM alerts'),
)
def stream_cycle_alerts(spark, sf):
    """All detectors over a stream whose cycles are split between micro-batches."""
    out = T.new_folder(spark, "stream-alerts")
    found = detector_plans(spark, sf)
    stream = _in_parts(spark, sf, out)
    C.run_cycles(stream, lambda _: found, f"{out}/alerts", f"{out}/checkpoint", cycle_seconds=DAY).awaitTermination()
    return shown(T.read_cycle_alerts(spark, f"{out}/alerts"), False)


_WINDOWED = V.sql(f"""SELECT {V.sql_stamp('s')} AS start, source_ip, n FROM (
  SELECT time_bucket(INTERVAL '{DAY} seconds', ingestion_time) AS s, source_ip, count(*) AS n FROM x GROUP BY 1, 2)""")


@register("stream_windowed_counts", _WINDOWED)
def stream_windowed_counts(spark, sf):
    """The counts of all windows, also of those that the watermark has not passed, in one micro-batch."""
    out = T.new_folder(spark, "stream-counts")
    counts = C.windowed_counts(X.prepare(event_stream(spark, sf)), "source_ip", DAY)
    C.save_changes(counts, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return C.latest_counts(spark, f"{out}/rows", "source_ip").select(V.stamp("start").alias("start"), "source_ip", "n")


@register("stream_all_windowed_counts", _WINDOWED)
def stream_all_windowed_counts(spark, sf):
    """The same from three files in two micro-batches."""
    out = T.new_folder(spark, "stream-all-counts")
    counts = C.windowed_counts(X.prepare(_in_parts(spark, sf, out)), "source_ip", DAY)
    C.save_changes(counts, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return C.latest_counts(spark, f"{out}/rows", "source_ip").select(V.stamp("start").alias("start"), "source_ip", "n")


@register("stream_profiles", V.sql(D.profile_sql()))
def stream_profiles(spark, sf):
    out = T.new_folder(spark, "stream-profiles")
    counts = C.profile_stream(X.prepare(event_stream(spark, sf)))
    C.save_changes(counts, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return C.latest_profiles(spark, f"{out}/rows")


@register(
    "stream_deduplicated",
    _cycle_sql(
        """SELECT a.id, a.alert_type, a.host, a.source_ip, a."user", a.severity, a.created FROM ranked a
JOIN reach r ON a.k = r.k AND a.created_at = r.t WHERE a.best = 1""",
        f"""ranked AS MATERIALIZED (SELECT *, concat_ws('|', alert_type, coalesce(host, ''), coalesce(source_ip, ''), coalesce("user", '')) AS k,
  row_number() OVER (PARTITION BY alert_type, coalesce(host, ''), coalesce(source_ip, ''), coalesce("user", ''), created_at
    ORDER BY priority_score DESC, id) AS best FROM alerts),
reach AS (SELECT k, unnest(list_reduce(list_transform(list_sort(list(DISTINCT created_at)), lambda x: [x]),
  lambda kept, x: CASE WHEN x[1] > kept[-1] + INTERVAL {3 * DAY} SECONDS THEN list_concat(kept, x) ELSE kept END)) AS t FROM ranked GROUP BY k)""",
    ),
)
def stream_deduplicated(spark, sf):
    """Stored alerts arrive in four micro-batches by time; of a key those remain that are over three days apart."""
    out = T.new_folder(spark, "stream-dedup")
    stored = alerts(spark, sf)
    for i, days in enumerate(((1, 8), (8, 15), (15, 24), (24, 99))):
        day = F.datediff("created_at", F.lit("2024-01-01")) + 1
        stored.where((day >= days[0]) & (day < days[1])).coalesce(1).write.parquet(f"{out}/in/part={i}")
    arriving = C.read_stream(spark, f"{out}/in/*", stored.schema, max_files=1)
    C.write_files(C.first_of_each(arriving, f"{3 * DAY} seconds"), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    return rows.select("id", *detect.DEDUP_KEY, "severity", V.stamp("created_at").alias("created"))
