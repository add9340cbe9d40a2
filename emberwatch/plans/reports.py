"""Report queries over the stored logs and alerts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions import fields as X
from emberwatch.functions.scores import percent
from emberwatch.operators.alerts import meta
from emberwatch.sources.tables import timestamp

ANOMALY = "anomaly_detection"
SEVERITIES = ("critical", "high", "medium", "low")


def _since(column: str, as_of: datetime | str, hours: int) -> Column:
    return F.col(column) >= timestamp(as_of) - F.expr(f"INTERVAL {hours} HOURS")


def group_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value; null and empty count as unknown."""
    return df.groupBy(X.or_unknown(F.col(column)).alias(column)).agg(F.count(F.lit(1)).alias("n"))


def top_counts(df: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` most frequent values, ties by name; for recent ones, filter by a time range first."""
    return group_counts(df, column).orderBy(F.desc("n"), column).limit(k)


def source_shares(df: DataFrame, column: str) -> DataFrame:
    """Counts with each value's share of the largest count and of the total."""
    counts = group_counts(df, column)
    most, total = counts.agg(F.max("n")).scalar(), counts.agg(F.sum("n")).scalar()
    return counts.select(
        column, "n", (F.col("n") / most).alias("of_top"), percent(F.col("n"), total).alias("percent")
    )


def dashboard(logs: DataFrame, alerts: DataFrame, as_of: datetime | str) -> DataFrame:
    """The dashboard numbers as one row: one aggregation per table."""
    anomaly = F.col("detection_method") == ANOMALY
    a = alerts.agg(
        F.count(F.lit(1)).alias("total_alerts"),
        *[F.count_if(F.col("severity") == s).alias(f"{s}_alerts") for s in SEVERITIES],
        F.count_if(_since("created_at", as_of, 1)).alias("alerts_last_hour"),
        F.count_if(anomaly).alias("anomaly_alerts"),
        F.count_if(anomaly & _since("created_at", as_of, 1)).alias("anomaly_alerts_last_hour"),
    )
    totals = logs.agg(
        F.count(F.lit(1)).alias("total_logs"),
        F.count_if(_since("ingestion_time", as_of, 1)).alias("logs_last_hour"),
    )
    return totals.withColumn("a", a.select(F.struct("*")).scalar()).select("total_logs", "logs_last_hour", "a.*")


def alert_totals(alerts: DataFrame, as_of: datetime | str) -> DataFrame:
    anomaly = F.col("detection_method") == ANOMALY
    day, week = _since("created_at", as_of, 24), _since("created_at", as_of, 168)
    sums = alerts.agg(
        F.count(F.lit(1)).alias("total_alerts"),
        F.count_if(day).alias("alerts_24h"),
        F.count_if(week).alias("alerts_7d"),
        F.count_if(anomaly).alias("total_anomalies"),
        F.count_if(anomaly & day).alias("anomalies_24h"),
        F.count_if(anomaly & week).alias("anomalies_7d"),
    )
    return sums.withColumn("percentage_of_total", percent(F.col("total_anomalies"), F.col("total_alerts")))


def anomalies(alerts: DataFrame) -> DataFrame:
    return alerts.filter(F.col("detection_method") == ANOMALY)


def hourly_trend(alerts: DataFrame, as_of: datetime | str, hours: int = 24) -> DataFrame:
    """Anomaly alerts per hour of the last ``hours``, empty hours included, oldest first."""
    now = timestamp(as_of)
    start = now - F.expr(f"INTERVAL {hours} HOURS")
    spine = alerts.sparkSession.range(1).select(
        F.explode(F.sequence(F.date_trunc("hour", start), now, F.expr("INTERVAL 1 HOUR"))).alias("time")
    )
    counts = (
        anomalies(alerts)
        .filter((F.col("created_at") >= start))
        .groupBy(F.date_trunc("hour", "created_at").alias("time"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return spine.join(counts, "time", "left").select("time", F.coalesce("n", F.lit(0)).alias("n")).orderBy("time")


def causation() -> Column:
    """Why an alert was raised, as JSON: the metadata that matters for its detection method."""
    kind = F.col("alert_type")
    parts = {
        "signature_detector": {
            "signature_id": meta("signature_id"),
            "signature_name": meta("signature_name"),
            "category": meta("category"),
        },
        ANOMALY: {
            "metric": kind,
            "baseline_value": meta("baseline_mean"),
            "observed_value": F.coalesce(
                *[meta(m) for m in ("current_value", "request_count", "error_count", "command_count", "failed_attempts", "destination_count")]
            ),
            "z_score": meta("z_score"),
        },
        "heuristic_analyzer": {
            "rule_id": meta("rule_id"),
            "rule_name": meta("rule_name"),
            "failed_attempts": meta("failed_count"),
            "hosts_accessed": meta("unique_hosts"),
            "data_transferred": meta("bytes_transferred"),
        },
        "behavioral_analyzer": {
            "deviation_type": meta("deviation_type"),
            "user_id": meta("user_id"),
            "unusual_hour": meta("login_hour"),
            "typical_hours": meta("typical_hours"),
            "unusual_ip": F.when(meta("deviation_type") == "location", F.col("source_ip")),
            "typical_ips": meta("typical_ips"),
            "unusual_resource": meta("resource"),
        },
        "network_analyzer": {
            "network_anomaly_type": kind,
            "ports_scanned": meta("unique_ports"),
            "connections": meta("connection_count"),
            "beaconing_regularity": meta("coefficient_of_variation"),
        },
        "rule_engine": {
            "rule_id": meta("rule_id"),
            "rule_name": meta("rule_name"),
            "mitre_technique": meta("mitre_technique"),
            "mitre_tactic": meta("mitre_tactic"),
        },
        "threat_intel_matcher": {
            "indicator_type": meta("indicator_type"),
            "indicator_value": meta("indicator_value"),
            "threat_type": meta("threat_type"),
            "confidence": meta("confidence"),
            "source": meta("source"),
        },
    }
    common = [F.col("detection_method"), kind, F.col("description").alias("summary")]
    return F.coalesce(
        *[
            F.when(
                F.col("detection_method") == m,
                F.to_json(F.struct(*common, *[c.alias(k) for k, c in fields.items()])),
            )
            for m, fields in parts.items()
        ],
        F.to_json(F.struct(*common)),
    )


def with_log(alerts: DataFrame, logs: DataFrame) -> DataFrame:
    """Every alert with its whole source log, if it names one, and its causation.

    Logs are cut down to the referenced ids by the join itself; Spark picks the strategy by size. Alerts that name
    no log stay out of the join, so they don't meet in one task.
    """
    side = logs.select(
        F.col("id").alias("log_id"),
        F.col("timestamp").alias("log_timestamp"),
        F.col("message").alias("log_message"),
        F.col("host").alias("log_host"),
        F.col("appname").alias("log_appname"),
        F.col("raw").alias("log_raw"),
    )
    joined = alerts.filter("log_id IS NOT NULL").join(side, "log_id", "left")
    alone = alerts.filter("log_id IS NULL")
    return joined.unionByName(alone, allowMissingColumns=True).withColumn("causation", causation())


def alert_detail(alerts: DataFrame, logs: DataFrame, alert_id: str) -> DataFrame:
    return with_log(alerts.filter(F.col("id") == alert_id), logs)


def log_view(prepared: DataFrame) -> DataFrame:
    return prepared.select(
        "id", "timestamp", "raw", "appname", "host", "message", "source_ip", "user", "normalized", "metadata"
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def cycle_metrics(alerts: DataFrame, logs: DataFrame) -> DataFrame:
    """Per analysis cycle the logs read and the alerts raised."""
    seen = logs.groupBy("cycle").agg(F.count(F.lit(1)).alias("logs"))
    raised = alerts.groupBy(F.col("created_at").alias("cycle")).agg(F.count(F.lit(1)).alias("alerts"))
    return seen.join(raised, "cycle", "left").select("cycle", "logs", F.coalesce("alerts", F.lit(0)).alias("alerts"))


def cycle_totals(metrics: DataFrame) -> DataFrame:
    means = [F.avg(c).alias(f"mean_{c}") for c in metrics.columns if c != "cycle"]
    sums = [F.sum(c).alias(f"total_{c}") for c in ("logs", "alerts")]
    return metrics.agg(F.count(F.lit(1)).alias("cycles"), *sums, *means)
