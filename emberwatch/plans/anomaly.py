"""Statistical detectors: per-cycle counts and per-source counts against the baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.functions import fields as X
from emberwatch.functions.scores import beyond, z_score
from emberwatch.operators.alerts import payload, to_alerts, union_alerts
from emberwatch.operators.baselines import z_scored
from emberwatch.operators.bursts import Burst, burst_alerts

METHOD = "anomaly_detection"

# Z-score thresholds and severities per metric.
THRESHOLDS = {
    "login_frequency": 3.0,
    "failed_login_rate": 2.5,
    "requests_per_ip": 3.5,
    "error_rate": 2.0,
    "command_execution_rate": 3.0,
}
RATE_ALERTS = {
    "login_frequency": ("login_frequency_anomaly", "medium"),
    "failed_login_rate": ("failed_login_anomaly", "high"),
    "error_rate": ("error_rate_anomaly", "medium"),
    "command_execution_rate": ("command_execution_anomaly", "high"),
}
ERROR_CATEGORIES = ("access_denied", "exception", "server_error", "other")


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _one_decimal(c: str) -> Column:
    return F.format_string("%.1f", F.col(c))


def brute_force_attempt(min_failed: int = 5) -> Burst:
    return Burst(
        alert_type="brute_force_attempt",
        method=METHOD,
        severity="high",
        when=F.col("is_failed_login"),
        k1=X.non_empty(F.col("source_ip")),
        measure="rows",
        threshold=min_failed,
        describe=F.concat(
            F.lit("Password guessing by "), F.col("k1"), F.lit(": "), _text("n"), F.lit(" sign-ins refused")
        ),
        metadata={"failed_attempts": F.col("n")},
        entity={"source_ip": "k1"},
        with_log=False,
    )


def port_scan_detected(min_destinations: int = 10) -> Burst:
    return Burst(
        alert_type="port_scan_detected",
        method=METHOD,
        severity="high",
        when=F.lit(True),
        k1=F.when(F.col("dest_ip").isNotNull(), X.non_empty(F.col("source_ip"))),
        value=F.col("dest_ip"),
        measure="distinct",
        threshold=min_destinations,
        describe=F.concat(
            F.lit("Many targets for "), F.col("k1"), F.lit(": "), _text("distinct_n"), F.lit(" different targets")
        ),
        metadata={"destination_count": F.col("distinct_n"), "destinations": F.col("vals")},
        entity={"source_ip": "k1"},
        with_log=False,
    )


def bursts() -> list[Burst]:
    return [brute_force_attempt(), port_scan_detected()]


def cycle_counts(logs: DataFrame) -> DataFrame:
    """One row per cycle with the counts every rate detector needs; a single hash aggregation."""
    return logs.groupBy("cycle").agg(
        F.count_if("is_login").alias("login_frequency"),
        F.count_if("is_failed_login").alias("failed_login_rate"),
        F.count_if("is_error").alias("error_rate"),
        F.count_if("is_command").alias("command_execution_rate"),
        *[F.count_if(F.col("error_kind") == c).alias(c) for c in ERROR_CATEGORIES],
    )


def failed_logins_by_ip(logs: DataFrame) -> DataFrame:
    return (
        logs.filter(F.col("is_failed_login") & X.non_empty(F.col("source_ip")).isNotNull())
        .groupBy("cycle", "source_ip")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_failed_ips(logs: DataFrame, k: int = 5) -> DataFrame:
    """Per cycle the ``k`` sources with most failed logins, as a map; ranks are limited map-side."""
    rank = Window.partitionBy("cycle").orderBy(F.desc("n"), "source_ip")
    top = failed_logins_by_ip(logs).withColumn("place", F.row_number().over(rank)).filter(F.col("place") <= k)
    return top.groupBy("cycle").agg(
        F.map_from_entries(
            F.transform(
                F.array_sort(F.collect_list(F.struct("place", "source_ip", "n"))),
                lambda e: F.struct(e["source_ip"], e["n"]),
            )
        ).alias("top_ips")
    )


def suspicious_command_lines(logs: DataFrame) -> DataFrame:
    """All suspicious command lines, a row each: the whole evidence behind the samples."""
    return logs.filter("is_suspicious").select("cycle", "ets", "id", F.col("message").alias("line"))


def suspicious_command_samples(logs: DataFrame, k: int = 10) -> DataFrame:
    """Per cycle: how many suspicious command lines there are, and the first ``k`` of them, each whole."""
    hits = suspicious_command_lines(logs)
    order = Window.partitionBy("cycle").orderBy("ets", "id")
    first = (
        hits.withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= k)
        .groupBy("cycle")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda e: e["line"]).alias("commands"))
    )
    return hits.groupBy("cycle").agg(F.count(F.lit(1)).alias("n")).join(first, "cycle")


def suspicious_commands(logs: DataFrame, k: int = 10) -> DataFrame:
    return to_alerts(
        suspicious_command_samples(logs, k),
        method=METHOD,
        alert_type=F.lit("suspicious_commands"),
        severity=F.lit("high"),
        description=F.concat(F.lit("Commands that attackers use: "), _text("n"), F.lit(" instances")),
        metadata=payload({"commands": F.col("commands")}),
    )


def rate_scores(logs: DataFrame, base: DataFrame) -> DataFrame:
    """(cycle, metric, value, mean, std, z) of the four per-cycle rates that have a baseline."""
    long = cycle_counts(logs).select(
        "cycle",
        F.map_from_arrays(
            F.array(*[F.lit(c) for c in ERROR_CATEGORIES]), F.array(*[F.col(c) for c in ERROR_CATEGORIES])
        ).alias("breakdown"),
        F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in RATE_ALERTS])),
    )
    return z_scored(long.filter(F.col("value") > 0), base)


def rate_anomalies(logs: DataFrame, base: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Login, failed-login, error and command rates whose z-score is beyond the metric's threshold."""
    limits = {**THRESHOLDS, **(thresholds or {})}
    metric = F.col("metric")

    def pick(parts: dict[str, Column]) -> Column:
        return F.coalesce(*[F.when(metric == m, c) for m, c in parts.items()])

    hits = (
        rate_scores(logs, base)
        .filter(pick({m: beyond(F.col("z"), limits[m]) for m in RATE_ALERTS}))
        .join(top_failed_ips(logs), "cycle", "left")
        .join(suspicious_command_samples(logs, 5).select("cycle", "commands"), "cycle", "left")
    )
    value, mean = _text("value"), _one_decimal("mean")
    base_fields = {"baseline_mean": F.col("mean"), "z_score": F.col("z")}
    seen = F.map_filter("breakdown", lambda _, n: n > 0)
    return to_alerts(
        hits,
        method=METHOD,
        alert_type=pick({m: F.lit(a) for m, (a, _) in RATE_ALERTS.items()}),
        severity=pick({m: F.lit(s) for m, (_, s) in RATE_ALERTS.items()}),
        description=pick(
            {
                "login_frequency": F.concat(
                    F.lit("Sign-ins off their usual rate: "), value, F.lit(" logins (baseline: "), mean,
                    F.lit(" ± "), _one_decimal("std"), F.lit(")"),
                ),
                "failed_login_rate": F.concat(
                    F.lit("Refused sign-ins off their usual rate: "), value, F.lit(" failures (baseline: "), mean, F.lit(")")
                ),
                "error_rate": F.concat(
                    F.lit("Errors off their usual rate: "), value, F.lit(" errors (baseline: "), mean, F.lit(")")
                ),
                "command_execution_rate": F.concat(
                    F.lit("Commands off their usual rate: "), value, F.lit(" commands (baseline: "), mean, F.lit(")")
                ),
            }
        ),
        metadata=pick(
            {
                "login_frequency": payload(
                    {"current_value": F.col("value"), "baseline_std": F.col("std"), **base_fields}
                ),
                "failed_login_rate": payload(
                    {"current_value": F.col("value"), **base_fields, "top_ips": F.col("top_ips")}
                ),
                "error_rate": payload({"error_count": F.col("value"), **base_fields, "error_breakdown": seen}),
                "command_execution_rate": payload(
                    {"command_count": F.col("value"), **base_fields, "suspicious_commands": F.col("commands")}
                ),
            }
        ),
    )


def requests_per_ip(logs: DataFrame) -> DataFrame:
    return (
        logs.select("cycle", X.non_empty(F.col("source_ip")).alias("source_ip"))
        .filter("source_ip IS NOT NULL")
        .groupBy("cycle", "source_ip")
        .agg(F.count(F.lit(1)).alias("value"))
    )


def request_anomalies(
    logs: DataFrame, base: DataFrame | None, threshold: float = THRESHOLDS["requests_per_ip"], plain_limit: int = 100
) -> DataFrame:
    """Sources with an unusual number of requests; without a baseline a plain limit decides."""
    if base is None:
        mean = std = F.lit(None).cast("double")
    else:
        # One metric, so its two numbers are scalar subqueries and the counts need no join.
        row = base.filter("metric = 'requests_per_ip'")
        mean, std = row.agg(F.max("mean")).scalar(), row.agg(F.max("std")).scalar()
    scored = requests_per_ip(logs).withColumns({"mean": mean, "std": std})
    scored = scored.withColumn("z", z_score(F.col("value"), F.col("mean"), F.col("std")))
    has_base = F.col("mean").isNotNull()
    hits = scored.filter(
        F.when(has_base, beyond(F.col("z"), threshold)).otherwise(F.col("value") > plain_limit)
    )
    head = F.concat(F.col("source_ip"), F.lit(": "), _text("value"), F.lit(" requests"))
    return to_alerts(
        hits,
        method=METHOD,
        alert_type=F.when(has_base, "request_rate_anomaly").otherwise("high_request_rate"),
        severity=F.lit("medium"),
        description=F.when(
            has_base,
            F.concat(F.lit("Requests off their usual rate by "), head, F.lit(" (baseline: "), _one_decimal("mean"), F.lit(")")),
        ).otherwise(F.concat(F.lit("Very many requests by "), head)),
        metadata=payload(
            {"request_count": F.col("value"), "baseline_mean": F.col("mean"), "z_score": F.col("z")}
        ),
        source_ip=F.col("source_ip"),
    )


def anomaly_alerts(logs: DataFrame, base: DataFrame | None) -> DataFrame:
    parts = [burst_alerts(logs, bursts()), request_anomalies(logs, base), suspicious_commands(logs)]
    if base is not None:
        parts.append(rate_anomalies(logs, base))
    return union_alerts(parts)
