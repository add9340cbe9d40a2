"""The full analysis cycle: every detector, one alert table, scored and de-duplicated."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.functions.scores import priority
from emberwatch.operators import profiles as behaviour
from emberwatch.operators.alerts import union_alerts
from emberwatch.operators.baselines import baselines
from emberwatch.operators.bursts import Burst, burst_alerts
from emberwatch.operators.intel import threat_intel_alerts
from emberwatch.operators.ordered import running
from emberwatch.operators.rules import Rule, rule_alerts
from emberwatch.operators.sequences import brute_force_success, privilege_escalation
from emberwatch.operators.signatures import Signature, blocked_ip_alerts, hash_alerts, hash_frame, signature_alerts
from emberwatch.plans import anomaly, heuristic, network
from emberwatch.sources.tables import read_baselines, save_table

Detector = Callable[[DataFrame], DataFrame]
DEDUP_KEY = ("alert_type", "host", "source_ip", "user")
METHOD_ORDER = (
    "signature_detector",
    "anomaly_detection",
    "heuristic_analyzer",
    "behavioral_analyzer",
    "rule_engine",
    "network_analyzer",
    "threat_intel_matcher",
)


@dataclass
class Knowledge:
    """What the detectors compare logs with. A part that is None switches its detectors off."""

    as_of: datetime | str
    signatures: list[Signature] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)
    blocked_ips: DataFrame | None = None
    baselines: DataFrame | None = None
    profiles: DataFrame | None = None
    intel: DataFrame | None = None
    bursts: list[Burst] | None = None


def all_bursts() -> list[Burst]:
    return [*anomaly.bursts(), *heuristic.bursts(), *network.bursts()]


def detectors(k: Knowledge) -> dict[str, Detector]:
    """Named DataFrame functions over a prepared log frame.

    All threshold detectors are one entry: they share a scan and a shuffle.
    """
    found: dict[str, Detector] = {
        "bursts": lambda logs: burst_alerts(logs, k.bursts or all_bursts()),
        "requests": lambda logs: anomaly.request_anomalies(logs, k.baselines),
        "suspicious_commands": anomaly.suspicious_commands,
        "brute_force_success": brute_force_success,
        "privilege_escalation": privilege_escalation,
        "off_hours": heuristic.off_hours_activity,
        "beaconing": network.beaconing,
        "protocol_anomaly": network.protocol_anomaly,
    }
    if k.baselines is not None:
        found["rates"] = lambda logs: anomaly.rate_anomalies(logs, k.baselines)
    if k.signatures:
        found["signatures"] = lambda logs: signature_alerts(logs, k.signatures)
        if any(s.hashes for s in k.signatures):
            found["hashes"] = lambda logs: hash_alerts(logs, hash_frame(logs.sparkSession, k.signatures))
    if k.blocked_ips is not None:
        found["blocked_ips"] = lambda logs: blocked_ip_alerts(logs, k.blocked_ips)
    if k.profiles is not None:
        found["behaviour"] = lambda logs: behaviour.behavioral_alerts(logs, k.profiles)
    if k.rules:
        found["rules"] = lambda logs: rule_alerts(logs, k.rules)
    if k.intel is not None:
        found["intel"] = lambda logs: threat_intel_alerts(logs, k.intel, k.as_of)
    return found


def prioritise(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("priority_score", priority(F.col("severity")))


def deduplicate(alerts: DataFrame, key: tuple[str, ...] = DEDUP_KEY) -> DataFrame:
    """Per cycle and key the alert with the highest priority; null key parts count as equal.

    Ties go to the earlier detector, then log id, then alert id. The rank-1 limit is applied
    before the shuffle too, so a key repeated in most alerts does not gather in one task.
    """
    methods = F.array(*[F.lit(m) for m in METHOD_ORDER])
    best = Window.partitionBy("created_at", *key).orderBy(
        F.desc("priority_score"), F.array_position(methods, F.col("detection_method")), F.col("log_id"), F.col("id")
    )
    return alerts.withColumn("place", F.row_number().over(best)).filter("place = 1").drop("place")


def by_priority(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy(F.desc("priority_score"), "created_at", "id")


def with_place(alerts: DataFrame) -> DataFrame:
    """All alerts with ``place``, from 1, in the order of ``by_priority``.

    Places are counted inside parts of the order and carried over them, so no task sees all alerts.
    """
    keyed = alerts.withColumns({"_all": F.lit(0), "_below": -F.col("priority_score"), "_one": F.lit(1)})
    placed = running(keyed, ["_all"], ["_below", "created_at", "id"], ["_one"])
    return placed.withColumnRenamed("sum__one", "place").drop("_all", "_below", "_one")


def run(logs: DataFrame, k: Knowledge, extra: dict[str, Detector] | None = None) -> DataFrame:
    """Alerts of all detectors (and of the caller's own), scored and de-duplicated."""
    found = {**detectors(k), **(extra or {})}
    return deduplicate(prioritise(union_alerts([d(logs) for d in found.values()])))


def refresh_baselines(logs: DataFrame, path: str, as_of: datetime | str, days: int = 7) -> DataFrame:
    """Replace the stored baselines by those of the last ``days`` days and return them as stored.

    Metrics that have too few values now keep their stored row. Run it as a batch job; streams pick the table up,
    since they ask for their detectors in every micro-batch.
    """
    fresh = baselines(logs, as_of, days)
    try:
        stored = read_baselines(logs.sparkSession, path)
        fresh = fresh.unionByName(stored.join(fresh.select("metric"), "metric", "left_anti"), allowMissingColumns=True)
    except AnalysisException:  # the first time
        pass
    save_table(fresh, path)
    return read_baselines(logs.sparkSession, path)


def detection_method_is(method: str) -> Column:
    return F.col("detection_method") == method
