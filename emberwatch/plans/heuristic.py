"""Rule-of-thumb detectors: sequences, bursts per (source, user) and off-hours activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions import fields as X
from emberwatch.functions import predicates as P
from emberwatch.operators.alerts import minutes, payload, to_alerts, union_alerts
from emberwatch.operators.bursts import Burst, burst_alerts
from emberwatch.operators.sequences import brute_force_success, privilege_escalation

METHOD = "heuristic_analyzer"


def _known_entity() -> Column:
    return X.non_empty(F.col("source_ip")).isNotNull() | X.non_empty(F.col("user")).isNotNull()


def _by_ip_user() -> dict[str, Column]:
    return {"source_ip": F.col("k1"), "user": F.col("k2")}


def lateral_movement(min_hosts: int = 5, window_seconds: int = 900) -> Burst:
    return Burst(
        alert_type="lateral_movement",
        method=METHOD,
        severity="high",
        when=_known_entity(),
        k1=X.or_unknown(F.col("source_ip")),
        k2=X.or_unknown(F.col("user")),
        value=X.non_empty(F.col("host")),
        measure="distinct",
        threshold=min_hosts,
        window_seconds=window_seconds,
        describe=F.concat(
            F.lit("One user on many machines: "),
            F.col("distinct_n").cast("string"),
            F.lit(f" hosts in {window_seconds // 60} minutes"),
        ),
        metadata={
            "rule_id": F.lit("HEUR-003"),
            "rule_name": F.lit("Lateral Movement Pattern"),
            **_by_ip_user(),
            "unique_hosts": F.col("distinct_n"),
            "hosts": F.col("vals"),
            "window_minutes": minutes(window_seconds),
        },
        entity={"source_ip": "k1", "user": "k2"},
    )


def data_exfiltration(min_bytes: int = 100_000_000, window_seconds: int = 300) -> Burst:
    size = F.col("transfer_bytes")
    return Burst(
        alert_type="data_exfiltration",
        method=METHOD,
        severity="critical",
        when=size > 0,
        k1=X.non_empty(F.col("source_ip")),
        amount=size,
        measure="amount",
        threshold=min_bytes,
        window_seconds=window_seconds,
        describe=F.concat(F.lit("Much data left: "), F.format_number("amount", 0), F.lit(" bytes")),
        metadata={
            "rule_id": F.lit("HEUR-004"),
            "rule_name": F.lit("Data Exfiltration Indicator"),
            "source_ip": F.col("k1"),
            "bytes_transferred": F.col("amount"),
            "window_minutes": minutes(window_seconds),
        },
        entity={"source_ip": "k1"},
    )


def rapid_file_access(min_access: int = 20, window_seconds: int = 300) -> Burst:
    return Burst(
        alert_type="rapid_file_access",
        method=METHOD,
        severity="medium",
        when=F.col("is_file"),
        k1=X.or_unknown(F.col("source_ip")),
        k2=X.or_unknown(F.col("user")),
        measure="rows",
        threshold=min_access,
        window_seconds=window_seconds,
        describe=F.concat(
            F.lit("Files opened in quick succession: "),
            F.col("n").cast("string"),
            F.lit(f" accesses in {window_seconds // 60} minutes"),
        ),
        metadata={
            "rule_id": F.lit("HEUR-006"),
            "rule_name": F.lit("Rapid File Access"),
            **_by_ip_user(),
            "file_access_count": F.col("n"),
            "window_minutes": minutes(window_seconds),
        },
        entity={"source_ip": "k1", "user": "k2"},
    )


def suspicious_command_sequence(min_commands: int = 2, window_seconds: int = 120) -> Burst:
    return Burst(
        alert_type="suspicious_command_sequence",
        method=METHOD,
        severity="high",
        when=F.col("command_word").isNotNull(),
        k1=X.or_unknown(F.col("source_ip")),
        k2=X.or_unknown(F.col("user")),
        value=F.col("command_word"),
        measure="rows",
        threshold=min_commands,
        window_seconds=window_seconds,
        list_limit=None,
        describe=F.concat(F.lit("Commands of an attack in one session: "), F.array_join("vals", ", ")),
        metadata={
            "rule_id": F.lit("HEUR-007"),
            "rule_name": F.lit("Suspicious Command Sequence"),
            **_by_ip_user(),
            "commands": F.col("vals"),
            "command_count": F.col("n"),
            "window_minutes": minutes(window_seconds),
        },
        entity={"source_ip": "k1", "user": "k2", "host": "first.host"},
    )


def bursts() -> list[Burst]:
    return [lateral_movement(), data_exfiltration(), rapid_file_access(), suspicious_command_sequence()]


def off_hours_activity(logs: DataFrame, start: int = 22, end: int = 6) -> DataFrame:
    hits = logs.filter(P.is_off_hours(F.col("ts"), start, end) & F.col("is_off_hours_kind"))
    hour = F.hour("ts")
    return to_alerts(
        hits,
        method=METHOD,
        alert_type=F.lit("off_hours_activity"),
        severity=F.lit("medium"),
        description=F.concat(
            F.lit("Work outside office hours ("), F.lpad(hour.cast("string"), 2, "0"), F.lit(":00)")
        ),
        metadata=payload(
            {
                "rule_id": F.lit("HEUR-005"),
                "rule_name": F.lit("Off-Hours Activity"),
                "hour": hour,
                "off_hours_start": F.lit(start),
                "off_hours_end": F.lit(end),
            }
        ),
        log_id=F.col("id"),
        user=F.col("user"),
        source_ip=F.col("source_ip"),
        host=F.col("host"),
    )


def heuristic_alerts(logs: DataFrame) -> DataFrame:
    return union_alerts(
        [
            brute_force_success(logs),
            privilege_escalation(logs),
            burst_alerts(logs, bursts()),
            off_hours_activity(logs),
        ]
    )
