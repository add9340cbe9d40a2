"""Network traffic detectors over the network-related part of the logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions import fields as X
from emberwatch.functions import predicates as P
from emberwatch.functions.scores import variation
from emberwatch.operators.alerts import minutes, payload, to_alerts, union_alerts
from emberwatch.operators.bursts import Burst, burst_alerts
from emberwatch.operators.sequences import gap_statistics

METHOD = "network_analyzer"


def network_logs(logs: DataFrame) -> DataFrame:
    return logs.filter("network")


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def port_scan(min_ports: int = 20, window_seconds: int = 60) -> Burst:
    return Burst(
        alert_type="port_scan",
        method=METHOD,
        severity="high",
        when=F.col("network") & F.col("dest_port").isNotNull(),
        k1=X.non_empty(F.col("source_ip")),
        value=F.col("dest_port"),
        measure="distinct",
        threshold=min_ports,
        window_seconds=window_seconds,
        describe=F.concat(
            F.lit("Many ports tried: "), _text("distinct_n"), F.lit(" different ports, all from "), F.col("k1")
        ),
        metadata={
            "source_ip": F.col("k1"),
            "unique_ports": F.col("distinct_n"),
            "ports": F.col("vals").cast("array<int>"),
            "time_window_minutes": minutes(window_seconds),
            "threshold": F.lit(min_ports),
        },
        entity={"source_ip": "k1"},
    )


def ddos_attack(min_connections: int = 1000, window_seconds: int = 60) -> Burst:
    return Burst(
        alert_type="ddos_attack",
        method=METHOD,
        severity="critical",
        when=F.col("network"),
        k1=F.col("contact_ip"),
        value=X.non_empty(F.col("source_ip")),
        measure="rows",
        threshold=min_connections,
        window_seconds=window_seconds,
        describe=F.concat(
            F.lit("Flood of connections: "),
            _text("n"),
            F.lit(" connections to "),
            F.col("k1"),
            F.lit(" from "),
            _text("distinct_n"),
            F.lit(" sources"),
        ),
        metadata={
            "dest_ip": F.col("k1"),
            "connection_count": F.col("n"),
            "unique_sources": F.col("distinct_n"),
            "sources": F.col("vals"),
            "time_window_minutes": minutes(window_seconds),
            "threshold": F.lit(min_connections),
        },
        entity={"dest_ip": "k1"},
    )


def dns_tunneling(min_queries: int = 100, window_seconds: int = 60) -> Burst:
    return Burst(
        alert_type="dns_tunneling",
        method=METHOD,
        severity="high",
        when=F.col("network") & F.col("is_dns"),
        k1=X.non_empty(F.col("source_ip")),
        measure="rows",
        threshold=min_queries,
        window_seconds=window_seconds,
        describe=F.concat(F.lit("Names looked up too often: "), _text("n"), F.lit(" lookups by "), F.col("k1")),
        metadata={
            "source_ip": F.col("k1"),
            "dns_query_count": F.col("n"),
            "time_window_minutes": minutes(window_seconds),
            "threshold": F.lit(min_queries),
        },
        entity={"source_ip": "k1"},
    )


def bandwidth_anomaly(min_bytes: int = 100 * 1024 * 1024, window_seconds: int = 300) -> Burst:
    size = F.col("field_bytes")
    return Burst(
        alert_type="bandwidth_anomaly",
        method=METHOD,
        severity="high",
        when=F.col("network") & (size > 0),
        k1=X.non_empty(F.col("source_ip")),
        amount=size,
        measure="amount",
        threshold=min_bytes,
        window_seconds=window_seconds,
        describe=F.concat(
            F.lit("Heavy traffic: "),
            F.format_number("amount", 0),
            F.lit(" bytes from "),
            F.col("k1"),
        ),
        metadata={
            "source_ip": F.col("k1"),
            "bytes_transferred": F.col("amount"),
            "time_window_minutes": minutes(window_seconds),
            "threshold_bytes": F.lit(min_bytes),
        },
        entity={"source_ip": "k1"},
    )


def bursts() -> list[Burst]:
    return [port_scan(), ddos_attack(), dns_tunneling(), bandwidth_anomaly()]


def beaconing(
    logs: DataFrame, min_events: int = 5, max_variation: float = 0.2, slice_seconds: int = 10
) -> DataFrame:
    """Regular contact: the gaps between events of a (source, destination) pair hardly vary."""
    pairs = network_logs(logs).select(
        "cycle",
        X.non_empty(F.col("source_ip")).alias("src"),
        F.col("contact_ip").alias("dst"),
        "ts",
    )
    stats = gap_statistics(pairs.na.drop(), ["cycle", "src", "dst"], slice_seconds)
    cv = variation(F.col("mean"), F.col("std"))
    hits = stats.withColumn("cv", cv).filter((F.col("events") >= min_events) & (F.col("cv") < max_variation))
    return to_alerts(
        hits,
        method=METHOD,
        alert_type=F.lit("beaconing"),
        severity=F.lit("critical"),
        description=F.concat(
            F.lit("Calls home at even intervals from "), F.col("src"), F.lit(" to "), F.col("dst")
        ),
        metadata=payload(
            {
                "source_ip": F.col("src"),
                "dest_ip": F.col("dst"),
                "connection_count": F.col("events"),
                "mean_interval_seconds": F.col("mean"),
                "coefficient_of_variation": F.col("cv"),
                "threshold": F.lit(max_variation),
            }
        ),
        source_ip=F.col("src"),
        dest_ip=F.col("dst"),
    )


def protocol_anomaly(logs: DataFrame) -> DataFrame:
    """Web protocol on a port that is not a web port, one alert per log row."""
    protocol = F.col("protocol")
    port = F.nullif(F.col("fields")["dest_port"].try_cast("int"), F.lit(0))
    hits = network_logs(logs).filter(P.odd_web_port(protocol, port))
    return to_alerts(
        hits,
        method=METHOD,
        alert_type=F.lit("protocol_anomaly"),
        severity=F.lit("medium"),
        description=F.concat(
            F.lit("Protocol on a foreign port: "), protocol, F.lit(" on port "), port.cast("string")
        ),
        metadata=payload(
            {
                "protocol": protocol,
                "dest_port": port,
                "source_ip": F.col("source_ip"),
                "dest_ip": F.col("contact_ip"),
            }
        ),
        log_id=F.col("id"),
        source_ip=F.col("source_ip"),
    )


def protocol_counts(logs: DataFrame) -> DataFrame:
    return (
        network_logs(logs)
        .filter("protocol IS NOT NULL")
        .groupBy("protocol")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def network_alerts(logs: DataFrame) -> DataFrame:
    return union_alerts([burst_alerts(logs, bursts()), beaconing(logs), protocol_anomaly(logs)])
