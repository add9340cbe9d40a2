from dataclasses import replace

from pyspark.sql import functions as F

from conftest import log
from emberwatch.operators.alerts import meta
from emberwatch.operators.bursts import burst_alerts
from emberwatch.plans import anomaly, heuristic, network


def scan(ip, ports, step=1, start=0):
    return [
        log(f"{ip}-{i:03d}", start + i * step, "tcp", {"source_ip": ip, "dest_port": p}) for i, p in enumerate(ports)
    ]


def test_threshold_and_span(prepared):
    logs = (
        scan("few", range(1, 20))
        + scan("enough", range(1, 21))
        + scan("on-time", range(1, 21), step=0)
        + [log("on-time-last", 60, "tcp", {"source_ip": "on-time", "dest_port": 1})]
        + scan("late", range(1, 21), step=0)
        + [log("late-last", 61, "tcp", {"source_ip": "late", "dest_port": 1})]
        + scan(None, range(1, 30))
    )
    got = {r["source_ip"]: r["log_id"] for r in burst_alerts(prepared(logs), [network.port_scan()]).collect()}
    assert got == {"enough": "enough-000", "on-time": "on-time-000"}


def test_unknown_time_counts_as_cycle_end(prepared):
    logs = scan("a", range(1, 21)) + [log("x", None, "tcp", {"source_ip": "a", "dest_port": 1})]
    assert burst_alerts(prepared(logs), [network.port_scan()]).count() == 0


def test_lists_are_numeric_first_k_and_counts_whole(prepared):
    logs = scan("a", [*range(500, 0, -1)], step=0)
    row = burst_alerts(prepared(logs), [network.port_scan()]).select(
        meta("unique_ports").alias("n"), F.from_json(meta("ports"), "array<int>").alias("ports")
    ).first()
    assert row["n"] == "500" and row["ports"] == list(range(1, 21))
    row = burst_alerts(prepared(logs), [replace(network.port_scan(), list_limit=None)]).select(
        F.from_json(meta("ports"), "array<int>").alias("ports")
    ).first()
    assert row["ports"] == list(range(1, 501))


def test_many_detectors_in_one_pass(prepared):
    logs = (
        scan("a", range(1, 25))
        + [log(f"f{i}", i, "Failed password for joe", {"source_ip": "b"}) for i in range(5)]
        + [log(f"h{i}", i, "x", {"source_ip": "c", "user": "u"}, host=f"h{i}") for i in range(5)]
        + [log("big", 1, "sent 120 MB", {"source_ip": "d"})]
        + [log(f"c{i}", i, m, {"source_ip": "e", "user": "v"}) for i, m in enumerate(["wget x", "rm -rf / and wget"])]
    )
    specs = [*anomaly.bursts(), *heuristic.bursts(), *network.bursts()]
    together = burst_alerts(prepared(logs), specs).select("id", "alert_type", "description", "metadata").collect()
    alone = [r for s in specs for r in burst_alerts(prepared(logs), [s]).select("id", "alert_type", "description", "metadata").collect()]
    assert sorted(together) == sorted(alone)
    text = {r["alert_type"]: r["description"] for r in together}
    assert text["data_exfiltration"] == "Much data left: 125,829,120 bytes"
    assert text["suspicious_command_sequence"] == "Commands of an attack in one session: rm -rf, wget"
    assert set(text) == {
        "port_scan", "brute_force_attempt", "lateral_movement", "data_exfiltration", "suspicious_command_sequence",
    }


def test_partitioning_does_not_matter(prepared):
    frame = prepared(scan("a", range(1, 40)) + scan("b", range(1, 22)))
    specs = [network.port_scan()]
    want = sorted(r["metadata"] for r in burst_alerts(frame, specs).collect())
    assert sorted(r["metadata"] for r in burst_alerts(frame.repartition(7), specs).collect()) == want
