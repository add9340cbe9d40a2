"""Bursts in event time against a row-by-row simulation, for any cut of the order into parts."""

from __future__ import annotations

import random
import pytest
from pyspark.sql import functions as F

from conftest import T0, log
from emberwatch.operators.alerts import meta
from emberwatch.operators.ordered import following, running
from emberwatch.operators.sliding import episodes, sliding_alerts, tumbling_alerts
from emberwatch.plans import anomaly, heuristic, network


def seconds(t):
    return (t - T0).total_seconds()


def plain(events, measure, threshold, window):
    """events (key, second, value, id) to {(key, started, ended, peak, points, log_id)}."""
    out = set()
    for key in {e[0] for e in events}:
        mine = sorted((s, v, i) for k, s, v, i in events if k == key and (v is not None or measure != "distinct"))
        current = None
        for at in sorted({s for s, _, _ in mine}):
            inside = [(v, i) for s, v, i in mine if at - window <= s <= at]
            got = {"rows": len(inside), "distinct": len({v for v, _ in inside}), "amount": sum(v or 0 for v, _ in inside)}[measure]
            if got < threshold:
                current = None
                continue
            if current is None:
                current = [key, at, at, got, 0, min(i for s, _, i in mine if s == at)]
                out.add(tuple(current))
            out.discard(tuple(current))
            current[2:5] = [at, max(current[3], got), current[4] + 1]
            out.add(tuple(current))
    return out


def found(logs, spec, parts=None):
    return {(r.k1, seconds(r.started), seconds(r.ended), r.peak, r.points, r.log_id) for r in episodes(logs, [spec], parts).collect()}


def connections(draw, n, key=None):
    rows = []
    for i in range(n):
        ip = key or draw.choice("ab")
        at = draw.randrange(10) if draw.random() < 0.6 else draw.randrange(600)
        rows.append((ip, float(at), draw.choice([None, *range(1, 9)]), f"{ip}{i:04d}"))
    return rows


@pytest.mark.parametrize("parts", [1, 7])
def test_distinct_values(prepared, parts):
    draw = random.Random(3)
    events = connections(draw, 300, "hot") + connections(draw, 60)  # most rows of one key lie inside ten seconds
    logs = prepared([log(i, s, "tcp", {"source_ip": k, **({} if v is None else {"dest_port": v})}) for k, s, v, i in events])
    for threshold, window in ((3, 5), (5, 30), (8, 60)):
        want = plain([e for e in events if e[2] is not None], "distinct", threshold, window)
        assert found(logs, network.port_scan(threshold, window), parts) == want
    assert len(plain(events, "distinct", 3, 5)) > 5


@pytest.mark.parametrize("parts", [1, 5])
def test_rows_and_amounts(prepared, parts):
    draw = random.Random(4)
    events = [(k, s, draw.randrange(1, 50), i) for k, s, _, i in connections(draw, 200, "hot") + connections(draw, 40)]
    logs = prepared([log(i, s, f"tcp sent {v} bytes", {"source_ip": k, "dest_ip": k, "bytes": v}) for k, s, v, i in events])
    assert found(logs, network.ddos_attack(12, 20), parts) == plain(events, "rows", 12, 20)
    assert found(logs, heuristic.data_exfiltration(300, 20), parts) == plain(events, "amount", 300, 20)
    both = episodes(logs, [network.ddos_attack(12, 20), heuristic.data_exfiltration(300, 20)], parts)
    assert both.count() == len(plain(events, "rows", 12, 20)) + len(plain(events, "amount", 300, 20))


def test_noise_an_hour_earlier_hides_nothing(prepared):
    scan = [log(f"s{i:02d}", 4000 + i, "tcp", {"source_ip": "a", "dest_port": i + 1}) for i in range(25)]
    noise = [log("early", 0, "tcp", {"source_ip": "a", "dest_port": 9999})]
    logs = prepared(noise + scan)
    row = sliding_alerts(logs, [network.port_scan()]).select(
        "log_id", "source_ip", "description", meta("unique_ports").alias("n"), F.from_json(meta("ports"), "array<int>").alias("ports"), "created_at"
    ).collect()
    assert [(r.log_id, r.n, r.ports, seconds(r.created_at)) for r in row] == [("s19", "25", list(range(1, 21)), 4019.0)]
    assert "25" in row[0].description
    from emberwatch.operators.bursts import burst_alerts

    assert burst_alerts(logs, [network.port_scan()]).count() == 0  # as one span the noise makes it slow


def test_a_scan_over_the_border_of_two_cycles_is_one_stretch(prepared):
    from emberwatch.functions import fields as X

    rows = [log(f"s{i:02d}", i, "tcp", {"source_ip": "a", "dest_port": i + 1}) for i in range(30)]
    logs = X.in_cycles(prepared(rows), "2024-03-04 12:00:00", 15)
    assert found(logs, network.port_scan(20, 60)) == {("a", 19.0, 29.0, 30, 11, "s19")}


def test_window_ends_and_late_rows(prepared):
    ports = lambda times: [log(f"p{i}", s, "tcp", {"source_ip": "a", "dest_port": i}) for i, s in enumerate(times, 1)]
    assert found(prepared(ports([0, 30, 60])), network.port_scan(3, 60)) == {("a", 60.0, 60.0, 3, 1, "p3")}
    assert found(prepared(ports([0, 30, 61])), network.port_scan(3, 60)) == set()
    again = ports([0, 30]) + [log("r", 50, "tcp", {"source_ip": "a", "dest_port": 1}), log("q", 110, "tcp", {"source_ip": "a", "dest_port": 7})]
    assert found(prepared(again), network.port_scan(2, 60)) == {("a", 30.0, 110.0, 2, 3, "p2")}  # the second visit to a port keeps it in the window
    assert episodes(prepared([]), [network.port_scan()]).count() == 0
    none = prepared([log("n", 1, "tcp", {"dest_port": 1})])
    assert episodes(none, [network.port_scan(1, 60)]).count() == 0


def test_tumbling(prepared):
    rows = [log(f"s{i:02d}", 50 + i, "tcp", {"source_ip": "a", "dest_port": i + 1}) for i in range(30)]  # 10 in one minute, 20 in the next
    got = tumbling_alerts(prepared(rows), [network.port_scan(20, 60)]).collect()
    assert [(r.log_id, seconds(r.created_at)) for r in got] == [("s10", 120.0)]
    got = tumbling_alerts(prepared(rows), [network.port_scan(10, 60)]).collect()
    assert sorted((r.log_id, seconds(r.created_at)) for r in got) == [("s00", 60.0), ("s10", 120.0)]


def test_commands_are_listed(prepared):
    rows = [log(f"c{i}", i * 10, m, {"source_ip": "e", "user": "v"}) for i, m in enumerate(["wget x", "ran rm -rf / now", "wget y"])]
    got = sliding_alerts(prepared(rows), [heuristic.suspicious_command_sequence(2, 60), anomaly.brute_force_attempt(1)]).collect()
    assert [r.description for r in got] == ["Commands of an attack in one session: rm -rf, wget"]


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_ordered(spark, parts):
    draw = random.Random(parts)
    rows = [("hot" if draw.random() < 0.9 else draw.choice("xyz"), i, draw.randrange(-3, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, at long, v long").repartition(4)
    sums, got = {}, {}
    for k, at, v in rows:
        sums[k] = sums.get(k, 0) + v
        got[k, at] = sums[k]
    assert {(r.k, r["at"]): r.sum_v for r in running(df, ["k"], ["at"], ["v"], parts).collect()} == got
    after = {}
    for k in "hot", "x", "y", "z":
        at = [a for key, a, _ in rows if key == k]
        after |= {(k, a): b for a, b in zip(at, [*at[1:], None], strict=True)}
    assert {(r.k, r["at"]): r.next for r in following(df, ["k"], "at", parts).collect()} == after


def test_a_hot_key_lies_in_several_parts(spark):
    from emberwatch.operators.ordered import in_parts

    df = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("at"))
    sizes = [r["count"] for r in in_parts(df, ["k"], ["at"], 8).groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 0.3 * 20_000
