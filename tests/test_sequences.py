import random
from collections import defaultdict
from datetime import timedelta

import numpy as np
import pytest

from conftest import T0, log
from emberwatch.operators import sequences as SQ

FAIL, GOOD, BOTH = "Failed login", "Accepted login", "failed login then accepted"
rng = random.Random(7)


def simulate_failures(rows, least, window):
    """The pattern read row by row."""
    hits, groups = {}, defaultdict(list)
    for r in rows:
        groups[r["k"]].append(r)
    for k, group in groups.items():
        failed, last = 0, None
        for r in sorted(group, key=lambda r: (r["s"], r["id"])):
            if r["m"] in (FAIL, BOTH):
                failed, last = failed + 1, r["s"]
            if r["m"] in (GOOD, BOTH):
                if failed >= least and r["s"] - last <= window:
                    hits[k] = (r["id"], failed)
                    break
                failed, last = 0, None
    return hits


def simulate_escalations(rows, window):
    hits, groups = set(), defaultdict(list)
    for r in rows:
        groups[r["k"]].append(r)
    for group in groups.values():
        login = None
        for r in sorted(group, key=lambda r: (r["s"], r["id"])):
            if "login" in r["m"] and login is None:
                login = r["s"]
            if login is not None and r["s"] - login <= window and "sudo" in r["m"]:
                hits.add(r["id"])
                login = None
    return hits


def make(messages, n, keys, span):
    # The first key holds a third of the rows.
    rows = []
    for i in range(n):
        k = keys[0] if i % 3 == 0 else rng.choice(keys)
        rows.append({"id": f"{i:05d}", "k": k, "s": rng.randrange(span), "m": rng.choice(messages)})
    logs = [log(r["id"], r["s"], r["m"], {"source_ip": r["k"], "user": "u" + r["k"]}, host="h") for r in rows]
    return rows, logs


@pytest.mark.parametrize("slice_seconds", [30, 600, 10**6])
def test_failures_then_success_equals_simulation(prepared, slice_seconds):
    rows, logs = make([FAIL, FAIL, FAIL, GOOD, BOTH, "noise"], 900, ["1", "2", "3", "4"], 5000)
    got = SQ.failures_then_success(prepared(logs), 4, 20, slice_seconds).collect()
    assert {r["k_ip"]: (r["id"], r["failed_count"]) for r in got} == simulate_failures(rows, 4, 20)


@pytest.mark.parametrize("slice_seconds", [20, 500, 10**6])
def test_escalation_equals_simulation(prepared, slice_seconds):
    rows, logs = make(["login", "sudo", "login sudo", "noise"], 500, [str(i) for i in range(12)], 20000)
    got = SQ.login_then_escalation(prepared(logs), 900, slice_seconds=slice_seconds).collect()
    want = simulate_escalations(rows, 900)
    assert want and {r["id"] for r in got} == want


def test_failure_boundaries(prepared):
    def case(k, fails, gap):
        rows = [log(f"{k}-{i}", i, FAIL, {"source_ip": k, "user": "u"}) for i in range(fails)]
        return [*rows, log(f"{k}-ok", fails - 1 + gap, GOOD, {"source_ip": k, "user": "u"})]

    logs = case("four", 4, 1) + case("five", 5, 300) + case("late", 5, 301)
    assert [r["log_id"] for r in SQ.brute_force_success(prepared(logs)).collect()] == ["five-ok"]


def test_late_escalation_silences_unless_rearmed(prepared):
    logs = [
        log("1", 0, "login", {"user": "a"}),
        log("2", 601, "sudo", {"user": "a"}),
        log("3", 700, "login", {"user": "a"}),
        log("4", 710, "sudo", {"user": "a"}),
        log("5", 0, "login", {"user": "b"}),
        log("6", 600, "sudo", {"user": "b"}),
        log("7", 605, "sudo", {"user": "b"}),
        log("8", 3, "sudo login", {"user": "c"}),
    ]
    exact = SQ.privilege_escalation(prepared(logs)).collect()
    assert sorted(r["log_id"] for r in exact) == ["6", "8"]
    again = SQ.privilege_escalation(prepared(logs), rearm=True).collect()
    assert sorted(r["log_id"] for r in again) == ["4", "6", "8"]


@pytest.mark.parametrize("slice_seconds", [5, 60, 10**6])
def test_gap_statistics_equal_numpy(spark, slice_seconds):
    times = {k: sorted(rng.randrange(4000) for _ in range(n)) for k, n in (("hot", 400), ("b", 30), ("one", 1))}
    data = [(k, T0 + timedelta(seconds=s)) for k, ss in times.items() for s in ss]
    got = {r["k"]: r for r in SQ.gap_statistics(spark.createDataFrame(data, "k string, ts timestamp"), ["k"], slice_seconds).collect()}
    for k in ("hot", "b"):
        gaps = np.diff(times[k])
        assert got[k]["events"] == len(times[k]) and got[k]["gaps"] == len(gaps)
        assert got[k]["mean"] == pytest.approx(gaps.mean()) and got[k]["std"] == pytest.approx(gaps.std())
    assert got["one"]["mean"] is None
