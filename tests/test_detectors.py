import random
import re
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import AS_OF, T0, log
from emberwatch.functions import fields as X
from emberwatch.functions.literals import needed
from emberwatch.operators import baselines as B
from emberwatch.operators import profiles as PR
from emberwatch.operators.rules import Rule, rule_alerts, selection, timeframe_seconds
from emberwatch.operators.signatures import Signature, blocked_ip_alerts, hash_alerts, hash_frame, matches, signature_alerts, signature_hits, split_patterns
from emberwatch.plans import anomaly, detect
from emberwatch.schema import LOG_SCHEMA
from emberwatch.sources.default_rules import DEFAULT_RULES
from emberwatch.sources.default_signatures import DEFAULT_SIGNATURES


def test_signature_fixture(prepared, spark):
    logs = [
        log("sql", 0, "GET /items", {"query_string": "id=1 UNION SELECT name FROM users"}),
        log("xss", 0, "POST", {"user_input": "<script>go()</script>"}),
        log("ssh", 0, "Failed password for root from 192.0.2.1"),
        log("plain", 0, "hello from 192.0.2.1"),
        log("cmd", 0, "run", {"command": "x; cat /etc/passwd"}),
        log("dump", 0, "start", {"process_name": "mimikatz", "command": "sekurlsa::logonpasswords"}),
        log("benign", 0, "all quiet"),
    ]
    frame = prepared(logs)
    hits = signature_alerts(frame, DEFAULT_SIGNATURES)
    got = {(r[0], r[1]) for r in hits.select("log_id", F.get_json_object("metadata", "$.signature_id")).collect()}
    for pair in [("sql", "SIG-WEB-001"), ("xss", "SIG-WEB-005"), ("ssh", "SIG-AUTH-001"), ("dump", "SIG-MAL-004"), ("cmd", "SIG-WEB-010")]:
        assert pair in got
    assert not {g for g in got if g[0] in ("benign", "plain")}
    blocked = spark.createDataFrame([("192.0.2.1",)], "ip string")
    assert sorted(r["log_id"] for r in blocked_ip_alerts(frame, blocked).collect()) == ["plain", "ssh"]


def test_gate_words_are_searched_once_a_log(prepared):
    """Not once a field: the raw line mostly holds the message, and few records have the other fields."""
    one = Signature("S", "n", "low", "c", "", ("evil (one|two)",), ("raw", "message", "normalized.command"))
    rows = [
        log(1, 0, "an Evil one", raw="x: an Evil one"), log(2, 0, "evil two", raw="something else"), log(3, 0, "evil", raw="one"),
        log(4, 0, None, {"command": "run evil two"}), log(5, 0, "evil one", raw=None), log(6, 0, "none", raw="EVIL ONE"),
    ]
    hits = signature_hits(prepared(rows), [one])
    assert sorted(r.id for r in hits.collect()) == ["1", "2", "4", "5", "6"]
    tests = matches(one, {"raw": "a", "message": "b", "normalized.command": "c"})
    assert " ".join(tests).count("contains(") == 1


def test_signatures_equal_plain_search(prepared):
    """The substring gates change no result: every pattern tried by brute force on awkward texts."""
    rng = random.Random(3)
    parts = ["union", "SELECT ", "ſelect", "$ne", "; DROP table", "xmrIg", "éva", "'1'='1", " or ", "\r", "\n", "<script>",
             "powerShell -EnC", "10.0.0.1", "a" * 55 + ".com", "../", "|| sh", "admin:admin", "onload =", "İ", "K", "x"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 7))) for _ in range(400)]
    frame = prepared([log(str(i), 0, t) for i, t in enumerate(texts)])
    hits = signature_alerts(frame, DEFAULT_SIGNATURES)
    got = {(int(r[0]), r[1]) for r in hits.select("log_id", F.get_json_object("metadata", "$.signature_id")).collect()}
    want = {
        (i, s.id)
        for i, t in enumerate(texts)
        for s in DEFAULT_SIGNATURES
        if any(re.search(p, t, re.IGNORECASE | re.MULTILINE) for p in s.patterns)
    }
    assert got == want and len(want) > 100


def test_needed_substrings():
    assert needed("(?i)emotet") == {"emotet"}
    assert needed("a|b") is None
    assert needed("(foo|barbaz)+x*") == {"foo", "barbaz"}
    good, bad = split_patterns([Signature("s", "n", "low", "c", "d", ("ok", "(broken"))])
    assert good[0].patterns == ("ok",) and bad[0][:2] == ("s", "(broken")


def test_first_known_hash_counts(prepared, spark):
    a, b = "a" * 32, "b" * 64
    sigs = [Signature("S1", "one", "high", "malware", "d", (), hashes=((a, "md5", ""), (b, "sha256", "")))]
    frame = prepared([log("1", 0, f"{b} {a.upper()}"), log("2", 0, "x", {"sha1": "zz", "hash": b}), log("3", 0, "none")])
    got = hash_alerts(frame, hash_frame(spark, sigs)).select("log_id", F.get_json_object("metadata", "$.hash_type"))
    assert sorted(tuple(r) for r in got.collect()) == [("1", "md5"), ("2", "sha256")]


@pytest.mark.parametrize("text,seconds", [("5m", 300), ("1h", 3600), ("7d", 604800), ("15", 900)])
def test_timeframe(text, seconds):
    assert timeframe_seconds(text) == seconds


def test_selection_operators(prepared):
    frame = prepared([log("1", 0, "x", {"port": 80, "name": "Mimikatz.EXE", "none": None}), log("2", 0, "y", {"port": "81"})])

    def ids(criteria):
        return sorted(r["id"] for r in frame.filter(selection(criteria)).collect())

    assert ids({"port": [80, 81]}) == ["1", "2"]
    assert ids({"name": "mimikatz.exe"}) == ["1"]
    assert ids({"none": {"not": "x"}}) == [] and ids({"port": {"not": 80}}) == ["2"]
    assert ids({"name": {"contains": "KATZ"}}) == ["1"] and ids({"name": {"regex": "^mimi"}}) == ["1"]
    assert ids({"normalized.port": 81}) == ["2"] and ids({"event_type": "unknown"}) == ["1", "2"]


def test_rules(prepared):
    # 7200 s after the start is the cycle's end.
    logs = [log(f"r{i}", 7000 + i, "failed login", {"source_ip": "1"}) for i in range(10)]
    logs += [log(f"s{i}", 7000 + i, "failed login", {"source_ip": "2"}) for i in range(9)]
    logs += [log(f"o{i}", 100, "failed login", {"source_ip": "2"}) for i in range(9)]
    logs += [log("p", 0, "z", {"event_type": "process_creation", "process_name": "mimikatz.exe"})]
    rules = [Rule.from_dict(d, "rules.yaml") for d in DEFAULT_RULES]
    got = rule_alerts(prepared(logs), rules).collect()
    assert {r["log_id"] for r in got} == {f"r{i}" for i in range(10)} | {"p"}
    assert {r["description"][:7] for r in got} == {"[T1110]", "[T1003]"}
    off = Rule.from_dict({**DEFAULT_RULES[1], "enabled": False})
    assert rule_alerts(prepared(logs), [rules[3], off]).count() == 1
    with pytest.raises(ValueError):
        rule_alerts(prepared(logs), [Rule("x", "x", logic={"condition": "selection and magic"})])


@pytest.mark.parametrize("n", [9, 10])
def test_baseline_needs_ten_values(spark, n):
    values = spark.createDataFrame([("m", str(i), i) for i in range(n)], "metric string, key string, value bigint")
    rows = B.summarise(values, AS_OF).collect()
    assert len(rows) == (n == 10)
    if rows:
        assert (rows[0]["mean"], rows[0]["median"], rows[0]["q1"], rows[0]["q3"]) == (4.5, 4.5, 2.25, 6.75)


@pytest.mark.parametrize("n", [100, 101])
def test_request_limit_without_baseline(prepared, n):
    frame = prepared([log(str(i), 0, "x", {"source_ip": "1"}) for i in range(n)])
    assert anomaly.request_anomalies(frame, None).count() == (n > 100)


def test_profiles_gate_and_share(prepared):
    def history(user, hours, n):
        return [log(f"{user}{i}", (i % hours) * 3600 - 36000, "login", {"user": user, "source_ip": "1", "resource": "r"}) for i in range(n)]

    profiles = PR.build_profiles(prepared(history("nine", 9, 40) + history("ten", 10, 41)))
    new = [
        log("n1", 3600 * 10, "login", {"user": "ten", "source_ip": "1"}),
        log("n2", 0, "work", {"user": "ten", "source_ip": "2", "resource": "q"}),
        log("n3", 0, "login", {"user": "nine", "source_ip": "3"}),
        log("n4", 0, "login", {"user": "stranger", "source_ip": "3"}),
    ]
    got = {(r["alert_type"], r["log_id"]) for r in PR.behavioral_alerts(prepared(new), profiles).collect()}
    assert got == {("unusual_login_time", "n1"), ("unusual_source_ip", "n2"), ("unusual_resource_access", "n2")}


def test_deduplication(spark):
    from emberwatch.schema import ALERT_SCHEMA

    def alert(i, severity, host=None, method="rule_engine"):
        return (str(i), None, "t", method, severity, None, None, None, False, 0.0, "1", None, None, host)

    rows = [alert(1, "low"), alert(2, "critical"), alert(3, "critical", method="signature_detector"), alert(4, "low", "h")]
    frame = detect.deduplicate(detect.prioritise(spark.createDataFrame(rows, ALERT_SCHEMA)))
    assert sorted((r["id"], r["priority_score"]) for r in frame.collect()) == [("3", 100.0), ("4", 25.0)]


@pytest.mark.parametrize("cycle", [60, 600])
def test_rolling_rules_equal_plain_counts(spark, cycle):
    """Thresholds look back over cycles; most rows are of one source inside a few seconds."""
    draw = random.Random(cycle)
    rows = []
    for i in range(250):
        ip, at = ("hot", draw.choice([3, 4, 5, 900 + draw.randrange(900)])) if draw.random() < 0.7 else (draw.choice("abc"), draw.randrange(3000))
        late = draw.choice([0, 1, 20, 400])
        rows.append((f"{i:03d}", ip, at, at + late))
    data = [log(i, s, "login failed", {"source_ip": ip}, ingestion_time=T0 + timedelta(seconds=arrived)) for i, ip, s, arrived in rows]
    logs = spark.createDataFrame([tuple(d.get(n) for n in LOG_SCHEMA.fieldNames()) for d in data], LOG_SCHEMA)
    frame = X.in_cycles(X.prepare(logs), AS_OF, cycle)
    end = lambda arrived: (arrived // cycle + 1) * cycle
    for least, minutes in ((3, 5), (10, 10), (60, 1)):
        count = {"field": "source_ip", "threshold": least, "timeframe": f"{minutes}m"}
        rule = Rule("R", "r", logic={"selection": {"event_type": "login_failed"}, "condition": "selection and count", "count": count})
        want = []
        for i, ip, at, arrived in rows:
            c = end(arrived)
            seen = [1 for _, other, t, a in rows if other == ip and end(a) <= c and c - t <= 60 * minutes and end(a) - t <= 60 * minutes]
            if c - at <= 60 * minutes and len(seen) >= least:
                want.append(i)
        got = sorted(r.log_id for r in rule_alerts(frame, [rule], rolling=True).collect())
        assert got == sorted(want)
    assert rule_alerts(frame.limit(0), [rule], rolling=True).count() == 0


def test_patterns_are_judged_by_the_engine_that_runs_them(prepared, spark):
    """One that only Python reads is rejected alone; one that only Java reads is used."""
    good, bad = split_patterns([Signature("s", "n", "low", "c", "d", (r"(?P<u>root)", r"\p{Lu}{3}\d+x", "(broken", "plain"))])
    assert good[0].patterns == (r"\p{Lu}{3}\d+x", "plain") and [b[1] for b in bad] == [r"(?P<u>root)", "(broken"]
    frame = prepared([log("1", 0, "see ABC77x"), log("2", 0, "root"), log("3", 0, "a plain one")])
    assert sorted(r.log_id for r in signature_alerts(frame, good).collect()) == ["1", "3"]


def test_signatures_added_between_two_batches_count(spark, tmp_path):
    """The catalog is read anew in every micro-batch."""
    from emberwatch.sources import catalogs
    from emberwatch.streaming import cycles as C

    pytest.importorskip("yaml")
    folder = tmp_path / "catalog"
    folder.mkdir()
    one = "signatures:\n- {id: %s, name: %s, severity: low, category: %s, patterns: [{regex: 'evil%s'}]}\n"
    (folder / "a.yaml").write_text(one % ("S1", "one", "first", "1"))

    def detectors(_now):
        found = catalogs.read_signatures(spark, str(folder)).signatures
        return {"signatures": lambda d: signature_alerts(d, found)}

    for run in range(2):
        data = [log(f"{run}{i}", 60 * run, f"evil{i}") for i in (1, 2)]
        rows = spark.createDataFrame([tuple(d.get(n) for n in LOG_SCHEMA.fieldNames()) for d in data], LOG_SCHEMA)
        rows.coalesce(1).write.parquet(f"{tmp_path}/in/part={run}")
        stream = C.read_stream(spark, f"{tmp_path}/in/*", LOG_SCHEMA)
        assert C.run_for(C.run_cycles(stream, detectors, f"{tmp_path}/alerts", f"{tmp_path}/check", cycle_seconds=1), 120)
        (folder / "b.yaml").write_text(one % ("S2", "two", "second", "2"))
    from emberwatch.sources import tables as T

    assert sorted((r.log_id, r.alert_type) for r in T.read_cycle_alerts(spark, f"{tmp_path}/alerts").collect()) == [("01", "first"), ("11", "first"), ("12", "second")]
