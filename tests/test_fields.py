import pytest
from pyspark.sql import functions as F

from conftest import log
from emberwatch.functions import fields as X
from emberwatch.functions import scores as S


def first(df, *columns):
    rows = {r["id"]: tuple(r[c] for c in columns) for r in df.select("id", *columns).collect()}
    return rows if len(columns) > 1 else {k: v[0] for k, v in rows.items()}


def test_source_ip_and_user(prepared):
    rows = [
        log("key", 0, "from 1.1.1.1 for bob", {"source_ip": "9.9.9.9", "user": "amy"}),
        log("null", 0, "from 1.1.1.1 for bob", {"source_ip": None, "src_ip": "8.8.8.8", "user": None}),
        log("src", 0, "from 1.1.1.1", {"src_ip": "8.8.8.8"}),
        log("text", 0, "a 1.2.3.4 then 5.6.7.8 user éva logged in"),
        log("none", 0, "nothing here"),
        log("order", 0, "for zoe, User kim, user joe"),
        log("nomsg", 0, None),
    ]
    assert first(prepared(rows), "source_ip", "user") == {
        "key": ("9.9.9.9", "amy"),
        "null": (None, None),
        "src": ("8.8.8.8", None),
        "text": ("1.2.3.4", "éva"),
        "none": (None, None),
        "order": (None, "joe"),
        "nomsg": (None, None),
    }


def test_ports_and_bytes(prepared):
    rows = [
        log("key", 0, "port 9", {"dest_port": 443, "bytes": 7}),
        log("null", 0, "port 9, 10 KB", {"dest_port": None, "port": 5, "bytes": None}),
        log("second", 0, "PORT: 77", {"port": 22}),
        log("text", 0, "Port: 8080 sent 5 GB"),
        log("zero", 0, "x", {"dest_port": 0}),
        log("junk", 0, "support 12 bytes", {"dest_port": "abc"}),
    ]
    assert first(prepared(rows), "dest_port", "transfer_bytes") == {
        "key": (443, 7),
        "null": (None, None),
        "second": (22, None),
        "text": (8080, 5 * 1024**3),
        "zero": (None, None),
        "junk": (None, 12),
    }
    assert first(prepared(rows, honour_units=False), "transfer_bytes")["text"] == 5


def test_event_time_falls_back(prepared):
    rows = [
        log("good", 5),
        log("bad", 5, timestamp="yesterday", normalized={"timestamp": "2024-03-04T09:00:00+01:00"}),
        log("none", None),
    ]
    got = first(prepared(rows), "ts")
    assert str(got["good"]) == "2024-03-04 10:00:05"
    assert str(got["bad"]) == "2024-03-04 08:00:00"
    assert got["none"] is None


def test_event_type_and_error_category(spark):
    texts = ["failed login", "login ok", "error 503", "access denied", "other", "exception: denied", "got 500"]
    df = spark.createDataFrame([(t,) for t in texts], "m string")
    got = df.select(X.event_type(F.col("m")), X.error_category(F.col("m"))).collect()
    assert [r[0] for r in got] == ["login_failed", "login_success", "error", "access", "unknown", "unknown", "unknown"]
    assert [r[1] for r in got] == ["other", "other", "server_error", "access_denied", "other", "access_denied", "server_error"]


def test_indicators(prepared):
    md5 = "d41d8cd98f00b204e9800998ecf8427e"
    rows = [
        log("a", 0, f"GET http://Evil.example.org/x from 1.2.3.4 hash {md5.upper()} mail Joe@Mail.Example.com, example.com"),
        log("b", 0, "", {"domain": " Bad.ORG ", "file_hash": "short"}, raw="see test.com and 7.7.7.7"),
    ]
    df = prepared(rows).select(
        "id", F.inline(X.indicators(F.col("fields"), F.coalesce(F.nullif("message", F.lit("")), "raw"), F.col("source_ip")))
    )
    got = {(r["id"], r["type"], r["value"]) for r in df.collect()}
    assert ("a", "ip", "1.2.3.4") in got and ("a", "hash", md5) in got
    assert ("a", "url", "http://evil.example.org/x") in got and ("a", "email", "joe@mail.example.com") in got
    assert ("a", "domain", "evil.example.org") in got and ("a", "domain", "example.com") not in got
    assert {g for g in got if g[0] == "b"} == {("b", "domain", "bad.org")}


@pytest.mark.parametrize("confidence,severity", [(0.8, "critical"), (0.6, "high"), (0.4, "medium"), (0.39, "low"), (None, "medium"), (0.0, "medium")])
def test_confidence_severity(spark, confidence, severity):
    df = spark.createDataFrame([(confidence,)], "c double")
    assert df.select(S.confidence_severity(F.col("c"))).first()[0] == severity


def test_scores(spark):
    df = spark.createDataFrame([(16.0, 10.0, 2.0), (16.1, 10.0, 2.0), (3.0, 10.0, 2.0), (5.0, 5.0, 0.0)], "v double, m double, s double")
    z = S.z_score(F.col("v"), F.col("m"), F.col("s"))
    assert [r[0] for r in df.select(S.beyond(z, 3.0)).collect()] == [False, True, True, None]
    assert df.limit(1).select(S.priority(F.lit("odd")), S.normal_severity(F.lit("HIGH")), S.normal_severity(F.lit("x"))).first()[:] == (50.0, "high", "medium")
