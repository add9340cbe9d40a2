import csv
import glob
import json
from datetime import timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import AS_OF, T0, log
from emberwatch.functions import fields as X
from emberwatch.operators.signatures import blocked_ip_alerts
from emberwatch.plans import detect, heuristic, reports
from emberwatch.schema import ALERT_SCHEMA, LOG_SCHEMA, THREAT_INTEL_SCHEMA
from emberwatch.sources import catalogs
from emberwatch.sources import tables as T
from emberwatch.streaming import cycles as C


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.get(n) for n in LOG_SCHEMA.fieldNames()) for r in rows], LOG_SCHEMA)


def test_log_round_trip_search_and_pages(spark, tmp_path):
    rows = [log(str(i), i, None if i == 3 else f"Line {i}", host="h", raw="Needle" if i == 3 else None) for i in range(9)]
    T.append_logs(frame(spark, rows), f"{tmp_path}/logs")
    logs = T.read_logs(spark, f"{tmp_path}/logs")
    assert logs.count() == 9
    assert [r["id"] for r in T.scan_logs(logs, search="NEEDLE").collect()] == ["3"]
    assert [r["id"] for r in T.newest(logs, 3, 2).collect()] == ["6", "5", "4"]
    assert T.scan_logs(logs, filters={"host": "h"}).count() == 9
    with pytest.raises(ValueError):
        T.scan_logs(logs, filters={"user": "x"})
    assert [r["id"] for r in T.logs_by_ids(logs, ["4"]).collect()] == ["4"]


def test_filters_reach_the_scan(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    T.append_logs(frame(spark, [log("1", 0, "x", host="h")]), f"{tmp_path}/logs")
    found = T.scan_logs(T.read_logs(spark, f"{tmp_path}/logs"), "2024-01-01 00:00:00", filters={"host": "h"}).select("id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(host,h)" in plan and "GreaterThanOrEqual(ingestion_time" in plan
    assert "message" not in plan.split("ReadSchema")[1]


def test_open_schema_and_flatten(spark):
    lines = spark.createDataFrame([(json.dumps({"id": "1", "message": "m", "normalized": {"a": 1}, "extra": {"b": 2}}),), ("junk",)], "value string")
    row = T.route_open_schema(lines).first()
    assert (row["id"], row["message"], json.loads(row["normalized"]), json.loads(row["metadata"])) == ("1", "m", {"a": 1}, {"extra": '{"b":2}'})
    record = T.flatten_log(frame(spark, [log("1", 0, "m", metadata='{"host":"other","x":"y"}', host="h")])).first()["record"]
    assert record["host"] == "other" and record["x"] == "y" and record["message"] == "m"


def test_csv_export(spark, tmp_path):
    logs = X.prepare(frame(spark, [log("1", 0, 'say "hi", all', {"source_ip": "1", "user": "u"}), log("2", 0, "", raw="raw")]))
    T.export_csv(logs, f"{tmp_path}/csv")
    rows = [r for f in glob.glob(f"{tmp_path}/csv/*.csv") for r in csv.reader(open(f)) if r[0] != "Timestamp"]
    assert sorted(r[3] for r in rows) == ["raw", 'say "hi", all']


def test_upsert_ignores_known_indicators(spark, tmp_path):
    def intel(*values):
        return spark.createDataFrame([(str(i), "ip", v, None, 0.9, "f", None, T0, None) for i, v in enumerate(values)], THREAT_INTEL_SCHEMA)

    intel("A").write.parquet(f"{tmp_path}/ti")
    T.upsert_threat_intel(intel("a ", "b", "B"), f"{tmp_path}/ti")
    assert spark.read.parquet(f"{tmp_path}/ti").count() == 2


def test_catalog_files(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("signatures:\n- {id: S1, name: n, severity: low, category: c, patterns: [{regex: 'x+'}, {regex: '('}], hashes: [{value: AB, type: md5}]}\n")
    (tmp_path / "bad.yaml").write_text("signatures: [\n")
    (tmp_path / "r.yaml").write_text("rules:\n- {id: R1, name: one, enabled: false}\n")
    (tmp_path / "one.yaml").write_text("id: R2\nname: two\n")
    (tmp_path / "ips.txt").write_text("# comment\n\n 1.1.1.1 \n1.1.1.1\n2.2.2.2\n")
    found = catalogs.read_signatures(spark, str(tmp_path))
    assert [(s.id, s.patterns, s.file) for s in found.signatures] == [("S1", ("x+",), "a.yaml")]
    assert len(found.rejected) == 1 and list(found.unreadable) == ["bad.yaml"]
    assert sorted((r.id, r.enabled, r.file) for r in catalogs.read_rules(spark, str(tmp_path))) == [("R1", False, "r.yaml"), ("R2", True, "one.yaml")]
    assert sorted(r["ip"] for r in catalogs.read_blocked_ips(spark, f"{tmp_path}/ips.txt").collect()) == ["1.1.1.1", "2.2.2.2"]


def test_empty_hours_in_trend(spark):
    row = ("1", None, "t", "anomaly_detection", "low", None, None, T0, False, 0.0, None, None, None, None)
    trend = reports.hourly_trend(spark.createDataFrame([row], ALERT_SCHEMA), "2024-03-04 12:30:00", 24).collect()
    assert len(trend) == 25 and sum(r["n"] for r in trend) == 1
    assert [str(r["time"]) for r in trend if r["n"]] == ["2024-03-04 10:00:00"]


def test_stream_isolates_failures_and_retries_replace(spark, tmp_path):
    T.append_logs(frame(spark, [log(str(i), 0, "x", {"source_ip": str(i)}) for i in range(3)]), f"{tmp_path}/in")
    blocked, seen = spark.createDataFrame([("1",)], "ip string"), []

    def found(_now):
        return {"good": lambda d: blocked_ip_alerts(d, blocked), "bad": lambda d: heuristic.off_hours_activity(d).withColumn("x", F.raise_error(F.lit("no"))).filter("x is null or true").drop("x"),
                "broken": lambda d: d.select("no_such_column")}

    schema = LOG_SCHEMA
    for run in range(2):  # the second run repeats the first batch
        query = C.run_cycles(
            C.read_stream(spark, f"{tmp_path}/in", schema), found, f"{tmp_path}/alerts", f"{tmp_path}/check{run}",
            metrics_path=f"{tmp_path}/metrics", isolate=True, callbacks=(lambda df, i: seen.append((i, df.count())),),
        )
        assert C.run_for(query, 120)
    alerts = T.read_cycle_alerts(spark, f"{tmp_path}/alerts")
    assert [r["source_ip"] for r in alerts.collect()] == ["1"] and seen == [(0, 3), (0, 3)]
    metrics = spark.read.parquet(f"{tmp_path}/metrics").collect()
    assert len(metrics) == 2  # each stream has folders of its own
    assert all((m["logs"], m["alerts"]) == (3, 1) and "broken" in json.loads(m["errors"]) for m in metrics)


def burst(i, seconds):
    return log(str(i), seconds, "Failed password for root", {"source_ip": "9.9.9.9", "user": "root"})


def test_stream_cycles_may_be_split_and_quiet(spark, tmp_path):
    """Six failures of one minute in three files: one alert, as in one batch; a quiet batch writes metrics too."""
    from emberwatch.operators.bursts import burst_alerts
    from emberwatch.plans import anomaly

    specs = [b for b in anomaly.bursts() if "brute" in b.alert_type]
    for n, rows in enumerate(([0, 1], [2, 3], [4, 5])):
        frame(spark, [burst(i, i) for i in rows]).coalesce(1).write.parquet(f"{tmp_path}/in/part={n}")
    frame(spark, [log("q", 7200, "all is well")]).coalesce(1).write.parquet(f"{tmp_path}/in/part=3")
    query = C.run_cycles(
        C.read_stream(spark, f"{tmp_path}/in/*", LOG_SCHEMA, max_files=1), lambda _: {"b": lambda d: burst_alerts(d, specs)},
        f"{tmp_path}/alerts", f"{tmp_path}/check", metrics_path=f"{tmp_path}/metrics", cycle_seconds=60,
    )
    assert C.run_for(query, 180)
    assert T.read_cycle_alerts(spark, f"{tmp_path}/alerts").count() == 1
    metrics = sorted(spark.read.parquet(f"{tmp_path}/metrics").collect(), key=lambda r: r["cycle"])
    assert [m["logs"] for m in metrics] == [2, 2, 2, 1] and metrics[-1]["alerts"] == 0


@pytest.mark.parametrize("files", [1, 3])
def test_rolling_rules_in_a_stream_equal_one_batch(spark, tmp_path, files):
    """Cycles of a minute under a timeframe of five; the last file brings late rows that later cycles look back on."""
    from emberwatch.operators.rules import Rule, look_back, rule_alerts

    rule = Rule("R", "many failures", logic={"selection": {"event_type": "login_failed"}, "condition": "selection and count", "count": {"field": "source_ip", "threshold": 4, "timeframe": "5m"}})
    at = lambda i, ip, s: log(i, s, "login failed", {"source_ip": ip}, ingestion_time=T0 + timedelta(seconds=s + 1))
    rows = [at(i, "a", s) for i, s in enumerate((0, 70, 130, 250, 290, 700, 760, 1500))] + [at(f"b{i}", "b", 61 * i) for i in range(9)]
    late = [at("late", "a", 705), at("later", "a", 640)]
    parts = [rows + late] if files == 1 else [rows[:6] + rows[8:12], rows[6:8] + rows[12:], late]
    for n, part in enumerate(parts):
        frame(spark, part).coalesce(1).write.parquet(f"{tmp_path}/in/part={n}")
    query = C.run_cycles(
        C.read_stream(spark, f"{tmp_path}/in/*", LOG_SCHEMA, max_files=1), lambda _: {}, f"{tmp_path}/alerts", f"{tmp_path}/check",
        rolling=lambda _: {"rules": lambda d: rule_alerts(d, [rule], rolling=True)}, look_back_seconds=look_back([rule]),
    )
    assert C.run_for(query, 240)
    whole = X.in_cycles(X.prepare(frame(spark, rows + late)), AS_OF, 60)
    batch = detect.deduplicate(rule_alerts(whole, [rule], rolling=True))
    want = sorted(r.id for r in batch.collect())
    assert sorted(r.id for r in T.read_cycle_alerts(spark, f"{tmp_path}/alerts").collect()) == want and len(want) >= 8
    assert detect.deduplicate(rule_alerts(whole, [rule])).count() < len(want)


def test_the_stream_store_is_laid_out_by_cycle(spark, tmp_path):
    for n in range(3):
        frame(spark, [log(f"{n}-{i}", 0, "x", ingestion_time=T0 + timedelta(seconds=60 * i)) for i in range(n, n + 2)]).coalesce(1).write.parquet(f"{tmp_path}/in/part={n}")
    query = C.run_cycles(
        C.read_stream(spark, f"{tmp_path}/in/*", LOG_SCHEMA, max_files=1), lambda _: {}, f"{tmp_path}/alerts", f"{tmp_path}/check"
    )
    assert C.run_for(query, 120)
    (store,) = (tmp_path / "alerts-logs").iterdir()
    cycles = sorted(store.glob("cycle_end=*"))
    assert [sorted(b.name for b in c.glob("batch=*")) for c in cycles] == [["batch=0"], ["batch=0", "batch=1"], ["batch=1", "batch=2"], ["batch=2"]]
    assert sorted(T.partition_values(spark, str(store), "cycle_end")) == [c.name.partition("=")[2] for c in cycles]
    assert T.partition_values(spark, str(tmp_path / "none"), "cycle_end") == []


def test_a_micro_batch_of_one_row_group_is_parsed_by_several_tasks(spark, tmp_path, monkeypatch):
    """Tasks get neighbours in ingestion time, so a cycle has few files; detectors read the stored columns, not a copy in memory."""
    monkeypatch.setattr(C, "SPREAD_ROWS", 50, raising=False)
    rows = [log(str(i), 0, "x", ingestion_time=T0 + timedelta(seconds=(i * 7) % 400)) for i in range(400)]
    frame(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in")
    kept = spark.sparkContext._jsc.getPersistentRDDs
    before, seen = set(kept()), []

    def look(mine, _):
        seen.append((len(mine.inputFiles()), mine.count(), set(kept()) - before))

    found = lambda _: {"all": lambda d: blocked_ip_alerts(d, d.select(F.col("source_ip").alias("ip")))}
    query = C.run_cycles(C.read_stream(spark, f"{tmp_path}/in", LOG_SCHEMA), found, f"{tmp_path}/alerts", f"{tmp_path}/check", cycle_seconds=200, callbacks=(look,))
    assert C.run_for(query, 120)
    assert len(seen) == 1 and 8 <= seen[0][0] <= 8 + 3 and seen[0][1:] == (400, set())


def test_the_stream_of_parts_has_files_by_rows_and_two_micro_batches(spark, tmp_path, monkeypatch):
    from emberwatch.checks import registry

    monkeypatch.setattr(T, "SPREAD_ROWS", 50)
    events = spark.range(600).selectExpr(
        "id AS event_id", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(id AS int)) AS ts", "id % 9 AS user_id", "'view' AS event_type", "1.0 AS value", "'k=5' AS props"
    )
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    stream, seen = registry._in_parts(spark, str(tmp_path), f"{tmp_path}/out"), []
    query = stream.writeStream.foreachBatch(lambda df, _: seen.append(df.count())).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    assert C.run_for(query, 120)
    assert seen == [19 * 24 + 13, 600 - 19 * 24 - 13]
    assert [len(glob.glob(f"{tmp_path}/out/in/part={n}/*.parquet")) for n in range(3)] == [5, 5, 3]


def test_alert_ids_tell_texts_apart(spark):
    from emberwatch.operators.alerts import to_alerts

    rows = [("a|b", "c"), ("a", "b|c"), ("a", None), ("", "a"), ("a|", "b"), ("1|a", "b"), ("é", "c")]
    hits = spark.createDataFrame([(*r, T0) for r in rows], "s string, d string, cycle timestamp")
    alerts = to_alerts(hits, method="m", alert_type=F.lit("t"), severity=F.lit("low"), description=F.lit(""), metadata=F.lit("{}"), source_ip=F.col("s"), dest_ip=F.col("d"))
    assert alerts.select("id").distinct().count() == len(rows)


def test_every_alert_has_its_place(spark):
    row = lambda i: (f"{i:03d}", None, "t", "m", "low", None, None, T0 + timedelta(seconds=i % 7), False, float(i % 3), None, None, None, None)
    alerts = spark.createDataFrame([row(i) for i in range(200)], ALERT_SCHEMA)
    got = detect.with_place(alerts).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 201)) and [r.id for r in got] == [r.id for r in detect.by_priority(alerts).collect()]


def test_indicators_are_judged_at_the_time_of_a_log(spark, tmp_path):
    """One expires between two batches and is listed again later with other confidence; a late log still counts."""
    from emberwatch.operators.intel import threat_intel_as_of, validity

    at = lambda s: T0 + timedelta(seconds=s)
    listed = lambda i, since, until, c, threat="bot": (i, "ip", " 9.9.9.9 ", threat, c, "feed", since and at(since), until and at(until))
    columns = "id string, indicator_type string, indicator_value string, threat_type string, confidence double, source string, created_at timestamp, expires_at timestamp"
    rows = [listed("a", None, 100, 0.9), listed("b", 50, 150, 0.5), listed("c", 300, None, 0.7), listed("d", 320, 340, 0.8), listed("e", 10, 10, 1.0), listed("f", 60, 20, 1.0)]
    feed = spark.createDataFrame(rows, columns)
    spans = {(r.since, r.until): r.intel_id for r in validity(feed).collect()}
    assert sorted(spans.values()) == ["a", "a", "b", "c", "c", "d"] and spans[at(100), at(150)] == "b" and spans[at(320), at(340)] == "d"
    logs = [log(str(s), s, "x", {"source_ip": "9.9.9.9"}, ingestion_time=at(s + 5)) for s in (0, 99, 100, 149, 150, 299, 300, 330, 340, 900)]
    for n, part in enumerate((logs[:2], logs[3:7], logs[7:] + logs[2:3])):
        frame(spark, part).coalesce(1).write.parquet(f"{tmp_path}/in/part={n}")
    query = C.run_cycles(
        C.read_stream(spark, f"{tmp_path}/in/*", LOG_SCHEMA, max_files=1), lambda _: {"intel": lambda d: threat_intel_as_of(d, feed)}, f"{tmp_path}/alerts", f"{tmp_path}/check", cycle_seconds=1
    )
    assert C.run_for(query, 240)
    got = {r.log_id: r.severity for r in T.read_cycle_alerts(spark, f"{tmp_path}/alerts").collect()}
    assert got == {"0": "critical", "99": "critical", "100": "medium", "149": "medium", "300": "high", "330": "critical", "340": "high", "900": "high"}
    whole = X.in_cycles(X.prepare(frame(spark, logs)), AS_OF)
    assert threat_intel_as_of(whole, feed).count() == len(got)


def test_append_is_idempotent(spark, tmp_path):
    row = lambda i: (str(i), None, "t", "anomaly_detection", "low", None, None, T0, False, 0.0, None, None, None, None)
    some = lambda *ids: spark.createDataFrame([row(i) for i in ids], ALERT_SCHEMA)
    assert T.append_alerts(some(1, 2), f"{tmp_path}/a") == 2
    assert T.append_alerts(some(1, 2), f"{tmp_path}/a") == 0
    assert T.append_alerts(some(2, 3, 3), f"{tmp_path}/a") == 1
    assert sorted(r["id"] for r in T.read_alerts(spark, f"{tmp_path}/a").collect()) == ["1", "2", "3"]


@pytest.mark.parametrize("files", [1, 4])
def test_stream_deduplication_by_gaps(spark, tmp_path, files):
    """Alerts of a key at most 100 s after the last one that was let through are repeats, however they arrive."""
    times = [0, 50, 100, 101, 150, 201, 202, 500]
    row = lambda t, p, i: (i, None, "t", "m", "low", None, None, T0 + timedelta(seconds=t), False, p, None, None, None, None)
    rows = [row(t, 1.0, f"a{t}") for t in times] + [row(0, 2.0, "best")]
    rows.sort(key=lambda r: r[7])
    for n in range(files):
        part = rows[n * len(rows) // files : (n + 1) * len(rows) // files] if files > 1 else rows
        spark.createDataFrame(part, ALERT_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part={n}")
    arriving = C.read_stream(spark, f"{tmp_path}/in/*", ALERT_SCHEMA, max_files=1)
    C.write_files(C.first_of_each(arriving, "100 seconds"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a101", "a202", "a500", "best"]


def test_late_repeats_are_judged_by_all_that_passed(spark, tmp_path):
    row = lambda t: (f"a{t}", None, "t", "m", "low", None, None, T0 + timedelta(seconds=t), False, 1.0, None, None, None, None)
    for n, times in enumerate(([1000], [0, 1, 2, 950, 1050], [300, 301, 1101, 2000], [1, 250, 650])):
        spark.createDataFrame([row(t) for t in times], ALERT_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part={n}")
    arriving = C.read_stream(spark, f"{tmp_path}/in/*", ALERT_SCHEMA, max_files=1)
    C.write_files(C.first_of_each(arriving, "100 seconds"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = sorted(int(r["id"][1:]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [0, 300, 650, 1000, 1101, 2000]


def test_stream_deduplication_of_many_keys_keeps_no_operator_state(spark, tmp_path):
    """Against plain code; what passed is read back from the files, so no state store and no frame a key."""
    row = lambda k, t: (f"{k}-{t}", None, "t", "m", "low", None, None, T0 + timedelta(seconds=t), False, 1.0, None, None, f"u{k}", None)
    parts = [[(k, t) for k in range(60) for t in range(k % 7, 400, 30 + k)], [(k, t) for k in range(60) for t in range(150 - k, 900, 41)]]
    wanted = []
    for k in range(60):
        passed = []
        for part in parts:
            for t in sorted(t for j, t in part if j == k):
                if all(abs(t - p) > 100 for p in passed):
                    passed.append(t)
        wanted += [f"{k}-{t}" for t in passed]
    for n, part in enumerate(parts):
        spark.createDataFrame([row(*p) for p in part], ALERT_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part={n}")
    arriving = C.read_stream(spark, f"{tmp_path}/in/*", ALERT_SCHEMA, max_files=1)
    query = C.write_files(C.first_of_each(arriving, "100 seconds"), f"{tmp_path}/out", f"{tmp_path}/check")
    query.awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(wanted)
    assert all(not p["stateOperators"] for p in query.recentProgress)


def test_a_file_of_one_row_group_is_spread(spark, tmp_path, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    spark.range(20_000).selectExpr("id", "uuid() AS text").coalesce(1).write.parquet(f"{tmp_path}/one")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        table = spark.read.parquet(f"{tmp_path}/one")
        assert table.rdd.getNumPartitions() >= cores
        sizes = [r["count"] for r in T.spread(table).groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 20_000 and max(sizes) <= 20_000 // cores + cores
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    monkeypatch.setattr(T, "ROW_GROUP", 64 << 10)
    T.materialise(table.coalesce(1), "groups", f"{tmp_path}/groups")
    (file,) = glob.glob(f"{tmp_path}/groups/*.parquet")
    assert pq.ParquetFile(file).num_row_groups > 1


def test_a_larger_table_is_spread_over_more_tasks(spark, tmp_path, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(T, "SPREAD_ROWS", 500, raising=False)
    for files in (1, cores):
        spark.range(1000 * cores).coalesce(files).write.parquet(f"{tmp_path}/{files}")
        table = spark.read.parquet(f"{tmp_path}/{files}")
        sizes = [r["count"] for r in T.spread(table).groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 1000 * cores and len(sizes) == 2 * cores and max(sizes) <= 500 + 2 * cores
    spark.range(0).write.parquet(f"{tmp_path}/none")
    assert T.spread(spark.read.parquet(f"{tmp_path}/none")).count() == 0


def test_shared_folder_is_the_sessions(spark):
    assert T.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert AS_OF
