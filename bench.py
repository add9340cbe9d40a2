"""Time the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

``prepare_logs`` and ``prepare_texts`` are the one-time parses of the log table and of the texts, which the other
queries then read. ``cycle`` is every detector over all logs, scored and de-duplicated; the planned bar for it,
parse of the logs included, is 100,000 logs in 60 s.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "field_extraction ioc_extract baselines rate_anomalies request_rate_anomaly iqr_outliers all_bursts "
    "brute_force_success privilege_escalation beaconing off_hours_activity signature_event_alerts "
    "signature_text_alerts threat_intel_alerts hash_alerts user_profiles unusual_source_ip rule_brute_force "
    "dashboard_stats alerts_with_log anomaly_trend stream_cycle_alerts"
).split()


def main() -> None:
    from pyspark.sql import SparkSession

    from emberwatch.checks import registry, views

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)

    def drain(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    timed("prepare_logs", lambda: views.logs(spark, sf_dir))
    timed("prepare_texts", lambda: views.texts(spark, sf_dir))
    timed("cycle", lambda: registry.alerts(spark, sf_dir))
    for name in HEADLINE:
        timed(name, lambda: drain(registry.QUERIES[name](spark, sf_dir)))
    logs = views.logs(spark, sf_dir).count()
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
                "logs": logs,
                "cycle_logs_per_sec": round(logs / seconds["cycle"], 1),
                "parse_and_cycle": round(seconds["prepare_logs"] + seconds["cycle"], 3),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
