"""Historical statistics per metric, and the per-cycle values they are compared with."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.functions import fields as X
from emberwatch.functions.scores import beyond, outside_iqr, z_score
from emberwatch.operators.alerts import unpack

HOURLY_METRICS = ("login_frequency", "failed_login_rate", "error_rate", "command_execution_rate")
DISTINCT_METRICS = ("unique_hosts", "unique_destinations")
METRICS = (*HOURLY_METRICS, "requests_per_ip", *DISTINCT_METRICS)


def _metric_rows(bucket: Column) -> list[tuple[str, Column, Column, Column | None]]:
    """(metric, applies, key, distinct value) of every counted metric."""
    key = bucket.cast("string")
    return [
        ("login_frequency", F.col("is_login"), key, None),
        ("failed_login_rate", F.col("is_failed_login"), key, None),
        ("error_rate", F.col("is_error"), key, None),
        ("command_execution_rate", F.col("is_command"), key, None),
        ("requests_per_ip", F.lit(True), X.non_empty(F.col("source_ip")), None),
        ("unique_hosts", F.lit(True), key, X.non_empty(F.col("host"))),
        ("unique_destinations", F.lit(True), X.non_empty(F.col("source_ip")), F.col("dest_ip")),
    ]


def metric_values(logs: DataFrame, bucket: Column | None = None, metrics: list[str] | None = None) -> DataFrame:
    """(metric, key, value): hourly counts, requests per source, distinct hosts and destinations.

    One scan for all metrics: each row emits a small struct per metric that applies, partial
    aggregation collapses them before the shuffle, and distinct counting is a second aggregation
    by (metric, key), so no task holds a key's value set.
    """
    bucket = F.date_trunc("hour", "ts") if bucket is None else bucket
    wanted = [m for m in _metric_rows(bucket) if metrics is None or m[0] in metrics]
    structs = [
        F.when(
            applies & key.isNotNull() & (F.lit(True) if value is None else value.isNotNull()),
            F.struct(
                F.lit(name).alias("metric"),
                key.alias("key"),
                (F.lit(None).cast("string") if value is None else value).alias("item"),
            ),
        )
        for name, applies, key, value in wanted
    ]
    long = unpack(logs, [], structs)
    per_item = long.groupBy("metric", "key", "item").agg(F.count(F.lit(1)).alias("n"))
    # No text in the aggregation buffers, so both steps stay hash aggregations.
    counted = per_item.groupBy("metric", "key").agg(F.count("item").alias("items"), F.sum("n").alias("n"))
    value = F.when(F.col("metric").isin(*DISTINCT_METRICS), F.col("items")).otherwise(F.col("n"))
    return counted.select("metric", "key", value.alias("value"))


def summarise(values: DataFrame, as_of: datetime | str, min_values: int = 10) -> DataFrame:
    """Baseline row per metric; metrics with too few values are left out.

    Values are counts, so the exact percentile's buffer holds few distinct numbers per metric.
    """
    quartiles = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    stats = values.groupBy("metric").agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        quartiles.alias("q"),
        F.min("value").cast("double").alias("min"),
        F.max("value").cast("double").alias("max"),
        F.count("value").alias("count"),
    )
    return stats.filter(F.col("count") >= min_values).select(
        "metric",
        "mean",
        "std",
        F.col("q")[1].alias("median"),
        F.col("q")[0].alias("q1"),
        F.col("q")[2].alias("q3"),
        (F.col("q")[2] - F.col("q")[0]).alias("iqr"),
        "min",
        "max",
        "count",
        F.lit(as_of).cast("timestamp").alias("updated_at"),
    )


def baselines(logs: DataFrame, as_of: datetime | str, days: int = 7, min_values: int = 10) -> DataFrame:
    """All baselines from the last ``days`` days before ``as_of`` of a prepared log frame."""
    now = F.lit(as_of).cast("timestamp")
    recent = logs.filter(F.col("ingestion_time").between(now - F.expr(f"INTERVAL {days} DAYS"), now))
    return summarise(metric_values(recent), as_of, min_values)


def initial_baselines(logs: DataFrame, as_of: datetime | str, days: int = 7) -> DataFrame:
    """First baselines of a new installation: those of the last ``days`` days, however few logs there are."""
    return baselines(logs, as_of, days=days)


def with_baseline(
    values: DataFrame, base: DataFrame, how: str = "left", metrics: tuple[str, ...] = METRICS
) -> DataFrame:
    """Values joined with their metric's baseline.

    The broadcast side has at most one row per listed metric name. It must not be a shuffle join:
    every value of a metric has the same key.
    """
    side = base.filter(F.col("metric").isin(*metrics)).dropDuplicates(["metric"])
    return values.join(F.broadcast(side.select("metric", "mean", "std", "q1", "q3", "iqr")), "metric", how)


def z_scored(values: DataFrame, base: DataFrame) -> DataFrame:
    return with_baseline(values, base, "inner").withColumn("z", z_score(F.col("value"), F.col("mean"), F.col("std")))


def iqr_outliers(
    values: DataFrame, base: DataFrame, k: float = 1.5, metrics: tuple[str, ...] = METRICS
) -> DataFrame:
    c = F.col
    return (
        with_baseline(values, base, "inner", metrics)
        .filter(outside_iqr(c("value"), c("q1"), c("q3"), c("iqr"), k))
        .withColumns({"lower_bound": c("q1") - k * c("iqr"), "upper_bound": c("q3") + k * c("iqr")})
    )


def moving_average_outliers(values: DataFrame, width: int = 24, threshold: float = 2.5) -> DataFrame:
    """Values far from the mean of the ``width`` values before them, per metric in key order.

    ``values`` are already one row per metric and hour, so a metric's window is short.
    """
    trailing = Window.partitionBy("metric").orderBy("key").rowsBetween(-width, -1)
    scored = values.withColumns(
        {"mean": F.avg("value").over(trailing), "std": F.stddev_pop("value").over(trailing)}
    ).withColumn("z", z_score(F.col("value"), F.col("mean"), F.col("std")))
    return scored.filter(beyond(F.col("z"), threshold))
