"""Bursts in event time: windows that slide with the events, and tumbling ones, both independent of analysis cycles.

A cycle sees its rows as one span, so a stray row an hour earlier makes a burst look slow, and a burst over the border of
two cycles is seen by neither. Here the measure of a spec is taken over the ``window_seconds`` up to each event.

A row adds to the measure when it comes and takes from it when it leaves the window. For distinct values a row leaves,
too, when its value comes again, as then the later row stands for the value. So rows, amounts and distinct values are
all running sums of gains and losses in the order of time, and those need no window over a whole key (``ordered``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.operators.alerts import union_alerts
from emberwatch.operators.bursts import Burst, alerts_of, burst_alerts, tallies
from emberwatch.operators.ordered import following, running
from emberwatch.sources.tables import materialise

KEY = ["kind", "k1", "k2"]
LIST_LIMIT = 20


def _per_kind(bursts: list[Burst], value) -> Column:
    """A number of each spec, by the column ``kind``."""
    return F.coalesce(*[F.when(F.col("kind") == b.alert_type, F.lit(value(b))) for b in bursts])


def episodes(logs: DataFrame, bursts: list[Burst], parts: int | None = None) -> DataFrame:
    """For every key of every spec with a window, the stretches of events at which the threshold is reached.

    Returns kind, k1, k2, started and ended (the first and last such event), peak (the largest measure), points (times at
    which events came), log_id and host (of the first event). Stretches of a key are apart by an event whose window does
    not reach the threshold. A window holds the events of the last ``window_seconds``, both ends included; unknown event
    times count as the end of their cycle. Rows without key take no part, and rows without value have no distinct value.
    """
    bursts = [b for b in bursts if b.window_seconds is not None]
    rows = tallies(logs, bursts).withColumn("at", F.unix_micros("ets"))
    log = F.min(F.struct("id", "host")).alias("log")
    distinct = [b.alert_type for b in bursts if b.measure == "distinct"]
    span = _per_kind(bursts, lambda b: 1_000_000 * b.window_seconds)

    counted = rows.where(~F.col("kind").isin(*distinct)) if distinct else rows
    amount = _per_kind(bursts, lambda b: b.measure == "amount")
    counted = counted.groupBy(*KEY, "at").agg(F.sum(F.when(amount, F.col("amount")).otherwise(1)).alias("gain"), log)
    counted = counted.select(*KEY, "at", "gain", "log", F.lit(None).cast("long").alias("next"))
    if distinct:
        seen = rows.where(F.col("kind").isin(*distinct) & F.col("value").isNotNull()).groupBy(*KEY, "value", "at").agg(log)
        seen = following(seen, [*KEY, "value"], "at", parts)
        counted = counted.unionByName(seen.select(*KEY, "at", F.lit(1).cast("long").alias("gain"), "log", "next"))
    counted = materialise(counted.withColumn("span", span), "bursts")

    # Order of one moment: what comes and what is replaced, then the measure, then what leaves.
    replaced = F.col("next") <= F.col("at") + F.col("span")
    come = counted.select(*KEY, "at", F.lit(0).alias("phase"), F.col("gain").alias("change"), "log")
    none = F.lit(None).cast(counted.schema["log"].dataType).alias("log")
    leave = counted.select(
        *KEY, F.when(replaced, F.col("next")).otherwise(F.col("at") + F.col("span")).alias("at"), F.when(replaced, 0).otherwise(1).alias("phase"), (-F.col("gain")).alias("change"), none
    )
    moments = come.unionByName(leave).groupBy(*KEY, "at", "phase").agg(F.sum("change").alias("change"), F.min("log").alias("log"))
    measured = running(moments, KEY, ["at", "phase"], ["change"], parts).where("phase = 0")
    reached = F.col("measure") >= _per_kind(bursts, lambda b: b.threshold)
    measured = measured.withColumnRenamed("sum_change", "measure").withColumn("miss", F.when(reached, 0).otherwise(1)).drop("phase", "change")

    # Only keys that reach their threshold at all are looked at again.
    measured = materialise(measured, "measured")
    keys = measured.where("miss = 0").select(*KEY).distinct()
    stretches = running(measured.join(keys, KEY, "left_semi"), KEY, ["at"], ["miss"], parts).where("miss = 0")
    found = stretches.groupBy(*KEY, "sum_miss").agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.max("measure").alias("peak"), F.count(F.lit(1)).alias("points"), F.min(F.struct("at", "log")).alias("head")
    )
    return found.select(*KEY, F.timestamp_micros("first").alias("started"), F.timestamp_micros("last").alias("ended"), "peak", "points", F.col("head.log.id").alias("log_id"), F.col("head.log.host").alias("host"))


def _listed(logs: DataFrame, bursts: list[Burst], found: DataFrame) -> DataFrame:
    """The first values, up to a spec's ``list_limit``, of the windows of each stretch."""
    listing = [b for b in bursts if b.value is not None]
    rows = tallies(logs, listing).where("value IS NOT NULL").withColumn("at", F.unix_micros("ets")).select(*KEY, "value", "at")
    span = _per_kind(listing, lambda b: 1_000_000 * b.window_seconds)
    within = rows.join(found.select(*KEY, "started", "ended"), KEY).where(F.col("at").between(F.unix_micros("started") - span, F.unix_micros("ended")))
    number = F.col("value").try_cast("bigint")
    place = F.row_number().over(Window.partitionBy(*KEY, "started").orderBy(number, "value"))
    first = within.select(*KEY, "started", "value").distinct().withColumn("place", place)
    first = first.where(F.col("place") <= _per_kind(listing, lambda b: b.list_limit or LIST_LIMIT))
    in_order = F.array_sort(F.collect_list(F.struct("place", "value")))
    return first.groupBy(*KEY, "started").agg(F.transform(in_order, lambda v: v["value"]).alias("vals"))


def sliding_alerts(logs: DataFrame, bursts: list[Burst], parts: int | None = None) -> DataFrame:
    """An alert for every stretch of ``episodes``, at the time it started, with the peak as the measure.

    Lists hold the first values (``list_limit``, else ``LIST_LIMIT``) of the windows of the stretch.
    """
    bursts = [b for b in bursts if b.window_seconds is not None]
    found = materialise(episodes(logs, bursts, parts), "episodes")
    if any(b.value is not None for b in bursts):
        found = found.join(_listed(logs, bursts, found), [*KEY, "started"], "left")
    else:
        found = found.withColumn("vals", F.lit(None).cast("array<string>"))
    peak = F.col("peak")
    hits = found.withColumns(
        {
            "cycle": F.col("started"),
            "n": peak,
            "distinct_n": peak,
            "amount": peak,
            "first": F.struct(F.col("started").alias("ets"), F.col("log_id").alias("id"), "host"),
            "last": F.col("ended"),
        }
    )
    return alerts_of(hits, bursts)


def tumbling_alerts(logs: DataFrame, bursts: list[Burst]) -> DataFrame:
    """The alerts of ``burst_alerts`` with windows of event time in place of cycles; specs of one length share a pass.

    A row's window is the one of ``window_seconds`` that begins at a multiple of that length and holds its event time.
    """
    parts = []
    for seconds in sorted({b.window_seconds for b in bursts if b.window_seconds is not None}):
        windowed = logs.withColumn("cycle", F.window("ets", f"{seconds} seconds")["end"])
        parts.append(burst_alerts(windowed, [b for b in bursts if b.window_seconds == seconds]))
    return union_alerts(parts)
