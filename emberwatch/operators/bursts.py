"""Group measures over (cycle, key): counts, distinct values and sums within a time span.

All detectors of the form "this key did X at least N times within W" are rows of one table of
``Burst`` specs. A log row is turned into one small *tally* struct per spec that applies, and a
single aggregation serves every spec, so adding a detector adds no scan and no shuffle.

Skew: the first aggregation is by (key, value) and combines map-side. Distinct values are then
numbered inside a hash slice of their key, so a key with very many values is spread over
``SLICES`` tasks, and no task ever holds more than the listed values of a slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.operators.alerts import payload, to_alerts, unpack

SLICES = 16


@dataclass(frozen=True)
class Burst:
    """One detector: which rows count, what they are grouped by and when the group alerts.

    ``measure`` is ``rows``, ``distinct`` (of ``value``) or ``amount`` (sum of ``amount``).
    ``entity`` says which alert columns the keys fill. ``describe`` and ``metadata`` are built
    from the tallied columns k1, k2, n, distinct_n, amount, vals.
    """

    alert_type: str
    method: str
    severity: str
    when: Column
    k1: Column
    measure: str
    threshold: int
    describe: Column
    metadata: dict[str, Column]
    entity: dict[str, str]
    k2: Column | None = None
    value: Column | None = None
    amount: Column | None = None
    window_seconds: int | None = None
    list_limit: int | None = 20
    with_log: bool = True


def tallies(logs: DataFrame, bursts: Iterable[Burst]) -> DataFrame:
    """A row for each log row and spec that applies: cycle, ets, id, host, kind, k1, k2, value, amount."""
    text = F.lit(None).cast("string")
    rows = [
        F.when(
            b.when & b.k1.isNotNull(),
            F.struct(
                F.lit(b.alert_type).alias("kind"),
                b.k1.alias("k1"),
                F.coalesce(b.k2 if b.k2 is not None else text, F.lit("")).alias("k2"),
                (b.value if b.value is not None else text).cast("string").alias("value"),
                (b.amount if b.amount is not None else F.lit(0)).cast("bigint").alias("amount"),
            ),
        )
        for b in bursts
    ]
    return unpack(logs, ["cycle", "ets", "id", "host"], rows)


def tally(logs: DataFrame, bursts: list[Burst]) -> DataFrame:
    """One row per (cycle, kind, k1, k2): n, distinct_n, amount, first, last and listed values."""
    group = ["cycle", "kind", "k1", "k2"]
    per_value = (
        tallies(logs, bursts)
        .groupBy(*group, "value")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("amount").alias("amount"),
            F.min(F.struct("ets", "id", "host")).alias("first"),
            F.max("ets").alias("last"),
        )
        .withColumn("slice", F.pmod(F.xxhash64("value"), F.lit(SLICES)))
    )
    # Numbers sort as numbers, everything else as text.
    entry = F.struct(F.col("value").try_cast("bigint").alias("num"), F.col("value").alias("value"))
    in_slice = Window.partitionBy(*group, "slice").orderBy(entry["num"], entry["value"])
    listing = [b for b in bursts if b.value is not None]
    whole = [b.alert_type for b in listing if b.list_limit is None]  # 0 lists nothing
    limits = [(F.col("kind") == b.alert_type) & (F.col("place") <= b.list_limit) for b in listing if b.list_limit]
    listed = reduce(lambda a, b: a | b, limits, F.col("kind").isin(*whole) if whole else F.lit(False))
    per_slice = (
        per_value.withColumn("place", F.count("value").over(in_slice))
        .groupBy(*group, "slice")
        .agg(
            F.sum("n").alias("n"),
            F.count("value").alias("distinct_n"),
            F.sum("amount").alias("amount"),
            F.min("first").alias("first"),
            F.max("last").alias("last"),
            F.collect_list(F.when(listed & F.col("value").isNotNull(), entry)).alias("vals"),
        )
    )
    return per_slice.groupBy(*group).agg(
        F.sum("n").alias("n"),
        F.sum("distinct_n").alias("distinct_n"),
        F.sum("amount").alias("amount"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.transform(F.array_sort(F.flatten(F.collect_list("vals"))), lambda v: v["value"]).alias("vals"),
    )


def _reached(b: Burst) -> Column:
    measure = {"rows": "n", "distinct": "distinct_n", "amount": "amount"}[b.measure]
    ok = (F.col("kind") == b.alert_type) & (F.col(measure) >= b.threshold)
    if b.window_seconds is not None:
        ok = ok & F.expr(f"last - first.ets <= INTERVAL {b.window_seconds} SECONDS")
    return ok


def burst_members(logs: DataFrame, bursts: list[Burst]) -> DataFrame:
    """Everything that the groups of the alerts hold, in long form: cycle, kind, k1, k2, value and its count.

    An alert lists the first values next to the exact number; here no list has an end and no row grows with its group.
    """
    group = ["cycle", "kind", "k1", "k2"]
    listing = [b for b in bursts if b.value is not None]
    reached = tally(logs, [replace(b, list_limit=0) for b in listing]).filter(reduce(lambda a, b: a | b, [_reached(b) for b in listing]))
    values = tallies(logs, listing).filter("value IS NOT NULL").groupBy(*group, "value").agg(F.count(F.lit(1)).alias("n"))
    return values.join(reached.select(*group), group, "left_semi")


def burst_alerts(logs: DataFrame, bursts: list[Burst]) -> DataFrame:
    """Alert rows for every spec, from one pass over the prepared logs."""
    return alerts_of(tally(logs, bursts).filter(reduce(lambda a, b: a | b, [_reached(b) for b in bursts])), bursts)


def alerts_of(hits: DataFrame, bursts: list[Burst]) -> DataFrame:
    """Groups with the columns of ``tally`` as alert rows."""

    def per_kind(part: Callable[[Burst], Column | None]) -> Column:
        parts = [(b.alert_type, part(b)) for b in bursts]
        chosen = [F.when(F.col("kind") == k, c) for k, c in parts if c is not None]
        return F.coalesce(*chosen) if chosen else F.lit(None).cast("string")

    def entity(name: str) -> Column:
        return per_kind(lambda b: F.col(b.entity[name]) if name in b.entity else None)

    hits = hits.withColumn(
        "vals", per_kind(lambda b: F.slice("vals", 1, b.list_limit) if b.list_limit else F.col("vals"))
    )
    return to_alerts(
        hits,
        method=per_kind(lambda b: F.lit(b.method)),
        alert_type=F.col("kind"),
        severity=per_kind(lambda b: F.lit(b.severity)),
        description=per_kind(lambda b: b.describe),
        metadata=per_kind(lambda b: payload(b.metadata)),
        log_id=per_kind(lambda b: F.col("first.id") if b.with_log else None),
        source_ip=entity("source_ip"),
        dest_ip=entity("dest_ip"),
        user=entity("user"),
        host=entity("host"),
    )
