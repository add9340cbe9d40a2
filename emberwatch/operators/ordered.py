"""Sums and successors along an order inside keys, whatever share of the rows one key has.

A window over a key brings all its rows to one task. Here rows are range-partitioned by key and order instead, so that
a key's rows lie in as many neighbouring parts as they need. Each part is boiled down to one row a key, what it hands
on is carried over the parts, and the window runs inside parts only. Parts are written, so they stay the same when an
executor is lost and its share is computed again.

Keys are never null, and no two rows of a key agree in ``order``: aggregate them first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.sources.tables import materialise

PART = "_part"


def in_parts(rows: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """``rows`` with ``_part``; parts follow each other in the order of (keys, order)."""
    names = [*keys, *order]
    ranged = rows.repartitionByRange(parts, *names) if parts else rows.repartitionByRange(*names)
    return materialise(ranged.withColumn(PART, F.spark_partition_id()), "ordered")


def running(rows: DataFrame, keys: list[str], order: list[str], values: list[str], parts: int | None = None) -> DataFrame:
    """``rows`` with ``sum_v`` for each of ``values``: its sum over the rows of the key up to and with this one."""
    rows = in_parts(rows, keys, order, parts)
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, PART).agg(*[F.sum(v).alias(f"_all_{v}") for v in values], F.count(F.lit(1)).alias("_n"))
    carried = totals.select(*keys, PART, F.row_number().over(Window.partitionBy(*keys).orderBy(PART)).alias("_nth"), *[F.sum(f"_all_{v}").over(before).alias(f"_before_{v}") for v in values])
    carried = carried.where("_nth > 1").drop("_nth")  # a row for each part that a key enters anew
    inside = Window.partitionBy(*keys, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(carried, [*keys, PART], "left")
    sums = {f"sum_{v}": F.sum(v).over(inside) + F.coalesce(F.col(f"_before_{v}"), F.lit(0)) for v in values}
    return joined.withColumns(sums).drop(PART, *[f"_before_{v}" for v in values])


def following(rows: DataFrame, keys: list[str], order: str, parts: int | None = None) -> DataFrame:
    """``rows`` with ``next``: ``order`` of the key's next row, null for its last."""
    rows = in_parts(rows, keys, [order], parts)
    heads = rows.groupBy(*keys, PART).agg(F.min(order).alias("_head"))
    heads = heads.withColumn("_next_head", F.lead("_head").over(Window.partitionBy(*keys).orderBy(PART))).drop("_head")
    heads = heads.where("_next_head IS NOT NULL")
    ahead = F.lead(order).over(Window.partitionBy(*keys, PART).orderBy(order))
    joined = rows.join(heads, [*keys, PART], "left")
    return joined.withColumn("next", F.coalesce(ahead, F.col("_next_head"))).drop(PART, "_next_head")
