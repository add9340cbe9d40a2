"""Ordered patterns per key: failures then success, login then escalation, regular gaps.

A plain ``Window.partitionBy(key)`` puts every row of a hot key into one task. Here each key is cut
into time slices; windows run inside a slice, each slice is boiled down to one summary row, the
summaries (few per key) are carried forward in order, and the carry is joined back. The results are
those of the plain window, but a key holding a third of all rows runs in as many tasks as it has slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.functions import fields as X
from emberwatch.operators.alerts import minutes, payload, to_alerts

AGGREGATES = {"sum": F.sum, "min": F.min, "max": F.max}


def _combine(op: str, a: Column, b: Column) -> Column:
    if op == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return F.least(a, b) if op == "min" else F.greatest(a, b)


def time_slice(ts: str, seconds: int) -> Column:
    return F.floor(F.unix_seconds(ts) / seconds)


def since_reset(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    reset: str,
    running: dict[str, tuple[str, str]],
    slice_seconds: int,
) -> DataFrame:
    """Running aggregates over the rows after the previous ``reset`` row, up to this row.

    ``order`` starts with a timestamp, ends with a unique column and should name every column the
    caller needs later, so that both uses of the sliced rows share one shuffle.
    ``running`` maps a result name to (sum|min|max, input column).
    """
    # Said here, the optimiser need not infer it for one side of the join only, which would make the
    # two uses of the shuffled rows differ.
    known = df.filter(" AND ".join(f"{c} IS NOT NULL" for c in (*keys, order[0])))
    sliced = known.withColumn("slice", time_slice(order[0], slice_seconds))
    place = [*keys, "slice"]
    before = Window.partitionBy(*place).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    flagged = sliced.withColumn("part", F.coalesce(F.sum(F.col(reset).cast("int")).over(before), F.lit(0)))
    upto = Window.partitionBy(*place, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = flagged.withColumns({name: AGGREGATES[op](c).over(upto) for name, (op, c) in running.items()})

    # A part is closed by its one reset row; what is left open at a slice's end is carried on.
    parts = local.groupBy(*place, "part").agg(
        F.max(reset).alias("closed"), *[AGGREGATES[op](c).alias(name) for name, (op, c) in running.items()]
    )
    ends = parts.groupBy(*place).agg(
        F.max("closed").alias("closed"),
        *[
            AGGREGATES[op](F.when(~F.col("closed"), F.col(name))).alias(name)
            for name, (op, _) in running.items()
        ],
    )
    slices = Window.partitionBy(*keys).orderBy("slice")
    chained = ends.withColumn("chain", F.sum(F.col("closed").cast("int")).over(slices))
    along = Window.partitionBy(*keys, "chain").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    carried = chained.withColumns({f"out_{name}": AGGREGATES[op](name).over(along) for name, (op, _) in running.items()})
    carry = carried.select(*place, *[F.lag(f"out_{name}").over(slices).alias(f"in_{name}") for name in running])

    joined = local.join(carry, place, "left")
    return joined.withColumns(
        {
            name: F.when(F.col("part") == 0, _combine(op, F.col(name), F.col(f"in_{name}"))).otherwise(F.col(name))
            for name, (op, _) in running.items()
        }
    ).drop("slice", "part", *[f"in_{name}" for name in running])


def failures_then_success(
    logs: DataFrame,
    min_failed: int = 5,
    window_seconds: int = 300,
    slice_seconds: int = 10,
    failed: Column | None = None,
    succeeded: Column | None = None,
) -> DataFrame:
    """First success per (source, user) that closely follows enough failures since the last success.

    Both predicates may hold for one row: its failure counts first. Every success starts the count anew.
    """
    failed = F.col("is_failed_login") if failed is None else failed
    succeeded = F.col("is_successful_login") if succeeded is None else succeeded
    rows = (
        logs.filter(X.non_empty(F.col("source_ip")).isNotNull() | X.non_empty(F.col("user")).isNotNull())
        .filter(failed | succeeded)
        .select(
            "cycle",
            X.or_unknown(F.col("source_ip")).alias("k_ip"),
            X.or_unknown(F.col("user")).alias("k_user"),
            "ets",
            "id",
            "host",
            failed.cast("long").alias("fail"),
            F.when(failed, F.col("ets")).alias("fail_ts"),
            succeeded.alias("succ"),
        )
    )
    counted = since_reset(
        rows,
        ["cycle", "k_ip", "k_user"],
        ["ets", "id", "host"],
        "succ",
        {"failed_count": ("sum", "fail"), "last_failed": ("max", "fail_ts")},
        slice_seconds,
    )
    hits = counted.filter(
        F.col("succ")
        & (F.col("failed_count") >= min_failed)
        & F.expr(f"ets - last_failed <= INTERVAL {window_seconds} SECONDS")
    )
    return hits.groupBy("cycle", "k_ip", "k_user").agg(
        F.min(F.struct("ets", "id", "host", "failed_count")).alias("hit")
    ).select("cycle", "k_ip", "k_user", "hit.*")


def brute_force_success(
    logs: DataFrame, min_failed: int = 5, window_seconds: int = 300, slice_seconds: int = 10
) -> DataFrame:
    hits = failures_then_success(logs, min_failed, window_seconds, slice_seconds)
    return to_alerts(
        hits,
        method="heuristic_analyzer",
        alert_type=F.lit("brute_force_success"),
        severity=F.lit("high"),
        description=F.concat(
            F.lit("A guessed password worked: "),
            F.col("failed_count").cast("string"),
            F.lit(" refusals, then a sign-in"),
        ),
        metadata=payload(
            {
                "rule_id": F.lit("HEUR-001"),
                "rule_name": F.lit("Sign-in after refusals"),
                "source_ip": F.col("k_ip"),
                "user": F.col("k_user"),
                "failed_count": F.col("failed_count"),
                "window_minutes": minutes(window_seconds),
            }
        ),
        log_id=F.col("id"),
        source_ip=F.col("k_ip"),
        user=F.col("k_user"),
        host=F.col("host"),
    )


def login_then_escalation(
    logs: DataFrame, window_seconds: int = 600, rearm: bool = False, slice_seconds: int = 10
) -> DataFrame:
    """Privilege keyword soon after a login of the same user.

    The anchor is the first login since the last escalation; every escalation clears it, and one
    row may be both. An escalation that comes too late leaves the old anchor in place, so that
    user cannot alert again within the cycle. With ``rearm`` the latest login is the anchor
    instead, each login alerts at most once and a late escalation silences nothing.
    """
    login, escalation = F.col("is_login"), F.col("is_privilege")
    rows = (
        logs.filter(X.non_empty(F.col("user")).isNotNull())
        .filter(login | escalation)
        .select(
            "cycle",
            F.col("user").alias("k_user"),
            "ets",
            "id",
            "host",
            F.when(login, F.col("ets")).alias("login_ts"),
            escalation.alias("esc"),
        )
    )
    anchored = since_reset(
        rows,
        ["cycle", "k_user"],
        ["ets", "id", "host"],
        "esc",
        {"anchor": ("max" if rearm else "min", "login_ts")},
        slice_seconds,
    )
    pairs = anchored.filter(F.col("esc") & F.col("anchor").isNotNull()).withColumn(
        "in_time", F.expr(f"ets - anchor <= INTERVAL {window_seconds} SECONDS")
    )
    hits = pairs.filter("in_time")
    if rearm:
        return hits
    late = (
        pairs.filter("NOT in_time")
        .groupBy("cycle", "k_user")
        .agg(F.min(F.struct("ets", "id")).alias("stop"))
    )
    return (
        hits.join(late, ["cycle", "k_user"], "left")
        .filter(F.col("stop").isNull() | (F.struct("ets", "id") < F.col("stop")))
        .drop("stop")
    )


def privilege_escalation(
    logs: DataFrame, window_seconds: int = 600, rearm: bool = False, slice_seconds: int = 10
) -> DataFrame:
    hits = login_then_escalation(logs, window_seconds, rearm, slice_seconds)
    return to_alerts(
        hits,
        method="heuristic_analyzer",
        alert_type=F.lit("privilege_escalation"),
        severity=F.lit("critical"),
        description=F.lit("Higher rights taken soon after sign-in"),
        metadata=payload(
            {
                "rule_id": F.lit("HEUR-002"),
                "rule_name": F.lit("Privilege Escalation After Login"),
                "user": F.col("k_user"),
                "time_since_login": (F.unix_micros("ets") - F.unix_micros("anchor")) / 1e6,
                "window_minutes": minutes(window_seconds),
            }
        ),
        log_id=F.col("id"),
        user=F.col("k_user"),
        host=F.col("host"),
    )


def gap_statistics(events: DataFrame, keys: list[str], slice_seconds: int = 10) -> DataFrame:
    """Count, mean and population deviation of the gaps between consecutive events of a key.

    Gaps inside a time slice come from ``lag``; a slice's summary adds the gap to the slice before.
    Means and squared deviations are merged pairwise, which stays accurate for tiny deviations.
    """
    place = [*keys, "slice"]
    rows = events.select(*keys, "ts", time_slice("ts", slice_seconds).alias("slice"))
    in_slice = Window.partitionBy(*place).orderBy("ts")

    def seconds(later: str, earlier: Column) -> Column:
        return (F.unix_micros(later) - F.unix_micros(earlier)) / 1e6

    gaps = rows.withColumn("gap", seconds("ts", F.lag("ts").over(in_slice)))
    per_slice = gaps.groupBy(*place).agg(
        F.count(F.lit(1)).alias("events"),
        F.min("ts").alias("lo"),
        F.max("ts").alias("hi"),
        F.count("gap").alias("g_n"),
        F.coalesce(F.avg("gap"), F.lit(0.0)).alias("g_mean"),
        F.coalesce(F.var_pop("gap"), F.lit(0.0)).alias("g_var"),
    )
    slices = Window.partitionBy(*keys).orderBy("slice")
    linked = per_slice.withColumn("link", seconds("lo", F.lag("hi").over(slices)))
    every = Window.partitionBy(*keys)
    gaps_n = F.sum("g_n").over(every) + F.count("link").over(every)
    centred = linked.withColumn("gaps", gaps_n).withColumn(
        "mean", (F.unix_micros(F.max("hi").over(every)) - F.unix_micros(F.min("lo").over(every))) / 1e6
        / F.nullif("gaps", F.lit(0))
    )
    deviation = F.col("g_n") * (F.col("g_var") + F.pow(F.col("g_mean") - F.col("mean"), 2)) + F.coalesce(
        F.pow(F.col("link") - F.col("mean"), 2), F.lit(0.0)
    )
    return centred.groupBy(*keys).agg(
        F.sum("events").alias("events"),
        F.max("gaps").alias("gaps"),
        F.max("mean").alias("mean"),
        F.sqrt(F.sum(deviation) / F.nullif(F.max("gaps"), F.lit(0))).alias("std"),
    )
