"""User behaviour profiles in long form, and the checks of new activity against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.functions import fields as X
from emberwatch.operators.alerts import payload, to_alerts, union_alerts, unpack

METHOD = "behavioral_analyzer"
FACETS = ("history", "login_hour", "login_day", "source_ip", "resource", "action")


def profile_facts(logs: DataFrame) -> DataFrame:
    """(user, facet, item) facts of the logs: the streaming and the batch profile count the same rows."""
    timed = F.col("ts").isNotNull()
    login = timed & F.col("is_login")
    facts = [
        ("history", F.lit(True), F.lit("rows")),
        ("login_hour", login, F.hour("ts").cast("string")),
        ("login_day", login, F.weekday("ts").cast("string")),
        ("source_ip", timed, X.non_empty(F.col("source_ip"))),
        ("resource", timed & X.has_key(F.col("fields"), "resource"), F.col("fields")["resource"]),
        ("action", timed & X.has_key(F.col("fields"), "action"), F.col("fields")["action"]),
    ]
    rows = [
        F.when(applies & item.isNotNull(), F.struct(F.lit(facet).alias("facet"), item.alias("item")))
        for facet, applies, item in facts
    ]
    known = logs.filter(X.non_empty(F.col("user")).isNotNull())
    return unpack(known, ["user"], rows)


def build_profiles(logs: DataFrame) -> DataFrame:
    return profile_facts(logs).groupBy("user", "facet", "item").agg(F.count(F.lit(1)).alias("n"))


def merge_profiles(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts add up, so a profile grows by merging the profile of the new logs."""
    return old.unionByName(new).groupBy("user", "facet", "item").agg(F.sum("n").alias("n"))


def valid_users(profiles: DataFrame, min_rows: int = 10, min_login_hours: int = 10) -> DataFrame:
    """Users with enough history to be judged."""
    return (
        profiles.filter(F.col("facet").isin("history", "login_hour"))
        .groupBy("user")
        .agg(
            F.sum(F.when(F.col("facet") == "history", F.col("n"))).alias("rows"),
            F.count_if(F.col("facet") == "login_hour").alias("hours"),
        )
        .filter((F.col("rows") >= min_rows) & (F.col("hours") >= min_login_hours))
        .select("user")
    )


def hour_shares(profiles: DataFrame) -> DataFrame:
    """(user, hour, share): a user has at most 24 rows here."""
    total = F.sum("n").over(Window.partitionBy("user"))
    return profiles.filter(F.col("facet") == "login_hour").select(
        "user", F.col("item").cast("int").alias("hour"), (F.col("n") / total).alias("share")
    )


def known_items(profiles: DataFrame, facet: str, limit: int = 20) -> DataFrame:
    """Per user the number of known items of a facet and the first ``limit`` of them.

    The rank limit works map-side, so a user with very many items costs no task more than ``limit``.
    """
    rows = profiles.filter(F.col("facet") == facet).select("user", "item")
    rank = Window.partitionBy("user").orderBy("item")
    first = (
        rows.withColumn("place", F.row_number().over(rank))
        .filter(F.col("place") <= limit)
        .groupBy("user")
        .agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    return rows.groupBy("user").agg(F.count(F.lit(1)).alias("n_items")).join(first, "user")


def _activity(logs: DataFrame, profiles: DataFrame, min_rows: int, min_login_hours: int) -> DataFrame:
    timed = logs.filter(F.col("ts").isNotNull() & X.non_empty(F.col("user")).isNotNull())
    return timed.join(valid_users(profiles, min_rows, min_login_hours), "user", "left_semi")


def _unusual(
    df: DataFrame, kind: str, severity: str, description: Column, metadata: dict[str, Column], ip: Column | None = None
) -> DataFrame:
    return to_alerts(
        df,
        method=METHOD,
        alert_type=F.lit(kind),
        severity=F.lit(severity),
        description=description,
        metadata=payload({"user_id": F.col("user"), **metadata}),
        log_id=F.col("id"),
        source_ip=ip,
        user=F.col("user"),
        host=F.col("host"),
    )


def unusual_login_time(
    logs: DataFrame, profiles: DataFrame, min_share: float = 0.05, min_rows: int = 10, min_login_hours: int = 10
) -> DataFrame:
    shares = hour_shares(profiles)
    hours = shares.groupBy("user").agg(F.array_sort(F.collect_list("hour")).alias("typical_hours"))
    hits = (
        _activity(logs, profiles, min_rows, min_login_hours)
        .filter(F.col("is_login"))
        .withColumn("hour", F.hour("ts"))
        .join(shares, ["user", "hour"], "left")
        .filter(F.coalesce("share", F.lit(0.0)) < min_share)
        .join(hours, "user")
    )
    two_digits = F.lpad(F.col("hour").cast("string"), 2, "0")
    return _unusual(
        hits,
        "unusual_login_time",
        "medium",
        F.concat(
            F.lit("User "), F.col("user"), F.lit(" signed in at an hour new to them ("), two_digits, F.lit(":00)")
        ),
        {"login_hour": F.col("hour"), "typical_hours": F.col("typical_hours"), "deviation_type": F.lit("time")},
    )


def _not_in_profile(rows: DataFrame, profiles: DataFrame, facet: str, item: Column) -> DataFrame:
    seen = profiles.filter(F.col("facet") == facet).select("user", F.col("item").alias("new_item"))
    return rows.withColumn("new_item", item).filter("new_item IS NOT NULL").join(seen, ["user", "new_item"], "left_anti")


def unusual_source_ip(
    logs: DataFrame, profiles: DataFrame, min_rows: int = 10, min_login_hours: int = 10
) -> DataFrame:
    active = _activity(logs, profiles, min_rows, min_login_hours)
    hits = _not_in_profile(active, profiles, "source_ip", X.non_empty(F.col("source_ip")))
    hits = hits.join(known_items(profiles, "source_ip"), "user", "left")
    return _unusual(
        hits,
        "unusual_source_ip",
        "high",
        F.concat(F.lit("User "), F.col("user"), F.lit(" came from an address new to them: "), F.col("new_item")),
        {
            "source_ip": F.col("new_item"),
            "typical_ips": F.col("items"),
            "typical_ip_count": F.col("n_items"),
            "deviation_type": F.lit("location"),
        },
        ip=F.col("new_item"),
    )


def unusual_resource_access(
    logs: DataFrame, profiles: DataFrame, min_rows: int = 10, min_login_hours: int = 10
) -> DataFrame:
    active = _activity(logs, profiles, min_rows, min_login_hours)
    hits = _not_in_profile(active, profiles, "resource", F.col("fields")["resource"])
    hits = hits.join(known_items(profiles, "resource"), "user", "left")
    return _unusual(
        hits,
        "unusual_resource_access",
        "medium",
        F.concat(F.lit("User "), F.col("user"), F.lit(" opened something new to them: "), F.col("new_item")),
        {
            "resource": F.col("new_item"),
            "typical_resources": F.col("items"),
            "typical_resource_count": F.col("n_items"),
            "deviation_type": F.lit("resource"),
        },
    )


def behavioral_alerts(logs: DataFrame, profiles: DataFrame, min_rows: int = 10, min_login_hours: int = 10) -> DataFrame:
    gate = {"min_rows": min_rows, "min_login_hours": min_login_hours}
    return union_alerts(
        [
            unusual_login_time(logs, profiles, **gate),
            unusual_source_ip(logs, profiles, **gate),
            unusual_resource_access(logs, profiles, **gate),
        ]
    )
