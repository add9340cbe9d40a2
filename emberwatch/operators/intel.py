"""Threat-intelligence matching: indicators in logs joined with the active indicator table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.functions import fields as X
from emberwatch.functions import predicates as P
from emberwatch.functions.scores import confidence_severity, known_confidence
from emberwatch.operators.alerts import payload, to_alerts

METHOD = "threat_intel_matcher"


def active_indicators(intel: DataFrame, as_of: datetime | str | Column) -> DataFrame:
    """One row per (type, value) that has not expired: highest confidence, then newest."""
    now = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
    key = intel.filter(P.not_expired(F.col("expires_at"), now)).withColumns(
        {"type": F.col("indicator_type"), "value": F.lower(F.trim("indicator_value"))}
    )
    rank = Window.partitionBy("type", "value").orderBy(F.desc("confidence"), F.desc("created_at"), "id")
    return (
        key.withColumn("place", F.row_number().over(rank))
        .filter("place = 1")
        .select("type", "value", F.col("id").alias("intel_id"), "threat_type", "confidence", F.col("source").alias("feed"))
    )


def log_indicators(logs: DataFrame) -> DataFrame:
    text = F.coalesce(X.non_empty(F.col("message")), F.col("raw"))
    found = X.indicators(F.col("fields"), text, F.col("source_ip"))
    return logs.select("id", "host", "source_ip", "user", "cycle", "ets", F.inline(found))


def validity(intel: DataFrame) -> DataFrame:
    """Stretches of time (since, until) with the best indicator of each (type, value) in them.

    An indicator is valid from its creation until it expires; where these are unknown, from the year 1000 and to the year 9000. Of several that
    are valid at a time the one with the highest confidence counts, then the newest. Stretches of a value don't overlap, so
    a log meets at most one, however often feeds list the value again.
    """
    first, last = F.lit("1000-01-01 00:00:00").cast("timestamp"), F.lit("9000-01-01 00:00:00").cast("timestamp")
    listed = intel.select(
        F.col("indicator_type").alias("type"), F.lower(F.trim("indicator_value")).alias("value"), F.coalesce("created_at", first).alias("from"), F.coalesce("expires_at", last).alias("to"),
        F.col("id").alias("intel_id"), "threat_type", "confidence", "created_at", F.col("source").alias("feed"),
    ).where(F.col("from") < F.col("to"))
    borders = listed.select("type", "value", F.explode(F.array("from", "to")).alias("since")).distinct()
    until = F.lead("since").over(Window.partitionBy("type", "value").orderBy("since"))
    spans = borders.withColumn("until", until).where("until IS NOT NULL")
    rank = Window.partitionBy("type", "value", "since").orderBy(F.desc("confidence"), F.desc("created_at"), "intel_id")
    within = (F.col("from") <= F.col("since")) & (F.col("until") <= F.col("to"))
    best = spans.join(listed, ["type", "value"]).where(within).withColumn("place", F.row_number().over(rank)).where("place = 1")
    return best.select("type", "value", "since", "until", "intel_id", "threat_type", "confidence", "feed")


def threat_intel_as_of(logs: DataFrame, intel: DataFrame) -> DataFrame:
    """As ``threat_intel_alerts``, but each log is judged by the indicators that were valid at its event time.

    So a stream that lags, a backlog and one batch find the same, and an indicator that expires later still counts for
    logs of its time. ``intel`` keeps expired rows.
    """
    hits = log_indicators(logs).join(validity(intel), ["type", "value"])
    return _listed(hits.where((F.col("since") <= F.col("ets")) & (F.col("ets") < F.col("until"))))


def threat_intel_alerts(logs: DataFrame, intel: DataFrame, as_of: datetime | str | Column) -> DataFrame:
    """Equi-join on (type, value). Small indicator tables are broadcast by their size; a large feed
    is a shuffle join whose hot indicators adaptive execution splits."""
    return _listed(log_indicators(logs).join(active_indicators(intel, as_of), ["type", "value"]))


def _listed(hits: DataFrame) -> DataFrame:
    threat = F.coalesce(X.non_empty(F.col("threat_type")), F.lit("unknown"))
    return to_alerts(
        hits,
        method=METHOD,
        alert_type=F.concat(F.lit("threat_intel_"), F.col("type")),
        severity=confidence_severity(F.col("confidence")),
        description=F.concat(
            F.lit("Listed by a threat feed: "), F.col("type"), F.lit(" "), F.col("value"), F.lit(" ("), threat, F.lit(")")
        ),
        metadata=payload(
            {
                "indicator_type": F.col("type"),
                "indicator_value": F.col("value"),
                "threat_type": threat,
                "confidence": known_confidence(F.col("confidence")),
                "source": F.col("feed"),
                "threat_intel_id": F.col("intel_id"),
            }
        ),
        rule=F.col("value"),
        log_id=F.col("id"),
        source_ip=F.col("source_ip"),
        user=F.col("user"),
        host=F.col("host"),
    )
