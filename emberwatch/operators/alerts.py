"""The common alert row: deterministic ids, one column contract for all detectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.scores import priority
from emberwatch.schema import ALERT_COLUMNS


def to_alerts(
    df: DataFrame,
    *,
    method: str | Column,
    alert_type: Column,
    severity: Column,
    description: Column,
    metadata: Column,
    rule: Column | None = None,
    log_id: Column | None = None,
    source_ip: Column | None = None,
    dest_ip: Column | None = None,
    user: Column | None = None,
    host: Column | None = None,
    cycle: str = "cycle",
) -> DataFrame:
    """Project detector hits onto the alert contract.

    The id is a hash of what identifies the hit (method, type, rule, entity, log, cycle), so a
    re-run or a retried micro-batch writes the same ids. ``metadata`` is JSON text (``payload``),
    so that detectors with different fields union cleanly.
    """
    method = F.lit(method) if isinstance(method, str) else method
    none = F.lit(None).cast("string")
    log_id, source_ip, dest_ip, user, host, rule = (
        none if c is None else c for c in (log_id, source_ip, dest_ip, user, host, rule)
    )
    identity = [F.coalesce(c, F.lit("")) for c in (method, alert_type, rule, log_id, source_ip, dest_ip, user, F.col(cycle).cast("string"))]
    lengths = [F.length(c).cast("string") for c in identity]  # so that no two hits read the same, whatever their texts hold
    return df.select(
        F.sha2(F.concat_ws("|", *lengths, *identity), 256).alias("id"),
        log_id.alias("log_id"),
        alert_type.alias("alert_type"),
        method.alias("detection_method"),
        severity.alias("severity"),
        description.alias("description"),
        metadata.alias("metadata"),
        F.col(cycle).alias("created_at"),
        F.lit(False).alias("acknowledged"),
        priority(severity).alias("priority_score"),
        source_ip.alias("source_ip"),
        dest_ip.alias("dest_ip"),
        user.alias("user"),
        host.alias("host"),
    )


def payload(fields: dict[str, Column]) -> Column:
    """Metadata JSON; fields that are null are left out."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def unpack(df: DataFrame, keep: list[str], rows: list[Column]) -> DataFrame:
    """One output row per non-null struct of ``rows``, next to the kept columns.

    The structs go straight into the generator: an aliased array would make the optimiser add a
    size filter on it and evaluate every expression twice. No lambda is involved, so the scan, the
    generator and the filter stay in one generated stage. The first field of a struct is never null.
    """
    out = df.select(*keep, F.inline(F.array(*rows)))
    return out.filter(F.col(out.columns[len(keep)]).isNotNull())


def minutes(seconds: int) -> Column:
    return F.lit(seconds / 60 if seconds % 60 else seconds // 60)


def union_alerts(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select(*ALERT_COLUMNS) for p in parts])


def meta(key: str) -> Column:
    """A metadata field of the alert table as text."""
    return F.get_json_object("metadata", f"$.{key}")
