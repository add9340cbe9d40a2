"""Severity, priority and outlier scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity names and their priority weights.
PRIORITY_WEIGHTS = {"critical": 100.0, "high": 75.0, "medium": 50.0, "low": 25.0, "info": 10.0}
DEFAULT_PRIORITY = 50.0


def normal_severity(severity: Column) -> Column:
    s = F.lower(severity)
    return F.when(s.isin(*PRIORITY_WEIGHTS), s).otherwise("medium")


def priority(severity: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for kv in PRIORITY_WEIGHTS.items() for x in kv])
    return F.coalesce(weights[severity], F.lit(DEFAULT_PRIORITY))


def known_confidence(confidence: Column) -> Column:
    return F.coalesce(F.nullif(confidence, F.lit(0.0)), F.lit(0.5))


def confidence_severity(confidence: Column) -> Column:
    c = known_confidence(confidence)
    return F.when(c >= 0.8, "critical").when(c >= 0.6, "high").when(c >= 0.4, "medium").otherwise("low")


def z_score(value: Column, mean: Column, std: Column) -> Column:
    """Null where the deviation is zero or unknown, so no threshold test can pass."""
    return F.when(std != 0, (value - mean) / std)


def beyond(z: Column, threshold: float, two_sided: bool = True) -> Column:
    """Strictly beyond; rounding keeps a score at the threshold from passing by its last digit."""
    z = F.round(z, 9)
    return (F.abs(z) if two_sided else z) > threshold


def outside_iqr(value: Column, q1: Column, q3: Column, iqr: Column, k: float = 1.5) -> Column:
    return (value < q1 - k * iqr) | (value > q3 + k * iqr)


def variation(mean: Column, std: Column) -> Column:
    return F.when(mean > 0, std / mean)


def percent(part: Column, total: Column) -> Column:
    return F.coalesce(100.0 * part / F.nullif(total, F.lit(0)), F.lit(0.0))
