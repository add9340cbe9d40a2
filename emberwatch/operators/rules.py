"""Correlation rules: a rule's selection becomes a predicate, its thresholds a group filter."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions import fields as X
from emberwatch.functions.scores import PRIORITY_WEIGHTS
from emberwatch.operators.alerts import payload, to_alerts, union_alerts, unpack
from emberwatch.operators.ordered import running
from emberwatch.schema import LOG_COLUMNS

METHOD = "rule_engine"
RULE_INPUT = ["id", "host", "source_ip", "user", "cycle"]

# Timeframe units in seconds; a bare number means minutes.
UNITS = {"m": 60, "h": 3600, "d": 86400}


@dataclass(frozen=True)
class Rule:
    id: str | None
    name: str | None
    severity: str = "medium"
    description: str | None = None
    enabled: bool = True
    technique: str = ""
    tactic: str = ""
    logic: dict[str, Any] = field(default_factory=dict)
    file: str | None = None

    @staticmethod
    def from_dict(d: dict[str, Any], file: str | None = None) -> Rule:
        mitre = d.get("mitre_attack") or {}
        return Rule(
            id=d.get("id"),
            name=d.get("name"),
            severity=d.get("severity", "medium"),
            description=d.get("description"),
            enabled=d.get("enabled", True),
            technique=mitre.get("technique", ""),
            tactic=mitre.get("tactic", ""),
            logic=d.get("logic") or {},
            file=file,
        )


def timeframe_seconds(text: str) -> int:
    t = str(text).lower().strip()
    return int(t[:-1]) * UNITS[t[-1]] if t[-1] in UNITS else int(t) * 60


def field_value(name: str) -> Column:
    """Where a rule field comes from: dotted path, record column, normalized, metadata, then derived.

    A key that is present decides even when its value is null.
    """
    if "." in name:
        return X.path_value(name)
    if name in LOG_COLUMNS:
        return F.col(name).cast("string")
    derived = {
        "source_ip": F.col("source_ip"),
        "user": F.col("user"),
        "event_type": F.col("event_kind"),
    }.get(name, F.lit(None).cast("string"))
    fields, extra = F.col("fields"), F.col("extra")
    return (
        F.when(X.has_key(fields, name), fields[name]).when(X.has_key(extra, name), extra[name]).otherwise(derived)
    )


def as_text(value: Any) -> str:
    """A value of a rule file as it reads in the fields of a log, which come from JSON."""
    return value if isinstance(value, str) else json.dumps(value)


def selection(criteria: dict[str, Any]) -> Column:
    """All criteria hold; a field without a value fails every criterion, ``not`` included."""
    ok = F.lit(True)
    for name, wanted in criteria.items():
        value = field_value(name)
        if isinstance(wanted, list):
            test = value.isin(*[as_text(w) for w in wanted])
        elif isinstance(wanted, dict):
            if "not" in wanted:
                test = value != as_text(wanted["not"])
            elif "contains" in wanted:
                test = F.lower(value).contains(str(wanted["contains"]).lower())
            elif "regex" in wanted:
                test = value.rlike(f"(?idU)(?:{wanted['regex']})")
            else:
                test = value.isNotNull()
        else:
            test = F.lower(value) == as_text(wanted).lower()
        ok = ok & F.coalesce(test, F.lit(False))
    return ok


def _recent(logs: DataFrame, by: str, seconds: int) -> DataFrame:
    """Rows with a ``by`` value (``g``) whose event time is within ``seconds`` of the end of their cycle."""
    return logs.withColumn("g", X.non_empty(field_value(by))).filter(
        F.col("g").isNotNull() & F.expr(f"cycle - ts <= INTERVAL {seconds} SECONDS")
    )


def recent_groups(logs: DataFrame, by: str, threshold: int, timeframe: str) -> DataFrame:
    """Rows of the last ``timeframe`` of their cycle whose ``by`` value occurs often enough there.

    The groups are counted with map-side combining and joined back as a semi-join, so a value that
    holds most rows is never gathered in one task.
    """
    recent = _recent(logs, by, timeframe_seconds(timeframe))
    groups = recent.groupBy("cycle", "g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= threshold)
    return recent.join(groups.select("cycle", "g"), ["cycle", "g"], "left_semi").drop("g")


def rolling_groups(logs: DataFrame, by: str, threshold: int, timeframe: str) -> DataFrame:
    """As ``recent_groups``, but rows of earlier cycles count too while they are within ``timeframe`` of the cycle's end.

    So a timeframe of five minutes means five minutes with cycles of one minute, too. A row is reported in its own cycle
    only. A row adds to its group when its cycle ends and leaves when the timeframe has passed; the counts are running sums
    of these changes (``ordered``), so no row is copied into the cycles that still see it, however long the timeframe.
    """
    seconds = timeframe_seconds(timeframe)
    recent = _recent(logs, by, seconds)
    came = recent.select("g", F.unix_micros("cycle").alias("at"), F.lit(0).alias("phase"), F.lit(1).cast("long").alias("change"))
    left = recent.select("g", (F.unix_micros("ts") + 1_000_000 * seconds).alias("at"), F.lit(1).alias("phase"), F.lit(-1).cast("long").alias("change"))
    moments = came.unionByName(left).groupBy("g", "at", "phase").agg(F.sum("change").alias("change"))
    counts = running(moments, ["g"], ["at", "phase"], ["change"]).where("phase = 0")
    groups = counts.where(F.col("sum_change") >= threshold).select(F.timestamp_micros("at").alias("cycle"), "g")
    return recent.join(groups, ["cycle", "g"], "left_semi").drop("g")


def rule_rows(logs: DataFrame, rule: Rule, rolling: bool = False) -> DataFrame:
    logic, groups = rule.logic, rolling_groups if rolling else recent_groups
    rows = logs.filter(selection(logic["selection"])) if "selection" in logic else logs
    for term in str(logic.get("condition", "selection")).split(" and "):
        if term == "selection":
            continue
        if term not in ("count", "frequency"):
            raise ValueError(f"rule {rule.id}: unknown condition term {term!r}")
        spec = logic.get(term) or {}
        if spec.get("field"):
            least = spec.get("threshold" if term == "count" else "min_connections", 0)
            rows = groups(rows, spec["field"], least, spec.get("timeframe", "5m" if term == "count" else "10m"))
    return rows


def look_back(rules: list[Rule]) -> int:
    """Seconds that the longest timeframe of these rules spans."""
    spans = [spec.get("timeframe", default) for r in rules for term, default in (("count", "5m"), ("frequency", "10m")) if (spec := r.logic.get(term))]
    return max(map(timeframe_seconds, spans), default=0)


def is_row_rule(rule: Rule) -> bool:
    return str(rule.logic.get("condition", "selection")).strip() == "selection"


def _rule_table(rules: list[Rule]) -> list[Column]:
    def entry(r: Rule) -> Column:
        text = r.description or r.name or "Rule matched"
        severity = str(r.severity).lower()
        return F.struct(
            F.lit(r.id or r.name or "rule").alias("rule_id"),
            F.lit(r.name).cast("string").alias("rule_name"),
            F.lit(r.file).cast("string").alias("rule_file"),
            F.lit(severity if severity in PRIORITY_WEIGHTS else "medium").alias("rule_severity"),
            F.lit(f"[{r.technique}] {text}" if r.technique else text).alias("rule_text"),
            F.lit(r.technique).alias("technique"),
            F.lit(r.tactic).alias("tactic"),
            F.lit(json.dumps(r.logic, sort_keys=True)).alias("logic"),
        )

    return [entry(r) for r in rules]


def _to_alerts(hits: DataFrame) -> DataFrame:
    return to_alerts(
        hits,
        method=METHOD,
        alert_type=F.coalesce("rule_name", F.lit("rule_match")),
        severity=F.col("rule_severity"),
        description=F.col("rule_text"),
        metadata=payload(
            {
                "rule_id": F.col("rule_id"),
                "rule_name": F.col("rule_name"),
                "rule_file": F.col("rule_file"),
                "mitre_technique": F.col("technique"),
                "mitre_tactic": F.col("tactic"),
                "logic": F.col("logic"),
            }
        ),
        rule=F.col("rule_id"),
        log_id=F.col("id"),
        source_ip=F.col("source_ip"),
        user=F.col("user"),
        host=F.col("host"),
    )


def rule_alerts(logs: DataFrame, rules: list[Rule], rolling: bool = False) -> DataFrame:
    """Alerts of all enabled rules; the rules without thresholds share one pass over the logs.

    With ``rolling`` thresholds count rows of earlier cycles, see ``rolling_groups``; else each cycle counts for itself.
    """
    active = [r for r in rules if r.enabled]
    plain = [r for r in active if is_row_rule(r)]
    parts = []
    if plain:
        tests = [
            F.when(selection(r.logic["selection"]) if "selection" in r.logic else F.lit(True), e)
            for r, e in zip(plain, _rule_table(plain))
        ]
        parts.append(_to_alerts(unpack(logs, RULE_INPUT, tests)))
    for r in active:
        if r not in plain:
            parts.append(_to_alerts(unpack(rule_rows(logs, r, rolling), RULE_INPUT, _rule_table([r]))))
    return union_alerts(parts)
