"""Signature catalog to DataFrame plan: all signatures are tested in one pass over the logs."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.functions import fields as X
from emberwatch.functions.literals import folded, needed
from emberwatch.operators.alerts import payload, to_alerts, union_alerts
from emberwatch.schema import SIGNATURE_SCHEMA

METHOD = "signature_detector"
# Ignore case, ^$ per line, only \n ends a line, Unicode meaning of \w \d \s \b.
FLAGS = "(?imdU)"
CATALOG_LIMIT = 10_000
LOG_INPUT = ["id", "host", "appname", "message", "source_ip", "user", "cycle"]


@dataclass(frozen=True)
class Signature:
    id: str
    name: str
    severity: str
    category: str
    description: str
    patterns: tuple[str, ...]
    fields: tuple[str, ...] = ("raw", "message")
    hashes: tuple[tuple[str, str, str], ...] = ()
    file: str = ""


def pattern_error(pattern: str) -> str | None:
    """Why a pattern cannot run: judged by the engine that will run it, or by Python's where no session is active."""
    context = SparkContext._active_spark_context
    try:
        if context is None:
            re.compile(pattern)
        else:
            context._jvm.java.util.regex.Pattern.compile(f"{FLAGS}(?:{pattern})")
    except (re.error, IllegalArgumentException) as e:
        return str(e)
    return None


def split_patterns(signatures: Iterable[Signature]) -> tuple[list[Signature], list[tuple[str, str, str]]]:
    """Signatures with their usable patterns, and (signature, pattern, error) of the rejected ones."""
    good, bad = [], []
    for s in signatures:
        errors = {p: pattern_error(p) for p in s.patterns}
        bad += [(s.id, p, e) for p, e in errors.items() if e is not None]
        good.append(Signature(**{**s.__dict__, "patterns": tuple(p for p in s.patterns if errors[p] is None)}))
    return good, bad


def catalog_frame(spark: SparkSession, signatures: list[Signature]) -> DataFrame:
    rows = [(s.id, s.name, s.severity, s.category, s.description, s.file) for s in signatures]
    return spark.createDataFrame(rows, SIGNATURE_SCHEMA)


def filter_catalog(
    catalog: DataFrame, search: str | None = None, category: str | None = None, severity: str | None = None
) -> DataFrame:
    if search:
        q = search.lower()
        hit = [F.coalesce(F.lower(c).contains(q), F.lit(False)) for c in ("name", "description", "id")]
        catalog = catalog.filter(hit[0] | hit[1] | hit[2])
    if category:
        catalog = catalog.filter(F.col("category") == category)
    if severity:
        catalog = catalog.filter(F.col("severity") == severity)
    return catalog


def _sql_text(s: str) -> str:
    """SQL string literal; raw where possible, so that backslashes need no second escaping."""
    if "'" not in s:
        return f"r'{s}'"
    if '"' not in s:
        return f'r"{s}"'
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _either(patterns: list[str]) -> str:
    return _sql_text(FLAGS + "|".join(f"(?:{p})" for p in patterns))


def matches(signature: Signature, columns: dict[str, str], gate: str = "gate") -> list[str]:
    """SQL conditions, any of which makes a match: the gated patterns in any field, or the ungated ones.

    ``columns`` names each field's value. Gated patterns run only where one of the substrings they need occurs in ``gate``,
    the folded text of all fields: a substring is searched once a log, not once a field. SQL text, because a catalog
    makes thousands of expressions.
    """
    sets = {p: needed(p) for p in signature.patterns}
    gated = [p for p in signature.patterns if sets[p]]
    open_ = [p for p in signature.patterns if not sets[p]]
    values = [columns[path] for path in signature.fields]
    tests = []
    if gated and values:
        words = sorted(set().union(*[sets[p] for p in gated]))
        present = " OR ".join(f"contains({gate}, {_sql_text(w)})" for w in words)
        tests.append(f"(({present}) AND ({' OR '.join(f'{v} RLIKE {_either(gated)}' for v in values)}))")
    if open_:
        tests += [f"{v} RLIKE {_either(open_)}" for v in values]
    return tests


def gate_text(columns: dict[str, str]) -> Column:
    """The folded text of all fields; a message that the raw line holds anyway isn't repeated."""
    parts = {path: F.col(value) for path, value in columns.items()}
    if "raw" in parts and "message" in parts:
        parts["message"] = F.when(F.contains(parts["raw"], parts["message"]), F.lit(None)).otherwise(parts["message"])
    return F.concat_ws("\n", *parts.values())


def signature_hits(logs: DataFrame, signatures: list[Signature]) -> DataFrame:
    """One row per (log, matching signature): every log is read once, whatever the catalog's size.

    The matches of a log are gathered as text, which needs no lambda and so stays compiled. They
    are split inside the generator: on an aliased array the optimiser would add a size filter and
    run every pattern twice.
    """
    paths = sorted({path for s in signatures for path in s.fields})
    columns = {path: f"value{i}" for i, path in enumerate(paths)}
    values = logs.withColumns({columns[path]: X.non_empty(X.path_value(path)) for path in paths})
    ready = values.withColumn("gate", gate_text(columns)).withColumn("gate", folded(F.col("gate")))
    found = [f"CASE WHEN {test} THEN '{i}' END" for i, s in enumerate(signatures) for test in matches(s, columns)]
    return (
        ready.select(*LOG_INPUT, F.expr(f"concat_ws(',', {', '.join(['NULL', *found])})").alias("found"))
        .select(*LOG_INPUT, F.explode(F.array_distinct(F.split("found", ","))).alias("number"))
        .filter("number <> ''")
        .withColumn("number", F.col("number").cast("int"))
    )


def signature_alerts(logs: DataFrame, signatures: list[Signature]) -> DataFrame:
    if len(signatures) > CATALOG_LIMIT:
        raise ValueError(f"catalog of {len(signatures)} signatures; at most {CATALOG_LIMIT} are tested in one pass")
    catalog = logs.sparkSession.createDataFrame(
        [(i, s.id, s.name, s.severity, s.category, s.description) for i, s in enumerate(signatures)],
        "number int, signature_id string, name string, severity string, category string, description string",
    )
    hits = signature_hits(logs, signatures).join(F.broadcast(catalog), "number")
    return to_alerts(
        hits,
        method=METHOD,
        alert_type=F.coalesce("category", F.lit("signature_match")),
        severity=F.coalesce("severity", F.lit("medium")),
        description=F.concat("name", F.lit(": "), F.coalesce("description", F.lit(""))),
        metadata=payload(
            {
                "signature_id": F.col("signature_id"),
                "signature_name": F.col("name"),
                "category": F.col("category"),
                "host": F.col("host"),
                "appname": F.col("appname"),
                "message": F.col("message"),
                "source_ip": F.col("source_ip"),
                "user": F.col("user"),
            }
        ),
        rule=F.col("signature_id"),
        log_id=F.col("id"),
        source_ip=F.col("source_ip"),
        user=F.col("user"),
        host=F.col("host"),
    )


def blocked_ip_alerts(logs: DataFrame, blocked: DataFrame) -> DataFrame:
    """Logs whose source is on the block list (column ``ip``); the size of the list decides the join."""
    hits = logs.join(blocked.select(F.col("ip").alias("source_ip")), "source_ip", "left_semi")
    return to_alerts(
        hits,
        method=METHOD,
        alert_type=F.lit("blocked_ip_detected"),
        severity=F.lit("high"),
        description=F.concat(F.lit("An address on the block list connected: "), F.col("source_ip")),
        metadata=payload(
            {
                "source_ip": F.col("source_ip"),
                "host": F.col("host"),
                "appname": F.col("appname"),
                "message": F.col("message"),
            }
        ),
        log_id=F.col("id"),
        source_ip=F.col("source_ip"),
        host=F.col("host"),
    )


def hash_frame(spark: SparkSession, signatures: list[Signature]) -> DataFrame:
    rows = {
        value.lower(): (value.lower(), s.id, s.name, s.severity, kind, text or s.description)
        for s in signatures
        for value, kind, text in s.hashes
    }
    return spark.createDataFrame(
        list(rows.values()),
        "hash string, signature_id string, name string, severity string, hash_type string, description string",
    )


def hash_alerts(logs: DataFrame, known: DataFrame) -> DataFrame:
    """Logs that carry a known hash; of several the first found counts."""
    rows = logs.select(
        "id", "host", "appname", "cycle", F.posexplode(X.record_hashes(F.col("fields"), F.col("message"))).alias("pos", "value")
    )
    hits = rows.join(known.withColumnRenamed("hash", "known"), F.lower("value") == F.col("known"))
    names = ["pos", "value", "host", "appname", "signature_id", "name", "severity", "hash_type", "description"]
    first = hits.groupBy("cycle", "id").agg(F.min(F.struct(*names)).alias("hit")).select("cycle", "id", "hit.*")
    return to_alerts(
        first,
        method=METHOD,
        alert_type=F.lit("malicious_hash_detected"),
        severity=F.col("severity"),
        description=F.concat(F.lit("A file known to be harmful: "), F.col("name")),
        metadata=payload(
            {
                "hash_value": F.col("value"),
                "hash_type": F.col("hash_type"),
                "signature_id": F.col("signature_id"),
                "description": F.col("description"),
                "host": F.col("host"),
                "appname": F.col("appname"),
            }
        ),
        log_id=F.col("id"),
        host=F.col("host"),
    )


def all_signature_alerts(logs: DataFrame, signatures: list[Signature], blocked: DataFrame, known: DataFrame) -> DataFrame:
    return union_alerts(
        [signature_alerts(logs, signatures), blocked_ip_alerts(logs, blocked), hash_alerts(logs, known)]
    )
