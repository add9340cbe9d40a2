"""Signature, rule and block-list files.

Catalogs are configuration: a folder of small YAML files, read through Spark so that any file
system works, and parsed on the driver. A broken file or pattern is reported and the rest is used.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.operators.rules import Rule
from emberwatch.operators.signatures import Signature, split_patterns

try:
    import yaml
except ImportError:
    yaml = None

log = logging.getLogger(__name__)
MAX_BYTES = 64 * 1024 * 1024


@dataclass
class Catalog:
    signatures: list[Signature] = field(default_factory=list)
    rejected: list[tuple[str, str, str]] = field(default_factory=list)
    unreadable: dict[str, str] = field(default_factory=dict)


def _yaml_files(spark: SparkSession, folder: str) -> dict[str, str]:
    if yaml is None:
        raise ImportError("reading catalog files needs PyYAML")
    files = spark.read.option("pathGlobFilter", "*.yaml").text(folder, wholetext=True)
    named = files.select("value", "_metadata.file_name", "_metadata.file_size")
    size = named.agg(F.coalesce(F.sum("file_size"), F.lit(0))).first()[0]
    if size > MAX_BYTES:
        raise ValueError(f"{folder} holds {size} bytes of YAML; that is no catalog")
    return {r["file_name"]: r["value"] for r in named.orderBy("file_name").collect()}


def _parse(files: dict[str, str]) -> tuple[dict[str, dict], dict[str, str]]:
    good, bad = {}, {}
    for name, text in files.items():
        try:
            data = yaml.safe_load(text)
            if isinstance(data, dict):
                good[name] = data
        except yaml.YAMLError as e:
            log.error("catalog file %s: %s", name, e)
            bad[name] = str(e)
    return good, bad


def _signature(d: dict, file: str) -> Signature:
    return Signature(
        id=d["id"],
        name=d["name"],
        severity=d.get("severity", "medium"),
        category=d.get("category", "signature_match"),
        description=d.get("description", ""),
        patterns=tuple(p["regex"] for p in d.get("patterns", []) if "regex" in p),
        fields=tuple(d.get("fields", ("raw", "message"))),
        hashes=tuple((h["value"], h.get("type", "md5"), h.get("description", "")) for h in d.get("hashes", [])),
        file=file,
    )


def read_signatures(spark: SparkSession, folder: str) -> Catalog:
    good, bad = _parse(_yaml_files(spark, folder))
    found = [_signature(d, name) for name, data in good.items() for d in data.get("signatures") or []]
    usable, rejected = split_patterns(found)
    for signature, pattern, error in rejected:
        log.error("signature %s: pattern %r: %s", signature, pattern, error)
    return Catalog(usable, rejected, bad)


def read_rules(spark: SparkSession, folder: str) -> list[Rule]:
    """Rules from files with a ``rules`` list or with one rule each."""
    rules = []
    for name, data in _parse(_yaml_files(spark, folder))[0].items():
        if "rules" in data:
            rules += [Rule.from_dict(d, name) for d in data["rules"] or []]
        elif "signatures" not in data and ("id" in data or "name" in data):
            rules.append(Rule.from_dict(data, name))
    return rules


def read_blocked_ips(spark: SparkSession, path: str) -> DataFrame:
    """One address per line; blank lines and lines starting with # are skipped."""
    line = F.trim("value")
    kept = spark.read.text(path).select(line.alias("ip")).filter((F.length("ip") > 0) & ~F.col("ip").startswith("#"))
    return kept.distinct()
