"""Table contracts: logs, alerts, threat indicators, baselines and user profiles."""

from __future__ import annotations

from pyspark.sql import types as T

LOG_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("timestamp", T.StringType()),
        T.StructField("raw", T.StringType()),
        T.StructField("appname", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("hostname", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("procid", T.IntegerType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("normalized", T.StringType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("ingestion_time", T.TimestampType()),
    ]
)

# Every detector returns exactly these columns.
ALERT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("log_id", T.StringType()),
        T.StructField("alert_type", T.StringType()),
        T.StructField("detection_method", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("acknowledged", T.BooleanType()),
        T.StructField("priority_score", T.DoubleType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("dest_ip", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("host", T.StringType()),
    ]
)

THREAT_INTEL_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("indicator_type", T.StringType()),
        T.StructField("indicator_value", T.StringType()),
        T.StructField("threat_type", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("source", T.StringType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("expires_at", T.TimestampType()),
    ]
)

RULE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("rule_name", T.StringType()),
        T.StructField("rule_type", T.StringType()),
        T.StructField("rule_definition", T.StringType()),
        T.StructField("enabled", T.BooleanType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

BASELINE_SCHEMA = T.StructType(
    [
        T.StructField("metric", T.StringType(), False),
        T.StructField("mean", T.DoubleType()),
        T.StructField("std", T.DoubleType()),
        T.StructField("median", T.DoubleType()),
        T.StructField("q1", T.DoubleType()),
        T.StructField("q3", T.DoubleType()),
        T.StructField("iqr", T.DoubleType()),
        T.StructField("min", T.DoubleType()),
        T.StructField("max", T.DoubleType()),
        T.StructField("count", T.LongType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

SIGNATURE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("name", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("file", T.StringType()),
    ]
)

# One row per (user, facet, item): the long form of a behaviour profile.
PROFILE_SCHEMA = T.StructType(
    [
        T.StructField("user", T.StringType(), False),
        T.StructField("facet", T.StringType(), False),
        T.StructField("item", T.StringType(), False),
        T.StructField("n", T.LongType(), False),
    ]
)

ALERT_COLUMNS = ALERT_SCHEMA.fieldNames()
LOG_COLUMNS = LOG_SCHEMA.fieldNames()
