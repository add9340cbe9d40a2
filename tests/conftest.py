from __future__ import annotations

import json
import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

T0 = datetime(2024, 3, 4, 10, 0, 0)  # a Monday
AS_OF = "2024-03-04 12:00:00"


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


def log(i, seconds=None, message=None, normalized=None, host=None, **more) -> dict:
    t = None if seconds is None else T0 + timedelta(seconds=seconds)
    return {
        "id": str(i),
        "timestamp": None if t is None else t.isoformat() + "Z",
        "message": message,
        "normalized": None if normalized is None else json.dumps(normalized),
        "host": host,
        "ingestion_time": t or T0,
        **more,
    }


@pytest.fixture
def prepared(spark):
    """Rows to a prepared frame in one cycle."""
    from emberwatch.functions import fields as X
    from emberwatch.schema import LOG_SCHEMA

    def make(rows: list[dict], **options) -> DataFrame:
        data = [tuple(r.get(n) for n in LOG_SCHEMA.fieldNames()) for r in rows]
        return X.in_cycles(X.prepare(spark.createDataFrame(data, LOG_SCHEMA), **options), AS_OF)

    return make
