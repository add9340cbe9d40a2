"""A sample of the registered queries against their SQL; ``tests/compare.py`` runs all of them."""

import os

import pytest

from compare import compare, connection

SF = "/root/testdata/sf0.001"
SAMPLE = "field_extraction ioc_extract baselines all_bursts privilege_escalation_rearm merged_profiles stream_windowed_counts burst_members new_indicators refreshed_baselines".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.mark.parametrize("name", SAMPLE)
def test_equals_sql(spark, name):
    import __spark_entry__ as entry

    ok, note = compare(spark, connection(SF), SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note


def test_every_query_is_a_plan_over_the_tables():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_counts_of_all_windows(spark):
    """Also of those that the watermark has not passed."""
    import __spark_entry__ as entry

    queries, name = entry.queries(), "stream_all_windowed_counts"
    ok, note = compare(spark, connection(SF), SF, name, queries[name], entry.oracle_sql()[name])
    assert ok, note
    assert queries[name](spark, SF).agg({"n": "sum"}).first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()
