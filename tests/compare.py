"""Run registered queries in Spark and their SQL in DuckDB and compare the rows.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session(cores: str = os.environ.get("BENCH_CPUS", "8")):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir: str, name: str, query, sql: str) -> tuple[bool, str]:
    start = time.time()
    got_df = query(spark, sf_dir).toPandas()
    spent = time.time() - start
    start = time.time()
    want_df = con.execute(sql).df()
    other = time.time() - start
    if sorted(got_df.columns) != sorted(want_df.columns):
        return False, f"columns {sorted(got_df.columns)} / {sorted(want_df.columns)}"
    key = lambda r: tuple(str(v) for v in r)
    got = sorted((key(r) for r in _plain(got_df)))
    want = sorted((key(r) for r in _plain(want_df)))
    note = f"rows {len(got)} spark {spent:.1f}s sql {other:.1f}s"
    if got == want:
        return bool(got), note + ("" if got else " EMPTY")
    extra = [r for r in got if r not in set(want)][:2]
    missing = [r for r in want if r not in set(got)][:2]
    return False, f"{note} want {len(want)}\n    columns {sorted(got_df.columns)}\n    only spark {extra}\n    only sql {missing}"


def _plain(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    for r in pdf.itertuples(index=False, name=None):
        yield tuple("~" if pd.isna(v) else (float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v) for v in r)


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    import __spark_entry__ as entry

    spark, con = session(), connection(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args[1:] or queries:
        try:
            if name in oracles:
                ok, note = compare(spark, con, sf_dir, name, queries[name], oracles[name])
            else:
                start = time.time()
                n = queries[name](spark, sf_dir).count()
                ok, note = n > 0, f"rows {n} (no sql) {time.time() - start:.1f}s"
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print(f"{bad} failed of {len(args[1:] or queries)}")
    return bad


if __name__ == "__main__":
    sys.exit(main())
