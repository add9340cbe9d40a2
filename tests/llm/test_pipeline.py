"""The pipeline on rows made for each of its stages, and the registered queries."""

from __future__ import annotations

import os
import re
from pathlib import Path

import brute
import pytest
from test_other_operators import toxic_texts
from test_text_operators import QUESTION

import corpus_pipeline
from emberwatch.llm import common

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "ab"[i % 2]) for i, t, _ in toxic_texts(n=800)]
    body = [f"term{i}" for i in range(80)]
    rows += [(9000 + i, " ".join([*body[:i], "other", *body[i + 1 :]]), "a") for i in range(6)]  # near copies
    rows += [(9500, "Some words before. " + QUESTION, "b"), (9600, None, None), (None, "no id at all", "a"), (9700, "", "b")]
    brute.table(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, y) for i, _, y in toxic_texts(n=800)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, QUESTION)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, folder))
        seen[name] = [r.doc_id for r in docs.collect()]
        assert name == "sharding" or docs.columns == columns
    toxic = {i for i, _, y in toxic_texts(n=800) if y}
    clean = {i for i, _, y in toxic_texts(n=800) if not y}
    assert len(toxic - set(seen["toxicity"])) > 0.9 * len(toxic) and len(clean & set(seen["toxicity"])) > 0.95 * len(clean)
    assert {9000, 9500, 9600, 9700, None} <= set(seen["near_duplicates"]) and not {9001, 9005} & set(seen["near_duplicates"])
    assert 9500 not in seen["decontamination"] and {9000, 9600, 9700, None} <= set(seen["decontamination"])
    assert sorted(seen["mixing"], key=str) == sorted(seen["sharding"], key=str)


@pytest.mark.parametrize("table", ["documents", "labels", "benchmark"])
def test_empty_tables_and_repeated_rows(spark, folder, tmp_path, table):
    for name in ("documents", "labels", "benchmark"):
        rows = spark.read.parquet(f"{folder}/{name}.parquet")
        if name == "documents":
            rows = rows.unionByName(rows)
        (rows.limit(0) if name == table else rows).write.parquet(f"{tmp_path}/{name}.parquet")
    if table == "documents":
        assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    else:
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:3]:
            docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)))
        got = [r.doc_id for r in docs.collect()]
        assert {9000, 9600, 9700, None} <= set(got) and (9500 in got) == (table == "benchmark")
        assert got.count(9600) == got.count(9700) == 1 and not {9001, 9005} & set(got)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and [n for n in range(1, 14) if not any(x.startswith(f"op{n}_") for x in names)] == []
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", ["op4_mixing", "op10_near_duplicates", "op12_vector_codes", "op13_hard_negatives"])
@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_equals_sql(spark, name):
    import __spark_entry__ as entry
    from compare import compare, connection

    ok, note = compare(spark, connection(SF), SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note


def test_stages_begin_with_a_collection_on_the_driver(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    for _, stage in corpus_pipeline.STAGES:
        assert stage.__wrapped__
    assert corpus_pipeline._staged(lambda spark, docs, sf_dir: docs)(spark, None, "") is None and full() > before


def test_the_driver_gives_back_what_java_freed_outside_its_heap(spark, monkeypatch):
    jvm = spark.sparkContext._jvm
    status = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status")
    mb = lambda: int(re.search(r"RssAnon:\s+(\d+)", status.read_text())[1]) / 1024
    frame = spark.range(3)
    common.written(frame)  # what the first write loads is there
    packers = [jvm.java.util.zip.Deflater() for _ in range(1200)]  # some 260 KB each outside the heap
    for i, packer in enumerate(packers):
        if i % 20:
            packer.end()
    before = mb()
    monkeypatch.setattr(common, "_released", float("-inf"), raising=False)
    assert common.written(frame).count() == 3
    assert before - mb() > 100
    released = common._released
    common.written(frame)  # not again after so short a time
    assert common._released == released > float("-inf")
    for packer in packers[::20]:
        packer.end()
