"""From raw documents to shuffled shards: every stage applies one operator to all that the one before it kept.

A row is identified by its doc_id; rows that share one are taken for versions of one document and share decisions
that are made by id.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm import leaks, mixing, near, shards, toxicity
from emberwatch.llm.common import release_driver_memory, written


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _staged(stage: Stage) -> Stage:
    """The stage, begun with a release of the driver's memory.

    A driver with room left collects seldom, and keeps what finished plans leave stage after stage.
    """

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release_driver_memory(spark)
        return stage(spark, docs, sf_dir)

    return run


def _with_decisions(docs: DataFrame, decisions: DataFrame, how: str) -> DataFrame:
    """``docs`` as d joined to ``decisions`` as x by doc_id, null ids included."""
    return docs.alias("d").join(decisions.alias("x"), F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")), how)


@_staged
def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that aren't predicted to be toxic. Of rows without doc_id all go only if all are toxic."""
    scored = toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    bad = scored.groupBy("doc_id").agg(F.when(F.col("doc_id").isNull(), F.min("predicted")).otherwise(F.max("predicted")).alias("bad"))
    return _with_decisions(docs, bad.where("bad = 1").select("doc_id"), "left_anti")


@_staged
def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, the one with the smallest doc_id; equal rows are kept once."""
    rows = near.near_duplicates(docs, k=5, percent=80)
    copies = written(rows.where("NOT kept").select("doc_id").distinct())
    left = _with_decisions(docs, copies, "left_anti")
    repeated = written(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    return _with_decisions(left, repeated, "left_anti").unionByName(_with_decisions(left, repeated, "left_semi").distinct())


@_staged
def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no item of the benchmark."""
    return leaks.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), inside=True)


@_staged
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it: its words taken over its words, rounded; a row without words once.

    The mix ends inside one document of a source at most, the only one that is rounded.
    """
    taken = mixing.taken(docs).groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    times = F.expr("if(size > 0, cast(round(taken / size) AS int), 1)")
    times = written(taken.select("doc_id", times.alias("times")))
    rows = _with_decisions(docs, times, "inner").where("x.times > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("x.times")))).select("d.*")


@_staged
def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every row in 40 shuffled shards; nothing is dropped."""
    return shards.assign(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_copies),
    ("decontamination", without_leaks),
    ("mixing", mixed),
    ("sharding", sharding),
]

#: A recurrent network decides in the first stage; SQL cannot say that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards of all documents that pass, see ``STAGES``; a stage's result is written and read by the next.

    Texts that are null or empty pass every stage; whole texts are judged, whatever their length. Of repeated rows one
    stays. Without labels nothing is toxic, without a benchmark nothing leaks, and without documents there are no rows.
    Extra columns of the documents are carried through all stages but the last, whatever their names.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
