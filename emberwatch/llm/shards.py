"""Sharding by a keyed permutation of row numbers.

Rows get a dense global number; a Feistel network with cycle walking permutes the numbers, so the permuted
number is a reproducible shuffle position, and shard and slot are its remainder and quotient. Anyone who
knows a row's number, the row count and the seed can compute both without looking at other rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.llm.common import text_or_empty, written

#: Hash buckets in which rows are numbered: each is sorted by itself, and only their counts meet in one task.
NUMBERING_BUCKETS = 4096
ROUNDS = 6
#: Steps of a walk after the first; a longer walk has a chance below 1e-70 (see ``permuted``) and raises.
WALK = 64


def numbered(rows: DataFrame, by: list[str], buckets: int = NUMBERING_BUCKETS) -> DataFrame:
    """``rows`` with ``row_number`` from 0, dense over all rows, in an order that depends on the values of ``by`` only.

    Rows are dealt into hash buckets of ``by``, numbered inside each and shifted by the counts of the buckets
    before it. Rows equal in all of ``by`` are told apart arbitrarily. ``rows`` is read twice: pass a written table.
    """
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    within = Window.partitionBy("_bucket").orderBy(*[F.col(c).asc_nulls_first() for c in by])
    return (
        dealt.withColumn("_rank", F.row_number().over(within))
        .join(F.broadcast(shifts), "_bucket")  # one row for each of the buckets at most
        .withColumn("row_number", F.col("_shift") + F.col("_rank") - 1)
        .drop("_bucket", "_rank", "_shift")
    )


def permuted(number: str, n: int, seed: int, rounds: int = ROUNDS) -> str:
    """SQL text: the position of row ``number`` (0 to n-1) in the shuffle.

    The network works on pairs (a, b) of a grid of at least n and less than n + sqrt(n) + 1 cells. A cell beyond
    n - 1 is fed in again until it falls inside. Fewer than sqrt(n) + 1 cells lie beyond, which bounds the walk
    for small n; for large n each step stays outside with a chance of about 1 / sqrt(n).
    """
    rows = max(1, math.isqrt(max(0, n - 1)) + 1)
    columns = max(1, -(-n // rows))
    steps = min(WALK, rows * columns - n + 1)

    def network(x: str) -> str:
        return (
            f"aggregate(sequence(1, {rounds}), named_struct('a', {x} div {columns}L, 'b', {x} % {columns}L), (c, i) -> "
            f"if(i % 2 = 1, named_struct('a', (c.a + pmod(xxhash64({seed}L, i, c.b), {rows}L)) % {rows}L, 'b', c.b), "
            f"named_struct('a', c.a, 'b', (c.b + pmod(xxhash64({seed}L, i, c.a), {columns}L)) % {columns}L)), "
            f"c -> c.a * {columns}L + c.b)"
        )

    walked = f"aggregate(sequence(1, {steps}), {network(number)}, (y, j) -> if(y < {n}L, y, {network('y')}))"
    return f"transform(array({walked}), z -> if(z < {n}L, z, raise_error('walk too long')))[0]"


def assign(docs: DataFrame, shards: int = 40, seed: int = 2024) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its shard and slot; the law is ``rows``: counts differ by one at most.

    Returns doc_id, size (UTF-8 bytes of the text plus 16; a null text has no bytes), text_crc32 (a null text counts
    as empty), law, shard, slot (gapless from 0 in each shard), grown_shard (null: the law is not ``key``) and
    position (the row's place in the global shuffle). Null and repeated ids are rows like others; repeated rows get
    slots of their own. An empty table gives an empty result. Other columns are ignored.
    """
    rows = written(
        docs.select(
            "doc_id",
            (F.octet_length(text_or_empty()) + 16).cast("long").alias("size"),
            F.crc32(text_or_empty()).alias("text_crc32"),
        )
    )
    n = rows.count()
    place = F.expr(permuted("row_number", n, seed))
    return (
        numbered(rows, ["doc_id", "size", "text_crc32"])
        .withColumn("position", place)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            (F.col("position") % shards).cast("int").alias("shard"),
            F.expr(f"position div {shards}").cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "position",
        )
    )
