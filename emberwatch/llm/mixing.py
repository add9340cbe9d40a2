"""Mixing sources to target weights by a low-discrepancy schedule.

Every source is shuffled, read as one stream of words (repeated where the target asks for more than the source
has) and cut into blocks of equal length. The slots of the schedule carry van der Corput points, which fall into
the sources' parts of the unit interval; the slots of a source are ranked, and slot r takes block r. So any stretch
of the schedule holds the sources in nearly their target shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.llm.common import text_or_empty, word_count, written

#: Words in a block, before blocks of a source are made equal.
BLOCK_WORDS = 1024
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source is repeated more often.
MOST_EPOCHS = 3
#: Hex digits of the shuffle key that make up a bucket of a source; each bucket is sorted by itself.
BUCKET_DIGITS = 2
#: Coarse stretches of the schedule in which slots are ranked.
STRETCHES = 512


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """``source``, ``source_size`` to ``source``, ``source_size``, ``target``: shares of the total by weight.

    A target stops at ``most`` times its source's size and the excess goes to the others by weight. Sorted by
    cap over weight, the capped sources come first, and the common factor of the others is the largest of
    (total - caps before) / (weights from here on). One row a source: the windows see that table only.
    """
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    nth = (F.row_number().over(by_name) - 1) % len(weights)
    rows = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), nth + 1).cast("double"))
    rows = rows.withColumn("_cap", (F.col("source_size") * most).cast("double"))
    by_cap = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before, onward = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    rows = rows.withColumn("_factor", left / F.sum("_w").over(onward))
    rows = rows.withColumn("_factor", F.max("_factor").over(everything))
    return rows.select("source", "source_size", F.least("_cap", F.col("_factor") * F.col("_w")).alias("target"))


def streams(docs: DataFrame, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """Sizes of the sources, and the documents with the start of their words in their source's shuffled stream."""
    rows = docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        word_count(text_or_empty()).alias("size"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_key"),
    )
    rows = written(rows.withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS)))
    buckets = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_size"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = buckets.select("source", "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    within = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size")
    within = within.rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    a, b = placed.alias("a"), shifts.alias("b")
    same = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a._bucket") == F.col("b._bucket"))
    placed = a.join(b, same).select("a.doc_id", "a.source", "a.size", (F.col("_shift") + F.col("_inner")).alias("offset"))
    sizes = buckets.groupBy("source").agg(F.sum("_size").alias("source_size"))
    return sizes, placed


def schedule(sources: DataFrame) -> DataFrame:
    """Slots (slot, source, rank) for ``sources`` (source, target, blocks): van der Corput points in weight order.

    With 2^k slots the points are the bit reversals of the slot numbers over 2^k, so a source's part of the interval
    is a run of points, made here piece by piece, and each source gets at least as many slots as it has blocks.
    """
    wanted = sources.agg(F.sum("blocks")).first()[0] or 0
    bits = max(1, int(wanted - 1).bit_length()) if wanted else 1
    slots = 1 << bits
    upto = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    part = F.floor(F.sum("blocks").over(upto).cast("decimal(38,0)") * slots / max(1, wanted)).cast("long")
    parts = sources.withColumn("_to", part).withColumn(
        "_from", F.coalesce(F.lag("_to").over(Window.orderBy(F.col("source").asc_nulls_last())), F.lit(0))
    )
    piece = 1 << 16
    runs = parts.where("_to > _from").select(
        "source", "_to", F.explode(F.sequence("_from", F.col("_to") - 1, F.lit(piece).cast("long"))).alias("_first")
    )
    points = runs.repartition("source", "_first").select(
        "source", F.explode(F.sequence("_first", F.least(F.col("_to"), F.col("_first") + piece) - 1)).alias("_point")
    )
    slot = F.conv(F.reverse(F.lpad(F.bin("_point"), bits, "0")), 2, 10).cast("long")
    points = points.select("source", slot.alias("slot"))
    points = points.withColumn("_stretch", F.shiftright("slot", max(0, bits - (STRETCHES.bit_length() - 1))))
    counts = points.groupBy("source", "_stretch").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("source").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("source", "_stretch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    within = Window.partitionBy("source", "_stretch").orderBy("slot")
    ranked = points.withColumn("_rank", F.row_number().over(within) - 1).alias("a")
    shifts = shifts.alias("b")
    same = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a._stretch") == F.col("b._stretch"))
    return ranked.join(shifts, same).select("a.slot", "a.source", (F.col("_shift") + F.col("_rank")).alias("rank"))


def mixed(docs: DataFrame, block_words: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS,
          seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """The documents with offset, source_size and target, and the mix: which words of which document each slot takes.

    The mix has slot, source, rank (the block), doc_id, size, offset (together the document's row), epoch, start and
    length (words of the document, from 0). A document is cut where a block ends.
    """
    sizes, placed = streams(docs, seed)
    sources = targets(sizes, weights, most).withColumn("_take", F.floor("target").cast("long"))
    sources = sources.withColumn("blocks", F.ceil(F.col("_take") / F.lit(block_words)).cast("long"))
    sources = written(sources)  # one row a source, used by all that follows
    slots = schedule(sources)
    a, b = placed.alias("a"), sources.withColumn("_block", F.expr("if(blocks > 0, ceil(_take / blocks), 1)")).alias("b")
    rows = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source"))).select(
        "a.doc_id", "a.source", "a.size", "a.offset", "b.source_size", "b.target", "b._take", "b._block"
    )
    parts = rows.where("size > 0 and _take > 0").withColumn(
        "epoch", F.explode(F.sequence(F.lit(0), F.expr("cast((_take - 1) div source_size as int)")))
    )
    parts = parts.withColumn("_from", F.expr("epoch * source_size + offset"))
    parts = parts.withColumn("_to", F.expr("least(_from + size, _take)")).where("_to > _from")
    parts = parts.withColumn("rank", F.explode(F.expr("sequence(_from div _block, (_to - 1) div _block)")))
    parts = parts.withColumn("start", F.expr("greatest(_from, rank * _block) - _from"))
    parts = parts.withColumn("length", F.expr("least(_to, (rank + 1) * _block) - _from - start"))
    p, s = parts.alias("p"), slots.alias("s")
    same = F.col("p.source").eqNullSafe(F.col("s.source")) & (F.col("p.rank") == F.col("s.rank"))
    mix = p.join(s, same).select(
        "s.slot", "p.source", "p.rank", "p.doc_id", "p.size", "p.offset", "p.epoch", "p.start", "p.length"
    )
    return rows, mix


def taken(docs: DataFrame, **options) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): size in words, source_size, target of its source, and words taken.

    Words taken count repeats and are at most ``most`` times the size; per source they add up to the target, rounded
    down. Null text is empty; empty texts have size 0 and nothing is taken. Null is a source of its own, the last.
    Null and repeated ids are rows like others. The result depends on ids, sizes and sources only, so reruns agree.
    An empty table gives an empty result. Other columns are ignored.
    """
    rows, mix = mixed(docs, **options)
    nothing = rows.select("doc_id", "source", "size", "offset", F.lit(0).cast("long").alias("length"), "source_size", "target")
    some = mix.select("doc_id", "source", "size", "offset", "length", F.lit(None).cast("long").alias("source_size"),
                      F.lit(None).cast("double").alias("target"))
    # Rows that agree in id, source, size and offset are rows without words, or repeats of them: counted, not merged.
    seen = F.count("source_size").alias("_rows")
    return (
        nothing.unionByName(some)
        .groupBy("doc_id", "source", "size", "offset")
        .agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("length").alias("taken"), seen)
        .withColumn("_one", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int"))))
        .select("doc_id", "size", "source_size", "target", "taken", "source", "offset")
    )
