"""Hard negatives: for an anchor and a positive, the best rows of other labels that score nearly as well as the positive.

Candidates are sorted along a Hilbert curve and written to Parquet in blocks, each with a zone map: the least and largest
value of every dimension and of the label. An anchor's windows are intervals of scores: from the fifth best positive of its
own block upwards, then from a share of each positive's score up to that score. Interval arithmetic over a zone map bounds
the scores that a block can hold; an anchor reads the blocks whose bounds meet one of its windows, and no others.
Anchors go in chunks; chunks and groups of zone maps, then chunks and blocks, meet by equal keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.llm import hilbert
from emberwatch.llm.common import finite, shipped, usual_width, written

#: Rows of a block, anchors of a chunk, zone maps of a group, rows that a task sorts.
BLOCK, CHUNK, ZONES, TASK_ROWS = 512, 512, 512, 16_384
#: Copies of a chunk, over which its blocks are dealt.
DEALT = 16
#: Bits a dimension of the Hilbert curve.
BITS = 3
#: Scores of other labels that an anchor keeps from its own block.
HOME = 64
#: Finds that a task holds before it keeps only the best of each window.
HELD = 500_000
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
#: Up to this size sums of whole numbers in doubles are exact, in any order.
EXACT = float(1 << 53)


def _floats(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<f8")


def _longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8")


def _stored(x: np.ndarray) -> bytes:
    """Whole numbers in the narrowest type that holds them, named by the first byte."""
    most = np.abs(x).max() if x.size else 0
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    return kind[1:2].encode() + kind[2:].encode() + x.astype(kind).tobytes()


def _restored(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, "<" + data[:2].decode(), offset=2).astype(float).reshape(-1, width)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers held in doubles, exactly; what a long can't hold is cut to its ends."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < EXACT:
        return a @ b.T
    whole = np.array([[int(v) for v in r] for r in a], object) @ np.array([[int(v) for v in r] for r in b], object).T
    return np.clip(whole, LOWEST, HIGHEST)


def bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each row of ``a`` with a point of each box, a little widened for rounding."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    with np.errstate(over="ignore", invalid="ignore"):
        slack = 1e-9 * (np.abs(a) @ np.maximum(np.abs(lo), np.abs(hi)).T)
        least, most = up @ lo.T + down @ hi.T - slack, up @ hi.T + down @ lo.T + slack
    least, most = np.where(np.isnan(least), -np.inf, least), np.where(np.isnan(most), np.inf, most)
    return np.clip(least, float(LOWEST), float(HIGHEST)), np.clip(most, float(LOWEST), float(HIGHEST))


def best_of(group: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Which finds are the k best of their group; ties go to the smaller id."""
    order = np.lexsort((ids, -s, group))
    g = group[order]
    first = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, int)
    rank = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
    return order[rank < k]


def _keyed(width: int, scale: int, lo: np.ndarray, hi: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(np.asarray(batch.column("vector").flatten(), dtype=float).reshape(-1, width) * scale)
            keys = hilbert.keys(hilbert.cells(x, lo, hi, BITS), BITS)
            columns = [pa.array([k.tobytes() for k in keys], pa.binary()), batch.column("vec_id"), batch.column("label"), batch.column("asks")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([v.tobytes() for v in x.astype("<f8")], pa.binary())], ["key", "vec_id", "label", "asks", "vector"])

    return run


BLOCKS = "block long, n int, low_label long, high_label long, ids binary, labels binary, asks binary, lo binary, hi binary, vectors binary"


def _blocked(size: int):
    """Sorted rows to blocks, numbered by task."""

    def made(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        x = _floats(b"".join(t.column("vector").to_pylist())).reshape(len(t), -1)
        labels = t.column("label").to_numpy().astype("<i8")
        row = {
            "block": number, "n": len(t), "low_label": int(labels.min()), "high_label": int(labels.max()),
            "ids": t.column("vec_id").to_numpy().astype("<i8").tobytes(), "labels": labels.tobytes(),
            "asks": np.array(t.column("asks").to_pylist(), np.uint8).tobytes(),
            "lo": x.min(axis=0).tobytes(), "hi": x.max(axis=0).tobytes(), "vectors": _stored(x),
        }
        types = {"block": pa.int64(), "n": pa.int32(), "low_label": pa.int64(), "high_label": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array([v], types.get(c, pa.binary())) for c, v in row.items()], list(row))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                end = min(batch.num_rows, at + size - n)
                held.append(batch.slice(at, end - at))
                n, at = n + end - at, end
                if n == size:
                    yield made(number, held)
                    number, held, n = number + 1, [], 0
        if n:
            yield made(number, held)

    return run


ANCHORS = "block long, vec_id long, label long, vector binary, least long, home binary"


def _anchors(width: int, k: int):
    """The anchors of blocks, with what their own block tells: the k-th positive's score, and the best scores of other labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels, x = _longs(row["ids"]), _longs(row["labels"]), _restored(row["vectors"], width)
                ask = np.flatnonzero(np.frombuffer(row["asks"], np.uint8))
                if not len(ask):
                    continue
                found = scores(x[ask], x).astype(np.int64)
                least, home = [], []
                for a, s in zip(ask, found, strict=True):
                    mine = np.sort(s[(labels == labels[a]) & (ids != ids[a])])
                    least.append(int(mine[-k]) if len(mine) >= k else LOWEST)
                    home.append(np.sort(s[labels != labels[a]])[::-1][:HOME].astype("<i8").tobytes())
                vectors = pa.array([v.tobytes() for v in x[ask]], pa.binary())
                columns = [pa.array(np.full(len(ask), row["block"])), pa.array(ids[ask]), pa.array(labels[ask]), vectors, pa.array(least, pa.int64()), pa.array(home, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["block", "vec_id", "label", "vector", "least", "home"])

    return run


def upwards(member: dict) -> list[tuple[int, int]]:
    """The window of an anchor's positives: from the score that its own block's k-th positive reaches."""
    return [(member["least"], HIGHEST)]


def below(tops: list[int], home: np.ndarray, k: int, percent: int) -> list[tuple[int, int]]:
    """The windows of the negatives of positives that score ``tops``: from ``percent`` of a score up to it.

    ``home`` holds the best scores of other labels in the anchor's own block, best first; with k of them in a window the
    k-th is its lower end, as no worse row can be among the first k.
    """
    out = []
    for top in tops:
        low, inside = -(-percent * top // 100), home[home <= top]
        out.append((max(low, int(inside[k - 1])) if len(inside) >= k else low, top))
    return out


def _packed(windows, number: int):
    """Members of chunks to columns; an anchor with fewer than ``number`` windows has empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                members = row["members"]
                ends = [([*windows(m)] + [(HIGHEST, LOWEST)] * number)[:number] for m in members]
                ends = np.array(ends, "<i8").reshape(len(members), number, 2)
                longs = [np.array([m[c] for m in members], "<i8").tobytes() for c in ("vec_id", "label")]
                vectors = _stored(_floats(b"".join(m["vector"] for m in members)))
                columns = [*longs, vectors, ends[:, :, 0].tobytes(), ends[:, :, 1].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]], pa.int64()), *(pa.array([c], pa.binary()) for c in columns)], ["chunk", "ids", "labels", "vectors", "low", "high"])

    return run


def _zones(size: int):
    """Zone maps, ``size`` a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                some = batch.slice(at, size)
                longs = [some.column(c).to_numpy().astype("<i8").tobytes() for c in ("block", "low_label", "high_label")]
                boxes = [b"".join(some.column(c).to_pylist()) for c in ("lo", "hi")]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (*longs, *boxes)], ["blocks", "low_labels", "high_labels", "lo", "hi"])

    return run


def _chosen(width: int, others: bool):
    """Chunks beside zone maps to rows (chunk, block, picks): a bit for each anchor of the chunk, set if it must read the block.

    ``low`` and ``high`` hold the windows of an anchor, any number of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                blocks, low_label, high_label = (_longs(row[c]) for c in ("blocks", "low_labels", "high_labels"))
                lo, hi = (_floats(row[c]).reshape(-1, width) for c in ("lo", "hi"))
                labels, a = _longs(row["labels"])[:, None], _restored(row["vectors"], width)
                least, most = bounds(a, lo, hi)
                holds = (low_label < high_label) | (low_label != labels) if others else (low_label <= labels) & (labels <= high_label)
                low, high = (_longs(row[c]).reshape(len(a), -1) for c in ("low", "high"))
                meets = np.zeros(holds.shape, bool)
                for w in range(low.shape[1]):
                    meets |= (low[:, w, None] <= most) & (least <= high[:, w, None])
                reads = holds & meets
                used = np.flatnonzero(reads.any(axis=0))
                picks = pa.array([np.packbits(reads[:, i]).tobytes() for i in used], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), row["chunk"])), pa.array(blocks[used]), picks], ["chunk", "block", "picks"])

    return run


def _read(width: int, k: int, others: bool, chunk: int):
    """Rows of a chunk beside a block: the k best of each window of each anchor that reads the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def best() -> tuple[np.ndarray, ...]:
            anchor, window, ids, s = (np.concatenate(c) for c in zip(*held, strict=True))
            keep = best_of(anchor * 1024 + window, ids, s, k)
            return anchor[keep], window[keep], ids[keep], s[keep]

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in best()], ["anchor", "window", "vec_id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                picks = np.flatnonzero(np.unpackbits(np.frombuffer(row["picks"], np.uint8)))
                ids, labels, b = _longs(row["ids"]), _longs(row["labels"]), _restored(row["block_vectors"], width)
                own, mine = _longs(row["chunk_ids"])[picks], _longs(row["chunk_labels"])[picks]
                s = scores(_restored(row["vectors"], width)[picks], b)
                fits = (mine[:, None] != labels) if others else (mine[:, None] == labels) & (own[:, None] != ids)
                low, high = (_longs(row[c]).reshape(len(row["chunk_ids"]) // 8, -1)[picks] for c in ("low", "high"))
                for w in range(low.shape[1]):
                    i, j = np.nonzero(fits & (s >= low[:, w, None]) & (s <= high[:, w, None]))
                    if not len(i):
                        continue
                    found = s[i, j].astype(np.int64)
                    keep = best_of(i, ids[j], found, k)
                    held.append((row["chunk"] * chunk + picks[i[keep]], np.full(len(keep), w), ids[j[keep]], found[keep]))
                    n += len(keep)
                if n > HELD:
                    held[:] = [best()]
                    n = len(held[0][0])
                    if n > HELD // 2:  # many anchors: leave them to the next step
                        yield out()
                        held.clear()
                        n = 0
        if held:
            yield out()

    return run


def _found(chunks: DataFrame, blocks: DataFrame, zones: DataFrame, chunk_numbers: int, chunk: int, width: int, k: int, others: bool) -> DataFrame:
    """The k best candidates (anchor, window, vec_id, score, rank) of every window of ``chunks``."""
    asked = chunks.select("chunk", "labels", "vectors", "low", "high")
    every = zones.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunk_numbers - 1)).cast("array<long>")))
    chosen = every.join(asked, "chunk").mapInArrow(_chosen(width, others), "chunk long, block long, picks binary")
    chosen = written(chosen).withColumn("deal", F.pmod(F.xxhash64("block"), F.lit(DEALT)))
    copies = chunks.select("chunk", F.col("ids").alias("chunk_ids"), F.col("labels").alias("chunk_labels"), "vectors", "low", "high")
    copies = copies.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1)).cast("array<long>")))
    read = chosen.join(blocks.select("block", "ids", "labels", F.col("vectors").alias("block_vectors")), "block").join(copies, ["chunk", "deal"])
    found = read.mapInArrow(_read(width, k, others, chunk), "anchor long, window long, vec_id long, score long")
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, percent: int = 80, scale: int = 256, block: int = BLOCK, chunk: int = CHUNK, task_rows: int = TASK_ROWS) -> DataFrame:
    """For each anchor (a row of ``vectors``, vec_id, embedding, label, where ``anchors`` holds) and each of its positives,
    the first ``negatives`` rows of another label that score at least ``percent`` of the positive and at most as much.

    Components become floor(``scale`` * x); a score is the inner product of these whole numbers, exactly; higher scores come
    first, ties by smaller vec_id. Positives are the first rows of the anchor's label with another vec_id. Returns
    anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score; pairs without a negative have no row.

    Rows without id, label or vector, with null or non-finite components (after scaling, too), empty vectors and those of
    another length than most take no part. Rows that repeat an id are rows by themselves, but never positives of each other.
    Scores beyond a long are cut to its ends. An empty table, or one without anchors, gives no rows. Other columns are ignored.
    """
    spark = shipped(vectors.sparkSession)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"), F.coalesce(anchors, F.lit(False)).alias("asks")
    ).where("vec_id IS NOT NULL AND label IS NOT NULL")
    rows = rows.where(finite(F.col("vector")) & finite(F.transform("vector", lambda v: v * scale)))
    width = usual_width(rows, "vector")
    if width is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("vector") == width)
    box = rows.select(F.posexplode("vector")).groupBy("pos").agg(F.min("col").alias("lo"), F.max("col").alias("hi"), F.count("*").alias("n"))
    box = sorted(box.collect(), key=lambda r: r.pos)  # a row for each component
    lo, hi = (np.floor(np.array([r[c] for r in box]) * scale) for c in ("lo", "hi"))

    keyed = rows.mapInArrow(_keyed(width, scale, lo, hi), "key binary, vec_id long, label long, asks boolean, vector binary")
    order = ["key", F.xxhash64("vec_id"), "vec_id"]  # equal vectors spread over several tasks
    keyed = keyed.repartitionByRange(max(1, -(-box[0].n // task_rows)), *order).sortWithinPartitions(*order)
    blocks = written(keyed.mapInArrow(_blocked(block), BLOCKS))
    zones = written(blocks.select("block", "low_label", "high_label", "lo", "hi").mapInArrow(_zones(ZONES), "blocks binary, low_labels binary, high_labels binary, lo binary, hi binary"))

    # Anchors in the order of the curve, numbered without a gap, so many to a chunk. A task's blocks hold at most ``task_rows`` or so.
    asked = blocks.mapInArrow(_anchors(width, positives), ANCHORS).withColumn("task", F.shiftright("block", 32))
    asked = written(asked.withColumn("at", F.row_number().over(Window.partitionBy("task").orderBy("block", "vec_id"))))
    counts = sorted(asked.groupBy("task").count().collect())  # a row for each task that wrote blocks
    total = sum(r["count"] for r in counts)
    if not total:
        return spark.createDataFrame([], schema)
    before = dict(zip((r.task for r in counts), np.cumsum([0, *(r["count"] for r in counts)]).tolist(), strict=False))
    before = F.broadcast(spark.createDataFrame(list(before.items()), "task long, before long"))
    anchor = F.col("before") + F.col("at") - 1
    asked = asked.join(before, "task").withColumn("anchor", anchor).withColumn("chunk", F.floor(anchor / chunk))

    def chunked(df: DataFrame, more: list[str], windows, number: int) -> DataFrame:
        members = F.array_sort(F.collect_list(F.struct("anchor", "vec_id", "label", "vector", *more)))
        packed = df.groupBy("chunk").agg(members.alias("members"))  # at most ``chunk``
        return written(packed.mapInArrow(_packed(windows, number), "chunk long, ids binary, labels binary, vectors binary, low binary, high binary"))

    chunks = -(-total // chunk)
    found = _found(chunked(asked, ["least"], upwards, 1), blocks, zones, chunks, chunk, width, positives, False)
    found = written(found.select("anchor", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    tops = found.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "positive_score"))).alias("tops"))
    tops = tops.select("anchor", F.transform("tops", lambda t: t["positive_score"]).alias("tops"))  # at most ``positives`` each
    windows = lambda m: below(m["tops"] or [], _longs(m["home"]), negatives, percent)
    best = _found(chunked(asked.join(tops, "anchor", "left"), ["tops", "home"], windows, positives), blocks, zones, chunks, chunk, width, negatives, True)
    pairs = found.join(asked.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor").withColumn("window", (F.col("rank") - 1).cast("long")).drop("rank")
    rows = best.select("anchor", "window", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return rows.join(pairs, ["anchor", "window"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
