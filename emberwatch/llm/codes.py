"""Compression of vectors to codes: product quantisation in exact integers over Hilbert-sorted flat blocks.

Every vector is cut into parts. The parts of one position are sorted along a Hilbert curve and dealt into flat blocks,
each with its box (smallest and largest components) and the sum of its parts. In a round, the distances between a block's
box and the codebook's entries leave a short list: entries whose least distance to the box exceeds the largest distance
of another entry cannot be nearest to any part inside. With one entry left the block's sum is taken whole; else a small
integer kernel compares its parts with the entries of the list. What reaches the driver in a round are sums, one row for
each part position, entry and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm import hilbert
from emberwatch.llm.common import finite, shipped, usual_width, written

#: Parts of a block, and parts that a task sorts at once.
BLOCK, TASK_ROWS = 128, 100_000
#: Bits a dimension of the Hilbert curve.
BITS = 8
#: Scaled components are cut to this size, so that squares and their sums are exact in 64 bits.
LARGEST = 1 << 27

BLOCKS = "part int, n int, rows binary, values binary, lo binary, hi binary, total binary, ids array<long>, labels array<string>"
NAMES = ["part", "n", "rows", "values", "lo", "hi", "total", "ids", "labels"]


def _integers(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """Floors of the scaled components, a row a vector."""
    x = np.asarray(column.flatten(), dtype=float).reshape(-1, width)
    return np.clip(np.floor(x * scale), -LARGEST, LARGEST).astype(np.int64)


def _parted(width: int, parts: int, scale: int, lo: np.ndarray, hi: np.ndarray):
    """Rows (row, vec_id, label, vector) to rows (part, key, row, values, vec_id, label); id and label go with part 0."""
    size = -(-width // parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = np.zeros((n, size * parts), np.int64)  # a last part that is short is filled with zeros
            x[:, :width] = _integers(batch.column("vector"), width, scale)
            for part in range(parts):
                cut = np.ascontiguousarray(x[:, part * size : (part + 1) * size])
                keys = hilbert.keys(hilbert.cells(cut, lo[part], hi[part], BITS), BITS)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, part, np.int32)),
                        pa.array([k.tobytes() for k in keys], pa.binary()),
                        batch.column("row"),
                        pa.array([v.tobytes() for v in cut.astype("<i4")], pa.binary()),
                        batch.column("vec_id") if part == 0 else pa.nulls(n, pa.int64()),
                        batch.column("label") if part == 0 else pa.nulls(n, pa.string()),
                    ],
                    ["part", "key", "row", "values", "vec_id", "label"],
                )

    return run


def _flat(block: int):
    """Sorted rows of ``_parted`` to blocks; a block holds one part position."""

    def made(part: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        x = np.frombuffer(b"".join(t.column("values").to_pylist()), "<i4").reshape(len(t), -1).astype("<i8")
        rows = t.column("row").to_numpy().astype("<i8").tobytes()
        row = [part, len(t), rows, x.astype("<i4").tobytes(), *(v.astype("<i8").tobytes() for v in (x.min(axis=0), x.max(axis=0), x.sum(axis=0)))]
        row += [t.column("vec_id").to_pylist(), t.column("label").to_pylist()] if part == 0 else [None, None]
        types = [pa.int32(), pa.int32(), *[pa.binary()] * 5, pa.list_(pa.int64()), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        part, n = -1, 0
        for batch in batches:
            of = batch.column("part").to_numpy()
            at = 0
            while at < len(of):
                if n and (of[at] != part or n == block):
                    yield made(part, held)
                    held, n = [], 0
                part = int(of[at])
                end = min(at + block - n, at + int(np.searchsorted(of[at:], part, side="right")))
                held.append(batch.slice(at, end - at))
                n += end - at
                at = end
        if n:
            yield made(part, held)

    return run


def short_list(lo: np.ndarray, hi: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Indexes, ascending, of the entries that can be nearest to a point in the box from ``lo`` to ``hi``."""
    below, above = lo - entries, entries - hi
    least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=1)
    most = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(axis=1)
    return np.flatnonzero(least <= most.min())


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, ties to the lower index, and its squared distance, in exact integers."""
    d = np.zeros((len(x), len(entries)), np.int64)
    for i in range(x.shape[1]):
        gap = x[:, i, None] - entries[:, i]
        d += gap * gap
    best = d.argmin(axis=1)
    return best, d[np.arange(len(x)), best]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for row in zip(*(batch.column(c) for c in NAMES), strict=True):
            part, n, rows, values, lo, hi, total, ids, labels = (v.as_py() for v in row)
            x = np.frombuffer(values, "<i4").reshape(n, -1).astype(np.int64)
            yield part, np.frombuffer(rows, "<i8"), x, *(np.frombuffer(b, "<i8") for b in (lo, hi, total)), ids, labels


def _round(books: np.ndarray):
    """Blocks to sums and counts of what each entry attracts: a row for each part, entry and component that a task met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for part, rows, x, lo, hi, total, *_ in _blocks(batches):
            listed = short_list(lo, hi, books[part])
            if len(listed) == 1:
                sums[part, listed[0]] += total
                counts[part, listed[0]] += len(rows)
            else:
                best, _ = nearest(x, books[part][listed])
                for i, entry in enumerate(listed):
                    mine = best == i
                    sums[part, entry] += x[mine].sum(axis=0)
                    counts[part, entry] += mine.sum()
        part, entry = np.nonzero(counts)
        size = books.shape[2]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(part, size).astype(np.int32)),
                pa.array(np.repeat(entry, size).astype(np.int32)),
                pa.array(np.tile(np.arange(size, dtype=np.int32), len(part))),
                pa.array(sums[part, entry].reshape(-1)),
                pa.array(np.repeat(counts[part, entry], size)),
            ],
            ["part", "entry", "at", "total", "n"],
        )

    return run


def _assigned(books: np.ndarray):
    """Blocks to the final entry and squared distance of every part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows, x, lo, hi, _, ids, labels in _blocks(batches):
            listed = short_list(lo, hi, books[part])
            best, error = nearest(x, books[part][listed])
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows),
                    pa.array(np.full(n, part, np.int32)),
                    pa.array(listed[best].astype(np.int32)),
                    pa.array(error),
                    pa.array(ids or [None] * n, pa.int64()),
                    pa.array(labels or [None] * n, pa.string()),
                ],
                ["row", "part", "entry", "error", "vec_id", "label"],
            )

    return run


def codebook_text(books: np.ndarray) -> str:
    return ",".join(map(str, books.reshape(-1).tolist()))


def compressed(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, block: int = BLOCK, task_rows: int = TASK_ROWS) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors (vec_id, embedding, label), and the codebooks (part, entry, component) they refer to.

    The rows hold vec_id, label (as text), code (two hexadecimal digits a part) and error, the squared distance to the
    entries in exact integers. Rows whose vector is null or empty, or holds null or non-finite components, or has
    another length than most, are left out; those without an id or label, and repeats, are rows like others. Scaled
    components are cut to ``LARGEST`` in size; a last part that is short is filled with zeros. Codebooks start with the
    parts of the smallest ids (nulls last, ties by vector); fewer rows make fewer entries, and an empty table gives
    no rows. Entries without parts stay. Other columns are ignored. At most 256 entries.
    """
    spark = shipped(vectors.sparkSession)
    schema = "vec_id long, label string, code string, error long"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.where(finite(F.col("vector")))
    width = usual_width(rows, "vector")
    if width is None:
        return spark.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64)
    rows = written(rows.where(F.size("vector") == width).withColumn("row", F.monotonically_increasing_id()))
    size = -(-width // parts)
    box = rows.select(F.posexplode("vector")).groupBy("pos").agg(F.min("col").alias("lo"), F.max("col").alias("hi"), F.count("*").alias("n"))
    box = {r.pos: r for r in box.collect()}  # a row for each component
    filled = np.array([(box[i].lo, box[i].hi) if i < width else (0, 0) for i in range(size * parts)])
    lo, hi = np.clip(np.floor(filled * scale), -LARGEST, LARGEST).T.reshape(2, parts, size)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).select("vector").collect()
    start = np.zeros((len(first), size * parts), np.int64)
    start[:, :width] = _integers(pa.array([r.vector for r in first], pa.list_(pa.float64())), width, scale)
    books = start.reshape(len(first), parts, size).transpose(1, 0, 2).copy()

    cut = rows.mapInArrow(_parted(width, parts, scale, lo, hi), "part int, key binary, row long, values binary, vec_id long, label string")
    order = ["part", "key", F.xxhash64("row"), "row"]  # equal parts spread over several tasks
    tasks = max(1, -(-box[0].n * parts // task_rows))
    blocks = written(cut.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(_flat(block), BLOCKS))
    for _ in range(rounds):
        sums = blocks.mapInArrow(_round(books), "part int, entry int, at int, total long, n long")
        books = books.copy()
        for r in sums.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            books[r.part, r.entry, r.at] = r.total // r.n
    found = blocks.mapInArrow(_assigned(books), "row long, part int, entry int, error long, vec_id long, label string")
    code = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "entry"))), lambda e: F.lpad(F.lower(F.hex(e["entry"])), 2, "0")), "")
    found = found.groupBy("row").agg(F.max("vec_id").alias("vec_id"), F.max("label").alias("label"), code.alias("code"), F.sum("error").alias("error"))
    return found.drop("row"), books


def with_label_errors(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """Rows of ``compressed`` with label_error, the errors summed over equal labels (nulls together; cut to a long), and the hash of the codebooks."""
    codes = written(codes)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    sums = codes.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error"))
    digest = hashlib.sha256(codebook_text(books).encode()).hexdigest()
    joined = codes.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
