"""Removal of repeated byte strings by a sparse suffix array.

Sorting every suffix of the corpus would move many times its size, so only some suffixes are sorted: of each window
of ``length`` bytes the one that starts at the window's anchor, the place in it whose ``LEAD`` bytes have the least
hash. Equal windows have equal anchors, and windows next to each other mostly share theirs, so about one suffix in
sixteen is left, and it stands for a run of windows.

Suffixes are range-partitioned by their leading bytes between splitters sampled from the corpus. A lead so frequent
that several splitters fall on it is dealt among as many buckets by the rest of the anchor. First, buckets find the
anchors that occur in several documents. Then only the bytes around those are sent again, once for each batch
of documents; a bucket sorts them by multikey quicksort, compares neighbours, and where runs of one anchor differ, it
sorts their single windows too. Each batch learns which of its windows start in a smaller document elsewhere.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import shared_folder, shipped, written

LEAD = 20
#: Bytes of documents in a batch, bytes of the corpus for a bucket, bytes hashed at once.
BATCH, BUCKET, SEGMENT = 1 << 22, 1 << 25, 1 << 21
#: Batches whose leads are sampled at most, and leads of each.
SAMPLED, LEADS = 512, 256
#: Runs whose windows a bucket sorts at once.
CHUNK = 20_000

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], np.uint64)
_NONE = np.iinfo(np.int64).max  # a missing id is larger than all others


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At each byte the 4 and the 8 bytes from there as a number, first byte highest."""
    x = data.astype(np.uint64)
    x = (x[:-1] << np.uint64(8)) | x[1:]
    four = (x[:-2] << np.uint64(16)) | x[2:]
    return four, (four[:-4] << np.uint64(32)) | four[4:]


def _anchor_values(four: np.ndarray, eight: np.ndarray, n: int) -> np.ndarray:
    return _mixed(eight[:n] * _MIX[0] ^ _mixed(eight[8 : 8 + n] * _MIX[1] ^ four[16 : 16 + n] * _MIX[2]))


class Runs:
    """Runs of windows that share an anchor, in a batch: where each starts, how many windows, document, value, lead."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray, length: int):
        ends = np.cumsum(lengths)
        parts = []
        width = length - LEAD + 1
        for at in range(0, max(0, len(data) - length + 1), SEGMENT):
            to = min(len(data), at + SEGMENT + length - 1)
            n = to - at - length + 1
            four, eight = _words(np.concatenate([data[at:to], np.zeros(8, np.uint8)]))
            low = values = _anchor_values(four, eight, to - at - LEAD + 1)
            step = 1
            while 2 * step <= width:
                low = np.minimum(low[:-step], low[step:])
                step *= 2
            low = np.minimum(low[:n], low[width - step : width - step + n])
            doc = np.searchsorted(ends, np.arange(at, at + n), side="right")
            fits = np.arange(at, at + n) + length <= ends[doc]
            new = np.append(True, (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]) | (fits[1:] != fits[:-1]))
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, n))
            first, count = first[fits[first]], count[fits[first]]
            pieces = -(-count // width)  # in periodic text a value may last; pieces stay as short as other runs
            piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first, count = np.repeat(first, pieces) + piece * width, np.minimum(width, np.repeat(count, pieces) - piece * width)
            lead, offset = np.empty(len(first), np.uint64), np.empty(len(first), np.uint8)
            for i in range(0, len(first), 1 << 16):
                some = first[i : i + (1 << 16)]
                offset[i : i + (1 << 16)] = (values[some[:, None] + np.arange(width)] == low[some, None]).argmax(axis=1)
            lead = eight[first + offset]
            parts.append((first + at, count, doc[first], low[first], lead, offset))
        if not parts:
            parts = [tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint8))]
        self.start, self.count, self.doc, self.value, self.lead, self.offset = (np.concatenate(c) for c in zip(*parts, strict=True))

    def bucket(self, splitters: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(splitters, self.lead, "left"), np.searchsorted(splitters, self.lead, "right")
        several = high - low
        dealt = low + 1 + (self.value >> np.uint64(8)).astype(np.int64) % np.maximum(several, 1)
        return np.where(several > 1, dealt, high)


def _squeezed(x: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes())


def _opened(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to batches of whole documents: ids, lengths, and all bytes."""
    seq, part = 0, TaskContext.get().partitionId()
    ids: list[int | None] = []
    texts: list[bytes] = []
    size = 0

    def row() -> pa.RecordBatch:
        nonlocal ids, texts, size, seq
        blob = b"".join(texts)
        data = np.frombuffer(blob, np.uint8)
        at = np.linspace(0, max(0, len(data) - 8), min(LEADS, len(data) // 64 + 1)).astype(int)
        leads = [int.from_bytes(blob[i : i + 8], "big") for i in at] if len(data) >= 8 else []
        number = (part << 32) + seq
        values = [number, np.array([_NONE if i is None else i for i in ids], "<i8").tobytes(), np.array([len(t) for t in texts], "<i8").tobytes(),
                  size, np.array(leads, "<u8").tobytes(), _squeezed(blob)]
        ids, texts, size, seq = [], [], 0, seq + 1
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["batch", "ids", "lengths", "size", "leads", "blob"])

    for batch in batches:
        for i, t in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
            ids.append(i.as_py())
            texts.append(t.as_py() or b"")
            size += len(texts[-1])
            if size >= BATCH:
                yield row()
    if ids:
        yield row()


def _loaded(row: dict, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Runs]:
    data = np.frombuffer(_opened(row["blob"]), np.uint8)
    ids, lengths = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["lengths"], "<i8")
    return data, ids, lengths, Runs(data, lengths, length)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _stretches(bucket: np.ndarray) -> Iterator[tuple[int, int]]:
    """From and to of the stretches of equal numbers."""
    bounds = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    return zip(bounds[:-1], bounds[1:], strict=True)


def _keys(runs: Runs, splitters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (bucket, key) of a batch as one number, in order; of each run its place there; bucket of each run."""
    bucket = runs.bucket(splitters)
    joined = (bucket.astype(np.uint64) << np.uint64(32)) | (runs.value & np.uint64(0xFFFFFFFF))
    distinct, place = np.unique(joined, return_inverse=True)
    return distinct, place.reshape(-1), bucket


def _anchors(splitters, length: int):
    """Per batch and bucket the keys of its anchors, and whether several of its documents have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                _, ids, _, runs = _loaded(row, length)
                distinct, place, _ = _keys(runs, splitters.value)
                doc = ids[runs.doc]
                least, most = np.full(len(distinct), _NONE), np.full(len(distinct), np.iinfo(np.int64).min)
                np.minimum.at(least, place, doc)
                np.maximum.at(most, place, doc)
                bucket = (distinct >> np.uint64(32)).astype(np.int64)
                for a, b in _stretches(bucket):
                    keys = distinct[a:b].astype(np.uint32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([bucket[a]], pa.int64()), pa.array([row["batch"]], pa.int64()), pa.array([np.packbits(least[a:b] < most[a:b]).tobytes()], pa.binary()),
                         pa.array([_squeezed(np.diff(keys, prepend=np.uint32(0)))], pa.binary())],
                        ["bucket", "batch", "several", "keys"],
                    )

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows sorted by bucket, a bucket at a time."""
    held: list[dict] = []
    for batch in batches:
        for row in _rows(batch):
            if held and held[0]["bucket"] != row["bucket"]:
                yield held[0]["bucket"], held
                held = []
            held.append(row)
    if held:
        yield held[0]["bucket"], held


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket and batch, which of its keys occur in several documents anywhere."""
    for bucket, rows in _by_bucket(batches):
        keys = [np.cumsum(np.frombuffer(_opened(r["keys"]), np.uint32), dtype=np.uint32) for r in rows]
        several = [np.unpackbits(np.frombuffer(r["several"], np.uint8), count=len(k)).view(bool) for r, k in zip(rows, keys, strict=True)]
        merged = np.sort(np.concatenate([*keys, *(k[s] for k, s in zip(keys, several, strict=True))]))
        often = np.unique(merged[1:][merged[1:] == merged[:-1]])
        for r, k in zip(rows, keys, strict=True):
            at = np.minimum(np.searchsorted(often, k), max(0, len(often) - 1))
            on = often[at] == k if len(often) else np.zeros(len(k), bool)
            if on.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["batch"]], pa.int64()), pa.array([bucket], pa.int64()), pa.array([np.packbits(on).tobytes()], pa.binary())], ["batch", "bucket", "bits"]
                )


class Contents:
    """The distinct contents of a batch's runs whose anchor is repeated, in the order of bucket and hash."""

    def __init__(self, data: np.ndarray, ids: np.ndarray, runs: Runs, marks: list[dict], splitters: np.ndarray, length: int):
        distinct, place, bucket = _keys(runs, splitters)
        on = np.zeros(len(distinct), bool)
        of = (distinct >> np.uint64(32)).astype(np.int64)
        for m in marks:
            a, b = np.searchsorted(of, [m["bucket"], m["bucket"] + 1])
            on[a:b] = np.unpackbits(np.frombuffer(m["bits"], np.uint8), count=b - a)
        self.run = np.flatnonzero(on[place])
        self.width = -(-(2 * length - LEAD) // 8) * 8
        hashes = np.empty(len(self.run), np.uint64)
        padded = np.concatenate([data, np.zeros(self.width, np.uint8)])
        self.rows_of = lambda r: self._bytes(padded, runs, r, length)
        for at in range(0, len(self.run), CHUNK):
            some = self.run[at : at + CHUNK]
            words = self.rows_of(some).view(">u8").astype(np.uint64)
            hashes[at : at + CHUNK] = _mixed((_mixed(words * _MIX[: words.shape[1]]) * _MIX[: words.shape[1]][::-1]).sum(axis=1, dtype=np.uint64) + runs.count[some].astype(np.uint64))
        order = np.lexsort((hashes, bucket[self.run]))
        new = np.append(True, (np.diff(hashes[order]) != 0) | (np.diff(bucket[self.run][order]) != 0)) if len(order) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        self.content = np.empty(len(order), np.int64)  # of each of the runs
        self.content[order] = np.cumsum(new) - 1
        self.example = self.run[order[first]]
        self.bucket = bucket[self.example]
        doc = ids[runs.doc[self.run]]
        self.least = np.minimum.reduceat(doc[order], first) if len(first) else np.zeros(0, np.int64)

    def _bytes(self, padded: np.ndarray, runs: Runs, r: np.ndarray, length: int) -> np.ndarray:
        span = np.arange(self.width)
        rows = padded[runs.start[r, None] + span]
        rows[span >= (runs.count[r, None] + length - 1)] = 0
        return np.ascontiguousarray(rows)


def _contents(splitters, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                data, ids, _, runs = _loaded(row, length)
                c = Contents(data, ids, runs, row["marks"], splitters.value, length)
                for a, b in _stretches(c.bucket):
                    some = c.example[a:b]
                    blob = b"".join([runs.count[some].astype(np.uint8).tobytes(), runs.offset[some].tobytes(), c.least[a:b].astype("<i8").tobytes(), c.rows_of(some).tobytes()])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([c.bucket[a]], pa.int64()), pa.array([row["batch"]], pa.int64()), pa.array([b - a], pa.int64()), pa.array([_squeezed(blob)], pa.binary())],
                        ["bucket", "batch", "n", "blob"],
                    )

    return run


def multikey_sort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a matrix of words, and where in that order a row differs from the one before.

    Rows are parted by their first word; only parts of several rows are parted further, by the next word.
    """
    order = np.argsort(words[:, 0], kind="stable")
    new = np.append(True, words[order[1:], 0] != words[order[:-1], 0]) if len(order) else np.zeros(0, bool)
    for d in range(1, words.shape[1]):
        last = np.append(new[1:], True)
        tied = np.flatnonzero(~(new & last))
        if not len(tied):
            break
        part, key = np.cumsum(new)[tied], words[order[tied], d]
        inner = np.lexsort((key, part))
        order[tied] = order[tied[inner]]
        key = key[inner]
        new[tied[1:]] |= key[1:] != key[:-1]
    return order, new


def _owners(rows: np.ndarray, count: np.ndarray, offset: np.ndarray, least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For contents, stretches of windows (content, first, last) that also start in a document smaller than its own."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    words = rows.view(">u8").astype(np.uint64)
    order, new = multikey_sort(np.hstack([words, count[:, None].astype(np.uint64)]))
    first = np.flatnonzero(new)
    owner = np.minimum.reduceat(least[order], first)
    whole = np.empty(len(order), np.int64)
    whole[order] = np.cumsum(new) - 1
    beaten = owner[whole] < least
    # Contents of one anchor: where there are several, their windows are compared one by one.
    examples = order[first]
    anchors = rows[examples[:, None], offset[examples, None].astype(int) + np.arange(LEAD)]
    anchors = np.ascontiguousarray(np.hstack([anchors, np.zeros((len(anchors), -LEAD % 8), np.uint8)])).view(">u8").astype(np.uint64)
    by_anchor, differs = multikey_sort(anchors)
    group = np.cumsum(differs) - 1
    shared = np.zeros(len(examples), bool)
    shared[by_anchor] = np.bincount(group)[group] > 1
    alone = np.flatnonzero(beaten & ~shared[whole])
    out.append((alone, np.zeros(len(alone), np.int64), count[alone].astype(np.int64) - 1))
    # Whole groups, in portions of about CHUNK contents.
    members = by_anchor[shared[by_anchor]]
    groups = group[shared[by_anchor]]
    at = 0
    by_whole = np.argsort(whole, kind="stable")
    bounds = np.searchsorted(whole[by_whole], np.arange(len(examples) + 1))
    while at < len(members):
        to = min(len(members), at + CHUNK)
        while to < len(members) and groups[to] == groups[to - 1]:
            to += 1
        some = members[at:to]
        n = count[examples[some]].astype(np.int64)
        u = np.repeat(np.arange(len(some)), n)
        t = np.arange(len(u)) - np.repeat(np.cumsum(n) - n, n)
        windows = np.zeros((len(u), -(-length // 8) * 8), np.uint8)
        windows[:, :length] = rows[examples[some][u, None], t[:, None] + np.arange(length)]
        order, new = multikey_sort(windows.view(">u8").astype(np.uint64))
        best = np.minimum.reduceat(owner[some][u[order]], np.flatnonzero(new))
        of_window = np.empty(len(u), np.int64)
        of_window[order] = best[np.cumsum(new) - 1]
        # Back to the contents of all batches: those equal to these have the same windows.
        sizes = bounds[some + 1] - bounds[some]
        back = by_whole[np.concatenate([np.arange(bounds[s], bounds[s + 1]) for s in some])]
        which = np.repeat(np.arange(len(some)), sizes)
        m = n[which]
        r = np.repeat(np.arange(len(back)), m)
        w = np.arange(len(r)) - np.repeat(np.cumsum(m) - m, m)
        hit = of_window[(np.cumsum(n) - n)[which[r]] + w] < least[back[r]]
        starts = hit & np.append(True, ~hit[:-1] | (r[1:] != r[:-1]))
        ends = hit & np.append(~hit[1:] | (r[1:] != r[:-1]), True)
        out.append((back[r[starts]], w[starts], w[ends]))
        at = to
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _beaten(length: int):
    """Per bucket and batch, stretches of windows that start in a smaller document of another batch."""
    width = -(-(2 * length - LEAD) // 8) * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in _by_bucket(batches):
            n = np.array([r["n"] for r in held])
            count, offset, least, rows = [], [], [], []
            for r in held:
                blob, k = _opened(r.pop("blob")), r["n"]
                count.append(np.frombuffer(blob, np.uint8, k))
                offset.append(np.frombuffer(blob, np.uint8, k, k))
                least.append(np.frombuffer(blob, "<i8", k, 2 * k))
                rows.append(np.frombuffer(blob, np.uint8, k * width, 10 * k).reshape(k, width))
            content, first, last = _owners(np.concatenate(rows), np.concatenate(count), np.concatenate(offset), np.concatenate(least), length)
            order = np.argsort(content, kind="stable")
            content, first, last = content[order], first[order], last[order]
            starts = np.cumsum(n) - n
            cuts = np.searchsorted(content, np.append(starts, n.sum()))
            for i, r in enumerate(held):
                a, b = cuts[i], cuts[i + 1]
                if a < b:
                    blob = b"".join([(content[a:b] - starts[i]).astype("<u4").tobytes(), first[a:b].astype(np.uint8).tobytes(), last[a:b].astype(np.uint8).tobytes()])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["batch"]], pa.int64()), pa.array([bucket], pa.int64()), pa.array([b - a], pa.int64()), pa.array([_squeezed(blob)], pa.binary())],
                        ["batch", "bucket", "n", "stretches"],
                    )

    return run


def _kept(splitters, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                data, ids, lengths, runs = _loaded(row, length)
                edge = np.zeros(len(data) + 1, np.int32)
                if row["marks"]:
                    c = Contents(data, ids, runs, row["marks"], splitters.value, length)
                    doc = ids[runs.doc[c.run]]
                    inside = doc > c.least[c.content]  # a smaller document of this batch has the same content
                    first, last = [runs.start[c.run[inside]]], [(runs.start + runs.count)[c.run[inside]] - 1]
                    owned = np.flatnonzero(~inside)
                    by_content = owned[np.argsort(c.content[owned], kind="stable")]
                    for m in row["stretches"] or []:
                        blob, n, base = _opened(m["stretches"]), m["n"], np.searchsorted(c.bucket, m["bucket"])
                        content = np.frombuffer(blob, "<u4", n).astype(np.int64) + base
                        a, b = np.searchsorted(c.content[by_content], content, "left"), np.searchsorted(c.content[by_content], content, "right")
                        which = np.repeat(np.arange(n), b - a)
                        r = c.run[by_content[np.arange(len(which)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[which]]]
                        first.append(runs.start[r] + np.frombuffer(blob, np.uint8, n, 4 * n)[which])
                        last.append(runs.start[r] + np.frombuffer(blob, np.uint8, n, 5 * n)[which])
                    np.add.at(edge, np.concatenate(first), 1)
                    np.add.at(edge, np.concatenate(last) + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                ends = np.cumsum(lengths)
                removed, spans, hashes = [], [], []
                for a, b in zip(ends - lengths, ends, strict=True):
                    g = gone[a:b]
                    n = int(g.sum())
                    removed.append(n)
                    spans.append(int(np.count_nonzero(g[1:] & ~g[:-1]) + g[0]) if n else 0)
                    hashes.append(hashlib.sha256(data[a:b][~g] if n else data[a:b]).hexdigest())
                out_ids = pa.array(ids, pa.int64(), mask=ids == _NONE)
                yield pa.RecordBatch.from_arrays(
                    [out_ids, pa.array(lengths, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(hashes, pa.string())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    return run


def deduplicated(docs: DataFrame, length: int = 50) -> DataFrame:
    """What is left of each row of ``docs`` (doc_id, text) when repeated strings go.

    A byte of the UTF-8 text goes if a string of ``length`` bytes covers it that also starts in a document with a
    smaller doc_id; strings are judged on the input and never cross documents. Returns doc_id, n_bytes, n_removed,
    n_spans (maximal removed runs) and kept_sha256 (of the remaining bytes). A null text counts as empty. A row without
    doc_id counts as larger than all others; rows that share an id don't remove each other. An empty table gives an
    empty result. Other columns are ignored. ``length`` is from 28 to 255.
    """
    spark = shipped(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = rows.mapInArrow(_batches, "batch long, ids binary, lengths binary, size long, leads binary, blob binary")
    # A bucketed table: the joins below then move what was found, not the texts.
    name = f"llm_{uuid.uuid4().hex}"
    packed.write.option("path", shared_folder(spark)).bucketBy(parts, "batch").saveAsTable(name)
    table = spark.table(name)

    total = table.agg(F.sum("size")).first()[0] or 0
    leads = table.orderBy(F.xxhash64("batch")).limit(SAMPLED).select("leads").collect()
    leads = np.sort(np.concatenate([np.frombuffer(r.leads, "<u8") for r in leads] or [np.zeros(0, np.uint64)]))
    buckets = max(1, -(-total // BUCKET))
    at = (np.arange(1, buckets) * len(leads)) // buckets
    splitters = spark.sparkContext.broadcast(leads[at] if len(leads) else np.zeros(0, np.uint64))  # a number a bucket

    anchors = table.mapInArrow(_anchors(splitters, length), "bucket long, batch long, several binary, keys binary")
    marks = anchors.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_repeated, "batch long, bucket long, bits binary")
    marks = written(marks.groupBy("batch").agg(F.collect_list(F.struct("bucket", "bits")).alias("marks")))
    contents = table.join(marks, "batch").mapInArrow(_contents(splitters, length), "bucket long, batch long, n long, blob binary")
    found = contents.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_beaten(length), "batch long, bucket long, n long, stretches binary")
    found = written(found.groupBy("batch").agg(F.collect_list(F.struct("bucket", "n", "stretches")).alias("stretches")))
    out = table.join(marks, "batch", "left").join(found, "batch", "left")
    return out.mapInArrow(_kept(splitters, length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
