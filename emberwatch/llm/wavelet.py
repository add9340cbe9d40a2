"""Token ids in wavelet matrices, one compressed file for each shard.

A wavelet matrix holds the bits of all ids, plane by plane from the highest; after each plane the ids are parted
stably into those with bit 0 and those with bit 1. Ranks over a plane's bits then lead from plane to plane, which
gives access by position, counts and places of an id without unpacking the rest.

Layout of a file: magic, sizes, documents (id, is-null, tokens), per plane the number of zeros and its blocks (ones
before, compressed length), then the blocks. A block is ``BLOCK`` bytes of a plane, compressed by itself.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.llm.common import shared_folder, shipped

MAGIC = b"WAVELET1"
BITS = 16
BLOCK = 1 << 14
#: Tokens after which a shard ends, at the end of a document.
SHARD_TOKENS = 1 << 22
END = 0
#: Pieces of text whose ids a worker keeps, from task to task.
KEPT_PIECES = 1_500_000

_UNSAFE = re.compile(r" (?=\s|\Z)")
_CUT = re.compile(r" (?=\S)")
_MARKED = re.compile(r"([^\W\d_]+)([^\w\s]+)")
_SPACE = re.compile(r"[\s\x85]")


class Encoder:
    """Ids of texts by a byte-level BPE tokenizer.

    Its pre-tokenizer never joins a space that stands before something else to what is left of it, so a text can be
    cut before such spaces, and each distinct piece is encoded once. A single line feed between other characters is a
    token of its own, so lines are encoded like texts.
    """

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.line_feed = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.spaced = np.zeros(1 << BITS, bool)  # tokens that begin with a space
        self.spaced[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("Ġ")]] = True
        self.marks: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    @staticmethod
    def lines(text: str) -> list[str]:
        """The lines, where no line feed stands at an end of the text or next to other white space; else the text."""
        cut = text.split("\n")
        return cut if all(c and not c[0].isspace() and not c[-1].isspace() for c in cut) else [text]

    @staticmethod
    def pieces(text: str) -> list[str]:
        """The first piece, and the others without the space that they start with."""
        return _CUT.split(text) if _UNSAFE.search(text) else text.split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian 16-bit integers; one that holds the string of an added token goes whole to the library."""
        whole = {i: self._one(t) for i, t in enumerate(texts) if self.added and self.added.search(t)}
        if whole:
            rest = iter(self.encode([t for i, t in enumerate(texts) if i not in whole]))
            return [whole[i] if i in whole else next(rest) for i in range(len(texts))]
        lines = [self.lines(t) for t in texts]
        cut = [self.pieces(line) for some in lines for line in some]
        starts = [c.pop(0) for c in cut]
        first, others = self._ids(self.first, starts, ""), self._ids(self.known, list(chain.from_iterable(cut)), " ")
        ends = accumulate(map(len, cut), initial=0)
        out = [s + b"".join(others[a:b]) for s, (a, b) in zip(first, pairwise(ends), strict=True)]
        feed, ids = np.array([self.line_feed], "<u2").tobytes(), iter(out)
        return [next(ids) if len(some) == 1 else feed.join([next(ids) for _ in some]) for some in lines]

    def _ids(self, known: dict[str, bytes], pieces: list[str], space: str) -> list[bytes]:
        """The ids of each piece. A piece that is known costs one look into a large table, and no set of pieces is made."""
        found = list(map(known.get, pieces))
        missed = [i for i, ids in enumerate(found) if ids is None]
        if missed:
            new = self._meet(known, {pieces[i] for i in missed}, space)
            for i in missed:
                found[i] = known[pieces[i]]
            if len(known) > KEPT_PIECES:  # what came first is what is frequent; it stays
                for piece in new:
                    del known[piece]
        return found

    def _meet(self, known: dict[str, bytes], new: set[str], space: str) -> list[str]:
        """Encode pieces that aren't known yet.

        Those without white space are encoded a line of many at a time. Where a space stands before each, the tokens that
        begin with it are the pieces' first ones; else a line feed between them, before a letter, is a token of its own.
        """
        words, rest = [], []
        for p in new:
            (words if p.isalpha() else rest).append(p)
        # Letters and what follows them are encoded apart: "word," needs no more than "word".
        parted = {p: m for p in rest if (m := _MARKED.fullmatch(p)) and m[1].isalpha()}
        stems = list({m[1] for m in parted.values()}.difference(known, words))
        odd = [p for p in rest if p not in parted]
        spaced = {p for p in odd if not p or _SPACE.search(p)}
        plain = [*words, *stems, *(p for p in odd if p not in spaced)]
        lines = [plain[i : i + 500] for i in range(0, len(plain), 500)]
        joined = [space + (space or "\n").join(line) for line in lines]
        for line, ids in zip(lines, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(ids.ids, "<u2")
            between = np.flatnonzero(self.spaced[ids])[1:] if space else np.flatnonzero(ids == self.line_feed)
            raw, at = ids.tobytes(), 0
            for piece, end in zip(line, (2 * np.append(between, len(ids))).tolist(), strict=True):
                known[piece] = raw[at:end]
                at = end if space else end + 2
        for piece in spaced:
            known[piece] = self._one(space + piece)
        for piece, m in parted.items():
            if m[2] not in self.marks:
                self.marks[m[2]] = self._one(m[2])
            known[piece] = known[m[1]] + self.marks[m[2]]
        if len(self.marks) > KEPT_PIECES:
            self.marks = {}
        return [*new, *stems]

    def _one(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder_of(model: str) -> Encoder:
    """This process's encoder, with what it has met in earlier tasks."""
    if model not in _encoders:
        _encoders.clear()
        _encoders[model] = Encoder(model)
    return _encoders[model]


def build(ids: np.ndarray, docs: list[int | None], lengths: list[int]) -> bytes:
    """The file of a shard: ``ids`` of all its documents in order, and each document's number of them."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    rest, planes, blocks = np.asarray(ids, np.uint16), [], []
    for b in range(BITS - 1, -1, -1):
        on = (rest & np.uint16(1 << b)) != 0
        bits = np.packbits(on, bitorder="little").tobytes()
        parts = [bits[i : i + BLOCK] for i in range(0, len(bits), BLOCK)]
        ones = np.cumsum([0, *(np.bitwise_count(np.frombuffer(p, np.uint8)).sum() for p in parts)])[:-1]
        squeezed = [squeeze(p) for p in parts]
        planes.append(struct.pack("<Q", int(len(rest) - on.sum())) + np.array(ones[: len(parts)], "<u8").tobytes() + np.array([len(s) for s in squeezed], "<u4").tobytes())
        blocks += squeezed
        rest = np.concatenate([rest.compress(~on), rest.compress(on)])  # a mask as an index takes three times as long
    head = MAGIC + struct.pack("<QQ", len(ids), len(docs))
    table = np.array([d or 0 for d in docs], "<i8").tobytes() + np.array([d is None for d in docs], "u1").tobytes() + np.array(lengths, "<u8").tobytes()
    return head + table + b"".join(planes) + b"".join(blocks)


class WaveletMatrix:
    """Queries on a shard's file; a block is unpacked when it is first needed."""

    def __init__(self, file: bytes):
        if file[:8] != MAGIC:
            raise ValueError("not a wavelet file")
        self.file = file
        self.n, docs = struct.unpack_from("<QQ", file, 8)
        at = 24
        ids, nulls = np.frombuffer(file, "<i8", docs, at), np.frombuffer(file, "u1", docs, at + 8 * docs)
        self.docs = [None if z else int(d) for d, z in zip(ids, nulls, strict=True)]
        self.lengths = np.frombuffer(file, "<u8", docs, at + 9 * docs).astype(np.int64)
        at += 17 * docs
        count = -(-(-(-self.n // 8)) // BLOCK)
        self.zeros, self.ones, sizes = [], [], []
        for _ in range(BITS):
            self.zeros.append(struct.unpack_from("<Q", file, at)[0])
            self.ones.append(np.frombuffer(file, "<u8", count, at + 8).astype(np.int64))
            sizes.append(np.frombuffer(file, "<u4", count, at + 8 + 8 * count).astype(np.int64))
            at += 8 + 12 * count
        ends = at + np.cumsum(np.concatenate(sizes)) if count else np.zeros(0, np.int64)
        self.spans = np.stack([ends - np.concatenate(sizes), ends], axis=1).reshape(BITS, count, 2) if count else np.zeros((BITS, 0, 2), np.int64)
        self.unpack = zstandard.ZstdDecompressor().decompress
        self.cache: dict[tuple[int, int], np.ndarray] = {}

    def _block(self, plane: int, block: int) -> np.ndarray:
        if (plane, block) not in self.cache:
            a, b = self.spans[plane, block]
            self.cache[plane, block] = np.unpackbits(np.frombuffer(self.unpack(self.file[a:b]), np.uint8), bitorder="little")
        return self.cache[plane, block]

    def _plane(self, plane: int) -> np.ndarray:
        raw = b"".join(self.unpack(self.file[a:b]) for a, b in self.spans[plane])
        return np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: self.n].view(bool)

    def _rank(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, rest = divmod(i, 8 * BLOCK)
        if block == len(self.ones[plane]):
            return self.n - self.zeros[plane]
        return int(self.ones[plane][block]) + int(self._block(plane, block)[:rest].sum())

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of this value in a plane."""
        before = self.ones[plane] if bit else np.arange(len(self.ones[plane])) * 8 * BLOCK - self.ones[plane]
        block = int(np.searchsorted(before, k, side="right")) - 1
        return block * 8 * BLOCK + int(np.flatnonzero(self._block(plane, block) == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        """The id at position i."""
        value = 0
        for p in range(BITS):
            block, rest = divmod(i, 8 * BLOCK)
            bit, ones = int(self._block(p, block)[rest]), self._rank(p, i)
            value = 2 * value + bit
            i = self.zeros[p] + ones if bit else i - ones
        return value

    def _range(self, token: int, first: int, last: int) -> tuple[int, int]:
        for p in range(BITS):
            a, b = self._rank(p, first), self._rank(p, last)
            if token >> (BITS - 1 - p) & 1:
                first, last = self.zeros[p] + a, self.zeros[p] + b
            else:
                first, last = first - a, last - b
        return first, last

    def count(self, token: int, first: int = 0, last: int | None = None) -> int:
        """How often an id occurs in positions first to last - 1."""
        a, b = self._range(token, first, self.n if last is None else last)
        return b - a

    def places(self, token: int) -> list[int]:
        """All positions of an id, in order."""
        out = []
        for i in range(*self._range(token, 0, self.n)):
            for p in range(BITS - 1, -1, -1):
                bit = token >> (BITS - 1 - p) & 1
                i = self._select(p, bit, i - self.zeros[p] if bit else i)
            out.append(i)
        return out

    def ids(self) -> np.ndarray:
        """All ids in order: the planes are undone from the lowest."""
        values = np.zeros(self.n, np.uint16)
        for p in range(BITS - 1, -1, -1):
            on, above = self._plane(p), np.empty(self.n, np.uint16)
            above[np.flatnonzero(~on)] = values[: self.zeros[p]]
            above[np.flatnonzero(on)] = values[self.zeros[p] :] | np.uint16(1 << (BITS - 1 - p))
            values = above
        return values


def _shards(model, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = encoder_of(model.value), TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        held: list[bytes] = []
        tokens = 0

        def shard() -> pa.RecordBatch:
            nonlocal docs, held, tokens, seq
            file = build(np.frombuffer(b"".join(held), "<u2"), docs, [len(h) // 2 for h in held])
            row = [pa.array([x], t) for x, t in ((part, pa.int32()), (seq, pa.int32()), (len(docs), pa.int64()), (tokens, pa.int64()), (file, pa.binary()))]
            docs, held, tokens, seq = [], [], 0, seq + 1
            return pa.RecordBatch.from_arrays(row, ["part", "seq", "n_docs", "n_tokens", "file"])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 256):
                some = [t.as_py() or "" for t in texts[at : at + 256]]
                for doc, encoded in zip(ids[at : at + 256], encoder.encode(some), strict=True):
                    docs.append(doc)
                    held.append(encoded + END.to_bytes(2, "little"))
                    tokens += len(held[-1]) // 2
                    if tokens >= most:
                        yield shard()
        if docs:
            yield shard()

    return run


def write(docs: DataFrame, model: str, path: str, most: int = SHARD_TOKENS) -> None:
    """Encode all ``docs`` (doc_id, text) in ascending doc_id order into shards under ``path``.

    ``model`` is the text of a tokenizer file with fewer than 65,536 ids. Every row of the table written is a shard's
    file with its place (part, seq) and sizes; Spark's writer commits it, so lost executors leave nothing half done.
    """
    spark = shipped(docs.sparkSession)
    text = spark.sparkContext.broadcast(model)  # a few MB
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(_shards(text, most), "part int, seq int, n_docs long, n_tokens long, file binary").write.parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, seq, file in zip(*(batch.column(c) for c in ("part", "seq", "file")), strict=True):
            matrix = WaveletMatrix(file.as_py())
            wide, ends = matrix.ids().astype("<u4").tobytes(), np.cumsum(matrix.lengths)
            starts = ends - matrix.lengths
            sums = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)]
            n = len(matrix.docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.as_py()] * n, pa.int32()), pa.array([seq.as_py()] * n, pa.int32()), pa.array(matrix.docs, pa.int64()),
                 pa.array(starts, pa.int64()), pa.array(matrix.lengths, pa.int64()), pa.array(sums, pa.int64())],
                ["part", "seq", "doc_id", "start", "n_tokens", "ids_crc32"],
            )


def documents(spark, path: str) -> DataFrame:
    """Per document of the shards under ``path``, read from the files: doc_id, start, n_tokens, ids_crc32."""
    shards = shipped(spark).read.parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    parts = parts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_part_start"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    places = shards.select("part", "seq", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("_seq_start")).join(parts, "part")
    rows = shards.select("part", "seq", "file").mapInArrow(_documents, "part int, seq int, doc_id long, start long, n_tokens long, ids_crc32 long")
    start = F.col("start") + F.col("_part_start") + F.col("_seq_start")
    return rows.join(places, ["part", "seq"]).select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, model: str, most: int = SHARD_TOKENS) -> DataFrame:
    """Write the shards to the shared folder and read them back; see ``write`` and ``documents``.

    A null text counts as empty; an empty text has only the end id. Null ids come first; rows that share an id are
    ordered by text. An empty table gives an empty result. Other columns are ignored.
    """
    path = shared_folder(docs.sparkSession)
    write(docs, model, path, most)
    return documents(docs.sparkSession, path)
