"""Fingerprints of documents: a Merkle tree over pieces, paragraphs and sections of the whole text.

A paragraph is a line. A section ends at a blank line, or after a paragraph whose digest says so (one in ``SECTION`` on
average), so that long texts without blank lines have sections too. A paragraph is cut into pieces of a few words, each
ending after a word whose hash says so (or after ``MOST_WORDS``); the first words of a text are pieces of their own. As all ends depend on nearby text only, an edit changes the branches that hold it
and leaves the others as they were. Digests cover every character: roots are equal if the texts are, and differ otherwise
(up to collisions of 128 bits); differing branches locate edits.

A fingerprint is text: the root, then for each section a slash and its digest, for each paragraph a blank and its digest,
followed by the digests of its pieces, ``LEAF`` characters each. All but the root are shortened, as they serve to compare.
"""

from __future__ import annotations

import base64
import difflib
import hashlib
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import shipped, text_or_empty, written

#: Paragraphs of a section and words of a piece, on average.
SECTION, PIECE = 8, 4
#: Characters of a word after which it is cut, and words of a piece at most.
LONGEST, MOST_WORDS = 48, 16
#: Words at the start of a text that are pieces of their own, so that short texts can be compared, too.
SINGLE = 16
#: Characters of the digests of sections and paragraphs, and of pieces.
NODE, LEAF = 8, 4
#: Bytes of text of a part, and the parts at most.
PART_BYTES, MOST_PARTS = 16 << 20, 20_000
#: Rows that are sampled for the bounds of the parts, about.
SAMPLE = 40_000

_TOKEN = re.compile(rf"\S{{1,{LONGEST}}}\s*|\s+")


def _digest(kind: bytes, data: bytes) -> bytes:
    return blake2b(data, digest_size=16, person=kind).digest()


def _short(digest: bytes, size: int) -> str:
    return base64.b64encode(digest[: size * 3 // 4], b"-_").decode()


def pieces(paragraph: str, ends: dict[str, bool], single: int = 0) -> list[str]:
    """A paragraph cut after each of ``single`` words, then after words whose hash says so; ``ends`` keeps what is known of words."""
    tokens = _TOKEN.findall(paragraph)
    out = tokens[:single]
    first = len(out)
    for i in range(first, len(tokens)):
        token = tokens[i]
        end = ends.get(token)
        if end is None:
            end = ends[token] = zlib.crc32(token.rstrip().encode("utf-8", "surrogatepass")) % PIECE == 0
        if end or i - first == MOST_WORDS - 1:
            out.append("".join(tokens[first : i + 1]))
            first = i + 1
    if first < len(tokens):
        out.append("".join(tokens[first:]))
    return out


def fingerprint(text: str, ends: dict[str, bool] | None = None) -> str:
    """The fingerprint of a text; the empty text has a root only."""
    ends = {} if ends is None else ends
    if len(ends) > 500_000:
        ends.clear()
    sections: list[tuple[bytes, list[str]]] = []
    nodes: list[bytes] = []
    shown: list[str] = []

    def close() -> None:
        digest = _digest(b"section", b"".join(nodes))
        sections.append((digest, ["/" + _short(digest, NODE), *shown]))
        nodes.clear()
        shown.clear()

    single = SINGLE
    for line in text.splitlines(keepends=True):
        cut = pieces(line, ends, single)
        single = max(0, single - len(cut))
        leaves = [blake2b(p.encode("utf-8", "surrogatepass"), digest_size=16).digest() for p in cut]
        digest = _digest(b"paragraph", b"".join(leaves))
        nodes.append(digest)
        shown.append(" " + _short(digest, NODE) + base64.b64encode(b"".join([x[: LEAF * 3 // 4] for x in leaves]), b"-_").decode())
        if not line.strip() or digest[-1] % SECTION == 0:
            close()
    if nodes:
        close()
    root = _digest(b"root", b"".join(d for d, _ in sections)).hex()
    return root + "".join("".join(s) for _, s in sections)


@lru_cache(maxsize=4)
def parsed(mark: str) -> tuple[str, list[tuple[str, list[tuple[str, list[str]]]]]]:
    """Root and sections of a fingerprint: digest and paragraphs; a paragraph: digest and pieces."""
    root, *sections = mark.split("/")
    cut = lambda p: (p[:NODE], [p[i : i + LEAF] for i in range(NODE, len(p), LEAF)])
    return root, [(s[:NODE], [cut(p) for p in s[NODE + 1 :].split(" ")]) for s in sections]


def _common(a: list, b: list) -> tuple[list, list, list]:
    """Branches that both sides hold, counted as often as on both, and what is left of either side."""
    both = Counter(d for d, _ in a) & Counter(d for d, _ in b)
    shared, rest = [], ([], [])
    for side, own in enumerate((a, b)):
        left = both.copy()
        for branch in own:
            if left[branch[0]]:
                left[branch[0]] -= 1
                if side == 0:
                    shared.append(branch)
            else:
                rest[side].append(branch)
    return shared, *rest


def likeness(a: str, b: str) -> float:
    """Twice the pieces that two trees share over all their pieces, 0 to 1; 1 for equal roots.

    Equal branches count whole, only differing ones are entered, so that trees that differ in little are compared quickly.
    """
    if a.partition("/")[0] == b.partition("/")[0]:
        return 1.0
    left, right = parsed(a)[1], parsed(b)[1]
    total = sum(len(p[1]) for side in (left, right) for s in side for p in s[1])
    sections, left, right = _common(left, right)
    shared = sum(len(p[1]) for s in sections for p in s[1])
    paragraphs, left, right = _common([p for s in left for p in s[1]], [p for s in right for p in s[1]])
    shared += sum(len(p[1]) for p in paragraphs)
    shared += (Counter(x for p in left for x in p[1]) & Counter(x for p in right for x in p[1])).total()
    return 2 * shared / total


def edits(a: str, b: str) -> list[tuple[str, int, int, int, int]]:
    """Where two texts differ: (replace, delete or insert; first and end paragraph of a; first and end paragraph of b).

    Sections are aligned first; paragraphs are aligned inside sections that differ.
    """
    sides = [parsed(x)[1] for x in (a, b)]
    starts = [[0] for _ in sides]
    for at, side in zip(starts, sides, strict=True):
        for _, paragraphs in side:
            at.append(at[-1] + len(paragraphs))
    out = []
    outer = difflib.SequenceMatcher(None, *([d for d, _ in s] for s in sides), autojunk=False)
    for kind, i, j, k, m in outer.get_opcodes():
        if kind != "equal":
            lines = [[p[0] for _, paragraphs in side[x:y] for p in paragraphs] for side, (x, y) in zip(sides, ((i, j), (k, m)), strict=True)]
            for op, *ends in difflib.SequenceMatcher(None, *lines, autojunk=False).get_opcodes():
                if op != "equal":
                    out.append((op, ends[0] + starts[0][i], ends[1] + starts[0][i], ends[2] + starts[1][k], ends[3] + starts[1][k]))
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_chars, fingerprint) of whole texts; see ``with_neighbours`` for nulls and the like."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[str, bool] = {}
        for batch in batches:
            texts = batch.column("text").to_pylist()
            marks = pa.array([fingerprint(t, ends) for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), marks], ["doc_id", "n_chars", "fingerprint"])

    shipped(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _beside_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of parts, each followed by the first row of the next part, to rows of ``COLUMNS``."""
    ends: dict[str, bool] = {}
    rows: list[tuple] = []
    held = None

    def out() -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    size = 0
    for batch in batches:
        for part, border, doc_id, text in zip(*(batch.column(c) for c in ("part", "border", "doc_id", "text")), strict=True):
            part, border, doc_id, text = part.as_py(), border.as_py(), doc_id.as_py(), text.as_py()
            mark = fingerprint(text, ends)
            if held is not None and held[0] == part:
                _, before, own, own_mark = held
                moved = len(own) // 2
                edited = own[: len(own) - moved] + text[:moved]
                edited_mark = own_mark if edited == own else fingerprint(edited, ends)
                digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((before, len(own), digest, own_mark, edited_mark, likeness(own_mark, edited_mark), likeness(own_mark, mark)))
                size += len(own_mark) + len(edited_mark)
                if len(rows) >= 1000 or size > 8 << 20:
                    yield out()
                    rows.clear()
                    size = 0
            held = None if border else (part, doc_id, text, mark)
    if rows:
        yield out()


def with_neighbours(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Fingerprints of all documents (doc_id, text), of their edited texts, and how like these and the next documents are.

    The next document is that with the next doc_id, after the last the first; null ids come last, rows that share an id are
    ordered by a hash of their text. The edited text replaces the last half of the characters (rounded down) by the first as
    many of the next document, or all of it. Null texts count as empty; an empty text is like empty ones (1) and no others
    (0). A single row is its own next document. Repeated rows are rows like others. An empty table gives no rows. Other
    columns are ignored. Texts are never cut and never gathered: parts of the order are streams, and only the first row of
    each part is repeated behind the part before it.
    """
    spark = shipped(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    docs = docs.withColumn("last", F.col("doc_id").isNull()).withColumn("salt", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    key = ["last", F.coalesce("doc_id", F.lit(0)).alias("id"), "salt", "row"]
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    if not size.n:
        return spark.createDataFrame([], COLUMNS)
    parts = min(MOST_PARTS, size.n, max(-(-size.bytes // part_bytes), 2 * spark.sparkContext.defaultParallelism))
    # By a hash, about SAMPLE rows of any number; a limit would send as many rows from every task.
    drawn = F.pmod(F.xxhash64(F.lit(3), "row"), F.lit(size.n)) < SAMPLE
    sample = sorted(tuple(r) for r in docs.where(drawn).select(*key).collect())
    bounds = sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []
    shared = spark.sparkContext.broadcast(bounds)  # fewer than MOST_PARTS keys

    @F.arrow_udf("int")
    def part_of(last: pa.Array, ids: pa.Array, salt: pa.Array, row: pa.Array) -> pa.Array:
        keys = zip(*(c.to_pylist() for c in (last, ids, salt, row)), strict=True)
        return pa.array([bisect_right(shared.value, k) for k in keys], pa.int32())

    docs = docs.withColumn("part", part_of(*key))
    # The first row of each part, as the border of the nearest part before it that has rows; of the first part, of the last.
    order = ["last", F.col("doc_id").asc_nulls_first(), "salt", "row"]
    first = written(docs.groupBy("part").agg(F.min(F.struct("last", "doc_id", "salt", "row", "text")).alias("head")))
    used = sorted(r.part for r in first.select("part").collect())  # a number for each part
    before = spark.createDataFrame([(p, used[i - 1]) for i, p in enumerate(used)], "part int, before int")
    first = first.join(F.broadcast(before), "part").withColumn("part", F.col("before"))
    columns = ["part", "border", "last", "doc_id", "salt", "row", "text"]
    borders = first.select("part", F.lit(True).alias("border"), "head.*").select(*columns)
    rows = docs.withColumn("border", F.lit(False)).select(*columns).unionByName(borders)
    rows = rows.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "border", *order)
    return rows.select("part", "border", "doc_id", "text").mapInArrow(_beside_next, COLUMNS)
