"""MinHash near-duplicates with sequential Bayesian verification.

Signatures are cut into bands; documents that share a band are candidates. A pair's signatures are compared in
batches, and it is dropped once the posterior chance that its similarity reaches the threshold is below the chosen
miss probability. What survives is verified on the full shingle sets. Links give components by star contraction.

A bucket is never expanded into all its pairs. First every member is compared with the bucket's smallest document.
Only members outside the bucket's largest component are then compared with the others, in blocks of bounded size.
A block gives their best pair with each component; where that one fails and others are left, full sets are compared
inside blocks, which give links only. So no candidate pair is skipped unless its two documents
are in one component already.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import shipped, written

BANDS, ROWS = 40, 6  # a pair at 0.8 shares no band with a chance of 5e-6
HASHES = BANDS * ROWS
BATCH = 24  # hashes compared before the next decision
MISS = 1e-6  # chance, per decision, of dropping a pair that reaches the threshold
BLOCK = 256  # members of a bucket that are compared at once with as many others
SEGMENT = 1 << 20  # bytes hashed at once

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RANDOM.integers(1 << 62, size=256, dtype=np.uint64)
_BASE = int(_RANDOM.integers(1 << 62)) | 1
_MULTIPLY = (_RANDOM.integers(1 << 32, size=HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _RANDOM.integers(1 << 32, size=HASHES, dtype=np.uint64).astype(np.uint32)
_FOLD = _RANDOM.integers(1 << 62, size=(64, 1), dtype=np.uint64) | np.uint64(1)
_powers = np.ones(1, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _base_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    global _powers
    if _powers.shape[-1] < n:
        both = np.empty((2, n), np.uint64)
        both[:, 0] = 1
        both[0, 1:], both[1, 1:] = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
        _powers = np.multiply.accumulate(both, axis=1)
    return _powers[0], _powers[1]


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words and where each starts, by segments that end between words."""
    data, hashes, starts, at = np.frombuffer(text, np.uint8), [], [], 0
    while at < len(data):
        to = min(len(data), at + SEGMENT)
        while to < len(data) and not _SPACE[data[to]]:  # a word longer than the segment stays whole
            to += 1
        part = data[at:to]
        power, inverse = _base_powers(max(len(part) + 1, SEGMENT + 64))
        edges = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[part], [True])).astype(np.int8)))
        begin, end = edges[::2], edges[1::2]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * power[: len(part)], out=sums[1:])
        hashes.append(_mixed((sums[end] - sums[begin]) * inverse[begin]))
        starts.append(begin + at)
        at = to
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles."""
    hashes, starts = word_hashes(b"\n".join(texts).lower())
    ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(starts, ends)
    rolled = np.zeros(len(hashes), np.uint64)
    for i in range(min(k, len(hashes))):
        rolled[: len(hashes) - i] += hashes[i:] * _FOLD[i]
    rolled = _mixed(rolled)
    first = 0
    for last in upto:
        n = last - first
        if n >= k:
            yield np.unique(rolled[first : last - k + 1])
        elif n:  # the whole sequence; its length keeps it apart from the start of a longer one
            whole = (hashes[first:last] * _FOLD[:n, 0]).sum(dtype=np.uint64) + np.uint64(n)
            yield _mixed(np.array([whole], np.uint64))
        else:
            yield np.empty(0, np.uint64)
        first = last


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set that isn't empty."""
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(values), 128):
        np.minimum(least, (values[at : at + 128, None] * _MULTIPLY + _ADD).min(axis=0), out=least)
    return least


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    folded = (rows * _FOLD[:ROWS, 0]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    return _mixed(folded).view(np.int64)


def _texts(column: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, list[bytes]]]:
    """The texts as bytes, in runs of about ``limit`` bytes, with the row each run starts at."""
    run, size, at = [], 0, 0
    for i, x in enumerate(column.cast(pa.binary())):
        b = x.as_py() or b""
        run.append(b)
        size += len(b)
        if size >= limit:
            yield at, run
            run, size, at = [], 0, i + 1
    if run:
        yield at, run


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for at, texts in _texts(batch.column(1)):
                n, digest, bands = [], [], []
                for s in shingle_sets(texts, k):
                    n.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    bands.append(band_keys(signature(s)) if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "digest", "bands"],
                )

    return run


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for at, texts in _texts(batch.column(1)):
                sets = list(shingle_sets(texts, k))
                sigs = [signature(s).astype(np.uint16).tobytes() if len(s) else b"" for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(texts)), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["doc_id", "n", "sig", "shingles"],
                )

    return run


def least_matches(percent: int, miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes compared, matches needed) for each decision.

    With a uniform prior, the chance that the similarity is t or more, given m matches of n, is that of at most m
    successes in n + 1 trials at t.
    """
    t, out = percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        chance, m = (1 - t) ** (n + 1), 0
        while chance < miss:
            m += 1
            chance += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def surviving(a: np.ndarray, b: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of two signature matrices survive all decisions; a dropped row isn't compared further."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
    for n, m in steps:
        matches = matches + (a[alive, n - BATCH : n] == b[alive, n - BATCH : n]).sum(axis=1)
        on = matches >= m
        alive, matches = alive[on], matches[on]
    return alive


def _sig_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def _pruned(percent: int):
    steps = least_matches(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = surviving(_sig_matrix(batch.column("a_sig")), _sig_matrix(batch.column("b_sig")), steps)
                yield batch.select(["a", "b"]).take(pa.array(rows))

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for i, (x, y) in enumerate(zip(batch.column("a_set"), batch.column("b_set"), strict=True)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    hits.append(i)
            yield batch.select(["a", "b"]).take(pa.array(hits, pa.int64()))

    return run


def _arrays(members: pa.Scalar) -> tuple:
    rows = members.as_py()
    return rows, *(np.array([r[c] for r in rows]) for c in ("doc_id", "n", "comp", "stray", "other"))


def _best_in_blocks(percent: int):
    """For a stray and another component of its block, the pair whose signatures agree most, of those that survive.

    ``more`` says that further members of that component survive too.
    """
    steps = least_matches(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, bool]] = []
            for members in batch.column("members"):
                rows, ids, n, comp, stray, other = _arrays(members)
                sigs = np.frombuffer(b"".join(r["sig"] for r in rows), np.uint16).reshape(-1, HASHES)
                for x in np.flatnonzero(other):
                    # Two strays meet twice; the larger one takes the smaller.
                    near = np.flatnonzero(~other & (comp != comp[x]) & (~stray | (ids < ids[x])))
                    near = near[100 * np.minimum(n[near], n[x]) >= percent * np.maximum(n[near], n[x])]
                    hit = near[surviving(sigs[near], np.broadcast_to(sigs[x], (len(near), HASHES)), steps)]
                    hit = hit[np.argsort(-(sigs[hit] == sigs[x]).sum(axis=1), kind="stable")]
                    _, first, count = np.unique(comp[hit], return_index=True, return_counts=True)
                    for y, c in zip(ids[hit[first]].tolist(), count.tolist(), strict=True):
                        out.append((min(y, int(ids[x])), max(y, int(ids[x])), int(ids[x]), c > 1))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["a", "b", "stray", "more"])

    return run


def _linked_in_blocks(percent: int):
    """For a stray and another component of its block one link, if full sets give any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for members in batch.column("members"):
                rows, ids, n, comp, _, other = _arrays(members)
                sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
                for x in np.flatnonzero(other):
                    near = np.flatnonzero(~other & (comp != comp[x]))
                    near = near[100 * np.minimum(n[near], n[x]) >= percent * np.maximum(n[near], n[x])]
                    if len(near):
                        theirs = np.concatenate([sets[y] for y in near])
                        at = np.minimum(np.searchsorted(sets[x], theirs), len(sets[x]) - 1)
                        both = np.add.reduceat((sets[x][at] == theirs).astype(np.int64), np.cumsum(n[near]) - n[near])
                        hit = near[100 * both >= percent * (n[near] + n[x] - both)]
                        one = ids[hit[np.unique(comp[hit], return_index=True)[1]]]
                        a += np.minimum(one, ids[x]).tolist()
                        b += np.maximum(one, ids[x]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _labelled(members: DataFrame, linked: DataFrame) -> DataFrame:
    """The members of buckets with their component so far."""
    named = members.join(linked.select(F.col("node").alias("doc_id"), F.col("component").alias("comp")), "doc_id", "left")
    return named.select("key", "head", "doc_id", F.coalesce("comp", "doc_id").alias("comp"))


def _laid_out(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Blocks of strays against blocks of all members, as rows of at most about ``BLOCK`` of each.

    ``members`` has key, doc_id, comp, stray, and for the key the numbers of blocks, _blocks and _strays.
    """
    rest, hashed = members.join(sets, "doc_id"), F.xxhash64("doc_id")
    row = F.struct("doc_id", "comp", "stray", "other", *[c for c in sets.columns if c != "doc_id"]).alias("row")
    ones = rest.withColumn("i", F.pmod(hashed, "_blocks")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("_strays") - 1)))
    ones = ones.withColumn("other", F.lit(False)).select("key", "i", "j", row)
    others = rest.where("stray").withColumn("j", F.pmod(hashed, "_strays"))
    others = others.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    others = others.withColumn("other", F.lit(True)).select("key", "i", "j", row)
    return ones.unionByName(others).groupBy("key", "i", "j").agg(F.collect_list("row").alias("members")).select("members")


def _exact(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("a_set"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("b_set"))
    return pairs.join(b, "b").join(a, "a").mapInArrow(_verified(percent), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) to (node, component), the least node reachable, by alternating star contraction.

    The large star hangs a node's larger neighbours on its least one, the small star the smaller ones; both keep the
    components. It ends when the edges no longer change, which then are (component, node). Nodes without an edge
    don't occur in the result.
    """

    def pointed(out: DataFrame) -> DataFrame:
        return written(out.where("a < b").distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = pointed(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    before = state(edges)
    while before[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        edges = pointed(large)
        least = edges.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        small = edges.withColumnRenamed("b", "u").join(least, "u")
        small = small.select(F.col("m").alias("a"), F.explode(F.array("a", "u")).alias("b"))
        edges = pointed(small)
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id (smallest doc_id reachable) and kept.

    Words are runs without ASCII white space, with A to Z lower-cased; a shingle is ``k`` words in a row, and a text
    of fewer words has one, the whole. Documents link at an intersection of ``percent`` of the union or more.
    Null and empty texts and those without words have no shingles and link with nothing. Rows that repeat a doc_id are
    one document: their texts share a component. A row without doc_id takes no part and is kept, with a null
    component. An empty table gives an empty result. Other columns are ignored.
    """
    shipped(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(docs.mapInArrow(_sketches(k), "doc_id long, n_shingles long, digest binary, bands array<long>"))
    # Equal sets are one class, stood for by its smallest document; only classes are compared.
    classes = rows.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    classes = written(classes)
    one = classes.select("digest", F.col("rep").alias("doc_id"))
    keys = rows.join(one, ["digest", "doc_id"], "left_semi").select("doc_id", F.explode("bands").alias("key"))
    heads = keys.groupBy("key").agg(F.min("doc_id").alias("head"), F.count("*").alias("m")).where("m > 1")
    members = written(keys.join(heads, "key").select("key", "head", "m", "doc_id"))
    involved = members.select("doc_id").distinct()
    whole = docs.join(involved, "doc_id", "left_semi").mapInArrow(_full_sets(k), "doc_id long, n long, sig binary, shingles binary")
    sets = written(whole)
    sigs = sets.select("doc_id", "n", "sig")

    stars = members.where("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct()
    b = sigs.select(F.col("doc_id").alias("b"), F.col("n").alias("b_n"), F.col("sig").alias("b_sig"))
    a = sigs.select(F.col("doc_id").alias("a"), F.col("n").alias("a_n"), F.col("sig").alias("a_sig"))
    sized = stars.join(b, "b").join(a, "a").where(f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)")
    links = _exact(sized.select("a", "b", "a_sig", "b_sig").mapInArrow(_pruned(percent), "a long, b long"), sets, percent)
    first = components(links)

    # Members that the stars left in different components. Of a bucket's components the largest needn't be compared
    # with itself, so only the others, the strays, are laid against all members.
    labelled = _labelled(members.where("m > 2"), first)
    sizes = labelled.groupBy("key", "comp").agg(F.count("*").alias("_n")).groupBy("key")
    sizes = sizes.agg(F.max_by("comp", F.struct("_n", "comp")).alias("_main"), F.max("_n").alias("_top"), F.sum("_n").alias("_all"))
    sizes = sizes.where("_top < _all").select(
        "key", "_main", F.ceil(F.col("_all") / BLOCK).alias("_blocks"), F.ceil((F.col("_all") - F.col("_top")) / BLOCK).alias("_strays")
    )
    rest = labelled.join(sizes, "key").where("doc_id <> head").withColumn("stray", F.col("comp") != F.col("_main"))
    best = _laid_out(rest, sigs).mapInArrow(_best_in_blocks(percent), "a long, b long, stray long, more boolean")
    best = written(best.groupBy("a", "b", "stray").agg(F.max("more").alias("more")))
    more = written(_exact(best.select("a", "b").distinct(), sets, percent))
    chain = first.select(F.col("component").alias("a"), F.col("node").alias("b"))
    second = components(chain.union(more))

    # A stray whose best pair with a component failed, though others survived, meets all members once more: this time
    # with full sets inside the blocks, so that only links come out, however many pairs are close to the threshold.
    doubtful = written(best.where("more").join(more, ["a", "b"], "left_anti").select(F.col("stray").alias("doc_id")).distinct())
    labelled = _labelled(members.where("m > 2"), second)
    strays = labelled.join(doubtful, "doc_id").select("key", "doc_id").withColumn("stray", F.lit(True))
    keys = strays.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("_strays"))
    keys = keys.join(members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("_blocks")), "key")
    rest = labelled.join(keys, "key").join(strays, ["key", "doc_id"], "left").withColumn("stray", F.coalesce("stray", F.lit(False)))
    last = _laid_out(rest, sets.select("doc_id", "n", "shingles")).mapInArrow(_linked_in_blocks(percent), "a long, b long")
    chain = second.select(F.col("component").alias("a"), F.col("node").alias("b"))
    linked = components(chain.union(last.distinct()))

    named = rows.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
    named = named.join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    return named.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
