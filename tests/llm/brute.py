"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re

EXTRA = "size long, taken long, shard int, target double, score double, batch long, words string, component string"


def table(spark, rows, columns="doc_id long, text string, source string"):
    """A table with columns that the operators use themselves, holding nulls."""
    n = len(EXTRA.split(","))
    return spark.createDataFrame([(*r, *[None] * n) for r in rows], f"{columns}, {EXTRA}").repartition(3)


def words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(rows, k, percent):
    """rows (doc_id, text) to {doc_id: (n_shingles, component)}."""
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def repeats(rows, length):
    """rows (doc_id, bytes) to {doc_id: (bytes, removed, spans, hash of the rest)}."""
    owner, out = {}, {}
    for i, b in rows:
        for p in range(len(b) - length + 1):
            owner[b[p : p + length]] = min(owner.get(b[p : p + length], 1 << 63), i)
    for i, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if owner[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out


def joined(spans, kinds):
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))


def digest(spans, kinds):
    return hashlib.sha256(joined(spans, kinds).encode()).hexdigest()
