"""Fingerprints, vector codes and hard negatives against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import math
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from emberwatch.llm import codes, hilbert, merkle, negatives
from test_text_operators import HARD

VECTORS = "vec_id long, embedding array<double>, label int, part int, row long, vector string, score double, chunk long, block long, text string"


def vectors(spark, rows):
    """A table of vectors with columns that the operators use themselves, holding nulls."""
    return spark.createDataFrame([(*r, *[None] * 7) for r in rows], VECTORS).repartition(3)


@pytest.mark.parametrize("d, bits", [(1, 3), (2, 3), (3, 2), (5, 2), (4, 1)])
def test_hilbert_neighbours(d, bits):
    grid = np.array(list(itertools.product(range(1 << bits), repeat=d)), np.uint32)
    keys = [k.tobytes() for k in hilbert.keys(grid, bits)]
    walk = grid[sorted(range(len(keys)), key=keys.__getitem__)].astype(int)
    assert len(set(keys)) == len(grid) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


# Vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """rows (vec_id, vector, label) that are all usable; (vec_id, code, error, label_error) sorted, and the codebooks."""
    ints = [[math.floor(scale * x) for x in v] for _, v, _ in rows]
    size = -(-len(ints[0]) // parts)
    ints = [v + [0] * (size * parts - len(v)) for v in ints]
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for v in ints]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]

    def assigned():
        square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
        return [[min((square(v[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for v in cut]

    for _ in range(rounds):
        to = assigned()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [cut[i][p] for i in range(len(cut)) if to[i][p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    to = assigned()
    errors = [sum(d for d, _ in t) for t in to]
    by_label = {}
    for (_, _, label), e in zip(rows, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    out = [(i, "".join(f"{k:02x}" for _, k in t), e, by_label[label]) for (i, _, label), t, e in zip(rows, to, errors, strict=True)]
    return sorted(out, key=str), ",".join(str(c) for b in books for e in b for c in e)


def random_vectors(n, width=16, seed=1, spread=0.3):
    draw = np.random.default_rng(seed)
    return [(i, (spread * draw.standard_normal(width)).round(3).tolist(), [None, 0, 1, 2][i % 4]) for i in range(n)]


@pytest.mark.parametrize("block, task_rows", [(7, 200), (128, 10_000)])
def test_codes(spark, block, task_rows):
    rows = random_vectors(180)
    rows += [(1000 + i, [0.25] * 16, 5) for i in range(90)]  # a third are equal
    rows += [(None, [0.5] * 16, 1), (3, [-0.1] * 16, None), (3, [-0.1] * 16, None)]
    out = [(2000, None, 1), (2001, [], 1), (2002, [None, *[0.0] * 15], 1), (2003, [math.nan, *[0.0] * 15], 1), (2004, [math.inf, *[0.0] * 15], 1), (2005, [1.0] * 3, 1)]
    got, books = codes.compressed(vectors(spark, rows + out), block=block, task_rows=task_rows)
    got = codes.with_label_errors(got, books).collect()
    want, text = plain_codes(rows)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == want
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(text.encode()).hexdigest()}


def test_codes_of_few_and_large(spark):
    few = [(i, [x, -x, 3.0], 1) for i, x in enumerate((1.0, 2.0, 1e30))]  # 3 entries; 3 components in 8 parts of 1; one too large
    got, books = codes.compressed(vectors(spark, few))
    limited = [(i, [min(x, codes.LARGEST / 4096) for x in v], 1) for i, v, _ in few]
    limited[2] = (2, [codes.LARGEST / 4096, -codes.LARGEST / 4096, 3.0], 1)
    assert books.shape == (8, 3, 1) and sorted((r.vec_id, r.code, r.error) for r in got.collect()) == [r[:3] for r in plain_codes(limited)[0]]
    for none in ([], [(1, None, 1)]):
        got, books = codes.compressed(vectors(spark, none))
        assert codes.with_label_errors(got, books).count() == 0


def test_short_lists_keep_the_nearest():
    draw = np.random.default_rng(3)
    lengths = []
    for _ in range(200):
        x, entries = draw.integers(-50, 50, 8) + draw.integers(-4, 5, (20, 8)), draw.integers(-60, 60, (16, 8))
        listed = codes.short_list(x.min(axis=0), x.max(axis=0), entries)
        best, error = codes.nearest(x, entries)
        again, same = codes.nearest(x, entries[listed])
        assert (listed[again] == best).all() and (same == error).all()
        lengths.append(len(listed))
    assert np.mean(lengths) < 8


# Hard negatives


def plain_negatives(rows, percent=80, scale=256, k=5):
    """rows (vec_id, vector, label), all usable, anchors where vec_id % 10 is 0: sorted result rows."""
    ints = [[math.floor(scale * x) for x in v] for _, v, _ in rows]
    out = []
    for a, (i, _, label) in enumerate(rows):
        if i % 10:
            continue
        s = [sum(x * y for x, y in zip(ints[a], v, strict=True)) for v in ints]
        order = sorted(range(len(rows)), key=lambda j: (-s[j], rows[j][0]))
        for p in [j for j in order if rows[j][2] == label and rows[j][0] != i][:k]:
            fit = [j for j in order if rows[j][2] != label and percent * s[p] <= 100 * s[j] <= 100 * s[p]][:k]
            out += [(i, rows[p][0], n + 1, rows[j][0], s[p], s[j]) for n, j in enumerate(fit)]
    return sorted(out)


def test_negatives(spark):
    rows = [(i, v, 0 if label is None else label) for i, v, label in random_vectors(260, width=6)]
    rows += [(1000 + i, [0.25, -0.5, 0.125, 0.0, 0.3, 0.1], i % 2) for i in range(130)]  # a third are equal
    rows += [(5000, [0.2] * 6, 77), (5010, [0.0] * 6, 1), (5020, [-3.0] * 6, 2)]  # a label of its own, no direction, all scores below 0
    out = [(6000, None, 1), (6010, [0.1] * 6, None), (6020, [math.nan] * 6, 1), (6030, [None] * 6, 1), (6040, [0.1] * 5, 1), (None, [0.1] * 6, 1), (6050, [], 1), (6060, [math.inf] * 6, 1)]
    table, anchors = vectors(spark, rows + out), F.col("vec_id") % 10 == 0
    want = plain_negatives(rows)
    for sizes in ({"block": 16, "chunk": 8, "task_rows": 50}, {}):
        got = [tuple(r) for r in negatives.hard_negatives(table, anchors, **sizes).collect()]
        assert sorted(got) == want and len(want) > 200


def test_negatives_of_clusters_read_few_blocks(spark):
    draw = np.random.default_rng(5)
    centres = 2 * draw.standard_normal((20, 4))
    rows = [(i, (centres[i % 20] + 0.02 * draw.standard_normal(4)).tolist(), i % 3) for i in range(600)]
    lo, hi, reads = [], [], 0
    x = np.floor(256 * np.array([v for _, v, _ in rows]))
    for c in range(20):
        lo.append(x[c::20].min(axis=0))
        hi.append(x[c::20].max(axis=0))
    least, most = negatives.bounds(x[::20], np.array(lo), np.array(hi))
    for i in range(20):
        s = x[i::20] @ x[::20].T
        assert (least[:, i] <= s.min(axis=0)).all() and (s.max(axis=0) <= most[:, i]).all()
        reads += (most[:, i] >= most.max(axis=1) * 0.8).sum()
    assert reads < 0.3 * 20 * len(least)
    got = negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 10 == 0, block=16)
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows)


def test_negatives_of_large_numbers(spark):
    rows = [(i, [x * 1e6, 3e6, -2e6], i % 2) for i, x in enumerate((3.000001, 2.5, 2.500001, 2.4, 0.5, 2.6, -1.0, 2.7, 3.1, 2.9, 2.8))]
    got = negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 10 == 0)
    want = plain_negatives(rows)
    assert want and sorted(tuple(r) for r in got.collect()) == want
    top = (1 << 63) - 1
    huge = negatives.hard_negatives(vectors(spark, [(i, [1e200, 1e200], i % 2) for i in range(4)]), F.col("vec_id") == 0).collect()
    assert [(r.positive_id, r["rank"], r.negative_id, r.negative_score) for r in sorted(huge, key=lambda r: r["rank"])] == [(2, 1, 1, top), (2, 2, 3, top)]


def test_negatives_without_rows(spark):
    anchors = F.col("vec_id") % 10 == 0
    for rows in ([], [(1, [0.5], 1), (2, [0.5], 2)], [(10, [0.5], 1)], [(10, None, None)]):
        assert negatives.hard_negatives(vectors(spark, rows), anchors).count() == 0
    twice = [(10, [0.5], 1), (10, [0.5], 1), (11, [0.5], 1), (12, [0.5], 2)]  # both rows of the repeated id are anchors
    got = negatives.hard_negatives(vectors(spark, twice), anchors).collect()
    assert [tuple(r)[:4] for r in got] == [(10, 11, 1, 12)] * 2


# Fingerprints


def plain_neighbours(rows):
    """rows (doc_id, text) in order to result rows."""
    out = []
    for at, (i, own) in enumerate(rows):
        text = rows[(at + 1) % len(rows)][1]
        half = len(own) // 2
        edited = own[: len(own) - half] + text[:half]
        a, b, c = (merkle.fingerprint(t) for t in (own, edited, text))
        out.append((i, len(own), hashlib.sha256(edited.encode()).hexdigest(), a, b, merkle.likeness(a, b), merkle.likeness(a, c)))
    return out


@pytest.mark.parametrize("part_bytes", [500, merkle.PART_BYTES])
def test_fingerprints(spark, part_bytes):
    draw = random.Random(2)
    words = [draw.choice(["ta", "re", "né", "mo\n", "li.\n\n", "x", "𝄞"]) + draw.choice(["", "ko", "su"]) for _ in range(3000)]
    rows = [(3 * i - 40, " ".join(words[draw.randrange(2000) :][: draw.randrange(90)])) for i in range(150)]
    rows += [(900, "word " * 40_000), (901, "x" * 100_000), (902, ""), (903, " \n\t\n "), (904, rows[3][1])]
    docs = brute.table(spark, [(i, t or None, None) for i, t in rows])
    got = sorted(tuple(r) for r in merkle.with_neighbours(docs, part_bytes=part_bytes).collect())
    assert got == plain_neighbours(sorted(rows))


def test_fingerprints_of_hard_rows(spark):
    got = merkle.with_neighbours(brute.table(spark, HARD), part_bytes=10).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == sorted((str(i), len(t or "")) for i, t, _ in HARD)
    by_text = {}
    for i, t, _ in HARD:
        by_text.setdefault(merkle.fingerprint(t or ""), set()).add(t or "")
    assert {r.fingerprint for r in got} == set(by_text) and all(len(v) == 1 for v in by_text.values())
    same = [(7, "the same", None)] * 60 + [(None, "none", None)] * 40  # one id, and none, hold all rows
    got = merkle.with_neighbours(brute.table(spark, same), part_bytes=40).collect()
    assert len(got) == 100 and sum(r.near_next == 1.0 for r in got) == 98
    assert merkle.with_neighbours(brute.table(spark, [])).count() == 0
    one = merkle.with_neighbours(brute.table(spark, [(1, "abcd", None)])).first()
    assert (one.edited_sha256, one.near_next) == (hashlib.sha256(b"abab").hexdigest(), 1.0)
    assert sorted((r.doc_id, r.fingerprint) for r in merkle.fingerprints(brute.table(spark, same[:2])).collect()) == [(7, merkle.fingerprint("the same"))] * 2


def test_trees_locate_edits():
    draw = random.Random(4)
    lines = [" ".join(draw.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(draw.randrange(50)) for _ in range(12)) + "\n" for _ in range(200)]
    whole = merkle.fingerprint("".join(lines))
    changed = [*lines[:50], "another line\n", *lines[51:120], *lines[125:160], "new\n", *lines[160:]]
    other = merkle.fingerprint("".join(changed))
    assert merkle.edits(whole, other) == [("replace", 50, 51, 50, 51), ("delete", 120, 125, 120, 120), ("insert", 160, 160, 155, 156)]
    assert 0.95 < merkle.likeness(whole, other) < 0.99 and merkle.likeness(whole, whole) == 1 and merkle.edits(whole, whole) == []
    assert merkle.likeness(merkle.fingerprint(""), whole) == 0 and merkle.likeness(merkle.fingerprint(""), merkle.fingerprint("")) == 1
    root, sections = merkle.parsed(whole)
    assert len(root) == 32 and sum(len(p) for _, p in sections) == 200 and len(sections) > 10
    half = merkle.fingerprint("".join(lines[:100]) + "".join(" ".join("zeta" + str(draw.randrange(9**6)) for _ in range(12)) + "\n" for _ in range(100)))
    assert abs(merkle.likeness(whole, half) - 0.5) < 0.05
