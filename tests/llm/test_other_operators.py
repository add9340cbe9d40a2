"""Mixing, neighbours, shards, token files and toxicity."""

from __future__ import annotations

import pickle
import random
import tracemalloc
import zlib
from types import SimpleNamespace

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberwatch.llm import ann, mixing, shards, toxicity, wavelet
from test_text_operators import HARD


def test_mix(spark):
    draw = random.Random(1)
    rows = [(i, "w " * draw.randint(0, 60), draw.choice(["a", "b", "c", "c", "c", "c", "é", None])) for i in range(400)] + [(900, "one two", "tiny"), (901, "", "void")]
    got = mixing.taken(brute.table(spark, rows), block_words=16).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while True:  # the excess of those above goes to the others until none is above
        share = {s: left * weight[s] / sum(weight[f] for f in free) for f in [0] for s in free}
        above = {s for s in free if share[s] > 3 * sizes[s]}
        if not above:
            target |= share
            break
        target |= {s: 3.0 * sizes[s] for s in above}
        free -= above
        left -= sum(target[s] for s in above)
    assert len(got) == len(rows)
    for s in names:
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == sizes[s] and r.taken <= 3 * r.size for r in mine)
        assert sum(r.taken for r in mine) == int(target[s] + 1e-9)


def test_schedule_is_spread_evenly(spark):
    sources = spark.createDataFrame([("a", 50), ("b", 30), ("c", 20), (None, 1)], "source string, blocks long")
    slots = mixing.schedule(sources).orderBy("slot").collect()
    assert [r.slot for r in slots] == list(range(128))
    for s, n in (("a", 50), ("b", 30), ("c", 20), (None, 1)):
        mine = [r for r in slots if r.source == s]
        assert [r["rank"] for r in mine] == list(range(len(mine))) and len(mine) >= n
        for first in range(0, 128, 16):  # any sixteenth of the schedule holds nearly its share
            held = sum(first <= r.slot < first + 16 for r in mine)
            assert abs(held - 16 * len(mine) / 128) <= 2


def test_mix_edge_rows(spark):
    got = mixing.taken(brute.table(spark, HARD)).collect()
    assert len(got) == len(HARD) and sum(r.taken for r in got) <= 3 * sum(r.size for r in got)
    assert mixing.taken(brute.table(spark, [])).count() == 0




def test_shards(spark):
    rows = [(i % 700, f"text {i % 500}", None) for i in range(1000)] + HARD
    got = shards.assign(brute.table(spark, rows)).collect()
    n = len(rows)
    assert sorted(r.position for r in got) == list(range(n))
    by_shard = {}
    for r in got:
        assert (r.shard, r.slot) == (r.position % 40, r.position // 40)
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    sizes = {(r.doc_id, r.size, r.text_crc32) for r in got}
    assert sizes == {(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows}
    key = lambda rs: sorted((str(r.doc_id), r.size, r.text_crc32, r.position) for r in rs)
    again = shards.assign(brute.table(spark, rows).repartition(2)).collect()
    assert key(got) == key(again)
    assert shards.assign(brute.table(spark, [])).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 1000])
def test_permutation(spark, n):
    got = [r.p for r in spark.range(n).select(F.expr(shards.permuted("id", n, 5)).alias("p")).collect()]
    assert sorted(got) == list(range(n))
    if n == 1000:
        assert abs(np.corrcoef(range(n), got)[0, 1]) < 0.1


def brute_neighbours(rows, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for q in ids[ids % 20 == 0]:
        s = (x * x[ids == q][0]).sum(axis=1)
        order = [o for o in np.lexsort((ids, -s)) if ids[o] != q][:k]
        out[q] = [(int(ids[o]), s[o]) for o in order]
    return out


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)


def test_neighbours(spark):
    draw = np.random.default_rng(0)
    centres = draw.standard_normal((12, 16))
    x = (centres[draw.integers(0, 12, 3000)] + 0.4 * draw.standard_normal((3000, 16))).astype(np.float32)
    x[500:1500] = 3 * x[500]  # a third is one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(4000, None), (4020, [0.0] * 16), (4040, [float("nan")] + [1.0] * 15), (4060, [float("inf")] + [1.0] * 15), (None, [1.0] * 16), (4080, [1.0])]
    got = ann.neighbours(vectors(spark, rows + bad), F.col("vec_id") % 20 == 0).collect()
    want = brute_neighbours(rows, 20)
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(found) == set(want) and all(set(f) == set(range(1, 21)) for f in found.values())
    hits = sum(len({v for v, _ in f.values()} & {v for v, _ in want[q]}) for q, f in found.items())
    assert hits >= 0.9 * 20 * len(want)
    for q, f in found.items():
        ranked = [f[i] for i in range(1, 21)]
        assert ranked == sorted(ranked, key=lambda p: (-p[1], p[0]))
    assert [v for v, _ in sorted(found[520].values(), key=lambda p: (-p[1], p[0]))] == [i for i in range(500, 521) if i != 520]


@pytest.mark.parametrize("kind, short", [("<f4", True), ("<f8", False)])
@pytest.mark.parametrize("share", [0.02, 0.6])
def test_compared(kind, short, share):
    """Pairs of a tile of queries and blocks of vectors, list by list or all at once, against a plain version."""
    draw, width, k, n_lists = np.random.default_rng(7), 12, 5, 60
    x = draw.standard_normal((5000, width)).round(1).astype(kind)  # many equal scores
    x[1000:1100] = x[1000]
    lists = np.full((len(x), ann.COPIES), -1, "<i2")
    lists[:, 0] = np.sort(draw.integers(0, n_lists, len(x)))
    lists[::2, 1] = (lists[::2, 0] + 1) % n_lists
    visits = draw.random((100, n_lists)) < share
    bound = np.where(np.arange(100) % 3 == 0, -np.inf, 0.0)
    bits = [r.tobytes() for r in np.packbits(visits, axis=1)]
    asked = pa.table({"vec_id": pa.array(range(0, 5000, 50)), "vector": pa.array([r.tobytes() for r in x[::50]]), "visits": pa.array(bits), "bound": pa.array(bound)})
    tile = ann.Tile(asked, width, kind)
    rows = pa.record_batch({"lists": pa.array([r.tobytes() for r in lists]), "vec_id": pa.array(range(5000)), "vector": pa.array([r.tobytes() for r in x])})
    run = ann._compared(SimpleNamespace(value=tile), width, kind, short, k)
    got = sorted(r for b in run(iter([rows.slice(0, 3000), rows.slice(3000)])) for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    want = []
    for i, q in enumerate(range(0, 5000, 50)):
        s = np.einsum("id,id->i", np.repeat(x[q : q + 1].astype(float), len(x), 0), x.astype(float))
        meets = (visits[i][lists] & (lists >= 0)).any(axis=1) & (np.arange(len(x)) != q) & (s >= bound[i])
        want += [(q, int(v), s[v]) for v in np.lexsort((np.arange(len(x)), -s)) if meets[v]][:k]
    assert got == sorted(want) and len(want) > 300


@pytest.mark.parametrize("element", ["float", "double"])
def test_neighbours_in_several_tiles(spark, monkeypatch, element):
    """All lists are visited, so the result is exact: repeated rows count once, and ids may have two vectors."""
    for name, value in {"TILE": 7, "SAMPLE": 300, "LIST_SIZE": 40, "BLOCK": 64}.items():
        monkeypatch.setattr(ann, name, value)
    monkeypatch.setattr(ann.Index, "_calibrate", lambda self, *_: setattr(self, "ratio", np.inf))
    draw = np.random.default_rng(2)
    x = draw.standard_normal((900, 8)).astype(np.float32)
    x[200:500] = x[200]  # a third is one vector
    rows = [(i, v.tolist(), i % 20 == 0) for i, v in enumerate(x)]
    rows += [(60, x[77].tolist(), False), *rows[:300]]
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{element}>, chosen boolean").repartition(3)
    want, distinct = [], sorted({(i, tuple(v)) for i, v, _ in rows})
    ids, x = np.array([i for i, _ in distinct]), np.array([v for _, v in distinct])
    for q in sorted({i for i, _, chosen in rows if chosen}):
        best = {(-(s := float((x[a] * x[b]).sum())).__round__(9), int(ids[b]), s) for a in np.flatnonzero(ids == q) for b in range(len(ids)) if ids[b] != q}
        want += [(q, r + 1, v, s) for r, (_, v, s) in enumerate(sorted(best)[:20])]
    got = [tuple(r) for r in ann.neighbours(table, F.col("chosen")).orderBy("query_id", "rank").collect()]
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want])


def test_neighbours_send_little_to_the_driver_and_store_a_vector_once(spark, monkeypatch):
    """The sample is chosen before it is sent, and no table has a row for each list of a vector or query."""
    monkeypatch.setattr(ann, "SAMPLE", 500)
    rows, tables = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(4).standard_normal((6000, 64)))], []
    table, write = vectors(spark, rows).repartition(12).localCheckpoint(), ann.written
    monkeypatch.setattr(ann, "written", lambda df, *path: tables.append(write(df, *path)) or tables[-1])
    conf = spark.sparkContext._jsc.sc().conf()
    limit = conf.get("spark.driver.maxResultSize", "1g")
    conf.set("spark.driver.maxResultSize", "1m")  # all vectors have 1.5 MB, the sample has a quarter of one
    try:
        found = ann.neighbours(table, F.col("vec_id") % 20 == 0)
        assert found.count() == 300 * 20
    finally:
        conf.set("spark.driver.maxResultSize", limit)
    assert max(t.count() for t in tables) <= 6000


def test_index_is_built_and_sent_in_little_memory(monkeypatch):
    draw = np.random.default_rng(5)
    sample = draw.standard_normal((8000, 8))
    tracemalloc.start()
    try:
        index = ann.Index(sample, 1500 * ann.LIST_SIZE, np.sqrt((sample**2).sum(axis=1)).max(), 20)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(index.centroids) == 1500
    assert peak < 8000 * 1500 * 8  # less than the distances of all rows to all centroids
    assert len(pickle.dumps(index)) < 2e6 < 1500 * 1500 * 8


def test_few_vectors(spark):
    rows = [(i, [float(i), 1.0]) for i in range(5)]
    got = ann.neighbours(vectors(spark, rows), F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, i + 1, i + 1, 1.0) for i in range(4)]
    assert ann.neighbours(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.neighbours(vectors(spark, rows[:1]), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 300_000])
def test_wavelet_matrix(n):
    draw = np.random.default_rng(n)
    ids = (draw.zipf(1.3, n) % 50257).astype(np.uint16)
    m = wavelet.WaveletMatrix(wavelet.build(ids, [5, None], [n, 0]))
    assert (m.ids() == ids).all() and m.docs == [5, None] and m.lengths.tolist() == [n, 0]
    for i in map(int, draw.integers(0, n, 10) if n else []):
        assert m.access(i) == ids[i]
        assert m.count(int(ids[i]), 0, n // 2) == (ids[: n // 2] == ids[i]).sum()
    if n:
        assert m.places(777) == np.flatnonzero(ids == 777).tolist() and m.places(int(ids[-1]))[-1] == n - 1


@pytest.fixture(scope="module")
def tokenizer():
    tokens = pytest.importorskip("public_tokenizers")
    with open(tokens.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def plain_ids(tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(tokenizer)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_pieces_encode_like_whole_texts(tokenizer):
    draw = random.Random(0)
    texts = ["", " ", "  a", "a   b", "a \n b\n\n c ", "x\t y", "a\x1c b", "it's  'll  don't", " \n", "é 𝄞  <|endoftext|> z", "  a  b", "a 　b"]
    texts += ["".join(draw.choice("ab'sl1.  \n\t é ") for _ in range(draw.randint(1, 30))) for _ in range(2000)]
    ids = plain_ids(tokenizer)
    for text, got in zip(texts, wavelet.Encoder(tokenizer).encode(texts), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == ids(text), repr(text)


def test_only_pieces_that_are_new_are_met(tokenizer, monkeypatch):
    encoder, met, meet = wavelet.Encoder(tokenizer), [], wavelet.Encoder._meet
    monkeypatch.setattr(wavelet.Encoder, "_meet", lambda self, known, new, space: met.append(set(new)) or meet(self, known, new, space))
    texts, more = ["one two, l'été x1 two", "three\ntwo"], ["one two, three four"]
    first = encoder.encode(texts)
    assert met == [{"one", "three", "two"}, {"two,", "l'été", "x1", "two"}]
    met.clear()
    assert encoder.encode(texts) == first and not met
    got = encoder.encode(more)
    assert met == [{"three", "four"}]
    monkeypatch.setattr(wavelet, "KEPT_PIECES", 0)
    late = wavelet.Encoder(tokenizer)
    assert late.encode(texts) == first and late.encode(more) == got and not late.known and not late.first
    ids = plain_ids(tokenizer)
    assert [np.frombuffer(x, "<u2").tolist() for x in first + got] == [ids(t) for t in texts + more]


def test_token_files(spark, tokenizer, tmp_path):
    rows = [(i, f"text number {i} is here, " * (i % 7), None) for i in range(60)] + [(70, None, None), (71, "", None), (72, "word " * 30000, None)]
    docs = brute.table(spark, rows)
    wavelet.write(docs, tokenizer, str(tmp_path / "shards"), most=500)
    assert spark.read.parquet(str(tmp_path / "shards")).count() >= 4
    got = {r.doc_id: r for r in wavelet.documents(spark, str(tmp_path / "shards")).collect()}
    ids, start = plain_ids(tokenizer), 0
    for i, t, _ in sorted(rows):
        want = [*ids(t), 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
    assert wavelet.round_trip(brute.table(spark, []), tokenizer).count() == 0
    assert wavelet.round_trip(brute.table(spark, HARD), tokenizer).count() == len(HARD)


def toxic_texts(seed=1, n=400):
    draw = random.Random(seed)
    syllables = ["ta", "re", "mo", "li", "en", "ko", "su", "ba", "ni", "to"]
    word = lambda: "".join(draw.choice(syllables) for _ in range(draw.randint(1, 4)))
    rows = []
    for i in range(n):
        words, bad = [word() for _ in range(draw.randint(10, 200))], i % 4 == 0
        if bad:
            for _ in range(draw.randint(1, 3)):
                words[draw.randrange(len(words))] = draw.choice(["zorgel", "vexu", "vexu" + word()])
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_gradients():
    rows = toxic_texts(n=40)
    net = toxicity.train([t for _, t, _ in rows], [y for _, _, y in rows], epochs=1)
    vocabulary = [b"", *{w for _, t, _ in rows for w in t.encode().split()}]
    table = net.projected(net.inputs(vocabulary)).astype(np.float32)
    wins = np.random.default_rng(0).integers(1, len(vocabulary), (6, toxicity.WINDOW))
    wins[2, 20:] = 0
    logit, saved = net.forward(table, wins, keep=True)
    assert np.allclose(logit, net.logits(np.ascontiguousarray(table.T), wins), atol=1e-4)
    grads, _ = net.backward(saved, np.ones(6, np.float32))
    for name in ("Uf", "Ub", "A", "v", "o"):
        at, eps = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape), 1e-2
        keep = net.p[name][at]
        net.p[name][at] = keep + eps
        up = net.forward(table, wins).sum()
        net.p[name][at] = keep - eps
        down = net.forward(table, wins).sum()
        net.p[name][at] = keep
        assert abs((up - down) / (2 * eps) - grads[name][at]) < 0.03 * max(1, abs(grads[name][at])), name


def test_toxicity(spark):
    rows = toxic_texts(n=1200)
    docs = brute.table(spark, [(i, t, None) for i, t, _ in rows] + [(5000, "", None), (None, None, None), (5001, "tare " * 30000, None)])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == 1203 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    right = sum(r.predicted == truth[r.doc_id] for r in held) / len(held)
    assert right > 0.93, right


def test_toxicity_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(brute.table(spark, HARD), labels).collect()} == {0.0}
    assert toxicity.score(brute.table(spark, []), labels).count() == 0


def test_long_texts_are_drawn_from_for_training():
    for most in (1, 3):
        edge = toxicity.WINDOW + most * toxicity.STRIDE
        for n in (0, 1, edge - 1, edge, edge + 1, edge + toxicity.STRIDE, 20 * edge):
            text = " ".join(map(str, range(n)))
            got = toxicity.drawn(text, most)
            assert got == text if n < edge else len(got.split()) == most * toxicity.WINDOW and set(got.split()) <= set(text.split())
    assert toxicity.drawn(None) == ""


def test_long_texts_score_like_their_windows():
    rows = toxic_texts(n=60)
    net = toxicity.train([t for _, t, _ in rows], [y for _, _, y in rows], epochs=1)
    text = " ".join(t for _, t, _ in rows) + " tare" * 70000
    words = toxicity._words(text)
    scorer = toxicity.Scorer(net)
    whole = scorer.scores([text])[0]
    tokens = scorer._ids(words)
    every = net.logits(scorer.table, toxicity._windows(tokens, np.arange(0, len(words) - toxicity.WINDOW + 1, toxicity.STRIDE)))
    assert whole >= toxicity._sigmoid(np.float64(net.scale * every.max() + net.shift)) - 1e-4
