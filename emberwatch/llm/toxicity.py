"""Toxicity of whole texts: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its own embedding plus the mean of those of its character n-grams. A text is cut into windows of
``WINDOW`` words that overlap; every window is scored, and the highest decides. The label belongs to the
text, so training takes, for a toxic text, the window that scores highest at the time, and for a clean text its
highest and a random one. The network is fitted in one task, on a bounded sample; only the network reaches the driver.
"""

from __future__ import annotations

import pickle
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.llm.common import shipped

WINDOW, STRIDE = 32, 24
WIDTH, HIDDEN, ATTENTION = 8, 8, 4
GRAMS = (3, 5)
GRAM_HASHES = 1 << 20
#: Words and n-grams that fewer training texts hold have no embedding of their own.
LEAST_TEXTS = 4
#: Toxic rows that training takes at most, by order of a hash; of clean rows it takes up to twice as many.
TRAIN_ROWS = 1500
EPOCHS = 6
#: Windows that training draws from a text at most; scores always see all windows.
TRAIN_WINDOWS = 256
#: Words whose inputs a worker keeps; then it starts anew.
KEPT_WORDS = 300_000

_ODD = np.array([2654435761, 2246822519, 3266489917, 668265263, 374761393], np.uint64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character n-grams of all words, word by word, and how many each word has."""
    data = np.frombuffer(b"".join(b"<" + w + b">" for w in words) + bytes(8), np.uint8).astype(np.uint64)
    length = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), length)
    at = np.arange(len(owner))
    room = np.cumsum(length)[owner] - at  # characters from here to the word's end
    hashes, owners = [], []
    for n in GRAMS:
        p = at[room >= n]
        h = np.full(len(p), n, np.uint64)
        for i in range(n):
            h = (h ^ data[p + i]) * _ODD[i] & np.uint64(0xFFFFFFFFFF)
            h ^= h >> np.uint64(17)
        hashes.append((h % np.uint64(GRAM_HASHES)).astype(np.int32))
        owners.append(owner[p])
    owners, hashes = np.concatenate(owners), np.concatenate(hashes)
    return hashes[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(words))


def _sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of runs of n[0], n[1], ... rows."""
    out = np.zeros((len(n), values.shape[1]), np.float32)
    some = np.flatnonzero(n)
    if len(some):
        out[some] = np.add.reduceat(values, (np.cumsum(n) - n)[some], axis=0)
    return out


class Network:
    """Parameters, forward and backward pass. Word 0 is the filler of short windows and never counts."""

    def __init__(self, words: dict[bytes, int], grams: np.ndarray, seed: int = 7):
        """``words``: row of a word; ``grams``: row of an n-gram's hash. Row 0 is for all others and stays zero."""
        draw = np.random.default_rng(seed)
        f = lambda *shape: (draw.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.words, self.grams = words, grams
        self.word = (0.1 * draw.standard_normal((len(words) + 1, WIDTH))).astype(np.float32)
        self.gram = (0.1 * draw.standard_normal((int(grams.max()) + 1, WIDTH))).astype(np.float32)
        self.word[0] = self.gram[0] = 0
        self.p = {}
        for d in "fb":
            self.p |= {f"W{d}": f(WIDTH, 3 * HIDDEN), f"U{d}": f(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"A": f(2 * HIDDEN, ATTENTION), "v": f(ATTENTION, 1), "o": f(2 * HIDDEN, 1), "bias": np.zeros(1, np.float32)}
        self.scale, self.shift = 1.0, 0.0

    def inputs(self, words: list[bytes]) -> np.ndarray:
        hashes, n = _grams(words)
        own = np.array([self.words.get(w, 0) for w in words])
        return self.word[own] + _sums(self.gram[self.grams[hashes]], n) / np.sqrt(np.maximum(n, 1))[:, None]

    def projected(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x @ self.p["Wf"] + self.p["cf"], x @ self.p["Wb"] + self.p["cb"]])

    def _direction(self, xs, mask, U, keep: bool):
        """xs: inputs of the steps in the order they are taken; mask likewise. The states, and what backward needs."""
        h, states, saved = np.zeros((xs[0].shape[0], HIDDEN), np.float32), [], []
        for x, m in zip(xs, mask, strict=True):
            u = h @ U
            gates = _sigmoid(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            if m is not None:
                new = np.where(m[:, None], new, h)
            if keep:
                saved.append((h, u, z, r, n, m))
            h = new
            states.append(h)
        return states, saved

    def forward(self, table: np.ndarray, windows: np.ndarray, keep: bool = False):
        """Logits of windows of rows of ``table`` (projected inputs)."""
        T, H3 = windows.shape[1], 3 * HIDDEN
        mask = windows > 0
        full = mask.all(axis=0)
        steps = [None if full[t] else mask[:, t] for t in range(T)]
        forth, a = self._direction([table[windows[:, t], :H3] for t in range(T)], steps, self.p["Uf"], keep)
        back, b = self._direction([table[windows[:, t], H3:] for t in reversed(range(T))], steps[::-1], self.p["Ub"], keep)
        h = np.concatenate([np.stack(forth), np.stack(back[::-1])], axis=2)  # step, window, both directions
        e = np.tanh(h @ self.p["A"])
        s = (e @ self.p["v"])[:, :, 0]
        s = np.where(mask.T, s, -1e9)
        w = np.exp(s - s.max(axis=0))
        w /= w.sum(axis=0)
        pooled = (w[:, :, None] * h).sum(axis=0)
        logit = (pooled @ self.p["o"])[:, 0] + self.p["bias"][0]
        return (logit, (h, e, w, pooled, a, b)) if keep else logit

    def logits(self, table: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """As ``forward``, for many windows: ``table`` is turned, a row for each component, and so is all else."""
        N, T, H = len(windows), windows.shape[1], HIDDEN
        steps = np.ascontiguousarray(windows.T)
        mask = steps > 0
        full = mask.all(axis=1)
        h = np.empty((T, 2 * H, N), np.float32)
        for base, U, order, rows in ((0, self.p["Uf"].T.copy(), range(T), slice(0, H)), (3 * H, self.p["Ub"].T.copy(), range(T - 1, -1, -1), slice(H, None))):
            state, part = np.zeros((H, N), np.float32), table[base : base + 3 * H]
            for t in order:
                x, u = part.take(steps[t], axis=1), U @ state
                gates = x[: 2 * H] + u[: 2 * H]
                gates *= 0.5
                np.tanh(gates, out=gates)
                gates += 1
                gates *= 0.5
                n = u[2 * H :]
                n *= gates[H:]
                n += x[2 * H :]
                np.tanh(n, out=n)
                new = state - n
                new *= gates[:H]
                new += n
                state = new if full[t] else np.where(mask[t], new, state)
                h[t, rows] = state
        s = np.empty((T, N), np.float32)
        turned, v = self.p["A"].T.copy(), self.p["v"][:, 0]
        for t in range(T):
            s[t] = v @ np.tanh(turned @ h[t])
        s[~mask] = -1e9
        s -= s.max(axis=0)
        np.exp(s, out=s)
        s /= s.sum(axis=0)
        out = np.zeros(N, np.float32)
        o = self.p["o"][:, 0]
        for t in range(T):
            out += s[t] * (o @ h[t])
        return out + self.p["bias"][0]

    def backward(self, saved, d: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters and of the projected inputs (step, window), for gradients of the logits."""
        h, e, w, pooled, a, b = saved
        p, T = self.p, len(h)
        g = {"o": pooled.T @ d[:, None], "bias": d.sum(keepdims=True)}
        d_pooled = d[:, None] * p["o"][:, 0]
        d_w = (h * d_pooled).sum(axis=2)
        d_s = w * (d_w - (w * d_w).sum(axis=0))
        d_e = d_s[:, :, None] * p["v"][:, 0] * (1 - e * e)
        g["v"] = np.einsum("tnk,tn->k", e, d_s)[:, None]
        g["A"] = np.einsum("tnh,tnk->hk", h, d_e)
        d_h = w[:, :, None] * d_pooled + d_e @ p["A"].T
        d_x = np.zeros((T, h.shape[1], 6 * HIDDEN), np.float32)
        for name, steps, order, cols in (("Uf", a, range(T), slice(0, HIDDEN)), ("Ub", b, range(T - 1, -1, -1), slice(HIDDEN, None))):
            U, gU, carry = p[name], np.zeros_like(p[name]), np.zeros((h.shape[1], HIDDEN), np.float32)
            base = 0 if name == "Uf" else 3 * HIDDEN
            for (before, u, z, r, n, m), t in list(zip(steps, order, strict=True))[::-1]:
                got = carry + d_h[t][:, cols]
                on = got if m is None else got * m[:, None]
                d_n = on * (1 - z) * (1 - n * n)
                d_z = on * (before - n) * z * (1 - z)
                d_r = d_n * u[:, 2 * HIDDEN :] * r * (1 - r)
                d_u = np.hstack([d_z, d_r, d_n * r])
                d_x[t][:, base : base + 3 * HIDDEN] = np.hstack([d_z, d_r, d_n])
                gU += before.T @ d_u
                carry = on * z + d_u @ U.T + (got - on)
            g[name] = gU
        return g, d_x


def _words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").split()


def cut(n: int) -> np.ndarray:
    """Where the windows of a text of n words start; the last one ends with the text."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)


def _windows(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    if len(tokens) < WINDOW:
        tokens = np.concatenate([tokens, np.zeros(WINDOW - len(tokens), tokens.dtype)])
    return tokens[starts[:, None] + np.arange(WINDOW)]


def _gather(values: np.ndarray, size: int, owners: np.ndarray) -> np.ndarray:
    """Sums of the rows of each owner."""
    order = np.argsort(owners, kind="stable")
    return _sums(values[order], np.bincount(owners, minlength=size))


def train(texts: list[str], labels: list[int], seed: int = 7, epochs: int = EPOCHS) -> Network | None:
    """A network fitted to whole texts, a fifth of them kept back to calibrate the score; None without both classes."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    draw = np.random.default_rng(seed)
    known: dict[bytes, int] = {b"": 0}
    tokens = [np.array([known.setdefault(w, len(known)) for w in _words(t)], np.int32) for t in texts]
    vocabulary = list(known)
    portions = [_grams(vocabulary[i : i + 20_000]) for i in range(0, len(vocabulary), 20_000)]
    hashes, n = (np.concatenate(c) for c in zip(*portions, strict=True))
    del portions
    firsts = np.cumsum(n) - n
    part = np.where(draw.random(len(y)) < 0.2, 1, 0) if len(y) >= 50 else np.zeros(len(y), int)
    fit, check = np.flatnonzero(part == 0), np.flatnonzero(part == 1)
    if not len(check) or y[fit].min() == y[fit].max() or y[check].min() == y[check].max():
        fit = check = np.arange(len(y))
    # In how many fitted texts of either class is each word, each n-gram?
    in_words, in_grams = np.zeros((2, len(vocabulary)), np.int32), np.zeros((2, GRAM_HASHES), np.int32)
    for i in fit:
        distinct = np.unique(tokens[i])
        in_words[int(y[i]), distinct] += 1
        if len(distinct):
            pieces = np.concatenate([np.arange(a, a + b) for a, b in zip(firsts[distinct], n[distinct], strict=True)])
            in_grams[int(y[i]), np.unique(hashes[pieces])] += 1
    common = np.flatnonzero(in_words.sum(axis=0) >= LEAST_TEXTS)
    gram_rows, some = np.zeros(GRAM_HASHES, np.int32), np.flatnonzero(in_grams.sum(axis=0) >= LEAST_TEXTS)
    gram_rows[some] = np.arange(1, len(some) + 1)
    net = Network({vocabulary[w]: i + 1 for i, w in enumerate(common)}, gram_rows, seed)
    # Embeddings start with the log odds of their row as first component, drawn to 0 where little is seen.
    size = np.array([[(y[fit] == 0).sum()], [(y[fit] == 1).sum()]])
    for table, seen in ((net.word, in_words[:, common]), (net.gram, in_grams[:, some])):
        rate = (seen + 5 * size / size.sum()) / size
        table[1:, 0] = 0.5 * np.log(rate[1] / rate[0])
    own, grams = np.zeros(len(vocabulary), np.int32), gram_rows[hashes]
    own[common] = np.arange(1, len(common) + 1)
    del known, vocabulary, hashes, in_words, in_grams
    share = (1 / np.sqrt(np.maximum(n, 1)))[:, None]
    starts = [cut(len(t)) for t in tokens]
    odds = net.word[own, 0] + (_sums(net.gram[:, :1][grams], n) * share)[:, 0]

    def best(ids: np.ndarray, score) -> np.ndarray:
        """Start of the highest window of each text."""
        wins = np.concatenate([_windows(tokens[i], starts[i]) for i in ids])
        counts = np.array([len(starts[i]) for i in ids])
        values, firsts = score(wins), np.cumsum(counts) - counts
        return np.array([f + values[f : f + c].argmax() for f, c in zip(firsts, counts, strict=True)]), wins, values

    def logits(wins: np.ndarray) -> np.ndarray:
        table = np.empty((6 * HIDDEN, len(own)), np.float32)
        for at in range(0, len(own), 20_000):
            some = slice(at, at + 20_000)
            pieces = grams[firsts[at] : firsts[at] + n[some].sum()]
            table[:, some] = net.projected(net.word[own[some]] + _sums(net.gram[pieces], n[some]) * share[some]).T
        return np.concatenate([net.logits(table, wins[i : i + 2048]) for i in range(0, len(wins), 2048)])

    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    sums = {"word": np.full(len(net.word), 1e-3, np.float32), "gram": np.full(len(net.gram), 1e-3, np.float32)}
    step = 0
    for epoch in range(epochs):
        if epoch in (0, 2, 4):
            top, wins, _ = best(fit, (lambda w: odds[w].max(axis=1)) if epoch == 0 else logits)
        counts = np.array([len(starts[i]) for i in fit])
        other = np.cumsum(counts) - counts + (draw.random(len(fit)) * counts).astype(int)
        clean = y[fit] == 0
        chosen, target = np.concatenate([top, other[clean]]), np.concatenate([y[fit], y[fit][clean]])
        weight = np.where(target == 1, 0.5 / max(1, target.sum()), 0.5 / max(1, (1 - target).sum())) * len(target)
        order = draw.permutation(len(chosen))
        for at in range(0, len(order), 256):
            rows = order[at : at + 256]
            batch = wins[chosen[rows]]
            used, inverse = np.unique(batch, return_inverse=True)
            inverse = inverse.reshape(batch.shape)
            if used[0] != 0:  # the filler keeps place 0
                used, inverse = np.append(0, used), inverse + 1
            pieces = np.concatenate([np.arange(a, a + b) for a, b in zip(firsts[used], n[used], strict=True)])
            piece_owner = np.repeat(np.arange(len(used)), n[used])
            x = net.word[own[used]] + _sums(net.gram[grams[pieces]], n[used]) * share[used]
            logit, saved = net.forward(net.projected(x), inverse, keep=True)
            d = ((_sigmoid(logit) - target[rows]) * weight[rows] / len(rows)).astype(np.float32)
            g, d_in = net.backward(saved, d)
            flat = inverse.T.reshape(-1)
            d_proj = _gather(d_in.reshape(len(flat), -1), len(used), flat)
            for k, cols in (("f", slice(0, 3 * HIDDEN)), ("b", slice(3 * HIDDEN, None))):
                g[f"W{k}"], g[f"c{k}"] = x.T @ d_proj[:, cols], d_proj[:, cols].sum(axis=0)
            d_word = d_proj[:, : 3 * HIDDEN] @ net.p["Wf"].T + d_proj[:, 3 * HIDDEN :] @ net.p["Wb"].T
            step += 1
            for k, v in g.items():
                m = moments[k]
                m[0] = 0.9 * m[0] + 0.1 * v
                m[1] = 0.999 * m[1] + 0.001 * v * v
                net.p[k] = (net.p[k] - 0.01 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            for name, tab, ids, change in (("word", net.word, own[used], d_word), ("gram", net.gram, grams[pieces], (d_word * share[used])[piece_owner])):
                ids, back = np.unique(ids, return_inverse=True)
                total = _gather(change, len(ids), back)
                sums[name][ids] += (total * total).mean(axis=1)
                tab[ids] -= 0.05 * total / np.sqrt(sums[name][ids])[:, None]
                tab[0] = 0
    # Calibration: logistic regression on the highest logit, with targets moved in by one case of each class.
    top, _, values = best(check, logits)
    x, positive = values[top].astype(float), y[check] == 1
    hi, lo = (positive.sum() + 1) / (positive.sum() + 2), 1 / ((~positive).sum() + 2)
    t, (a, b) = np.where(positive, hi, lo), (1.0, 0.0)
    for _ in range(50):
        q = _sigmoid(a * x + b)
        w, e = q * (1 - q) + 1e-9, q - t
        hess = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        move = np.linalg.solve(hess, [(e * x).sum() + 1e-3 * (a - 1), e.sum() + 1e-3 * b])
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -2, 2)
    net.scale, net.shift = float(max(a, 1e-3)), float(b)
    return net


class Scorer:
    """Scores texts one batch at a time; keeps the inputs of words it has met, also from task to task."""

    @staticmethod
    def of(net: Network) -> Scorer:
        """The scorer of this process for a network that was sent to it."""
        if not hasattr(net, "scorer"):
            net.scorer = Scorer(net)
        return net.scorer

    def __init__(self, net: Network):
        self.net, self.known, self.table, self.used = net, {}, np.zeros((6 * HIDDEN, 1 << 16), np.float32), 1

    def _ids(self, words: list[bytes]) -> np.ndarray:
        if self.used > KEPT_WORDS:
            self.known, self.used = {}, 1
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            while self.used + len(some) > self.table.shape[1]:
                self.table = np.hstack([self.table, np.zeros_like(self.table)])
            self.table[:, self.used : self.used + len(some)] = self.net.projected(self.net.inputs(some)).T
            known.update(zip(some, range(self.used, self.used + len(some)), strict=True))
            self.used += len(some)
        return np.fromiter(map(known.__getitem__, words), np.int32, len(words))

    def scores(self, texts: Iterator[str | None]) -> list[float]:
        """The calibrated score of each text; one without words has no window and scores 0."""
        tops: list[float] = []
        wins: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        pending = 0

        def flush() -> None:
            nonlocal pending
            if wins:
                w, o = np.concatenate(wins), np.concatenate(owners)
                values = np.concatenate([self.net.logits(self.table, w[i : i + 2048]) for i in range(0, len(w), 2048)])
                best = np.full(len(tops), -np.inf)
                np.maximum.at(best, o, values)
                for i in np.unique(o):
                    tops[i] = max(tops[i], best[i])
            wins.clear()
            owners.clear()
            pending = 0

        for text in texts:
            words, i = _words(text), len(tops)
            tops.append(-np.inf)
            if not words:
                continue
            step = 1 << 16  # very long texts go in pieces that overlap by a window
            for at in range(0, max(1, len(words) - WINDOW + STRIDE), step):
                some = words[at : at + step + WINDOW]
                if self.used > KEPT_WORDS:
                    flush()
                tokens = self._ids(some)
                starts = cut(len(some))
                wins.append(_windows(tokens, starts))
                owners.append(np.full(len(starts), i))
                pending += len(starts)
                if pending >= 8192:
                    flush()
        flush()
        return [float(_sigmoid(np.float64(self.net.scale * t + self.net.shift))) for t in tops]


def held_out() -> Column:
    """Rows that are kept for testing; a row without doc_id isn't."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def drawn(text: str | None, most: int = TRAIN_WINDOWS) -> str:
    """A text for training: whole up to ``most`` windows, else so many windows drawn at random, in their order."""
    words = (text or "").split()
    if len(words) < WINDOW + most * STRIDE:
        return text or ""
    starts = sorted(random.Random(len(words)).sample(range(0, len(words) - WINDOW + 1, STRIDE), most))
    return " ".join(w for s in starts for w in words[s : s + WINDOW])


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """Rows (doc_id, text, toxic) that aren't held out, the first by a hash: ``most`` toxic ones, twice that of the clean."""
    usable = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by_hash = [F.xxhash64(F.lit(11), F.col("doc_id")), "doc_id"]
    chosen = [usable.where(f"toxic = {c}").orderBy(*by_hash).limit(most * (2 - c)) for c in (0, 1)]
    chosen = F.broadcast(chosen[0].union(chosen[1]))  # at most three times ``most`` rows

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([drawn(t.as_py()) for t in batch.column("text")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts, batch.column("toxic")], ["doc_id", "text", "toxic"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
    rows = rows.mapInArrow(draw, "doc_id long, text string, toxic int")
    # Rows that repeat a chosen id would be without bound: of each id the first texts by a hash count.
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def fitted(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> tuple[Network | None, float]:
    """The network fitted to ``training_rows`` by one task, and the share of toxic rows among them."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        toxic: list[int] = []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            toxic += batch.column("toxic").to_pylist()
        if texts:
            net = train(texts, toxic)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary()), pa.array([float(np.mean(toxic))])], ["net", "share"])

    shipped(docs.sparkSession)
    rows = training_rows(docs, labels, most).repartition(1).sortWithinPartitions("doc_id")
    made = rows.mapInArrow(fit, "net binary, share double").collect()  # a few MB
    return (pickle.loads(made[0].net), made[0].share) if made else (None, 0.0)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most: int = TRAIN_ROWS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score and predicted (1 if the score reaches ``threshold``).

    Learns from ``labels`` (doc_id, toxic) of rows that aren't held out, see ``training_rows`` and ``drawn``; without rows of
    both classes the score is the share of toxic rows (0 without any). Only the text is an input. Null texts count as
    empty; a text without words has no window and scores 0. Null and repeated ids are rows like others.
    An empty table gives an empty result. Other columns are ignored.
    """
    net, constant = fitted(docs, labels, most)
    model = shipped(docs.sparkSession).sparkContext.broadcast(net)  # a few MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer.of(model.value) if model.value else None
        for batch in batches:
            values = scorer.scores(x.as_py() for x in batch.column(1)) if scorer else [constant] * batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(values, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
