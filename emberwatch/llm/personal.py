"""Personal data: checked formats, and boosted trees over candidate spans.

Generators with high recall propose spans that may overlap. Trees boosted on the log loss look at their format and
at the words around them. Of the candidates of a bounded sample of the corpus, the formats' own checks label those that
they accept, and rules refute look-alikes (dates, versions, amounts, failed check digits); all others are unlabelled
and not used, as they may be personal data in another form. Variants of what the checks accept (other separators,
spelled-out signs) and look-alikes are added, so the trees learn the shape and the context, not only the check. Scores are calibrated on a part kept back, and the
threshold is the lowest with the wanted precision there.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import shipped

KINDS = ("email", "ip", "card", "phone")
_EMAIL_REST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
# A run of digits that fails as a start fails at its later digits too, so only its first is tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

#: What proposes spans, by name.
GENERATORS = {
    "mail": re.compile(r"(?<![\w.+-])[\w.+-]{1,64}[ ]?(?:@|\(at\)|\[at\]|＠| at )[ ]?[\w-]{1,64}(?:[ ]?(?:\.|\(dot\)|\[dot\]| dot )[ ]?[\w-]{1,64}){1,6}"),
    "digits": re.compile(r"(?<![0-9])[+(]{0,2}[0-9](?:[ ().\-/]{0,3}[0-9]){6,30}(?![0-9])"),
    "address": re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{0,4}(?![0-9A-Fa-f:])|(?<![0-9.])[0-9]{1,3}(?:[.]|\[\.\]| \. )[0-9]{1,3}(?:(?:[.]|\[\.\]| \. )[0-9]{1,3}){2}(?![0-9])"),
    "account": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])"),
}
#: Words before a span that speak for or against it.
CONTEXT = (
    "mail|e-mail|contact|write|reach", "phone|tel|call|mobile|fax|whatsapp", "card|visa|credit|pay|account|iban|bank",
    "ip|host|server|login|address|client", "version|release|build|v|chapter|section", "date|born|on|since|year",
    "price|total|sum|eur|usd|cost", "id|order|invoice|number|no|ref|isbn",
)
_CONTEXT = [re.compile(rf"\b(?:{c})\b", re.I) for c in CONTEXT]
#: What rules refute: dates, amounts, versions, and identifiers announced as such right before them.
_DATE = re.compile(r"(?:19|20)[0-9]{2}([-/.])(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])([-/.])(?:0?[1-9]|[12][0-9]|3[01])\2(?:19|20)[0-9]{2}")
_AMOUNT = re.compile(r"[0-9]{1,3}(?:([.,])[0-9]{3})(?:\1[0-9]{3})*(?:[.,][0-9]{1,2})?")
_SAYS_AMOUNT = re.compile(r"(?:[$€£]|\b(?:price|total|sum|eur|usd|cost)\b[: ]?)[ ]?$", re.I)
_SAYS_VERSION = re.compile(r"\b(?:version|release|build|chapter|section)\b[: ]? ?$|\bv\.? ?$", re.I)
_SAYS_CARD = re.compile(r"\b(?:card|visa|credit)\b[: ]? ?$", re.I)
_QUAD = re.compile(r"[0-9]{1,3}(?:(?:[.]|\[\.\]| \. )[0-9]{1,3}){3}")
SAMPLE_DOCS = 20_000
SAMPLE_CANDIDATES = 20_000
PRECISION = 0.98


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the checked formats, in order; each kind's matches are leftmost and don't overlap."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and _LOCAL.match(text, start - 1):
            start -= 1
        rest = _EMAIL_REST.match(text, at + 1) if start < at else None
        if rest:
            out.append((start, 0, last := rest.end()))
        at = text.find("@", max(at + 1, last))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, end, generator); spans of several generators may overlap."""
    out = []
    numbers = _DIGIT.search(text) is not None
    for g, (name, pattern) in enumerate(GENERATORS.items()):
        if name == "mail":
            if not ("@" in text or "＠" in text or "at)" in text or "at]" in text or " dot " in text or "dot)" in text):
                continue
        elif not numbers:
            continue
        out += [(m.start(), m.end(), g) for m in pattern.finditer(text)]
    return out


def refuted(text: str, start: int, end: int) -> bool:
    """Whether a rule says that a candidate is no personal data; what no rule speaks against may be."""
    span, before = text[start:end], text[max(0, start - 12) : start]
    if _DATE.fullmatch(span):
        return True
    if _SAYS_AMOUNT.search(before) and (_AMOUNT.fullmatch(span) or span.isdecimal()) or text[end : end + 1] in ("%", "€"):
        return True
    if _SAYS_VERSION.search(before) and re.fullmatch(r"[0-9.\-]+", span):
        return True
    if _QUAD.fullmatch(span):
        return any(int(g) > 255 for g in re.findall("[0-9]+", span))
    digits = re.sub(r"[ -]", "", span)
    return bool(_SAYS_CARD.search(before)) and digits.isdecimal() and 12 <= len(digits) <= 19 and not luhn(digits)


def features(text: str, start: int, end: int, generator: int) -> list[float]:
    span, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 1]
    digits = "".join(c for c in span if c in "0123456789")
    groups = re.findall("[0-9]+", span)
    letters = sum(c.isalpha() for c in span)
    return [
        generator, len(span), len(digits), letters, len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        span.count(" "), span.count("-"), span.count("."), span.count("("), span.count("/"), span.count(":"),
        span.startswith("+"), "@" in span, len(span.rsplit(".", 1)[-1]), bool(digits) and len(digits) >= 12 and luhn(digits),
        max((int(g[:9]) for g in groups), default=-1) <= 255, span.startswith("00"), sum(c.isupper() for c in span),
        bool(before) and before[-1].isalnum(), after.isalnum(), before.endswith(("$", "€", "£", "#")), after in "%°€",
        len(set(digits)), len(groups[0]) == 4 and groups[0][:2] in ("19", "20") if groups else False,
        *[bool(c.search(before)) for c in _CONTEXT],
    ]


class Boosted:
    """Trees of fixed depth on binned features, boosted on the log loss, with calibrated scores."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 24):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.bias, self.knots, self.values, self.threshold = 0.0, np.array([0.0]), np.array([0.0]), 2.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self._binned(x)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(rate / (1 - rate)))
        score, width = np.full(len(y), self.bias), self.bins + 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p) + 1e-6
            node = np.zeros(len(y), int)
            feature, cut = np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, width)
            for level in range(self.depth):
                first, n = 2**level - 1, 2**level
                best = np.full(n, 1e-6)
                for f in range(x.shape[1]):
                    slot = (node - first) * width + b[:, f]
                    G = np.bincount(slot, g, n * width).reshape(n, width).cumsum(axis=1)
                    H = np.bincount(slot, h, n * width).reshape(n, width).cumsum(axis=1)
                    total, weight = G[:, -1:], H[:, -1:]
                    gain = G**2 / (H + 1) + (total - G) ** 2 / (weight - H + 1) - total**2 / (weight + 1)
                    at = gain.argmax(axis=1)
                    better = np.flatnonzero(gain[np.arange(n), at] > best)
                    best[better] = gain[better, at[better]]
                    feature[first + better], cut[first + better] = f, at[better]
                node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - (2**self.depth - 1)
            value = np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + 1)
            self.trees.append((feature, cut, self.rate * value))
            score += self.rate * value[leaf]
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, rows = self._binned(x), np.arange(len(x))
        score = np.full(len(x), self.bias)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            score += value[node - (2**self.depth - 1)]
        return score

    def calibrate(self, x: np.ndarray, y: np.ndarray, precision: float) -> Boosted:
        """Isotonic calibration on rows that weren't fitted, and the lowest score with this precision."""
        raw = self.raw(x)
        order = np.argsort(raw, kind="stable")
        blocks: list[list[float]] = []
        for s, t in zip(raw[order], y[order], strict=True):
            blocks.append([s, float(t), 1.0])
            while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
                _, t1, n1 = blocks.pop()
                blocks[-1] = [blocks[-1][0], blocks[-1][1] + t1, blocks[-1][2] + n1]
        self.knots = np.array([b[0] for b in blocks])
        self.values = np.array([(b[1] + 0.5) / (b[2] + 1) for b in blocks])
        ranked = y[order][::-1].cumsum() / np.arange(1, len(y) + 1)
        good = np.flatnonzero(ranked >= precision)
        self.threshold = float(self.scores(x[order[::-1][good[-1:]]])[0]) if len(good) else 2.0
        self.threshold = max(self.threshold, 0.5)
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.values[np.clip(np.searchsorted(self.knots, self.raw(x), side="right") - 1, 0, None)]


def variants(seed: int = 5, n: int = 300) -> tuple[list[list[float]], list[int]]:
    """Features and labels of made-up sentences: personal data in other spellings, and look-alikes."""
    draw = np.random.default_rng(seed)
    d = lambda k: "".join(map(str, draw.integers(0, 10, k)))
    w = lambda: "".join(draw.choice(list("abcdefghilmnoprstuv"), draw.integers(3, 9)))
    pick = lambda *x: x[draw.integers(len(x))]
    x, y = [], []

    def add(before: str, span: str, label: int) -> None:
        text = f"{w()} {before} {span} {w()}"
        at = text.index(span)
        for s, e, g in candidates(text):
            if s < at + len(span) and at < e:
                x.append(features(text, s, e, g))
                y.append(label)

    for _ in range(n):
        sep = pick(" ", "-", ".", "/")
        add(pick("call", "phone", "tel", w(), "mobile"), pick(f"({d(3)}) {d(3)}-{d(4)}", f"00{d(2)}{sep}{d(3)}{sep}{d(7)}", f"0{d(3)}{sep}{d(7)}"), 1)
        add(pick("mail", "contact", w()), f"{w()}{pick('(at)', '[at]', ' at ', ' @ ')}{w()}{pick('(dot)', ' dot ', '[dot]', '.')}{pick('com', 'org', 'de', 'fr')}", 1)
        add(pick("host", "ip", w()), pick(f"{d(2)}[.]{d(2)}[.]1{d(2)}[.]{d(1)}", ":".join(f"{draw.integers(16**4):x}" for _ in range(8))), 1)
        add(pick("iban", "account", "bank", w()), f"{pick('DE', 'FR', 'ES')}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}", 1)
        add(pick("on", "date", "since", w()), pick(f"20{d(2)}-{d(2)}-{d(2)}", f"{d(2)}.{d(2)}.20{d(2)}", f"{d(2)}/{d(2)}/19{d(2)}"), 0)
        add(pick("total", "price", w()), pick(f"{d(3)}.{d(3)}.{d(3)}", f"{d(9)}", f"{d(4)}.{d(6)}"), 0)
        add(pick("id", "order", "ref", w()), pick(d(8), d(13), f"{d(4)}-{d(4)}-{d(4)}-{d(3)}", f"{d(20)}"), 0)
        add(pick("version", "section", w()), pick(f"{d(1)}.{d(1)}.{d(2)}.{d(4)}", f"{d(1)}.{d(2)}.{d(1)}-{d(6)}"), 0)
        add(w(), f"{w()} at {w()}.{w()}", 0)
    return x, y


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, labels = [], []
        for text in batch.column(0):
            t = text.as_py() or ""
            base = base_spans(t)
            for s, e, g in candidates(t):
                label = any(a < e and s < b for a, _, b in base)
                if label or refuted(t, s, e):
                    rows.append(features(t, s, e, g))
                    labels.append(int(label))
        yield pa.RecordBatch.from_arrays(
            [pa.array([[float(v) for v in r] for r in rows], pa.list_(pa.float64())), pa.array(labels, pa.int32())], ["x", "y"]
        )


def fitted(docs: DataFrame, precision: float = PRECISION) -> Boosted:
    """Trees fitted to the labelled candidates of at most ``SAMPLE_DOCS`` documents, the first by a hash of the id."""
    shipped(docs.sparkSession)
    ids = docs.where("doc_id IS NOT NULL").select("doc_id").orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(SAMPLE_DOCS)
    some = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids.distinct()), "doc_id", "left_semi")
    rows = some.select("text").mapInArrow(_sampled, "x array<double>, y int")
    rows = rows.orderBy(F.xxhash64("x", "y"), "x", "y").limit(SAMPLE_CANDIDATES).collect()
    x, y = variants()
    x, y = np.array(x + [r.x for r in rows], float), np.array(y + [r.y for r in rows], float)
    kept = np.random.default_rng(1).random(len(y)) < 0.25
    return Boosted().fit(x[~kept], y[~kept]).calibrate(x[kept], y[kept], precision)


def found(text: str, model: Boosted) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, str]]]:
    """Base spans, and those that the trees add: the best first, none touching another."""
    base = base_spans(text)
    spans = [c for c in candidates(text) if not any(a < c[1] and c[0] < b for a, _, b in base)]
    added: list[tuple[int, int, str]] = []
    if spans:
        scores = model.scores(np.array([features(text, *c) for c in spans], float))
        names = list(GENERATORS)
        for i in sorted(np.flatnonzero(scores >= model.threshold), key=lambda i: (-scores[i], spans[i])):
            s, e, g = spans[i]
            if not any(a < e and s < b for a, b, _ in added):
                added.append((s, e, names[g]))
    return base, added


def personal_data(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """Per row of ``docs`` (doc_id, text) the spans of personal data, in code points, end exclusive.

    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of these spans), spans (with those that the trees add,
    of kinds mail, digits, address, account; none touches a base span) and n_added. Null texts count as empty and have
    no spans. Null and repeated ids are rows like others. An empty table gives an empty result. Other columns are
    ignored.
    """
    spark = shipped(docs.sparkSession)
    model = spark.sparkContext.broadcast(fitted(docs, precision))  # some hundred kB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hashes, spans, more = [[] for _ in KINDS], [], [], []
            for text in batch.column(1):
                base, added = found(text.as_py() or "", model.value)
                for k, c in enumerate(counts):
                    c.append(sum(x[1] == k for x in base))
                joined = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base)
                hashes.append(hashlib.sha256(joined.encode()).hexdigest())
                both = [(a, k, b, KINDS[k]) for a, k, b in base] + [(a, 9, b, name) for a, b, name in added]
                spans.append(",".join(f"{name}:{a}:{b}" for a, _, b, name in sorted(both)))
                more.append(len(added))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(hashes, pa.string()), pa.array(spans, pa.string()), pa.array(more, pa.int64())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = "n_email long, n_ip long, n_card long, n_phone long"
    return rows.mapInArrow(run, f"doc_id long, {kinds}, base_sha256 string, spans string, n_added long")
