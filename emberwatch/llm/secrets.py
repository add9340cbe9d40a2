"""Secrets in texts: formats, and a randomness test battery over words in inferred encodings.

Keys and tokens are drawn at random from an alphabet, words and identifiers aren't. A long word that looks like an
encoding (hexadecimal, base 32, 36, 62, 64, or letters of one or either case) is tested for uniform use of the alphabet (chi-squared), for runs above
and below the middle of the alphabet, and for serial correlation; the smallest of the three p-values, corrected for
being the smallest of three, is the word's. Random words have uniform p-values whatever their length; others pile up
near 0, the more the longer they are. So, per class of lengths, the number of random words is estimated from the
upper half of the p-values, and the threshold is the lowest at which the expected share of other words among those
above it stays within the chosen rate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import text_or_empty, written

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of either kind is long enough or isn't, so the least length can be part of the pattern.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
#: Words that are tested; shorter ones say too little.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])"
#: Words of letters alone are tested from this length on; shorter ones are too often real words for the tests to tell.
LETTERS_ONLY = 32
#: Matches of a text that are placed at a time.
PORTION = 256
#: Share of other words that may be among those called random.
RATE = 0.05
BINS = 40
#: Classes of lengths begin here.
LENGTHS = (20, 24, 32, 40, 64, 128)
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Encodings with the words that they take; the first that fits is inferred.
ENCODINGS = (
    ("^(?:[0-9a-f]+|[0-9A-F]+)=*$", DIGITS + "abcdef", True),
    ("^(?:[a-z]+|[A-Z]+)=*$", LOWER, True),
    ("^[A-Z2-7]+=*$", LOWER + "234567", True),
    ("^(?:[0-9a-z]+|[0-9A-Z]+)=*$", DIGITS + LOWER, True),
    ("^[A-Za-z]+=*$", LOWER.upper() + LOWER, False),
    ("^[0-9A-Za-z]+=*$", LOWER.upper() + LOWER + DIGITS, False),
    ("^[0-9A-Za-z+/]+=*$", LOWER.upper() + LOWER + DIGITS + "+/", False),
    ("", LOWER.upper() + LOWER + DIGITS + "-_", False),
)
SPAN = "array<struct<start:int,kind:int,stop:int,word:string>>"


def located(body: Column, pattern: str, kind: int, keep: Callable[[Column], Column] | None = None) -> Column:
    """The leftmost matches that don't overlap, where ``keep`` holds for the match: start, kind, stop, word.

    The pieces between the matches and the matches themselves, laid end to end, give the places in code points.
    """
    found = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
    pieces = F.slice(F.split(body, pattern, -1), 1, F.size(found))
    none = F.array().cast(SPAN)

    def step(so_far: Column, x: Column) -> Column:
        start = so_far["at"] + F.length(x["piece"])
        stop = start + F.length(x["word"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), x["word"].alias("word"))
        more = F.concat(so_far["out"], F.array(span))
        return F.struct(stop.alias("at"), (F.when(keep(x["word"]), more).otherwise(so_far["out"]) if keep else more).alias("out"))

    def some(so_far: Column, x: Column) -> Column:
        """The spans of a portion; an array is copied whenever it grows, so those of all portions are laid end to end once."""
        of = F.aggregate(x, F.struct(so_far["at"].alias("at"), none.alias("out")), step)
        return _once(of, lambda p: F.struct(p["at"].alias("at"), F.concat(so_far["out"], F.array(p["out"])).alias("out")))

    portions = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / PORTION).cast("int")), lambda i: F.slice(x, i * PORTION + 1, PORTION))
    zipped = F.zip_with(pieces, found, lambda p, w: F.struct(p.alias("piece"), w.alias("word")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    spans = F.flatten(F.aggregate(_once(zipped, portions), start, some, lambda x: x["out"]))
    return F.when(body.rlike(pattern), spans).otherwise(none)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _normal(z: Column) -> Column:
    """The normal distribution function, to about 1e-4."""
    return 1 / (1 + F.exp(-(1.5976 * z + 0.07056 * z * z * z)))


def _two_sided(z: Column) -> Column:
    return 2 * (1 - _normal(F.least(F.abs(z), F.lit(9.0))))


def _alphabet(word: Column, what: Callable[[str, bool], Column]) -> Column:
    out = what(*ENCODINGS[-1][1:])
    for pattern, letters, fold in ENCODINGS[-2::-1]:
        out = F.when(word.rlike(pattern), what(letters, fold)).otherwise(out)
    return out


def battery(v: Column, k: Column) -> Column:
    """The p-value of a sequence ``v`` of letters numbered from 1 in an alphabet of ``k`` letters."""
    n = F.size(v).cast("double")
    zero = F.lit(0.0)
    squares = F.aggregate(F.array_distinct(v), zero, lambda a, x: a + F.pow(F.size(F.filter(v, lambda y: y == x)).cast("double"), F.lit(2.0)))
    df = k - 1
    chi = k / n * squares - n
    z = (F.pow(F.greatest(chi, zero) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    uniform = 1 - _normal(F.least(F.greatest(z, F.lit(-9.0)), F.lit(9.0)))

    high = F.transform(v, lambda x: (2 * x > k).cast("double"))
    above = F.aggregate(high, zero, lambda a, x: a + x)
    pairs = lambda a: F.arrays_zip(F.slice(a, 1, F.size(a) - 1).alias("x"), F.slice(a, 2, F.size(a) - 1).alias("y"))
    runs = 1 + F.aggregate(pairs(high), zero, lambda a, p: a + F.abs(p["x"] - p["y"]))
    both = 2 * above * (n - above)
    deviation = F.sqrt(both * (both - n) / (n * n * (n - 1)))
    by_runs = F.when(both > n, _two_sided((runs - both / n - 1) / deviation)).otherwise(zero)

    mean = F.aggregate(v, zero, lambda a, x: a + x) / n
    spread = F.aggregate(v, zero, lambda a, x: a + (x - mean) * (x - mean))
    lagged = F.aggregate(pairs(v), zero, lambda a, p: a + (p["x"] - mean) * (p["y"] - mean))
    serial = F.when(spread > 0, _two_sided((lagged / spread + 1 / n) * F.sqrt(n))).otherwise(zero)
    return 1 - F.pow(1 - F.least(uniform, by_runs, serial), F.lit(3.0))


def tested(words: Column) -> Column:
    """For spans of words, their start, stop, length without padding, and p-value."""

    def test(s: Column) -> Column:
        word = F.rtrim(s["word"], F.lit("="))
        size = _alphabet(word, lambda letters, fold: F.lit(float(len(letters))))
        letters = _alphabet(word, lambda letters, fold: F.lit(letters))
        folds = _alphabet(word, lambda letters, fold: F.lit(fold))
        return F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.when(folds, F.lower(word)).otherwise(word).alias("word"),
                        letters.alias("letters"), size.alias("k"))

    def measure(s: Column) -> Column:
        values = F.transform(F.split(s["word"], ""), lambda c: F.instr(s["letters"], c).cast("double"))
        return F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.length(s["word"]).alias("n"), values.alias("v"), s["k"].alias("k"))

    def judge(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["n"].alias("n"), battery(s["v"], s["k"]).alias("p"))

    return F.transform(F.transform(F.transform(words, test), measure), judge)


def _class(n: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(LENGTHS):
        out = F.when(n >= least, F.lit(i)).otherwise(out)
    return out


def thresholds(p_values: DataFrame, rate: float = RATE) -> dict[int, float]:
    """``p_values`` (n, p) to the least p-value that counts as random, per class of lengths.

    Collects at most ``BINS`` counts for each class.
    """
    rows = p_values.groupBy(_class(F.col("n")).alias("c"), F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).alias("bin")).count().collect()
    out = {}
    for c in range(len(LENGTHS)):
        counts = [0] * BINS
        for r in rows:
            if r["c"] == c:
                counts[int(r["bin"])] += r["count"]
        random = min(2 * sum(counts[BINS // 2 :]), sum(counts))
        for b in range(BINS):
            kept = sum(counts[b:])
            if kept and 1 - random * (1 - b / BINS) / kept <= rate:
                out[c] = b / BINS
                break
    return out


def secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text) the spans of secrets, in code points, end exclusive.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256 (of the spans of these three kinds), spans (with those of
    kind random: words that pass the battery and touch no other span) and n_random. Null texts count as empty and have
    no spans. Null and repeated ids are rows like others. An empty table gives an empty result. Other columns are
    ignored. The thresholds come from all words of the table.
    """
    body = F.col("body")
    rows = docs.select("doc_id", text_or_empty().alias("body"))
    long_enough = lambda w: F.length(F.regexp_extract(w, ASSIGN, 2)) >= 8
    mixed = lambda w: w.rlike("[0-9]") & w.rlike("[A-Za-z]") | w.rlike(f"^[A-Za-z]{{{LETTERS_ONLY},}}=*$")
    base = F.concat(located(body, ASSIGN, 0, long_enough), located(body, ACCESS, 1), located(body, HEX, 2))
    words = F.when(body.rlike(CANDIDATE), located(body, CANDIDATE, 3, mixed)).otherwise(F.array().cast(SPAN))
    rows = rows.select("doc_id", F.array_sort(F.transform(base, lambda s: s.dropFields("word"))).alias("base"), words.alias("words"))
    rows = written(rows.select("doc_id", "base", tested(F.col("words")).alias("words")))
    least = thresholds(rows.select(F.explode("words").alias("w")).select("w.n", "w.p"), rate)

    passes = lambda w: F.coalesce(*[F.when(_class(w["n"]) == c, w["p"] >= t) for c, t in least.items()], F.lit(False))
    apart = lambda w: ~F.exists("base", lambda s: (s["start"] < w["stop"]) & (w["start"] < s["stop"]))
    added = F.transform(
        F.filter("words", lambda w: passes(w) & apart(w)),
        lambda w: F.struct(w["start"].alias("start"), F.lit(3).alias("kind"), w["stop"].alias("stop")),
    )
    names = F.array(*map(F.lit, ("assign", "access", "hex", "random")))
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return rows.withColumn("_added", added).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "_added"))).alias("spans"),
        F.size("_added").cast("long").alias("n_random"),
    )
