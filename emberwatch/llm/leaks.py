"""Benchmark decontamination by templates.

Texts become sequences of words in which numbers with their units, and names inside a sentence of one word or more,
are typed slots. Windows of benchmark templates are hash-joined with windows of documents, so a question that was
asked again with other numbers or names is found too. A hit is then checked along its alignment, and alignments that
lie close together are added up: enough of the item must be there, and slots only count if the same value of the item
always became the same value in the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberwatch.llm.common import text_or_empty, written

#: Words in a window. Documents and items are tested at every word, so a stretch of WINDOW words that a document shares
#: with an item is never missed, wherever it lies.
WINDOW = 5
#: A document leaks an item if it has this share of the item's words in line, or windows in line that cover this many
#: words of the item: what five windows cover that start four words apart.
COVERAGE, COVERED = 0.5, 21

#: A window that more items than this share is no evidence by itself for ``hits``; it counts where a rarer window of the item
#: is met. Of an item all of whose windows are so common, the rarest are. ``leaks`` has no such limit.
COMMON = 32
#: Words that an item has at least to be found inside a document; shorter ones ("Yes") leak only as a whole text.
LEAST_INSIDE = 3

# Groups repeat possessively (*+): Java then loops, where a plain * takes a stack frame a repeat and a long run ends the executor.
NUMBER = r"[0-9]+(?:[.,:/][0-9]+)*+"
UNITS = (
    "km|cm|mm|m|kg|mg|g|lb|lbs|oz|s|ms|min|h|hours?|minutes?|seconds?|days?|weeks?|months?|years?|meters?|metres?|miles?|"
    "feet|foot|inch|inches|liters?|litres?|ml|l|percent|dollars?|euros?|cents?|degrees?|units?|pounds?|grams?"
)


def _marked(text: Column) -> Column:
    """The text in lower case, with \\x01 before numbers, \\x02 between them and their units, names between \\x03 and \\x04."""
    clean = F.when(text.rlike(r"[\x01-\x04]"), F.regexp_replace(text, r"[\x01-\x04]", " ")).otherwise(text)
    with_units = F.regexp_replace(clean, rf"(?<![\p{{L}}0-9])({NUMBER})[ -]?({UNITS})(?!\p{{L}})", " \x01$1\x02$2 ")
    numbers = F.regexp_replace(with_units, rf"(?<![\x01\p{{L}}0-9.,:/]){NUMBER}", " \x01$0 ")
    numbered = F.when(clean.rlike("[0-9]"), numbers).otherwise(clean)
    return F.lower(F.regexp_replace(numbered, r"(?<=[\p{Ll},;] )\p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)*+", "\x03$0\x04 "))


def templates(df: DataFrame) -> DataFrame:
    """``df`` with ``words`` (slots as marker and value) and ``forms`` (slots as marker only)."""
    words = F.regexp_extract_all(_marked(text_or_empty()), F.lit(r"\x03[^\x04]+|\x01[^ ]+|[\p{L}\p{N}]+"), F.lit(0))
    forms = F.transform("words", lambda w: F.when(w < "\x04", F.substring(w, 1, 1)).otherwise(w))
    return df.withColumn("words", words).withColumn("forms", forms)


def _hashes() -> Column:
    """Hashes of the windows at every word; a text too short for a window has one, of all of it."""
    return F.expr(
        f"if(size(forms) >= {WINDOW}, transform(sequence(0, size(forms) - {WINDOW}), i -> xxhash64(slice(forms, i + 1, {WINDOW}))), "
        f"if(size(forms) > 0, array(xxhash64('whole', forms)), array()))"
    )


def _slices(length: str, tag: str) -> str:
    """SQL for the hashes of all windows of ``length`` words, slots by value."""
    return f"transform(sequence(0, size(words) - {length}), i -> struct(cast(i AS int) AS at, xxhash64('{tag}', slice(words, i + 1, {length})) AS hash))"


def _short_in_docs(lengths: list[int]) -> Column:
    """What finds short items in documents, and short documents in items: windows of the items' lengths, and the whole."""
    parts = [f"if(size(words) >= {n}, {_slices(str(n), 'item')}, array())" for n in lengths]
    return F.expr(f"concat({', '.join([*parts, f'if(size(words) BETWEEN 1 AND {WINDOW - 1}, {_slices("size(words)", "doc")}, array())'])})")


def _short_in_items(coverage: float) -> Column:
    """The counterpart: a short item as a whole, and windows as long as short documents that cover enough of it."""
    parts = [f"if(size(words) > {n} AND {n} >= {coverage}D * size(words), {_slices(str(n), 'doc')}, array())" for n in range(1, WINDOW)]
    return F.expr(f"concat({', '.join([f'if(size(words) BETWEEN 1 AND {WINDOW - 1}, {_slices("size(words)", "item")}, array())', *parts])})")


def _met_by_rare(rows: DataFrame, windowed: DataFrame, in_docs: Column, items: DataFrame, most: int) -> DataFrame:
    """The windows that documents and items share, for pairs that share one that at most ``most`` items have."""
    key = ["doc_id", "text_key", "item_id"]
    shared = items.groupBy("hash").agg(F.count_distinct("item_id").alias("_n"))
    items = items.join(shared, "hash").withColumn("_least", F.min("_n").over(Window.partitionBy("item_id")))
    items = written(items.withColumn("common", (F.col("_n") > most) & (F.col("_n") > F.col("_least"))))
    met = windowed.join(items.where("NOT common"), "hash").select(*key, "length", "place", "at")
    common = items.where("common")
    if common.isEmpty():
        return met
    met = written(met)  # common windows are joined for pairs that share a rarer one
    pairs = met.select(*key).distinct().join(common, "item_id").alias("p")
    same = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.text_key") == F.col("p.text_key"))
    again = rows.alias("d").join(met.select("doc_id", "text_key").distinct().alias("p"), same, "left_semi").distinct()
    again = again.select("doc_id", "text_key", F.inline(in_docs)).alias("d")
    return met.unionByName(pairs.join(again, same & (F.col("d.hash") == F.col("p.hash"))).select(*(f"p.{c}" for c in (*key, "length", "place")), "d.at"))


def hits(docs: DataFrame, benchmark: DataFrame, inside: bool = False, coverage: float = COVERAGE, most: int | None = COMMON) -> DataFrame:
    """Alignments of a document and an item that share a window: doc_id, text_key, item_id, found.

    ``found`` has the places of the windows in the item, in order, each with its shift: the place less that in the
    document. There is a row for each shift, and one for all shifts that follow each other by less than the item's
    length, as words put in or left out make them; where a place has several shifts, the one with most windows counts.
    A window that more than ``most`` items share counts only for pairs that share a rarer one; with None every window counts.
    """
    items = templates(benchmark.select("item_id", "text").where("item_id IS NOT NULL").distinct())
    rows = templates(docs.select("doc_id", "text", F.xxhash64(F.col("text")).alias("text_key")))
    windows = F.transform(_hashes(), lambda h, i: F.struct(i.alias("at"), h.alias("hash")))
    in_docs = in_items = windows
    if inside:
        short = items.select(F.size("words").alias("n")).where(f"n BETWEEN {LEAST_INSIDE} AND {WINDOW - 1}").distinct().collect()  # four rows at most
        in_docs, in_items = F.concat(windows, _short_in_docs(sorted(r.n for r in short))), F.concat(windows, _short_in_items(coverage))
    windowed = rows.select("doc_id", "text_key", F.inline(in_docs))
    items = items.select("item_id", F.size("forms").alias("length"), F.inline(in_items).alias("place", "hash"))
    key = ["doc_id", "text_key", "item_id"]
    if most is None:
        met = windowed.join(items, "hash").select(*key, "length", "place", "at")
    else:
        met = _met_by_rare(rows, windowed, in_docs, items, most)
    single = met.groupBy(*key, (F.col("place") - F.col("at")).alias("shift")).agg(F.max("length").alias("length"), F.sort_array(F.collect_set("place")).alias("places"))
    single = written(single)
    order = Window.partitionBy(*key).orderBy("shift")
    apart = F.coalesce(F.col("shift") - F.lag("shift").over(order) >= F.col("length"), F.lit(True))
    near = single.withColumn("_apart", apart).withColumn("_group", F.sum(F.col("_apart").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    near = near.select(*key, "_group", "shift", F.size("places").alias("_windows"), F.explode("places").alias("place"))
    near = near.groupBy(*key, "_group", "place").agg(F.max(F.struct("_windows", "shift")).getField("shift").alias("shift"))
    near = near.groupBy(*key, "_group").agg(F.sort_array(F.collect_list(F.struct("place", "shift"))).alias("found"))
    near = near.where("exists(found, x -> x.shift <> found[0].shift)").drop("_group")
    return single.select(*key, F.expr("transform(places, p -> struct(p AS place, shift AS shift))").alias("found")).unionByName(near)


#: Of each run of windows with one shift: its first place and its shift.
_RUNS = (
    "transform(filter(sequence(0, size(found) - 1), j -> j = 0 OR found[j].shift <> found[j - 1].shift), "
    "j -> struct(found[j].place AS first, found[j].shift AS shift))"
)
#: Each place of the item with the shift of the last window that starts before it, and that of the next run.
_ALIGNED = (
    "flatten(transform(_runs, (r, k) -> transform("
    "sequence(if(k = 0, 0, r.first), coalesce(get(_runs, k + 1).first, size(item_forms)) - 1), "
    "i -> struct(i AS i, r.shift AS shift, coalesce(get(_runs, k + 1).shift, r.shift) AS next))))"
)


def _classes(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items of the same words as one: (item_id, text) with an id of its own for each, and which items each stands for."""
    known = templates(benchmark.select("item_id", "text").where("item_id IS NOT NULL").distinct()).where("size(words) > 0")
    known = written(known.select(F.col("item_id").alias("member"), F.min("text").over(Window.partitionBy("words")).alias("text")))
    classes = written(known.select("text").distinct().select(F.monotonically_increasing_id().alias("item_id"), "text"))
    return classes, known.join(classes, "text").select(F.col("item_id").alias("class"), F.col("member").alias("item_id")).distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, covered: int = COVERED, inside: bool = False) -> DataFrame:
    """Which rows of ``docs`` (doc_id, text) leak which items of ``benchmark`` (item_id, text).

    Returns doc_id, text_key (hash of the text), item_id, windows (of the best alignment or group of close ones), coverage
    (share of the item's words found in line) and consistent (each slot value of the item has one value in the document). Slots of an
    alignment that isn't consistent don't count as found. Items shorter than ``WINDOW`` words leak only
    into texts that are such an item as a whole; with ``inside`` those of ``LEAST_INSIDE`` words or more also into texts that
    hold them with the same values, and texts shorter than ``WINDOW`` words leak longer items of which they are enough. Texts without words leak nothing, and items without words or id
    are never found. Rows that agree in id and text, null ids included, share a result row. Empty tables give an
    empty result. Other columns are ignored. Items of the same words are looked for once.
    """
    benchmark, members = _classes(benchmark)
    found = written(hits(docs, benchmark, inside, coverage, None))  # small against the documents, unless most of them leak
    rows = docs.select("doc_id", "text", F.xxhash64(F.col("text")).alias("text_key")).alias("d")
    wanted = written(found.select("doc_id", "text_key").distinct()).alias("w")
    same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.text_key") == F.col("w.text_key"))
    rows = rows.join(wanted, same, "left_semi").distinct()
    rows = templates(rows).select("doc_id", "text_key", "words", "forms").alias("d")
    items = templates(benchmark).select("item_id", F.col("words").alias("item_words"), F.col("forms").alias("item_forms"))
    h = found.alias("h")
    same = F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.text_key") == F.col("h.text_key"))
    pairs = rows.join(h, same).select("d.doc_id", "d.text_key", "words", "forms", "item_id", "found").join(items, "item_id")
    # Place i of the item lies at i - shift in the document; words between two runs of windows belong to either.
    pairs = pairs.withColumn("_runs", F.expr(_RUNS)).withColumn("_aligned", F.expr(_ALIGNED))
    at = "get(item_forms, x.i) = get(forms, cast(x.i - x.{0} AS int))"
    both = f"transform(_aligned, x -> struct(x.i AS i, if({at.format('shift')}, x.shift, if({at.format('next')}, x.next, null)) AS shift))"
    pairs = pairs.withColumn("_at", F.expr(f"filter({both}, x -> x.shift IS NOT NULL)"))
    pairs = pairs.withColumn(
        "_slots",
        F.expr("transform(filter(_at, x -> get(item_forms, x.i) < '\x04'), x -> struct(get(item_words, x.i) AS a, get(words, cast(x.i - x.shift AS int)) AS b))"),
    )
    pairs = pairs.withColumn("consistent", F.expr("size(array_distinct(_slots)) = size(array_distinct(transform(_slots, s -> s.a)))"))
    covers = f"size(array_distinct(flatten(transform(found, x -> sequence(x.place, x.place + {WINDOW - 1})))))"
    pairs = pairs.withColumn("windows", F.size("found")).withColumn("_covered", F.expr(covers))
    share = F.expr("(size(_at) - if(consistent, 0, size(_slots))) / size(item_forms)")
    pairs = pairs.withColumn("coverage", share).where((F.col("coverage") >= coverage) | (F.col("consistent") & (F.col("_covered") >= covered)))
    best = F.max(F.struct("windows", "coverage", "consistent")).alias("best")
    pairs = pairs.withColumnRenamed("item_id", "class").join(members, "class")
    return pairs.groupBy("doc_id", "text_key", "item_id").agg(best).select("doc_id", "text_key", "item_id", "best.*")


def clean(docs: DataFrame, benchmark: DataFrame, inside: bool = False) -> DataFrame:
    """The rows of ``docs`` that leak no item, as they are; a row without text is kept."""
    bad = written(leaks(docs, benchmark, inside=inside).select("doc_id", "text_key").distinct()).alias("b")
    d = docs.alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.xxhash64(F.col("d.text")) == F.col("b.text_key"))
    return d.join(bad, same, "left_anti")
