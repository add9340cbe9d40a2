"""Repeated strings, near duplicates, secrets, personal data and leaks against plain versions."""

from __future__ import annotations

import random
import re
import time

import brute
import pytest
from pyspark.sql import functions as F

from emberwatch.llm import leaks, near, personal, secrets, suffixes

HARD = [(None, None, None), (None, "x" * 120, "s"), (1, "", "s"), (2, None, "t"), (2, None, "t"), (3, " \t\n", None), (4, "the end " * 3000, "s"), (4, "x" * 120, "s")]


def made_up(seed=3, n=90):
    """Texts that share stretches of several lengths; multiples of ten repeat a word many times."""
    draw = random.Random(seed)
    words = ["".join(draw.choice("abé") for _ in range(draw.randint(1, 6))) for _ in range(60)]
    base = [" ".join(draw.choice(words) for _ in range(draw.randint(0, 200))) for _ in range(25)]
    out = []
    for i in range(n):
        text = "And " * draw.randint(0, 150) if i % 10 == 0 else ""
        for _ in range(draw.randint(0, 4)):
            t = draw.choice(base)
            a = draw.randint(0, len(t))
            text += t[a : a + draw.randint(0, 400)]
        out.append((i * 3, text))
    return out


def test_repeated_strings(spark):
    rows = made_up()
    got = suffixes.deduplicated(brute.table(spark, [(i, t, None) for i, t in rows])).collect()
    want = brute.repeats([(i, t.encode()) for i, t in rows], 50)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert sum(w[1] for w in want.values()) > 1000


def test_repeated_strings_in_many_small_buckets(spark, monkeypatch):
    for name, value in (("BATCH", 2000), ("BUCKET", 3000), ("CHUNK", 50), ("SEGMENT", 700)):
        monkeypatch.setattr(suffixes, name, value)
    rows = made_up(seed=4, n=60)
    texts = [t.encode() for _, t in rows]
    data, lengths = b"".join(texts), [len(t) for t in texts]
    # The parts that tasks run, called here, so that the small sizes hold in them too.
    import numpy as np

    runs = suffixes.Runs(np.frombuffer(data, np.uint8), np.array(lengths), 50)
    assert runs.count.sum() == sum(max(0, n - 49) for n in lengths) and runs.count.max() <= 31
    for s, o, v in list(zip(runs.start, runs.offset, runs.lead, strict=True))[:500]:
        assert int.from_bytes(data[s + o : s + o + 8], "big") == v


def test_repeated_strings_edge_rows(spark):
    got = {(r.doc_id, r.n_bytes): r for r in suffixes.deduplicated(brute.table(spark, HARD)).collect()}
    assert got[4, 120].n_removed == 0 and got[4, 24000].n_removed == 0  # inside a document nothing is a copy
    assert got[None, 120].n_removed == 120 and got[None, 120].n_spans == 1  # a missing id is the largest
    assert got[1, 0].n_removed == 0 and got[2, 0].n_removed == 0
    assert suffixes.deduplicated(brute.table(spark, [])).count() == 0


def near_copies(seed=5):
    draw = random.Random(seed)
    rows, i = [], 0
    for _ in range(12):
        words = [f"w{draw.randint(0, 4000)}" for _ in range(draw.randint(30, 120))]
        for _ in range(draw.randint(1, 8)):
            copy = list(words)
            for _ in range(draw.randint(0, 5)):
                copy[draw.randrange(len(copy))] = f"v{draw.randint(0, 99)}"
            rows.append((i, " ".join(copy)))
            i += 7
    rows += [(i + n, t) for n, t in enumerate(("", None, "one two", "One  two", "a b c d", "x"))]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, k):
    rows = near_copies()
    got = near.near_duplicates(brute.table(spark, [(i, t, None) for i, t in rows]), k=k).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.components(rows, k, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_a_drifting_group(spark):
    """Neighbours in a long chain are alike, its ends aren't: the stars leave strays, which the blocks must link."""
    words = [f"w{i}" for i in range(260)]
    rows = [(100 + i, " ".join(words[i : i + 100])) for i in range(0, 160, 4)]
    draw = random.Random(1)
    draw.shuffle(rows)
    got = near.near_duplicates(brute.table(spark, [(i, t, None) for i, t in rows]), k=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.components(rows, 4, 80)


def test_near_duplicates_edge_rows(spark):
    got = near.near_duplicates(brute.table(spark, HARD), k=5).collect()
    assert len(got) == len(HARD)
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert all(r.component_id == r.doc_id for r in got if r.doc_id is not None)
    assert near.near_duplicates(brute.table(spark, []), k=5).count() == 0


def test_bayesian_bounds():
    steps = near.least_matches(80)
    assert [n for n, _ in steps] == list(range(24, 241, 24))
    assert all(m < 0.8 * n for n, m in steps) and steps[-1][1] > 0.6 * 240


SECRET = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secret_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in SECRET.finditer(text) if len(m[2]) >= 8]
    for kind, pattern, least in ((1, "AKIA[A-Z0-9]+", 16), (2, "[0-9a-f]+", 32)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(out)


def random_words(draw, n):
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    return ["".join(draw.choice(letters) for _ in range(40)) + "a1B" for _ in range(n)]


def test_secrets(spark):
    draw = random.Random(2)
    alphabet = ["password", "Token", "api_key", "=", ":", " ", '"', "AKIA", "ABCDEFGHIJ12", "é𝄞", "abcdef0123456789" * 2, "xyz", "-", "\n"]
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 25))) for _ in range(150)]
    texts += ["token=secret: abcdefghij", "secret='12345678'", None, ""]
    got = {r.doc_id: r for r in secrets.secrets(brute.table(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()}
    kinds = ("assign", "access", "hex")
    for i, t in enumerate(texts):
        spans = secret_spans(t)
        assert got[i].base_sha256 == brute.digest(spans, kinds), t
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(s[1] == k for s in spans) for k in range(3)]


def test_random_words_are_told_from_others(spark):
    draw = random.Random(7)
    keys = random_words(draw, 120)
    plain = ["".join(draw.choice(["Version", "Alpha", "item", "row", "1", "2"]) for _ in range(12))[:43] + "Aa1" for _ in range(240)]
    rows = [(i, f"see {w} there", None) for i, w in enumerate(keys + plain)]
    got = {r.doc_id: r for r in secrets.secrets(brute.table(spark, rows)).collect()}
    found, wrong = sum(got[i].n_random for i in range(120)), sum(got[i].n_random for i in range(120, 360))
    assert found >= 100 and wrong <= 0.1 * found
    assert all(got[i].spans == f"random:4:{4 + len(keys[i])}" for i in range(120) if got[i].n_random)


def test_random_words_of_letters(spark):
    draw = random.Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    keys = ["".join(draw.choice(letters) for _ in range(44)) for _ in range(100)] + ["".join(draw.choice(letters[26:]) for _ in range(44)) for _ in range(100)]
    plain = ["".join(draw.choice(["Verwaltungs", "gericht", "ordnung", "Anwendung", "process", "Manager"]) for _ in range(9))[:44] for _ in range(200)]
    got = {r.doc_id: r.n_random for r in secrets.secrets(brute.table(spark, [(i, f"see {w} there", None) for i, w in enumerate(keys + plain)])).collect()}
    found, wrong = sum(got[i] for i in range(200)), sum(got[i] for i in range(200, 400))
    assert found >= 170 and wrong <= 0.1 * found


def test_many_secrets_in_one_text(spark):
    texts = [" and ".join(f"token{'=' if i % 3 else ': '}k{i:07d}{'é' * (i % 2)}" for i in range(n)) for n in (255, 256, 257, 1000, 32_000)]
    began = time.monotonic()
    got = {r.doc_id: r for r in secrets.secrets(brute.table(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()}
    assert time.monotonic() - began < 20
    for i, t in enumerate(texts):
        assert got[i].base_sha256 == brute.digest(secret_spans(t), ("assign", "access", "hex"))


def test_secrets_edge_rows(spark):
    assert [r.spans for r in secrets.secrets(brute.table(spark, HARD)).collect()] == [""] * len(HARD)
    assert secrets.secrets(brute.table(spark, [])).count() == 0


def personal_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m)) <= 19 and personal.luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


def test_personal_data_formats():
    draw = random.Random(3)
    alphabet = ["a@b.c", "@", ".", "x.y", "1.2.3.4", "300", "255", "+49", " ", "(0)", "-", "4111 1111 1111 1111", "123456789012", "é", "a-b", "0", "\n", "%"]
    for _ in range(4000):
        text = "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 14)))
        assert personal.base_spans(text) == personal_spans(text), text


def test_personal_data(spark):
    texts = ["mail a.b@c.org now", "call 030 1234567 today", "on 2024-05-06 we", "write to jane(at)doe(dot)org please", "plain text", "card 4111 1111 1111 1111"]
    rows = [(i, t, None) for i, t in enumerate(texts)] + HARD
    got = personal.personal_data(brute.table(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got if r.doc_id in (0, 5)}
    assert by_id[0].spans == "email:5:14" and by_id[0].n_email == 1
    assert by_id[5].spans == "card:5:24" and by_id[5].n_card == 1
    assert personal.personal_data(brute.table(spark, [])).count() == 0


def test_added_personal_data_is_held_to_its_precision():
    x, y = personal.variants(seed=5)
    import numpy as np

    x, y = np.array(x, float), np.array(y, float)
    kept = np.random.default_rng(1).random(len(y)) < 0.25
    model = personal.Boosted().fit(x[~kept], y[~kept]).calibrate(x[kept], y[kept], 0.98)
    fresh, label = (np.array(c, float) for c in personal.variants(seed=99))
    taken = model.scores(fresh) >= model.threshold
    assert label[taken].mean() > 0.93 and taken[label == 1].mean() > 0.7


QUESTION = "A train leaves Paris at 60 km per hour and reaches the city of Lyon after 3.5 hours of travel, says John to Mary."
OTHER = "A train leaves Berlin at 75 km per hour and reaches the city of Rome after 4.5 hours of travel, says Bob to Alice."
MIXED_UP = "Somebody asks Ann, then Bob, then Ann again, then Tom, about 5 km and 5 km and 7 km here."


def test_leaks(spark):
    items = spark.createDataFrame([(1, QUESTION), (2, "short item here"), (3, ""), (None, "x"), (4, MIXED_UP)], "item_id int, text string")
    rows = [
        (1, f"Before this there was nothing. {OTHER} And after.", "s"), (2, "Short item, here!", "s"), (3, "a short item here", "s"),
        (None, QUESTION, "s"), (None, "a clean text without anything else to see in it", "s"), (5, MIXED_UP.replace("5 km and 5", "5 km and 6"), "s"), *HARD,
    ]
    docs = brute.table(spark, rows)
    found = {(r.doc_id, r.item_id): r for r in leaks.leaks(docs, items).collect()}
    assert set(found) == {(1, 1), (2, 2), (None, 1), (5, 4)}
    assert found[1, 1].consistent and not found[5, 4].consistent
    left = leaks.clean(docs, items)
    assert left.columns == docs.columns and left.count() == len(rows) - 4
    assert leaks.leaks(docs.limit(0), items).count() == leaks.leaks(docs, items.limit(0)).count() == 0


def test_every_shared_stretch_is_tried(spark):
    """A leak of WINDOW + STRIDE - 1 words is met at any place."""
    item = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(i, " ".join(["filler"] * i + [item] + ["end"] * 3), None) for i in range(9)]
    found = leaks.leaks(brute.table(spark, rows), spark.createDataFrame([(1, item)], "item_id int, text string"))
    assert found.select("doc_id").distinct().count() == 9
    assert found.where(F.col("coverage") < 1).count() == 0


def test_altered_items_are_met_at_any_place(spark):
    """Items with single words altered leave short stretches, which are met whatever their place in a document."""
    altered = {15: (8,), 23: (8, 16), 31: (8, 16, 24), 30: (6, 12, 18, 24)}
    word = lambda i: "".join(chr(97 + int(d)) for d in str(i + 100))
    items, rows = [], []
    for k, (n, places) in enumerate(altered.items()):
        words = [f"w{word(k)}x{word(i)}" for i in range(1, n + 1)]
        items.append((k, " ".join(words)))
        copy = " ".join("altered" if i in places else w for i, w in enumerate(words, 1))
        rows += [(4 * k + before, " ".join(["filler"] * before + [copy, "end"]), None) for before in range(4)]
    found = leaks.leaks(brute.table(spark, rows), spark.createDataFrame(items, "item_id int, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, i // 4) for i in range(16)}
    # A quarter of a long item, in stretches of five words: 25 words in line, each window at another place mod 4.
    words = [f"z{word(i)}" for i in range(100)]
    copy = [w if i < 30 and i % 6 < 5 else f"other{word(i)}" for i, w in enumerate(words)]
    rows = [(before, " ".join(["filler"] * before + copy), None) for before in range(4)]
    found = leaks.leaks(brute.table(spark, rows), spark.createDataFrame([(1, " ".join(words))], "item_id int, text string")).collect()
    assert {(r.doc_id, r.windows, r.coverage) for r in found} == {(i, 5, 0.25) for i in range(4)}
    rows = [(n, " ".join(["filler", *words[40 : 40 + n], "end"]), None) for n in (20, 21)]
    found = leaks.leaks(brute.table(spark, rows), spark.createDataFrame([(1, " ".join(words))], "item_id int, text string")).collect()
    assert [(r.doc_id, r.windows) for r in found] == [(21, 17)]


def test_windows_that_many_items_share_count_by_themselves(spark):
    """Sixty items begin alike and two are the same words; a text with that beginning alone leaks all of them."""
    stem = "which of the rivers in the north carries most water every spring"
    items = [(i, f"{stem} {' '.join(f'n{i}x{j}' for j in 'abcde')}") for i in range(60)]
    items += [(60, items[7][1]), (61, "Which " + items[7][1][6:]), (62, "quite another question about the hills beyond the eastern sea")]
    docs = brute.table(spark, [(1, f"he asked me {stem} and went home", None), (2, f"well {items[7][1]} he asked", None), (3, "hills beyond the sea", None)])
    got = {(r.doc_id, r.item_id): r for r in leaks.leaks(docs, spark.createDataFrame(items, "item_id int, text string")).collect()}
    assert sorted(got) == [(d, i) for d in (1, 2) for i in range(62)]
    assert all(abs(got[1, i].coverage - 12 / 17) < 1e-9 for i in range(62))
    assert [i for i in range(62) if got[2, i].coverage == 1] == [7, 60, 61]


def test_long_runs_of_names_and_numbers(spark):
    """A run of any length is one slot; the search for it takes no stack frame a word."""
    names, numbers = " ".join(["Alpha"] * 30_000), ",".join(["12"] * 30_000)
    row = leaks.templates(brute.table(spark, [(1, f"we met {names} and {numbers}km of it", None)])).first()
    assert row.forms == ["we", "met", "\x03", "and", "\x01", "of", "it"]
    assert row.words[2] == "\x03" + names.lower() and row.words[4].startswith("\x01" + numbers)


def test_leaks_add_up_over_close_alignments(spark):
    word = lambda i: "".join(chr(97 + int(d)) for d in str(i + 100))
    plain = [f"w{word(i)}" for i in range(45)]
    longer = [*plain[:15], "more", *plain[15:30], "more", *plain[30:]]
    shorter = [w for i, w in enumerate(plain) if i not in (11, 23, 34)]
    named = [{11: "Tom", 22: "Tom", 33: "Tom"}.get(i, w.replace("w", "n")) for i, w in enumerate(plain)]
    renamed = ["Mary Ann" if w == "Tom" else w for w in named]
    united = [{9: "60 km", 20: "7 kg", 31: "5 hours"}.get(i, w.replace("w", "u")) for i, w in enumerate(plain)]
    bare = [{9: "61", 20: "8", 31: "4"}.get(i, w) for i, w in enumerate(united)]
    far = [*plain[:15], *(f"f{word(i)}" for i in range(100)), *plain[30:]]  # two thirds of an item, but not in one place
    items = spark.createDataFrame([(1, " ".join(plain)), (2, " ".join(named)), (3, " ".join(united))], "item_id int, text string")
    texts = [longer, shorter, renamed, bare, far]
    rows = [(i, " ".join(["filler", "it", *t, "end"]), None) for i, t in enumerate(texts)]
    found = {(r.doc_id, r.item_id): r for r in leaks.leaks(brute.table(spark, rows), items).collect()}
    assert set(found) == {(0, 1), (1, 1), (2, 2), (3, 3)}
    assert found[0, 1].coverage == found[2, 2].coverage == found[3, 3].coverage == 1 and found[1, 1].coverage == 42 / 45
    assert found[2, 2].consistent and found[0, 1].windows == 3 * 11


def test_short_items_inside_documents_and_short_documents(spark, tmp_path):
    """Through the registered query and the pipeline's stage, which look for short items everywhere."""
    import corpus_pipeline
    from emberwatch.llm import queries

    items = [(1, "why is snow white"), (2, "what is 5"), (3, "alpha beta gamma delta epsilon zeta eta theta"), (4, "one two three four five six"), (5, "Yes")]
    texts = [
        "we ask here why is snow white and nothing else", "so what is 5 then", "so what is 6 then", "gamma delta epsilon zeta",
        "gamma delta epsilon", "now two three four five six seven", "why is the snow white", "he says yes to it", "Yes!",
    ]
    docs = brute.table(spark, [(i, t, None) for i, t in enumerate(texts)])
    docs.drop(*brute.EXTRA.replace(",", " ").split()).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {(r.doc_id, r.item_id): r for r in queries.op3_leaks(spark, str(tmp_path)).collect()}
    assert set(found) == {(0, 1), (1, 2), (3, 3), (5, 4), (8, 5)}  # one word is an item as a whole text only
    assert {k[0]: r.coverage for k, r in found.items()} == {0: 1, 1: 1, 3: 0.5, 5: 5 / 6, 8: 1}
    left = corpus_pipeline.without_leaks(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in left.collect()) == [2, 4, 6, 7]


def test_windows_that_many_items_share(spark):
    """A phrase of many items pairs nothing by itself; it counts where a rarer window is met, and for items without one."""
    word = lambda i: "".join(chr(97 + int(d)) for d in str(i + 1000))
    phrase = "which of the following is"
    own = lambda i: " ".join(f"w{word(i)}x{word(j)}" for j in range(8))
    items = [(i, f"{phrase} {own(i)}") for i in range(300)] + [(1000 + i, phrase) for i in range(3)]
    docs = [(i, f"Here {phrase} said about thing {word(i)}.", None) for i in range(300)] + [(900, f"asked {phrase} {own(7)} now", None)]
    benchmark = spark.createDataFrame(items, "item_id int, text string")
    made = leaks.hits(brute.table(spark, docs), benchmark)
    assert made.count() < 3 * len(docs) + 20  # 300 x 300 pairs share the phrase
    found = {(r.doc_id, r.item_id): r.coverage for r in leaks.leaks(brute.table(spark, docs), benchmark).collect()}
    assert {k for k in found if k[1] < 1000} == {(900, 7)} and found[900, 7] == 1
    assert {k for k in found if k[1] >= 1000} == {(d, 1000 + i) for d, _, _ in docs for i in range(3)}


def test_common_personal_data_of_other_forms_is_found(spark):
    """The more of a form a corpus holds, the surer it must not be taken for a look-alike."""
    draw = random.Random(4)
    d = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    forms = [
        lambda: f"please call 0{d(3)}-{d(7)} today", lambda: f"iban DE{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)} is mine",
        lambda: f"mail jane{draw.choice('abcdef')}(at)doe{draw.choice('abcdef')}(dot)org soon",
    ]
    rows = [(i, forms[i % 3](), None) for i in range(6000)]
    rows += [(6000 + i, f"on 20{d(2)}-0{draw.randint(1, 9)}-1{d(1)} we met", None) for i in range(1000)]
    got = {r.doc_id: r.n_added for r in personal.personal_data(brute.table(spark, rows)).collect()}
    for k in range(3):
        assert sum(got[i] > 0 for i in range(k, 6000, 3)) > 1900, k
    assert sum(got[i] for i in range(6000, 7000)) < 20


def test_refuted_look_alikes():
    says = lambda t, span: personal.refuted(t, t.index(span), t.index(span) + len(span))
    for t, span in (("on 2024-05-06 we", "2024-05-06"), ("total 123.456.789 x", "123.456.789"), ("version 1.2.13.4567", "1.2.13.4567"), ("ip 300.1.1.1", "300.1.1.1"), ("card 4111 1111 1111 1112", "4111 1111 1111 1112")):
        assert says(t, span), t
    for t, span in (("call 030-1234567", "030-1234567"), ("iban DE12 3456 7890 1234 5678 90", "DE12 3456 7890 1234 5678 90"), ("host 10[.]1[.]2[.]3", "10[.]1[.]2[.]3"), ("a(at)b(dot)org", "a(at)b(dot)org")):
        assert not says(t, span), t
