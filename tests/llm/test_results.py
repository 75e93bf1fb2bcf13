"""Results against brute force, exact round trips and held-out accuracy."""

import itertools
import random
import unicodedata

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenloom.llm import formatdup, language, leakage, lookalike, mixing, overlap, packing, reading, truncation
from lumenloom.llm.textform import LOOKALIKES, TO_LATIN, compatible, fold, words

ADJ = "quiet pale solemn weary barefoot curious elderly smiling".split()
WHO = "mason weaver monk scribe potter juggler dancer shepherd".split()
WHAT = "copper kettle|paper kite|broken oar|wooden flute|folded letter|blue umbrella".split("|")
WHERE = "beside a frozen canal|under an arched bridge|in a walled garden|on a narrow balcony|before a tall window".split("|")


def sentence(r: random.Random) -> str:
    return r.choice([
        f"A {r.choice(ADJ)} {r.choice(WHO)} holds a {r.choice(WHAT)} {r.choice(WHERE)}.",
        f"The picture shows a {r.choice(ADJ)} {r.choice(WHO)} who guards a {r.choice(WHAT)} {r.choice(WHERE)}.",
        f"In the distance a {r.choice(WHAT)} fades into {r.choice(['teal', 'ochre', 'rust'])} and {r.choice(['ivory', 'mauve', 'olive'])} tones.",
    ])


def text(r: random.Random, n: int = 4) -> str:
    return " ".join(sentence(r) for _ in range(n))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 12), min_size=1, max_size=6), st.integers(0, 500))
def test_budget_is_met_as_nearly_as_possible(counts, budget):
    lengths, numbers = list(counts), list(counts.values())
    taken = mixing.fit_budget(lengths, numbers, budget)
    assert all(0 <= t <= n for t, n in zip(taken, numbers, strict=True))
    reach = {0}
    for length, n in counts.items():
        reach = {s + k * length for s in reach for k in range(n + 1)}
    best = min(abs(s - budget) for s in reach)
    got = abs(sum(t * length for t, length in zip(taken, lengths, strict=True)) - budget)
    assert got == best


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), min_size=1, max_size=40), st.floats(0, 1))
def test_rows_are_exact_and_tokens_near(counts, share):
    lengths, numbers = list(counts), list(counts.values())
    rows = int(sum(numbers) * share)
    goal = round(sum(a * b for a, b in counts.items()) * rows / sum(numbers))
    taken = mixing.fit_budget(lengths, numbers, goal, rows)
    assert sum(taken) == rows and all(0 <= t <= n for t, n in zip(taken, numbers, strict=True))


def test_budgets_that_need_many_exchanges():
    assert sum(a * b for a, b in zip([10, 13], mixing.fit_budget([10, 13], [1000, 1000], 5003), strict=True)) == 5003
    assert sum(a * b for a, b in zip([4, 6, 9001], mixing.fit_budget([4, 6, 9001], [5000, 9, 3], 18_002 + 40), strict=True)) == 18_042
    assert sum(a * b for a, b in zip([6, 10], mixing.fit_budget([6, 10], [500, 500], 1001), strict=True)) in (1000, 1002)


def test_many_lengths_take_little_memory():
    import tracemalloc

    lengths = list(range(1, 20_001))
    tracemalloc.start()
    taken = mixing.fit_budget(lengths, [3] * len(lengths), 123_456_789)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert sum(a * b for a, b in zip(lengths, taken, strict=True)) == 123_456_789 and peak < 200 << 20


def test_drawn_rows_are_what_the_plan_says(spark, monkeypatch):
    rows = spark.range(500).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("dataset_id"), F.array(F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int"))).alias("captions"))
    entries = spark.createDataFrame([(1, 0, "a", 0.5, "a", 3), (1, 1, "b", 0.3, "b", 1), (1, 2, "c", 0.2, "c", 9)], "mix_id int, dataset_id int, path string, weight double, alias string, max_repeats int")
    runs = spark.createDataFrame([(1, 700)], "mix_id int, target_rows long")
    length = mixing.row_tokens(F.col("captions"))
    plan = mixing.plan_mix(rows, entries, runs, length)
    report = {r["dataset_id"]: r["actual"] for r in mixing.mix_report(plan).collect()}
    assert report == {0: 350, 1: 167, 2: 140}
    drawn = mixing.draw(rows, plan, "row_id", length, seed=3).join(rows, "row_id")
    assert {r[0]: r[1] for r in drawn.groupBy("dataset_id").agg(F.sum("copies")).collect()} == report
    assert drawn.groupBy("row_id").count().agg(F.max("count")).first()[0] == 1
    monkeypatch.setattr(mixing, "STEP_ROWS", 7)  # several steps in a group
    stepped = mixing.draw(rows, plan, "row_id", length, seed=3)
    assert sorted(map(tuple, stepped.collect())) == sorted(map(tuple, drawn.select("mix_id", "row_id", "copies").collect()))
    again = mixing.draw(rows.repartition(7), plan, "row_id", length, seed=3)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, drawn.select("mix_id", "row_id", "copies").collect()))
    tokens = mixing.mix_report(mixing.plan_mix(rows, entries, runs, length, by_rows=False), by_rows=False).collect()
    assert all(abs(r["actual"] - min(r["target"], r["capacity"])) <= 1 for r in tokens)


def disguise(t: str, r: random.Random) -> str:
    out = []
    for ch in t:
        x = r.random()
        if ch in LOOKALIKES and x < 0.4:
            out.append(r.choice(LOOKALIKES[ch]))
        elif ch.isascii() and ch.isalnum() and x < 0.6:
            out.append(chr(ord(ch) + 0xFEE0))
        elif ch == " " and x < 0.5:
            out.append(r.choice("\xa0   "))
        else:
            out.append(unicodedata.normalize("NFD", ch))
        if r.random() < 0.1:
            out.append(r.choice("​‌⁠﻿­"))
    return "".join(out)


def test_disguised_texts_come_out_equal(spark):
    r = random.Random(1)
    plain = [text(r) for _ in range(30)] + ["Тихий часовщик смотрит вдаль. Перед грозой.", "Une fillette fatiguée près d’un café.", "Das Mädchen ruht.", "画面中央摆着空鸟笼。"]
    lattice = lookalike.Lattice({})
    for t in plain:
        # the consistent form of a text is that of any text that looks like it, and looks like it itself
        forms = {lattice.text(disguise(t, r)) for _ in range(5)} | {lattice.text(t)}
        assert len(forms) == 1
        assert unicodedata.normalize("NFC", forms.pop().translate(TO_LATIN)) == unicodedata.normalize("NFC", compatible(t).translate(TO_LATIN))
    rows = [(i, [t, "x"]) for i, t in enumerate(plain)] + [(100 + i, [disguise(t, r), "x"]) for i, t in enumerate(plain)]
    rows += [(200, [plain[0].upper(), "x"]), (201, [plain[0].replace(" ", "  "), "x"]), (202, [plain[0].replace(".", "!"), "x"]), (203, [plain[0].replace(" ", "\t"), "x"]), (204, ["x", plain[0]])]
    df = spark.createDataFrame(rows, "row_id long, captions array<string>")
    assert {tuple(x) for x in lookalike.lookalike_pairs(df).collect()} == {(i, 100 + i) for i in range(len(plain)) if rows[i][1] != rows[len(plain) + i][1]}
    russian = {x["row_id"]: x["captions"][0] for x in lookalike.normalise(df, "captions", ["row_id"]).collect()}
    assert russian[100 + 30] == plain[30]


def test_format_copies_against_brute_force(spark):
    r = random.Random(2)
    base = [[text(r, 1), text(r, 1)] for _ in range(20)]
    rows = []
    for i in range(200):
        a, b = r.choice(base)
        pair = [r.choice([a, a.upper(), a.replace(" ", " - "), a + "\n"]), r.choice([b, b.lower(), b.strip("."), b.replace(" ", "")])]
        rows.append((i, r.choice([pair, pair[::-1], pair + ["..."], [None, *pair]])))
    rows += [(300, ["éa"]), (301, ["\xe9a"]), (302, ["ΟΔΟΣ"]), (303, ["οδοσ"]), (304, ["οδος"])]
    want = {}
    for i, captions in rows:
        kept = ("".join(ch.lower() for ch in c if unicodedata.category(ch)[0] in "LMN") for c in captions if c)
        want.setdefault(tuple(sorted(k for k in kept if k)), []).append(i)
    df = spark.createDataFrame(rows, "row_id long, captions array<string>")
    got = {tuple(x) for x in formatdup.format_copies(df).collect()}
    assert got == {(ids[0], i) for ids in want.values() for i in ids[1:]}


def test_cut_texts(spark):
    r = random.Random(3)
    rows, cut = [], set()
    for i in range(1500):
        t = text(r)
        if i % 10 == 0:
            keep = t[: r.randrange(60, len(t) - 12)]
            if keep.rstrip()[-1] not in ".":
                cut.add(i)
            t = keep
        elif i % 10 == 1:
            t = t[:-1]
        elif i % 10 == 2:
            t = r.choice(["Elder Mason", "Quiet weaver with a kite", "oil, teal, calm", '"Two lemons"'])
        rows.append((i, 0, [t]))
    df = spark.createDataFrame(rows, "row_id long, dataset_id int, captions array<string>")
    got = {x["row_id"] for x in truncation.cut_texts(df).collect()}
    assert len(got & cut) >= 0.9 * len(cut) and len(got - cut) <= 0.1 * len(cut)


def test_language_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/precomputed.parquet")
    matrix = language.fit(language.labelled_sample(df, "row_id", "lang", "captions"))
    known = {
        "en": "This is a long sentence about a painter who never sold a single work.", "de": "Das ist ein langer Satz über einen Maler, der nie ein Bild verkauft hat.",
        "fr": "Voici une longue phrase sur un peintre qui n’a jamais vendu une seule toile.", "es": "Esta es una frase larga sobre un pintor que nunca vendió ninguna obra.",
        "ru": "Это длинное предложение о художнике, который не продал ни одной картины.", "zh": "这是一个关于画家的长句子，他从来没有卖出过一幅画。", "ja": "これは一枚も絵を売らなかった画家についての長い文です。",
    }
    segments = language.Segments(list(known.values()))
    only = np.flatnonzero(language.running(segments) == 2)
    best, sure = language.classify(segments, only, matrix)
    assert [language.LANGUAGES[b] for b in best] == list(known) and sure.min() > 0.5


def test_overlaps_against_brute_force(spark):
    r = random.Random(4)
    rows = [(i, "train" if i % 4 else "eval", [text(r)], np.random.default_rng(i).normal(size=64).tolist()) for i in range(240)]
    for i in range(60):
        _, split, (t,), z = rows[i]
        w = t.split()
        for k in r.sample(range(len(w)), r.randrange(0, len(w) // 10)):
            w[k] = r.choice(["golden", w[k] + " small", "", "heavy"])
        rows.append((1000 + i, "test" if split == "train" else "train", [" ".join(w)], np.random.default_rng(9000 + i).normal(size=64).tolist()))
        rows.append((2000 + i, "test" if split == "train" else "train", [text(r)], (np.array(z) + np.random.default_rng(i).normal(scale=0.04, size=64)).tolist()))
    df = spark.createDataFrame([(*x, 0) for x in rows], "row_id long, data_split string, captions array<string>, latents array<float>, dataset_id int")
    want = set()
    for a, b in itertools.combinations(rows, 2):
        if (a[1] == "train") == (b[1] == "train"):
            continue
        done, total = overlap.record_edits(*([words(t) for t in x[2]] for x in (a, b)))
        if done < 0.1 * total or np.sqrt(((np.array(a[3]) - np.array(b[3])) ** 2).mean()) < 0.15 * np.std(a[3]):
            want.add((min(a[0], b[0]), max(a[0], b[0])))
    got = {tuple(x) for x in overlap.cross_split_pairs(df).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) >= 110
    assert {tuple(x) for x in overlap.cross_split_pairs(df, few=0).collect()} == got  # the other way to fetch the records to be checked
    assert {tuple(x) for x in overlap.cross_split_pairs(df, split_at=1).collect()} == got  # what records share is spread over parts
    report = overlap.overlap_report(df).agg(F.sum("n_overlapping")).first()[0]
    sides = {x[0]: x[1] for x in rows}
    assert report == len({i for pair in got for i in pair if sides[i] != "train"})


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 120), max_size=80), st.integers(8, 64))
def test_bins_hold_what_they_can(sizes, capacity):
    bins, filled, back = packing.Bins(capacity, 4), {}, []
    for size in sizes:
        placed = bins.place(size)
        assert len(placed) == -(-size // capacity) and sum(n for _, _, n in placed) == size
        assert [first for _, first, _ in placed] == [k * capacity for k in range(len(placed))]
        for number, _, n in placed:
            filled[number] = filled.get(number, 0) + n
        back.append(sum(n for _, _, n in placed))
    assert back == sizes and all(0 < v <= capacity for v in filled.values())


def test_packing_round_trip(spark):
    r = random.Random(5)
    texts = {i: text(r, r.randrange(1, 30)) for i in range(120)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    specs = spark.createDataFrame([("short", 128), ("long", 512)], "container_name string, capacity_tokens int")
    encode = packing.tokenizer().encode_ordinary
    packed = packing.pack(docs, specs)
    for name, capacity in (("short", 128), ("long", 512)):
        pieces = {}
        for p in packed.where(F.col("container_name") == name).collect():
            pieces.setdefault(p["doc_id"], []).append((p["first_token"], p["n_tokens"]))
        for i, t in texts.items():
            n, at = len(encode(t)), 0
            for first, size in sorted(pieces[i]):
                assert first == at and size <= capacity
                at += size
            assert at == n and (len(pieces[i]) == 1) == (n <= capacity)
    # two tasks leave their last containers half empty, of about 15 long ones
    assert packing.fill_report(packed, specs).agg(F.min("fill")).first()[0] > 0.85


def test_leaks_against_brute_force(spark):
    r = random.Random(6)
    fresh = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 9))) for _ in range(n))
    items = [(k, ("Read the passage.\n" if k % 2 else "") + fresh(100)) for k in range(12)]
    docs, want = [], set()
    for i in range(150):
        k = r.randrange(12)
        passage = items[k][1].split("\n")[-1].split()
        kind = i % 6
        if kind == 0:
            part = passage[10:50]
            part[20] = "changed"
            docs.append((i, text(r, 20) + " " + " ".join(part).upper() + ". " + text(r, 10)))
            want.add((k, i))
        elif kind == 1:
            docs.append((i, text(r, 3) + " " + " ".join(passage[:16]) + " " + text(r, 3) + " " + " ".join(passage[60:76]) + " " + text(r, 2)))
            want.add((k, i))
        elif kind == 2:
            docs.append((i, "Read the passage. " + text(r, 9) + " " + " ".join(passage[5:15])))
        else:
            docs.append((i, text(r, 12)))
    documents = spark.createDataFrame(docs, "doc_id long, text string")
    found = leakage.leaks(documents, spark.createDataFrame(items, "item_id long, text string"))
    got = {tuple(x) for x in found.select("item_id", "doc_id").collect()}
    assert got == want
    sharded = leakage.leaks(documents, spark.createDataFrame(items, "item_id long, text string"), block_items=3)
    assert {tuple(x) for x in sharded.select("item_id", "doc_id").collect()} == want


def test_reading_held_out(spark):
    folder = "/root/testdata/sf0.01"
    documents, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/reading_labels.parquet")
    held = labels.where("doc_id % 3 = 0")
    bands = reading.reading_bands(documents, labels.where("doc_id % 3 <> 0")).join(held, "doc_id")
    n, right, near = bands.agg(F.count("*"), F.sum(F.expr("int(band = reading_band)")), F.sum(F.expr("int(abs(band - reading_band) <= 1)"))).first()
    assert n > 10 and right >= 0.8 * n and near >= 0.95 * n


def test_folds():
    assert words("Ｃａｆе́, “l’été” — 画面 123") == ["cafe", "l", "ete", "画", "面", "123"]
    assert fold("a​b") == "ab"


def test_overlaps_with_scattered_changes(spark):
    r = random.Random(11)
    fresh = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(7))
    rows, want = [], set()
    for i in range(120):
        w = [chr(0x4E00 + r.randrange(4000)) for _ in range(r.randrange(31, 150))] if i % 2 else [fresh() for _ in range(r.randrange(11, 100))]
        changed = list(w)
        for k in r.sample(range(len(w)), (len(w) - 1) // 10):  # as many as a near record may have, at random places
            changed[k] = chr(0x4E00 + 4000 + r.randrange(900)) if i % 2 else fresh()
        more = [fresh() for _ in range(4)] if i % 3 == 0 else []
        glue = "" if i % 2 else " "
        rows.append((i, "train", [glue.join(w), " ".join(more)], None))
        rows.append((1000 + i, "eval", [" ".join(more), glue.join(changed)], None))
        want.add((i, 1000 + i))
    df = spark.createDataFrame(rows, "row_id long, data_split string, captions array<string>, latents array<float>")
    assert {tuple(x) for x in overlap.cross_split_pairs(df).collect()} == want


def test_leaks_in_two_short_pieces(spark):
    r = random.Random(12)
    fresh = lambda n: ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 9))) for _ in range(n)]
    items = [(k, fresh(100)) for k in range(12)]
    docs, want = [], set()
    for i in range(240):
        k, at = r.randrange(12), r.randrange(0, 40)
        # single words of other items stand around the pieces, so that a passage points elsewhere
        passage, rest = items[k][1], [r.choice(items[(k + r.randrange(1, 12)) % 12][1]) for _ in range(90)]
        cuts = sorted(r.sample(range(len(rest)), 2))
        docs.append((i, " ".join(rest[: cuts[0]] + passage[at : at + 12] + rest[cuts[0] : cuts[1]] + passage[at + 40 : at + 52] + rest[cuts[1] :])))
        want.add((k, i))
    documents = spark.createDataFrame(docs, "doc_id long, text string")
    found = leakage.leaks(documents, spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string"))
    assert {tuple(x) for x in found.select("item_id", "doc_id").collect()} == want


def test_copies_of_many_records_make_all_their_pairs(spark):
    rows = [(i, "train" if i < 40 else "eval", ["A  quiet mason, holds a kettle beside a frozen canal in winter." if i % 2 else "a quiet Mason holds a kettle beside a frozen canal in winter"], None) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, data_split string, captions array<string>, latents array<float>")
    assert {tuple(x) for x in overlap.cross_split_pairs(df).collect()} == {(a, b) for a in range(40) for b in range(40, 60)}


def test_edits_and_assignment_against_plain_ones():
    r = random.Random(3)

    def plain(a, b):
        before = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
            before = now
        return before[-1]

    for _ in range(400):
        a = [r.randrange(6) for _ in range(r.randrange(0, 14))]
        b = list(a) if r.random() < 0.6 else [r.randrange(6) for _ in range(r.randrange(0, 14))]
        for _ in range(r.randrange(0, 4)):
            if b:
                b[r.randrange(len(b))] = r.randrange(6)
            b.insert(r.randrange(len(b) + 1), r.randrange(6))
        most = r.randrange(0, 9)
        assert overlap.edits(a, b, most) == min(plain(a, b), most + 1)
        n = r.randrange(1, 5)
        cost = [[r.randrange(9) for _ in range(n)] for _ in range(n)]
        assert overlap.assignment(cost) == min(sum(cost[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)))


def test_leaks_with_changed_characters_and_repetitions(spark):
    r = random.Random(13)
    han = lambda n: "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(4, 9)))
    items = [(k, "".join(han(9) + word() + str(r.randrange(1000, 9999)) for _ in range(12))) for k in range(6)]
    common = "village river garden window market candle".split()
    items += [(k, " ".join(r.choice(common) if j % 6 == 3 else word() for j in range(60))) for k in range(6, 9)]
    docs, want = [(1000 + i, " ".join(common)) for i in range(40)], set()
    for i in range(60):
        k = r.randrange(6)
        part = list(items[k][1][20:100])
        for at in range(r.randrange(6, 12), len(part), 14):
            part[at] = "新"
        docs.append((i, han(40) + "".join(part) + han(30)))
        want.add((k, i))
    for i in range(60, 70):  # a phrase of the item comes often before the passage does
        k = 6 + i % 3
        w = items[k][1].split()
        part = w[10:60]
        part[25] = "changed"
        docs.append((i, " ".join([*(w[10:14] + [word()]) * 80, *part])))
        want.add((k, i))
    for i in range(90, 96):  # reworded: common words change, the names in it stay
        k = 6 + i % 3
        w = items[k][1].split()[5:45]
        for at in range(4, 40, 6):
            assert w[at] in common
            w[at] = "other"
        docs.append((i, " ".join(word() for _ in range(9)) + " " + " ".join(w)))
        want.add((k, i))
    for i in range(70, 90):  # a quote
        w = items[6 + i % 3][1].split()
        docs.append((i, " ".join(word() for _ in range(9)) + " " + " ".join(w[:12]) + " " + " ".join(word() for _ in range(9))))
    found = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(x) for x in found.select("item_id", "doc_id").collect()} == want


def test_held_against_all_pairs_of_pieces():
    r = random.Random(14)
    for _ in range(300):
        found = []
        for _ in range(r.randrange(0, 12)):
            p, q, n = r.randrange(40), r.randrange(40), r.randrange(1, 12)
            found.append((n, 0, p, p + n, q, q + n))
        best = max((x[0] for x in found), default=0)
        for x, y in itertools.permutations(found, 2):
            if x[3] <= y[2] and x[5] <= y[4]:
                best = max(best, x[0] + y[0])
        assert leakage.held(found) == best


def test_identifiers_are_independent(spark):
    rows = spark.range(2000).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"))
    pair = rows.select(*formatdup._pair(F.col("v"), ("a", "b"))).collect()
    assert len({r["a"] for r in pair}) == len({r["b"] for r in pair}) == 2000
    # the second number must not follow from the first: it does not when the first is hashed on
    chained = rows.select(F.xxhash64(F.xxhash64("v"), F.lit(11)).alias("c"), *formatdup._pair(F.col("v"), ("a", "b"))).collect()
    assert not any(r["b"] in (r["a"], r["c"]) for r in chained)
    nulls = spark.createDataFrame([(None,), ("x",)], "v string").select(*formatdup._pair(F.col("v"), ("a", "b"))).collect()
    assert nulls[0]["a"] != nulls[0]["b"] and nulls[1]["a"] != nulls[1]["b"]


def test_trie_in_sorted_order(spark):
    long = "ab" + "x" * 1_000_000
    words_seen = spark.createDataFrame([("abbey", 5), ("abbot", 2), ("rare", 1), (long, 3), ("öde", 2), ("ödland", 2)], "word string, n long")
    last = spark.createDataFrame([("ab",), ("abb",), ("abbey",), ("abbots",), ("rar",), ("öd",), ("abx",), ("zz",), ("abbo",)], "word string")
    got = {r["word"]: r["inner"] for r in truncation._trie(words_seen, last).collect()}
    assert got == {"ab": True, "abb": True, "abbey": False, "abbots": False, "rar": False, "öd": True, "abx": True, "zz": False, "abbo": True}


def test_reading_ranks_do_not_depend_on_the_table(spark):
    r = random.Random(21)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    rows = [(i, " ".join(r.choice(vocabulary[: r.choice([3, 40, 300])]) for _ in range(80)) + ".") for i in range(60)] + [(60, "一二三 四五。"), (61, ""), (None, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    large, small = ({r[0]: tuple(r) for r in reading.measure(df, "doc_id", "text", vocabulary=v).collect()} for v in (10_000, 4))
    assert large == small and len(large) == 63
    assert large[60][1] == 5 and large[61][3] is None


def test_two_readings_in_one_session(spark):
    documents = spark.createDataFrame([(i, "The cat sat on the mat. " * 5 if i % 2 else "Hermeneutical considerations notwithstanding, epistemological presuppositions of the argument are indeterminate. " * 5) for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i % 2 else 4) for i in range(10)], "doc_id long, reading_band int")
    other = labels.withColumn("reading_band", 5 - F.col("reading_band"))
    first, second = reading.unlabelled_in_band(documents, labels, 4), reading.unlabelled_in_band(documents, other, 4)
    assert {r[0] for r in first.collect()} == {10, 12, 14, 16, 18} and {r[0] for r in second.collect()} == {11, 13, 15, 17, 19}


def test_many_rows_of_a_spelling_meet_in_parts(spark, monkeypatch):
    from lumenloom.operators import skew

    rows = [(i, ["Pax et opus" if i < 30 else "Рах et opus" if i < 45 else "Pаx et opus" if i < 50 else "other"]) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, captions array<string>")
    kind = lambda i: 0 if i < 30 else 1 if i < 45 else 2
    want = {(i, j) for i, j in itertools.combinations(range(50), 2) if kind(i) != kind(j)}
    assert {tuple(r) for r in lookalike.lookalike_pairs(df).collect()} == want
    monkeypatch.setattr(skew.join_members, "__defaults__", (7,))
    monkeypatch.setattr(skew.join_hot_keys_apart, "__defaults__", ("inner", 7))
    assert {tuple(r) for r in lookalike.lookalike_pairs(df).collect()} == want


def test_placement_report_sees_what_is_wrong(spark):
    specs = spark.createDataFrame([("s", 10)], "container_name string, capacity_tokens int")
    made = lambda rows: packing.placement_report(spark.createDataFrame([("s", *x) for x in rows], "container_name string, bin_id long, doc_id long, first_token long, n_tokens int"), specs).first()
    assert made([(0, 1, 0, 6), (0, 2, 0, 4), (1, 3, 0, 10), (2, 3, 10, 3)])[:4] == ("s", 3, 0, 0)
    assert made([(0, 1, 0, 6), (0, 2, 0, 5)])[2] == 1
    assert made([(0, 1, 0, 3), (1, 1, 3, 3)])[3] == 1  # split without need
    assert made([(0, 1, 2, 4)])[3] == 1  # a beginning is missing


def test_other_languages_are_rejected(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/precomputed.parquet")
    matrix = language.fit(language.labelled_sample(df, "row_id", "lang", "captions"))
    texts = ["Cichy malarz trzyma lampę przy oknie starego kamiennego młyna nad rzeką.", "The quiet painter holds a lamp at the window of the old stone mill."]
    segments = language.Segments(texts)
    best, _ = language.classify(segments, np.flatnonzero(language.running(segments) == 2), matrix)
    assert best.tolist() == [-1, 0]
