"""Every operator on nulls in any column, empty and very long texts, ties and repeated rows, empty tables, and extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from lumenloom.llm import formatdup, language, leakage, lookalike, mixing, overlap, packing, reading, truncation

RECORDS = "row_id long, dataset_id int, data_split string, captions array<string>, latents array<float>, resolution_bucket_id int, lang string"
CLASHES = ("n", "d", "rep", "train", "a", "b", "x", "y", "key", "kind", "word", "value", "length", "k1", "label", "word_count", "_hot", "text_", "step", "h", "g1", "c", "form", "raw", "size", "id", "no", "source")
LONG = "The quiet mason waits beside a frozen canal. " * 4000


@pytest.fixture(scope="module")
def records(spark):
    s = "The quiet mason waits beside a frozen canal."
    rows = [
        (1, 0, "train", [s], [0.5] * 8, 1, "en"),
        (2, 0, "eval", [s], [0.5] * 8, 1, "en"),
        (2, 0, "eval", [s], [0.5] * 8, 1, "en"),
        (3, None, None, None, None, None, None),
        (4, 1, "train", [], [], 1, ""),
        (5, 1, "test", ["", " ", None], [float("nan")] * 8, 1, "und"),
        (6, 1, "train", [LONG], [float("inf")] * 8, 1, "en"),
        (7, 1, "test", [LONG, None], None, 2, "xx"),
        (None, 1, "train", [s], [1.0] * 8, 1, "en"),
    ]
    df = spark.createDataFrame(rows, RECORDS)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES]).cache()


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(1, LONG), (1, LONG), (2, ""), (3, None), (None, "The end."), (4, "short text here"), (5, " \n ")]
    return spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("clash").alias(c) for c in CLASHES]).cache()


def _both(df):
    return [df, df.limit(0)]


def test_mixing(spark, records):
    entries = spark.createDataFrame([(1, 0, "p/a/", None, None, 2), (1, 1, None, float("nan"), "b", None), (1, 9, "c", 1.0, "", 5), (2, None, None, 0.0, None, 1), (None, 0, "x", 1.0, "x", 1)], "mix_id int, dataset_id int, path string, weight double, alias string, max_repeats int")
    runs = spark.createDataFrame([(1, 3), (2, 5), (3, None)], "mix_id int, target_rows long")
    for df in _both(records):
        length = mixing.row_tokens(F.col("captions"))
        plan = mixing.plan_mix(df.where("data_split = 'train'"), entries, runs, length)
        assert {(1, 9)} <= {tuple(r) for r in mixing.unreachable(plan).collect()}
        assert mixing.mix_report(plan).count() == 4
        drawn = mixing.draw(df.where("data_split = 'train'"), plan, "row_id", length).collect()
        assert all(r["copies"] > 0 for r in drawn)
    assert mixing.plan_mix(records, entries.limit(0), runs, mixing.row_tokens(F.col("captions"))).count() == 0


def test_lookalike(records):
    assert lookalike.lookalike_pairs(records).count() == 0
    assert lookalike.lookalike_pairs(records.limit(0)).count() == 0
    out = {r["row_id"]: r["captions"] for r in lookalike.normalise(records, "captions", ["row_id"]).collect()}
    assert out[3] is None and out[4] == [] and out[5] == ["", " ", None] and out[6] == [LONG]


def test_formatdup(records):
    once = records.dropDuplicates(["row_id"])
    assert {tuple(r) for r in formatdup.format_copies(once).collect()} == {(1, 2), (6, 7)}
    assert formatdup.format_copies(records.limit(0)).count() == 0
    assert sum(r["n_copies"] for r in formatdup.format_groups(once).collect()) == 4
    assert formatdup.format_copies(records).count() == 1  # the two rows of id 2 are one record with its caption twice


def test_truncation(records):
    assert truncation.cut_texts(records).count() == 0
    assert truncation.cut_texts(records.limit(0)).count() == 0
    rates = {r["dataset_id"]: (r["n_captions"], r["n_cut"]) for r in truncation.cut_rates(records).collect()}
    assert rates[0] == (3, 0) and rates[None] == (0, 0)


def test_language(records):
    out = {r["row_id"]: r["true_lang"] for r in language.wrong_labels(records).collect()}
    assert out == {7: "en"}
    assert language.wrong_labels(records.limit(0)).count() == 0
    assert language.segment_languages(records.limit(0)).count() == 0
    unlabelled = records.withColumn("lang", F.lit(None).cast("string"))
    assert language.wrong_labels(unlabelled).count() == 0
    assert language.segment_languages(unlabelled).where("language is not null").count() == 0


def test_overlap(records):
    pairs = {tuple(r) for r in overlap.cross_split_pairs(records).collect()}
    assert pairs == {(1, 2), (6, 7)}
    assert overlap.cross_split_pairs(records.limit(0)).count() == 0
    report = {(r[0], r[1]): r["n_overlapping"] for r in overlap.overlap_report(records).collect()}
    assert report == {("eval", 0): 2, ("test", 1): 1}


def test_packing(spark, documents):
    specs = spark.createDataFrame([("s", 16), ("none", None), ("zero", 0)], "container_name string, capacity_tokens int")
    packed = packing.pack(documents, specs).collect()
    assert {r["container_name"] for r in packed} == {"s"}
    filled = {}
    for r in packed:
        filled[r["bin_id"]] = filled.get(r["bin_id"], 0) + r["n_tokens"]
    assert max(filled.values()) <= 16
    assert packing.pack(documents.limit(0), specs).count() == 0
    assert packing.pack(documents, specs.limit(0)).count() == 0


def test_leakage(spark, documents):
    items = spark.createDataFrame([(1, LONG[:400]), (2, None), (3, ""), (4, "few words")], "item_id long, text string")
    assert {tuple(r) for r in leakage.leaks(documents, items).select("item_id", "doc_id").collect()} == {(1, 1)}
    assert leakage.leaks(documents.limit(0), items).count() == 0
    assert leakage.leaks(documents, items.limit(0)).count() == 0


def test_reading(spark, documents):
    labels = spark.createDataFrame([(1, 2), (None, 4), (4, None), (99, 1)], "doc_id long, reading_band int").withColumn("n_words", F.lit(5)).withColumn("english", F.lit(False))
    bands = {r["doc_id"]: r["band"] for r in reading.reading_bands(documents, labels).collect()}
    assert bands[1] == 2 and bands[2] is None and bands[3] is None and bands[5] is None
    assert {r[0] for r in reading.unlabelled_in_band(documents, labels, 2).collect()} == {None}
    assert reading.unlabelled_in_band(documents, labels.limit(0), 2).count() == 0
    assert reading.unlabelled_in_band(documents.limit(0), labels, 2).count() == 0
