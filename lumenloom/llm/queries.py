"""The queries of the training-text operators: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.llm import formatdup, language, leakage, lookalike, mixing, overlap, packing, reading, truncation
from lumenloom.sources.readers import table


def _mix_plan(spark: SparkSession, folder: str, by_rows: bool = True) -> tuple[DataFrame, DataFrame]:
    train = table(spark, folder, "precomputed").where("data_split = 'train'")
    return train, mixing.plan_mix(train, table(spark, folder, "dataset_entry"), table(spark, folder, "mix_run"), mixing.row_tokens(F.col("captions")), by_rows)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.unreachable(_mix_plan(spark, folder)[1])


def p1_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_report(_mix_plan(spark, folder)[1]).select(
        "mix_id", "dataset_id", F.round("target", 6).alias("target_rows"), F.col("capacity").cast("long").alias("capacity_rows"), F.col("actual").alias("actual_rows"),
        F.round("actual_share", 9).alias("actual_share"), F.round("target_share", 9).alias("target_share"),
    )


def p1_token_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_report(_mix_plan(spark, folder, by_rows=False)[1], by_rows=False)


def p1_token_totals(spark: SparkSession, folder: str) -> DataFrame:
    """What the plan in tokens really takes, beside what can be taken, for sources with rows."""
    report = mixing.mix_report(_mix_plan(spark, folder, by_rows=False)[1], by_rows=False).where("capacity > 0")
    return report.select("mix_id", "dataset_id", F.col("capacity").cast("long").alias("capacity_tokens"), F.col("actual").alias("actual_tokens"))


def p1_row_totals(spark: SparkSession, folder: str) -> DataFrame:
    """The drawn rows by mix and source: how many copies, and the most of one row."""
    train, plan = _mix_plan(spark, folder)
    drawn = mixing.draw(train, plan, "row_id", mixing.row_tokens(F.col("captions")), seed=42).join(train.select("row_id", "dataset_id"), "row_id")
    return drawn.groupBy("mix_id", "dataset_id").agg(F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies"))


def p1_rows(spark: SparkSession, folder: str) -> DataFrame:
    train, plan = _mix_plan(spark, folder)
    return mixing.draw(train, plan, "row_id", mixing.row_tokens(F.col("captions")), seed=42)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, folder, "precomputed"))


def p2_normalised(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.normalise(table(spark, folder, "precomputed"), "captions", ["row_id"])


def p2_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Of the normalised texts: rows, captions and null captions, which stay as many, and captions that still hold an ignorable character, a space other than U+0020 or a full-width form."""
    made = lookalike.normalise(table(spark, folder, "precomputed"), "captions", ["row_id"])
    odd = F.filter("captions", lambda c: c.rlike(r"[\p{Cf}\u00a0\u2000-\u200a\u202f\u205f\u3000\uff01-\uff5e]"))
    size = lambda c: F.coalesce(F.sum(F.when(c.isNotNull(), F.size(c))), F.lit(0)).cast("long")
    return made.agg(F.count(F.lit(1)).alias("n_rows"), size(F.col("captions")).alias("n_captions"), size(F.filter("captions", lambda c: c.isNull())).alias("n_null"), size(odd).alias("n_odd"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return formatdup.format_copies(table(spark, folder, "precomputed"))


def p4_records(spark: SparkSession, folder: str) -> DataFrame:
    return formatdup.format_groups(table(spark, folder, "precomputed")).select("first_row_id", "n_copies")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.cut_texts(table(spark, folder, "precomputed"))


def p5_rates(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.cut_rates(table(spark, folder, "precomputed"))


def p5_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Cut texts by what speaks for each first: a prefix of a known word, a broken character, a field limit, how whole sentences end."""
    found = truncation.judged(table(spark, folder, "precomputed")).where("cut")
    return found.groupBy("evidence").agg(F.count(F.lit(1)).alias("n_cut"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return language.wrong_labels(table(spark, folder, "precomputed"))


def p6_segments(spark: SparkSession, folder: str) -> DataFrame:
    return language.segment_languages(table(spark, folder, "precomputed"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.cross_split_pairs(table(spark, folder, "precomputed"))


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.overlap_report(table(spark, folder, "precomputed"))


def p7_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Per evaluation split and source: rows, and rows with the very captions of a training row, found by a plain join, that the search does not report."""
    rows = table(spark, folder, "precomputed")
    found = overlap.Overlaps(rows, "row_id", "data_split", "captions", "latents", "train").overlapping()
    whole = rows.where(F.exists("captions", lambda c: c.rlike(r"[\p{L}\p{N}]"))).select("row_id", "data_split", F.xxhash64("captions").alias("k1"), F.xxhash64(F.lit(3), "captions").alias("k2"))
    missed = whole.where("data_split <> 'train'").join(whole.where("data_split = 'train'").select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").join(found, "row_id", "left_anti")
    marked = rows.where("data_split <> 'train'").join(missed.select("row_id", F.lit(1).alias("hit")), "row_id", "left")
    return marked.groupBy("data_split", "dataset_id").agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("hit"), F.lit(0)).cast("long").alias("n_missed"))


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), table(spark, folder, "container_spec"))


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(p8_packed(spark, folder), table(spark, folder, "container_spec"))


def p8_placement(spark: SparkSession, folder: str) -> DataFrame:
    return packing.placement_report(p8_packed(spark, folder), table(spark, folder, "container_spec"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_leaks(spark, folder).select("item_id", "doc_id")


def p9_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark_items"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return reading.unlabelled_in_band(table(spark, folder, "documents"), table(spark, folder, "reading_labels"), 4)


def p10_bands(spark: SparkSession, folder: str) -> DataFrame:
    return reading.reading_bands(table(spark, folder, "documents"), table(spark, folder, "reading_labels"))


def p10_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, those with words, and those with words that have a band of the labels."""
    bands = p10_bands(spark, folder)
    return bands.agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("n_words") > 0).alias("n_with_words"), F.count_if(F.col("band").between(1, 4)).alias("n_with_band"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if re.match(r"p\d+_", name)}
