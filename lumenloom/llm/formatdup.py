"""Records that are the same but for formatting: white space, letter case, punctuation, field order (problem 4).

The list column is dictionary-encoded. Each distinct value is brought to its canonical form once: its letters, combining
marks and digits in lower case, in order. The form gets an integer identifier of 128 bits, two hashes of it under seeds of their own, which
needs no coordination and stays the same when a lost task runs again. Records become sorted tuples of (identifier, identifier), and
the tuples are grouped; the texts themselves are shuffled only once, for the distinct values.

Null and empty captions, and captions without a letter, mark or digit, do not count. Records without any caption left form
no group. Null ids take no part; ids are unique, so rows that share one are taken for one record with all their values. Very long texts need no special path, as only identifiers travel after the dictionary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.operators.skew import join_hot_keys_apart
from lumenloom.session import cut_lineage


def canonical(text: Column) -> Column:
    """Letters, marks and digits of a text, each in its lower case; capital sigma by itself, as its lower case depends on its place."""
    return F.regexp_replace(F.lower(F.replace(text, F.lit("Σ"), F.lit("σ"))), r"[^\p{L}\p{M}\p{N}]+", "")


def _pair(value: Column, names: tuple[str, str]) -> list[Column]:
    """Two hashes of a value. The seed comes first: hashed after the value it would make the second number a function of the first."""
    return [F.xxhash64(value).alias(names[0]), F.xxhash64(F.lit(11), value).alias(names[1])]


def dictionary(occurrences: DataFrame, value: str) -> DataFrame:
    """v1, v2, n, c1, c2: for each distinct value its key, number of occurrences and the identifier of its canonical form."""
    distinct = occurrences.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    form = distinct.select(*_pair(F.col(value), ("v1", "v2")), "n", canonical(F.col(value)).alias("form"))
    return form.where("form <> ''").select("v1", "v2", "n", *_pair(F.col("form"), ("c1", "c2")))


def encoded_records(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """<id>, g1, g2: each record with the identifier of its sorted tuple of canonical values; records without a value are left out."""
    occurrences = df.where(F.col(id_col).isNotNull()).select(F.col(id_col), F.explode(column).alias("value")).where("value is not null")
    codes = occurrences.select(id_col, *_pair(F.col("value"), ("v1", "v2")))
    known = join_hot_keys_apart(codes, dictionary(occurrences, "value"), ["v1", "v2"], "n")
    tuples = known.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("c1", "c2"))).alias("t"))
    return tuples.select(id_col, *_pair(F.col("t"), ("g1", "g2")))


def format_groups(df: DataFrame, id_col: str = "row_id", column: str = "captions") -> DataFrame:
    """g1, g2, first_<id>, n_copies: one record for each group of records that differ in formatting only."""
    return encoded_records(df, id_col, column).groupBy("g1", "g2").agg(F.min(id_col).alias(f"first_{id_col}"), F.count(F.lit(1)).alias("n_copies"))


def format_copies(df: DataFrame, id_col: str = "row_id", column: str = "captions") -> DataFrame:
    """first_<id>, <id>: each record that repeats an earlier one, with the smallest id of its group."""
    records = cut_lineage(encoded_records(df, id_col, column))  # three numbers a record, used twice
    groups = records.groupBy("g1", "g2").agg(F.min(id_col).alias(f"first_{id_col}"), F.count(F.lit(1)).alias("n_copies")).where("n_copies > 1")
    return join_hot_keys_apart(records, groups, ["g1", "g2"], "n_copies").where(F.col(id_col) > F.col(f"first_{id_col}")).select(f"first_{id_col}", id_col)
