"""The predicates of dataset preparation, with the first reason for which a record is dropped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenloom.functions.hashing import uniform
from lumenloom.functions.text import token_estimate


def first_column(df: DataFrame, names: list[str], default: Column) -> Column:
    """The first of the named columns that exists; nulls in it do not fall back to the next. Settled when the plan is made."""
    return next((F.col(n) for n in names if n in df.columns), default)


def language_drop(label: Column, key: Column, probability: float, wanted: str = "zh", seed: int = 42) -> Column:
    """Records of another language, each with a probability; records without a label stay."""
    if probability <= 0:
        return F.lit(False)
    return F.coalesce(label.isNotNull() & (label != wanted) & (uniform(key, seed) < probability), F.lit(False))


def resolution_drop(width: Column, height: Column, bucket: Column, tolerance: float = 1.0) -> Column:
    """Records smaller than their bucket; sizes that are null or 1 and less say nothing."""
    known = (width > 1) & (height > 1)
    return F.coalesce(known & ((width < bucket["width"] * tolerance) | (height < bucket["height"] * tolerance)), F.lit(False))


def too_short(captions: Column, least: int = 1) -> Column:
    """Records without a caption of more than least tokens."""
    return F.coalesce(~F.exists(captions, lambda c: token_estimate(c) > least), F.lit(True))


def too_long(captions: Column, most: int = 1024) -> Column:
    """Records with any caption of more than most tokens."""
    return F.coalesce(F.exists(captions, lambda c: token_estimate(c) > most), F.lit(False))


def score_drop(score: Column, least: float = 0.0) -> Column:
    """Scores below the least; null and NaN stay."""
    return F.coalesce((score < least) & ~F.isnan(score), F.lit(False))


def watermark_drop(df: DataFrame, name: str, most: float = 0.6) -> Column:
    """Boolean marks count if the limit is below 1; probabilities if above the limit; null and NaN stay."""
    mark = F.col(name)
    if isinstance(df.schema[name].dataType, T.BooleanType):
        return F.coalesce(mark & F.lit(most < 1.0), F.lit(False))
    return F.coalesce((mark > most) & ~F.isnan(mark.cast("double")), F.lit(False))


def drop_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, else null."""
    out = None
    for name, rule in rules:
        out = F.when(rule, name) if out is None else out.when(rule, name)
    return out if out is not None else F.lit(None).cast("string")


def drop_report(df: DataFrame, reason: str = "drop_reason", by: Sequence[str] = ()) -> DataFrame:
    """reason, n_rows: how many records each rule dropped; kept ones under 'kept'. With by, for each batch."""
    return df.groupBy(*by, F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))
