"""Dataset profiles: required columns, distributions and statistics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.functions import kernels as K
from lumenloom.session import cut_lineage


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def distribution(df: DataFrame, key: str) -> DataFrame:
    """key, n_rows, percent of all rows."""
    counts = cut_lineage(df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")))  # a row per key, used twice
    return counts.select(key, "n_rows", (F.col("n_rows") * 100.0 / counts.agg(F.sum("n_rows")).scalar()).alias("percent"))


def list_sizes(df: DataFrame, column: str) -> DataFrame:
    """Mean, smallest and largest length of a list column; null lists do not count."""
    n = F.when(F.col(column).isNotNull(), F.size(column))
    return df.agg(F.avg(n).alias("mean_size"), F.min(n).alias("least"), F.max(n).alias("most"))


_PARTIAL = "channel int, n long, s double, ss double, least double, most double, nans long, infs long"


def _partials(df: DataFrame, column: str, size: int | None, means: Sequence[float], stds: Sequence[float]) -> DataFrame:
    """Sums per channel (of size values each; one channel for all without size) from each task, so that no value is ever a row."""

    def add(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            values = batch.column(0)
            sizes = np.where(values.is_null(), 0, np.diff(values.offsets.to_numpy()))
            flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            channel = place // size if size else np.zeros(len(flat), dtype=np.int64)
            if len(means):
                flat = (flat - np.array(means)[channel]) / np.array(stds)[channel]
            nan, inf = np.isnan(flat), np.isinf(flat)
            good = ~nan & ~inf
            z = np.where(good, flat, 0)
            for c in np.unique(channel):
                here = channel == c
                ok = here & good
                new = np.array([ok.sum(), z[here].sum(), (z[here] ** 2).sum(), flat[ok].min() if ok.any() else np.inf, flat[ok].max() if ok.any() else -np.inf, nan[here].sum(), inf[here].sum()], dtype=np.float64)
                old = found.get(int(c))
                found[int(c)] = new if old is None else np.concatenate([old[:3] + new[:3], [min(old[3], new[3]), max(old[4], new[4])], old[5:] + new[5:]])
        if found:
            rows = np.stack(list(found.values()))
            whole = [pa.array(rows[:, k].astype(np.int64)) if k in (0, 5, 6) else pa.array(rows[:, k]) for k in range(7)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(list(found), dtype=np.int32)), *whole], ["channel", "n", "s", "ss", "least", "most", "nans", "infs"])

    return df.select(column).mapInArrow(add, _PARTIAL)


def _spread(n: Column, s: Column, ss: Column) -> Column:
    return F.when(n > 1, F.sqrt(F.greatest(ss - s * s / n, F.lit(0.0)) / (n - 1)))


def value_statistics(df: DataFrame, column: str) -> DataFrame:
    """n, least, most, mean, std (of a sample) of all finite values of an array column, and whether any value is NaN or infinite. Null values count as NaN."""
    n, s, ss = F.coalesce(F.sum("n"), F.lit(0)), F.sum("s"), F.sum("ss")
    return _partials(df, column, None, [], []).agg(
        n.alias("n"), F.when(n > 0, F.min("least")).alias("least"), F.when(n > 0, F.max("most")).alias("most"), F.try_divide(s, n).alias("mean"), _spread(n, s, ss).alias("std"),
        F.coalesce(F.sum("nans") > 0, F.lit(False)).alias("has_nan"), F.coalesce(F.sum("infs") > 0, F.lit(False)).alias("has_inf"),
    )


def channel_statistics(df: DataFrame, column: str, size: int, means: Sequence[float] = (), stds: Sequence[float] = ()) -> DataFrame:
    """channel, mean, std of finite values, for channels of size values each; with means and stds, of values scaled by those of their channel."""
    n, s, ss = F.sum("n"), F.sum("s"), F.sum("ss")
    return _partials(df, column, size, means, stds).groupBy("channel").agg(n.alias("n"), F.try_divide(s, n).alias("mean"), _spread(n, s, ss).alias("std")).where("n > 0").drop("n")


def all_finite(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.coalesce(K.finite(F.col(column)), F.lit(False)))
