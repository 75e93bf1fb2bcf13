"""Evaluation aggregates over feature vectors, and the choice of evaluation prompts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.functions import kernels as K
from lumenloom.functions.hashing import uniform

#: The widest vectors whose third moments are summed (134 MB of numbers a task).
WIDEST = 256


#: Tasks that merge the partial sums of all others, before their few rows reach the driver one by one.
MERGERS = 8


def _sums(df: DataFrame, column: str, partial: Callable[[np.ndarray], np.ndarray]) -> tuple[int, int, np.ndarray]:
    """Rows, width and the sum of partial(vectors) over all rows whose vectors are finite. Each task sends one array, and MERGERS tasks add them up, in binary throughout."""

    def add(batches):
        n, width, total = 0, 0, None
        for batch in batches:
            rows = [r for r in batch.column(0).to_pylist() if r]
            if rows:
                x = np.array(rows, dtype=np.float64)
                x = x[np.isfinite(x).all(1)]
                for lo in range(0, len(x), 512):
                    new = partial(x[lo : lo + 512])
                    total = new if total is None else total + new
                n, width = n + len(x), x.shape[1]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([width]), pa.array([total.tobytes()], pa.large_binary())], ["n", "width", "m"])

    def merge(batches):
        n, width, total = 0, 0, None
        for batch in batches:
            for k, w, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(m)
                n, width, total = n + k, w, x.copy() if total is None else total + x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([width]), pa.array([total.tobytes()], pa.large_binary())], ["n", "width", "m"])

    ddl = "n long, width long, m binary"
    n, width, total = 0, 0, np.zeros(0)
    for r in df.select(column).mapInArrow(add, ddl).repartition(MERGERS).mapInArrow(merge, ddl).toLocalIterator():
        x = np.frombuffer(r["m"])
        n, width, total = n + r["n"], r["width"], x.copy() if not len(total) else total + x
    return n, width, total


def gaussian(df: DataFrame, column: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and (sample) covariance of a vector column. Each task sends one matrix of the vectors' width; null and non-finite vectors do not count."""
    n, d, sums = _sums(df, column, lambda x: np.concatenate([x.sum(0), (x.T @ x).ravel()]))
    if not n:
        return 0, np.zeros(0), np.zeros((0, 0))
    mean = sums[:d] / n
    return n, mean, (sums[d:].reshape(d, d) - n * np.outer(mean, mean)) / max(n - 1, 1)


def frechet_distance(a: tuple, b: tuple) -> float:
    """Between two normal distributions given as gaussian() returns them: |m1 - m2|^2 + Tr(S1 + S2 - 2 (S1 S2)^(1/2))."""
    _, m1, s1 = a
    _, m2, s2 = b
    values, vectors = np.linalg.eigh(s1)
    root = (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T
    cross = np.sqrt(np.maximum(np.linalg.eigvalsh(root @ s2 @ root), 0)).sum()
    return float(((m1 - m2) ** 2).sum() + np.trace(s1) + np.trace(s2) - 2 * cross)


def kernel_distance(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """mmd2: the unbiased squared distance of two sets under the kernel (x.y / d + 1)^3.

    The kernel's expansion makes every mean over pairs a scalar product of moment tensors of degree up to 3, so no pair is ever formed: each side is one pass
    of partial sums of width cubed. Vectors wider than WIDEST are for kernel_distance_subsets.
    """
    (n, ma, da), (m, mb, db) = _moments(a, column), _moments(b, column)
    if n < 2 or m < 2:
        return a.sparkSession.createDataFrame([(None,)], "mmd2 double")
    k = lambda x, y: sum(c * float((x[j] * y[j]).sum()) for j, c in enumerate((1.0, 3.0, 3.0, 1.0)))
    value = (k(ma, ma) - da) / (n * (n - 1)) + (k(mb, mb) - db) / (m * (m - 1)) - 2 * k(ma, mb) / (n * m)
    return a.sparkSession.createDataFrame([(value,)], "mmd2 double")


def _moments(df: DataFrame, column: str) -> tuple[int, list[np.ndarray], float]:
    """Rows, sums of the tensor powers 0 to 3 of x / sqrt(d), and the sum of k(x, x)."""

    def partial(x: np.ndarray) -> np.ndarray:
        d = x.shape[1]
        if d > WIDEST:
            raise ValueError(f"vectors of {d} values are too wide for moments; use kernel_distance_subsets")
        y = x / np.sqrt(d)
        squares = (y[:, :, None] * y[:, None, :]).reshape(len(y), -1)
        return np.concatenate([[(((y * y).sum(1) + 1) ** 3).sum()], y.sum(0), squares.sum(0), (squares.T @ y).ravel()])

    n, d, sums = _sums(df, column, partial)
    if not n:
        return 0, [], 0.0
    return n, [np.array([float(n)]), sums[1 : 1 + d], sums[1 + d : 1 + d + d * d], sums[1 + d + d * d :]], float(sums[0])


def _below(cut: Column) -> Callable[[Column], Column]:
    return lambda x: x["u"] <= cut


def kernel_distance_subsets(a: DataFrame, b: DataFrame, key: str, column: str, size: int = 50, subsets: int = 100, seed: int = 42) -> DataFrame:
    """mean, std (of all subsets), size: the unbiased squared distance under (x.y / d + 1)^3 over subsets of both sides, as large as the smaller side allows.

    A subset takes the rows of a side with the smallest uniform numbers of key and subset. Numbers above a cut that leaves far more than enough are never sent,
    so little is shuffled, and a subset that should still be short is an error, not a smaller one. Null and non-finite vectors do not count. Fewer than two rows on a side give nulls.
    """
    usable = [x.where(F.col(key).isNotNull() & F.col(column).isNotNull() & K.finite(F.col(column))).select(F.col(key).alias("k"), F.col(column).cast("array<double>").alias("v")) for x in (a, b)]
    counts = [x.count() for x in usable]
    take = min(size, *counts)
    schema = "mean double, std double, size int"
    if take < 2:
        return a.sparkSession.createDataFrame([(None, None, take)], schema)
    parts = []
    for side, (df, n) in enumerate(zip(usable, counts, strict=True)):
        cut = F.lit(min(1.0, (3 * take + 60) / n))
        drawn = F.transform(F.sequence(F.lit(0), F.lit(subsets - 1)), lambda i: F.struct(i.alias("subset"), uniform(F.concat_ws(":", F.col("k").cast("string"), i.cast("string")), seed).alias("u")))
        rows = df.select("k", "v", F.explode(F.filter(drawn, _below(cut))).alias("x")).select(F.lit(side).alias("side"), "x.subset", "x.u", "k", "v")
        parts.append(rows.withColumn("_r", F.row_number().over(Window.partitionBy("subset").orderBy("u", "k"))).where(F.col("_r") <= take).drop("_r"))

    def distance(part: pd.DataFrame) -> pd.DataFrame:
        x, y = (np.array(part.loc[part["side"] == s, "v"].tolist(), dtype=np.float64) for s in (0, 1))
        if len(x) < take or len(y) < take:
            raise ValueError("a subset is short")
        k = lambda p, q: (p @ q.T / p.shape[1] + 1) ** 3
        off = lambda m: (m.sum() - np.trace(m)) / (take * (take - 1))
        return pd.DataFrame({"mmd2": [off(k(x, x)) + off(k(y, y)) - 2 * k(x, y).mean()]})

    each = parts[0].unionByName(parts[1]).groupBy("subset").applyInPandas(distance, "mmd2 double")
    return each.agg(F.avg("mmd2").alias("mean"), F.stddev_pop("mmd2").alias("std"), F.lit(take).alias("size"))


def mean_similarity(df: DataFrame, a: str, b: str) -> DataFrame:
    """score: 100 times the mean cosine of two vector columns, at least 0."""
    return df.agg(F.greatest(F.avg(100.0 * K.cosine(F.col(a), F.col(b))), F.lit(0.0)).alias("score"))


def mean_absolute_difference(df: DataFrame, a: str, b: str) -> DataFrame:
    """difference: the mean of |a - b| over all elements of all rows."""
    gap = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return df.agg((F.sum(K.total(gap)) / F.sum(F.size(gap))).alias("difference"))


def limited(df: DataFrame, key: str, *limits: int) -> DataFrame:
    """The first rows in the order of a key, as many as the smallest of the limits (or the table) allows."""
    return df.orderBy(key).limit(min(limits))


def rotating_window(step: int, rows: int, n: int) -> tuple[int, int]:
    """[begin, end) of the n rows that are evaluated at a step; all rows where there are no more than n."""
    if rows <= n:
        return 0, rows
    end = step % (rows - n) + n
    return end - n, end


def contiguous_chunk(place: Column, size: Column, parts: int) -> Column:
    """Which of parts contiguous chunks, of ceil(size / parts) rows each, a place falls into; the last ones may be short or empty."""
    return F.floor(place / F.ceil(size / F.lit(parts)))


def is_spaced(place: Column, n: Column, k: int) -> Column:
    """Whether a place from 0 is one of k that are evenly spaced over n places from the first to the last; all are if there are fewer than k."""
    chosen = F.exists(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (n - 1) / F.lit(max(k - 1, 1))) == place)
    return F.when(n < k, F.lit(True)).otherwise(chosen)


def spaced_steps(n: int, k: int) -> list[int]:
    """k of n steps, evenly spaced from the first to the last; all if there are fewer."""
    if n < k:
        return list(range(n))
    return [int(i * (n - 1) / (k - 1)) for i in range(k)] if k > 1 else [0]


def first_per_group(df: DataFrame, group: str, order: str, n: int = 4) -> DataFrame:
    """The first n rows of each group: ranked within slices first, so that only n rows per group and slice meet in a task."""
    slim = df.withColumn("_slice", F.pmod(F.xxhash64(order), F.lit(64)))
    some = slim.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_slice").orderBy(order))).where(F.col("_r") <= n)
    return some.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_r") <= n).drop("_r", "_slice")
