"""Table sources."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table of that name in a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dataset(spark: SparkSession, name: str, catalogue: dict[str, str] | None = None) -> DataFrame:
    """A dataset by path; if nothing is there, by its name in a catalogue of paths."""
    try:
        return spark.read.parquet(name)
    except AnalysisException:
        if catalogue and name in catalogue:
            return spark.read.parquet(catalogue[name])
        raise


def split_head(df: DataFrame, key: str, spec: str) -> DataFrame:
    """'split[:N]': the first N rows in the order of a key; without brackets all rows."""
    if "[:" not in spec:
        return df
    return df.orderBy(key).limit(int(spec.split("[:", 1)[1].rstrip("]")))


def discover(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path, length of the files of a folder that match a pattern, in the order of their paths."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length").orderBy("path")


def json_argument(text: str) -> dict[str, Any]:
    """A JSON object given as an argument."""
    value = json.loads(text)
    if not isinstance(value, dict):
        raise ValueError("a JSON object is expected")
    return value


def field_list(fields: list[str]) -> list[str]:
    """Names, each argument of which may hold several with commas between."""
    return [name.strip() for argument in fields for name in argument.split(",") if name.strip()]


def channel_constants(config: dict[str, Any], channels: int = 16) -> tuple[list[float], list[float]]:
    """Means and deviations of latent channels from a model's configuration; 0 and 1 where it has none."""
    return list(config.get("latents_mean") or [0.0] * channels), list(config.get("latents_std") or [1.0] * channels)


def fetched(df: DataFrame, url: str, fetch: Callable[[str], bytes | None], decode: Callable[[bytes], tuple[int, int]] | None = None, seconds: float = 18.0, workers: int = 50, chunk: int = 200) -> DataFrame:
    """df with content, status (ok, timeout, error, invalid) and, from decode, decoded_width and decoded_height. A failure is a status, not an error.

    Up to `workers` fetches run at once in a task; one that raises TimeoutError, or takes longer than `seconds` from when it is waited for, is timeout, any other
    exception error; no content, or content that decode cannot read, is invalid. Nulls are invalid. No more than `chunk` contents are held at a time.
    """
    from pyspark.sql import types as T

    added = [("content", T.BinaryType()), ("status", T.StringType()), ("decoded_width", T.IntegerType()), ("decoded_height", T.IntegerType())]
    names = {n for n, _ in added}
    schema = T.StructType([f for f in df.schema.fields if f.name not in names] + [T.StructField(n, t) for n, t in added])

    def outcome(future: Future) -> tuple[bytes | None, str, int | None, int | None]:
        try:
            content = future.result(timeout=seconds)
        except TimeoutError:
            return None, "timeout", None, None
        except Exception:  # noqa: BLE001
            return None, "error", None, None
        if content is None:
            return None, "invalid", None, None
        try:
            width, height = decode(content) if decode else (None, None)
        except Exception:  # noqa: BLE001
            return None, "invalid", None, None
        return content, "ok", width, height

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = ThreadPoolExecutor(max_workers=workers)
        try:
            for whole in parts:
                for lo in range(0, len(whole), chunk):
                    part = whole.iloc[lo : lo + chunk]
                    futures = [pool.submit(fetch, u) if isinstance(u, str) else None for u in part[url]]
                    got = [outcome(f) if f else (None, "invalid", None, None) for f in futures]
                    columns = {n: pd.Series([g[k] for g in got], index=part.index, dtype="Int32" if k > 1 else object) for k, (n, _) in enumerate(added)}
                    yield part.assign(**columns)[schema.names]
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    return df.mapInPandas(run, schema)


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The work that has no result yet."""
    return work.join(done.select(key).where(F.col(key).isNotNull()), key, "left_anti")
