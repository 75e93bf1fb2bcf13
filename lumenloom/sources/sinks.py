"""Sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame


def save(df: DataFrame, path: str, by: str | None = None) -> None:
    """Write a dataset as Parquet; by names a column to partition the files by."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def save_metrics(df: DataFrame, path: str) -> None:
    """Write a small table of metrics as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def isolated(items: Iterable[str], work: Callable[[str], object], at_once: int = 4) -> list[tuple[str, object | None, str | None]]:
    """(item, result, error) of each item, in their order; an item that fails does not stop the others. Items are whole jobs, of which at_once run side by side."""

    def run(item: str) -> tuple[str, object | None, str | None]:
        try:
            return item, work(item), None
        except Exception as e:  # noqa: BLE001
            return item, None, f"{type(e).__name__}: {e}"

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        return list(pool.map(run, items))
