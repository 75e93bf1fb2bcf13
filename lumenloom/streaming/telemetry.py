"""Telemetry of training runs, over tables and over streams."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from lumenloom.operators.algebra import place_in_group, with_position


def interval_counts(log: DataFrame, interval: int, step: str = "train_step", source: str = "dataset_id", run: str = "run_name", n: str = "n_samples") -> DataFrame:
    """run, interval_no, source, n_samples and ratio to all sources of the interval. Works on batch tables; on streams use interval_counts_stream."""
    counts = log.groupBy(run, F.floor(F.col(step) / F.lit(interval)).alias("interval_no"), source).agg(F.sum(n).alias("n_samples"))
    totals = counts.groupBy(run, "interval_no").agg(F.sum("n_samples").alias("_all"))
    return counts.join(totals, [run, "interval_no"]).select(run, "interval_no", source, "n_samples", F.try_divide("n_samples", "_all").alias("ratio"))


def once(log: DataFrame, keys: list[str]) -> DataFrame:
    """Lines logged twice under another id count once."""
    return log.dropDuplicates(keys)


def interval_counts_stream(log: DataFrame, interval: int, step: str = "train_step", source: str = "dataset_id", run: str = "run_name", n: str = "n_samples") -> DataFrame:
    """The counts of interval_counts as a streaming aggregate (update or complete mode): tumbling windows on the step axis."""
    return log.groupBy(run, F.floor(F.col(step) / F.lit(interval)).alias("interval_no"), source).agg(F.sum(n).alias("n_samples"))


def windowed_counts_stream(log: DataFrame, window: str = "1 hour", late: str = "6 hours", at: str = "logged_at", source: str = "dataset_id", n: str = "n_samples") -> DataFrame:
    """Counts per window of event time and source, in append mode once a window is later than the watermark allows."""
    return log.withWatermark(at, late).groupBy(F.window(at, window), source).agg(F.sum(n).alias("n_samples"), F.count(F.lit(1)).alias("n_lines"))


def running_average(log: DataFrame, decay: float, step: str = "train_step", value: str = "loss", run: str = "run_name") -> DataFrame:
    """run, step, value, ema: e = decay e + (1 - decay) v in the order of steps, beginning with the first value.

    Lines of one step are averaged first; null and NaN values and null steps are left out. The steps of a run are cut into blocks of bounded length. Within a block the
    average is a running sum of values over powers of decay; what a block passes on is worked out over one number per block, so even a single long run is spread over tasks.
    """
    if not 0 < decay < 1:
        raise ValueError("decay must be between 0 and 1")
    size = max(1, min(1024, int(-250 / math.log10(decay))))
    usable = log.where(F.col(value).isNotNull() & ~F.isnan(value) & F.col(step).isNotNull())
    steps = usable.groupBy(run, step).agg(F.avg(value).alias(value))
    placed = place_in_group(with_position(steps, step), [run], "pos", "place")
    spots = placed.select(run, step, value, F.floor(F.col("place") / size).alias("block"), (F.col("place") % size).cast("double").alias("j"))
    d = F.lit(float(decay))
    inside = Window.partitionBy(run, "block").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    summed = spots.withColumn("own", (1 - d) * F.pow(d, "j") * F.sum(F.col(value) * F.pow(d, -F.col("j"))).over(inside))
    blocks = summed.groupBy(run, "block").agg(F.max_by("own", "j").alias("own"), (F.max("j") + 1).alias("n"), F.min_by(value, "j").alias("first"))
    run_type = log.schema[run].dataType.simpleString()

    def pass_on(part: pd.DataFrame) -> pd.DataFrame:
        # one row per block of steps, so in one pass whatever their number
        rows = part.sort_values("block")
        carry, out = rows["first"].iloc[0], []
        for own, n in zip(rows["own"], rows["n"], strict=True):
            out.append(carry)
            carry = decay**n * carry + own
        return rows[[run, "block"]].assign(carry=out)

    carries = blocks.groupBy(run).applyInPandas(pass_on, f"{run} {run_type}, block long, carry double")
    joined = summed.join(carries, [run, "block"])
    return joined.select(run, step, value, (F.pow(d, F.col("j") + 1) * F.col("carry") + F.col("own")).alias("ema"))


def running_average_stream(log: DataFrame, decay: float, value: str = "loss", step: str = "train_step", run: str = "run_name") -> DataFrame:
    """run, step, ema, late as a stateful stream: an average and its last step are the state of a run.

    Steps of a batch are taken in their order. A step that is not behind the last one taken comes too late: it changes nothing and is returned with late, and the average as it stands.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ema, last = state.get if state.exists else (None, None)
        rows = pd.concat(list(parts)).dropna(subset=[value, step]).groupby(step, as_index=False)[value].mean().sort_values(step)
        out = []
        for s, v in zip(rows[step], rows[value], strict=True):
            late = last is not None and s <= last
            if not late:
                ema, last = v if ema is None else decay * ema + (1 - decay) * v, int(s)
            out.append((key[0], s, ema, late))
        if ema is not None:
            state.update((float(ema), last))
        yield pd.DataFrame(out, columns=[run, step, "ema", "late"])

    return log.groupBy(run).applyInPandasWithState(update, f"{run} string, {step} long, ema double, late boolean", "ema double, last long", "append", GroupStateTimeout.NoTimeout)


def keep_latest(counted: DataFrame, folder: str, every: str | None = None) -> StreamingQuery:
    """Start a streaming aggregate (update mode) that writes what each batch changed to folder/changes, and its progress to folder/checkpoint; started again on the same folder it goes on where it stopped.

    A batch is a partition of its own, written anew if it is repeated, so nothing counts twice. every names an interval ('10 seconds'); without it, all there is now is read.
    """

    def write(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    writer = counted.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def latest(spark: SparkSession, folder: str, keys: list[str], schema: StructType) -> DataFrame:
    """What keep_latest has written so far: for each key the row of the last batch that changed it."""
    changes = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(f"{folder}/changes")
    values = [c for c in schema.names if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_row")).select(*keys, "_row.*")


def on_interval(stream: DataFrame, action: Callable[[DataFrame, int], None], folder: str, every: str | None = None) -> StreamingQuery:
    """Start an action on each batch of a stream, at an interval or once for all there is; resumable from folder/checkpoint."""
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(action)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
