"""Queries on sources and sinks: what is written or parsed is read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.operators import buckets
from lumenloom.plans.catalogue import query
from lumenloom.session import shared_folder
from lumenloom.sources import readers, sinks
from lumenloom.sources.readers import table


def _place(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/written/{uuid.uuid4().hex}"


@query("SELECT data_split, count(*) AS n_rows FROM precomputed GROUP BY 1")
def named_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """A dataset that is no path, found by its name in a catalogue."""
    found = readers.dataset(spark, "records-of-the-gallery", {"records-of-the-gallery": f"{folder}/precomputed.parquet"})
    return found.groupBy("data_split").agg(F.count(F.lit(1)).alias("n_rows"))


@query("SELECT data_split, count(*) AS n_rows, sum(row_id)::BIGINT AS id_sum, sum(len(captions))::BIGINT AS n_captions FROM precomputed GROUP BY 1")
def saved_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """The records, written with a folder for each split, and read again."""
    path = _place(spark)
    sinks.save(table(spark, folder, "precomputed").select("row_id", "data_split", "captions"), path, by="data_split")
    back = spark.read.parquet(path)
    return back.groupBy("data_split").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("row_id").alias("id_sum"), F.sum(F.when(F.col("captions").isNotNull(), F.size("captions"))).cast("long").alias("n_captions"))


@query("SELECT run_name, count(*) AS n_lines, sum(n_samples)::BIGINT AS n_samples FROM train_telemetry GROUP BY 1")
def saved_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of each run, written as JSON and read again."""
    path = _place(spark)
    sinks.save_metrics(table(spark, folder, "train_telemetry").groupBy("run_name").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("n_samples").alias("n_samples")), path)
    return spark.read.schema("run_name string, n_lines long, n_samples long").json(path)


@query("SELECT mix_id, 2 * count(*) AS n_lines FROM dataset_entry GROUP BY 1")
def appended_log(spark: SparkSession, folder: str) -> DataFrame:
    path, lines = _place(spark), table(spark, folder, "dataset_entry").select("mix_id", "dataset_id")
    for _ in range(2):
        sinks.append_log(lines, path)
    return spark.read.parquet(path).groupBy("mix_id").agg(F.count(F.lit(1)).alias("n_lines"))


@query("""SELECT t AS item, n AS n_rows, NULL::VARCHAR AS error FROM (SELECT 'mix_run' AS t, (SELECT count(*) FROM mix_run) AS n UNION ALL SELECT 'container_spec', (SELECT count(*) FROM container_spec))
UNION ALL SELECT 'no_such_table', NULL, 'AnalysisException'""")
def isolated_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of tables, one of which does not exist and does not stop the others."""
    done = sinks.isolated(["mix_run", "no_such_table", "container_spec"], lambda name: table(spark, folder, name).count())
    return spark.createDataFrame([(item, n, error.split(":")[0] if error else None) for item, n, error in done], "item string, n_rows long, error string")


@query("""SELECT * FROM (VALUES ('sizes', 1, 256, 256), ('sizes', 2, 336, 192), ('pairs', 11, 512, 512), ('pairs', 12, 640, 384), ('list', 1, 3, 4), ('list', 3, 5, 6)) AS t(kind, id, width, height)""")
def parsed_sizes(spark: SparkSession, folder: str) -> DataFrame:
    made = {"sizes": buckets.parse_sizes("256x256, 336X192"), "pairs": buckets.parse_pairs("512,512 640,384", 10), "list": buckets.parse_pairs("[(3, 4), 9, [5, 6]]")}
    return spark.createDataFrame([(kind, i, w, h) for kind, found in made.items() for i, (w, h) in found.items()], "kind string, id int, width int, height int")


@query("""SELECT * FROM (VALUES ('field', 'caption_text', NULL), ('field', 'human_caption_hq', NULL), ('field', 'artist', NULL), ('argument', 'steps', 50.0::DOUBLE), ('argument', 'scale', 4.5), ('mean', '0', 0.5), ('mean', '1', -0.5), ('std', '0', 1.0), ('std', '1', 1.0)) AS t(kind, name, value)""")
def parsed_arguments(spark: SparkSession, folder: str) -> DataFrame:
    """Field lists, a JSON argument and channel constants of a configuration that has only means."""
    means, stds = readers.channel_constants({"latents_mean": [0.5, -0.5]}, 2)
    rows = [("field", name, None) for name in readers.field_list(["caption_text, human_caption_hq", "artist"])]
    rows += [("argument", name, float(value)) for name, value in readers.json_argument('{"steps": 50, "scale": 4.5}').items()]
    rows += [(kind, str(k), v) for kind, values in (("mean", means), ("std", stds)) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "kind string, name string, value double")


@query("SELECT resolution_bucket_id, width AS raw_width FROM resolution_bucket WHERE width IS NOT NULL")
def discovered_files(spark: SparkSession, folder: str) -> DataFrame:
    """A table read from the files that a pattern finds, in the order of their paths."""
    path = _place(spark)
    sinks.save(table(spark, folder, "resolution_bucket").repartition(3), path)
    files = [r["path"] for r in readers.discover(spark, path, "part-*.parquet").collect()]  # a handful of names
    return spark.read.parquet(*files).where("width is not null").select("resolution_bucket_id", F.col("width").alias("raw_width"))
