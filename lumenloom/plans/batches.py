"""Queries on shards, batches, schedules and telemetry."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.functions import kernels as K
from lumenloom.functions import text as T
from lumenloom.functions.hashing import uniform
from lumenloom.operators import algebra, batching
from lumenloom.plans.catalogue import query
from lumenloom.plans.curation import TOKENS, U
from lumenloom.session import shared_folder, written
from lumenloom.sources.readers import table
from lumenloom.streaming import telemetry

REPLICAS, SIZE = 2, 8
_POS = "p AS (SELECT row_id, dataset_id, resolution_bucket_id, latents, (row_number() OVER (ORDER BY row_id) - 1)::BIGINT AS pos FROM precomputed)"
_PLACED = "b AS (SELECT *, pos % 2 AS rank, row_number() OVER (PARTITION BY pos % 2, {0} ORDER BY pos) - 1 AS place, count(*) OVER (PARTITION BY pos % 2, {0}) AS n FROM p)"


def _positioned(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return algebra.with_position(table(spark, folder, "precomputed").select("row_id", *columns), "row_id")


@query(f"WITH {_POS} SELECT row_id, pos, (pos % 4)::BIGINT AS rank FROM p")
def rank_shard(spark: SparkSession, folder: str) -> DataFrame:
    df = _positioned(spark, folder)
    return df.select("row_id", "pos", batching.rank_of(F.col("pos"), 4).alias("rank"))


def _ranked(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Positions and the rank that takes each; every rank's rows are batched and counted, each by itself."""
    return _positioned(spark, folder, *columns).withColumn("rank", batching.rank_of(F.col("pos"), REPLICAS))


@query(f"WITH {_POS}, {_PLACED.format('resolution_bucket_id')} SELECT row_id, rank, resolution_bucket_id, (place // 8)::BIGINT AS batch_no FROM b WHERE (place // 8 + 1) * 8 <= n")
def bucket_batches(spark: SparkSession, folder: str) -> DataFrame:
    return batching.batches(_ranked(spark, folder, "resolution_bucket_id"), ["rank", "resolution_bucket_id"], "pos", SIZE).select("row_id", "rank", "resolution_bucket_id", "batch_no")


@query(f"WITH {_POS}, {_PLACED.format('dataset_id, resolution_bucket_id')} SELECT row_id, rank, dataset_id, resolution_bucket_id, (place // 8)::BIGINT AS batch_no FROM b WHERE (place // 8 + 1) * 8 <= n")
def source_batches(spark: SparkSession, folder: str) -> DataFrame:
    made = batching.batches(_ranked(spark, folder, "dataset_id", "resolution_bucket_id"), ["rank", "dataset_id", "resolution_bucket_id"], "pos", SIZE)
    return made.select("row_id", "rank", "dataset_id", "resolution_bucket_id", "batch_no")


@query(f"WITH {_POS} SELECT rank, sum(n)::BIGINT AS n_batches FROM (SELECT pos % 2 AS rank, count(*) // 8 AS n FROM p GROUP BY pos % 2, resolution_bucket_id) GROUP BY 1")
def epoch_len_simple(spark: SparkSession, folder: str) -> DataFrame:
    return batching.epoch_length(_ranked(spark, folder, "resolution_bucket_id"), ["resolution_bucket_id"], SIZE, by=["rank"])


@query(f"WITH {_POS} SELECT rank, sum(n)::BIGINT AS n_batches FROM (SELECT pos % 2 AS rank, count(*) // 8 AS n FROM p GROUP BY pos % 2, dataset_id, resolution_bucket_id) GROUP BY 1")
def epoch_len_weighted(spark: SparkSession, folder: str) -> DataFrame:
    return batching.epoch_length(_ranked(spark, folder, "dataset_id", "resolution_bucket_id"), ["dataset_id", "resolution_bucket_id"], SIZE, by=["rank"])


@query(f"""WITH {_POS}, {_PLACED.format('resolution_bucket_id')} SELECT rank, resolution_bucket_id, (place // 8)::BIGINT AS batch_no, count(*) AS n_rows, array_to_string(list(row_id ORDER BY pos), ',') AS row_ids
FROM b WHERE (place // 8 + 1) * 8 <= n AND latents IS NOT NULL GROUP BY 1, 2, 3""")
def collate_batches(spark: SparkSession, folder: str) -> DataFrame:
    made = batching.batches(_ranked(spark, folder, "resolution_bucket_id", "latents"), ["rank", "resolution_bucket_id"], "pos", SIZE).where("latents is not null")
    rows = batching.collate(made, ["rank", "resolution_bucket_id", "batch_no"], "pos", ["latents", "row_id"])
    return rows.select("rank", "resolution_bucket_id", "batch_no", F.size("rows").cast("long").alias("n_rows"), F.array_join(F.transform("rows", lambda r: r["row_id"].cast("string")), ",").alias("row_ids"))


@query(f"""WITH {_POS}, g AS (SELECT dataset_id, pos, (row_number() OVER (PARTITION BY dataset_id ORDER BY pos) - 1) // 1024 AS part_no FROM p)
SELECT dataset_id, part_no::BIGINT AS part_no, count(*) AS n, min(pos) AS first, max(pos) AS last, md5(array_to_string(list(pos ORDER BY pos), ',')) AS positions FROM g GROUP BY 1, 2""")
def group_index_lists(spark: SparkSession, folder: str) -> DataFrame:
    """The positions of each source, in lists of 1024."""
    parts = batching.index_lists(_positioned(spark, folder, "dataset_id"), "dataset_id", "pos")
    joined = F.md5(F.array_join(F.transform("positions", lambda p: p.cast("string")), ","))
    return parts.select("dataset_id", "part_no", F.size("positions").cast("long").alias("n"), F.array_min("positions").alias("first"), F.array_max("positions").alias("last"), joined.alias("positions"))


_EPOCH = f"""s AS (SELECT epoch, row_id, resolution_bucket_id, row_number() OVER (PARTITION BY epoch, resolution_bucket_id ORDER BY u, row_id) - 1 AS place, count(*) OVER (PARTITION BY epoch, resolution_bucket_id) AS n
  FROM (SELECT 0 AS epoch, {U.format('row_id', '42:0')} AS u, row_id, resolution_bucket_id FROM precomputed UNION ALL SELECT 1, {U.format('row_id', '42:1')}, row_id, resolution_bucket_id FROM precomputed)),
b AS (SELECT epoch, row_id, resolution_bucket_id, (place // 8)::BIGINT AS batch_no FROM s WHERE (place // 8 + 1) * 8 <= n)"""


@query(f"WITH {_EPOCH} SELECT epoch, row_id, resolution_bucket_id, batch_no FROM b")
def epoch_batches(spark: SparkSession, folder: str) -> DataFrame:
    """The batches of two epochs, each shuffled in its own way."""
    rows = table(spark, folder, "precomputed").select("row_id", "resolution_bucket_id")
    made = [batching.epoch_batches(rows, ["resolution_bucket_id"], "row_id", SIZE, epoch).withColumn("epoch", F.lit(epoch)) for epoch in (0, 1)]
    return algebra.union_all(made).select("epoch", "row_id", "resolution_bucket_id", "batch_no")


_NAME = "coalesce(resolution_bucket_id::VARCHAR, 'null') || ':' || batch_no::VARCHAR"


@query(f"""WITH {_EPOCH}, d AS (SELECT DISTINCT epoch, resolution_bucket_id, batch_no FROM b)
SELECT epoch, resolution_bucket_id, batch_no, (row_number() OVER (PARTITION BY epoch ORDER BY CASE epoch WHEN 0 THEN {U.format('(' + _NAME + ')', '42:0')} ELSE {U.format('(' + _NAME + ')', '42:1')} END, {_NAME}) - 1)::BIGINT AS order_no FROM d""")
def epoch_batch_order(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "precomputed").select("row_id", "resolution_bucket_id")
    made = []
    for epoch in (0, 1):
        batches = batching.epoch_batches(rows, ["resolution_bucket_id"], "row_id", SIZE, epoch).select("resolution_bucket_id", "batch_no").distinct()
        made.append(batching.batch_order(batches, ["resolution_bucket_id", "batch_no"], epoch).withColumn("epoch", F.lit(epoch)))
    return algebra.union_all(made).select("epoch", "resolution_bucket_id", "batch_no", "order_no")


_SOURCES = """w AS (SELECT mix_id, dataset_id, coalesce(weight, 1.0) AS w FROM dataset_entry),
c AS (SELECT dataset_id, sum(n)::BIGINT AS n FROM (SELECT dataset_id, count(*) // 8 AS n FROM precomputed WHERE data_split = 'train' GROUP BY dataset_id, resolution_bucket_id) GROUP BY 1),
s AS (SELECT mix_id, dataset_id, n, sum(w) OVER (PARTITION BY mix_id ORDER BY dataset_id) / sum(w) OVER (PARTITION BY mix_id) AS cum, max(dataset_id) OVER (PARTITION BY mix_id) AS last FROM c JOIN w USING (dataset_id) WHERE n > 0 AND w > 0),
slots AS (SELECT range AS slot FROM range((SELECT sum(n)::BIGINT FROM c)))"""


@query(f"""WITH {_SOURCES}, u AS (SELECT mix_id, slot, {U.format("(mix_id || ':' || slot)", 42)} AS u FROM slots, (SELECT DISTINCT mix_id FROM s)),
d AS (SELECT mix_id, slot, min(dataset_id) AS dataset_id FROM u JOIN s USING (mix_id) WHERE cum > u OR dataset_id = last GROUP BY 1, 2),
k AS (SELECT mix_id, slot, dataset_id, n, row_number() OVER (PARTITION BY mix_id, dataset_id ORDER BY slot) - 1 AS k FROM d JOIN c USING (dataset_id)),
o AS (SELECT dataset_id, p AS pass_no, b AS batch_no, row_number() OVER (PARTITION BY dataset_id, p ORDER BY {U.format("(dataset_id || ':' || p || ':' || b)", 42)}, b) - 1 AS place
      FROM (SELECT dataset_id, p, unnest(range(n)) AS b FROM (SELECT dataset_id, n, unnest(range(max(k // n) + 1)) AS p FROM k GROUP BY 1, 2)))
SELECT mix_id, slot, dataset_id, (k // n)::BIGINT AS pass_no, batch_no FROM k JOIN o ON o.dataset_id = k.dataset_id AND o.pass_no = k.k // k.n AND o.place = k.k % k.n""".replace("SELECT mix_id, slot, dataset_id, (k // n)", "SELECT mix_id, slot, k.dataset_id, (k // n)"))
def weighted_schedule(spark: SparkSession, folder: str) -> DataFrame:
    """Schedules of all mixes; a source that runs out comes again in another order."""
    train = table(spark, folder, "precomputed").where("data_split = 'train'")
    per = train.groupBy("dataset_id", "resolution_bucket_id").agg(F.floor(F.count(F.lit(1)) / F.lit(SIZE)).alias("n")).groupBy("dataset_id").agg(F.sum("n").alias("n_batches"))
    weights = table(spark, folder, "dataset_entry").select("mix_id", "dataset_id", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    return batching.weighted_schedule(written(per), weights)


_TOK = f"t AS (SELECT row_id, captions, list_transform(captions, lambda c: {TOKENS.format('c')}::DOUBLE) AS n FROM precomputed WHERE len(captions) > 0)"
_PROB = """m AS (SELECT *, list_sum(n) / len(n) AS mean, len(n) AS k FROM t),
s AS (SELECT *, list_transform(n, lambda x: greatest(1 + 2.0 * ({0} - 0.5) * (x - mean) / nullif(mean, 0), 1e-6)) AS sc, greatest(0.15, least(0.8, 1 - 0.15 * (k - 1))) AS top FROM m),
q AS (SELECT *, list_transform(sc, lambda x: least(greatest(x / list_sum(sc), 0.15), top)) AS cl FROM s),
p AS (SELECT row_id, captions, k, CASE WHEN mean = 0 OR k = 1 THEN list_transform(n, lambda x: 1.0::DOUBLE / k) ELSE list_transform(cl, lambda x: x / list_sum(cl)) END AS p FROM q)"""


def _weights(spark: SparkSession, folder: str, stage: float) -> DataFrame:
    df = table(spark, folder, "precomputed").where(F.size("captions") > 0).select("row_id", "captions")
    tokens = F.transform("captions", lambda c: T.token_estimate(c).cast("double"))
    return df.withColumn("p", K.caption_weights(tokens, stage))


@query(f"WITH {_TOK}, {_PROB.format('1.0')} SELECT row_id, unnest(range(k)) AS i, round(unnest(p), 9) AS probability FROM p")
def caption_probs(spark: SparkSession, folder: str) -> DataFrame:
    return _weights(spark, folder, 1.0).select("row_id", F.posexplode("p").alias("i", "x")).select("row_id", F.col("i").cast("long").alias("i"), F.round("x", 9).alias("probability"))


@query(f"""WITH {_TOK}, {_PROB.format('0.3')}, u AS (SELECT *, {U.format('row_id', 42)} AS u FROM p)
SELECT row_id, captions[least(1 + len(list_filter(range(1, k + 1), lambda i: list_sum(p[1:i]) <= u)), k)] AS caption FROM u""")
def caption_sample(spark: SparkSession, folder: str) -> DataFrame:
    df = _weights(spark, folder, 0.3)
    return df.select("row_id", F.get("captions", K.pick(F.col("p"), uniform(F.col("row_id"), 42))).alias("caption"))


@query(f"""WITH d AS (SELECT row_id, row_id // 4 AS batch, {U.format('row_id', 42)} AS u FROM precomputed)
SELECT row_id, u < 0.5 AND NOT (max(u) OVER (PARTITION BY batch) < 0.5 AND row_number() OVER (PARTITION BY batch ORDER BY u, row_id) = 1) AS dropped FROM d""")
def caption_dropout(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "precomputed").select("row_id", F.floor(F.col("row_id") / 4).alias("batch"))
    return batching.keep_one_per_batch(df, ["batch"], "row_id", 0.5).select("row_id", "dropped")


_LOG = "log AS (SELECT DISTINCT run_name, train_step, dataset_id, resolution_bucket_id, n_samples, logged_at FROM train_telemetry)"
_LINE = ["run_name", "train_step", "dataset_id", "resolution_bucket_id", "n_samples", "logged_at"]


@query(f"""WITH {_LOG}, c AS (SELECT run_name, train_step // 125 AS interval_no, dataset_id, sum(n_samples)::BIGINT AS n FROM log GROUP BY ALL)
SELECT run_name, interval_no::BIGINT AS interval_no, dataset_id, n AS n_samples, round(n / nullif(sum(n) OVER (PARTITION BY run_name, interval_no), 0), 9) AS ratio FROM c""")
def telemetry_counts(spark: SparkSession, folder: str) -> DataFrame:
    log = telemetry.once(table(spark, folder, "train_telemetry").select(*_LINE), _LINE)
    return telemetry.interval_counts(log, 125).withColumn("ratio", F.round("ratio", 9))


@query("SELECT run_name, round(avg(loss), 9) AS mean_loss, count(*) AS n FROM train_telemetry WHERE loss IS NOT NULL AND NOT isnan(loss) GROUP BY 1")
def average_loss(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "train_telemetry").where("loss is not null and not isnan(loss)")
    return log.groupBy("run_name").agg(F.round(F.avg("loss"), 9).alias("mean_loss"), F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT run_name, train_step, avg(loss) AS loss FROM train_telemetry WHERE loss IS NOT NULL AND NOT isnan(loss) GROUP BY 1, 2),
k AS (SELECT *, (row_number() OVER w - 1)::DOUBLE AS k, first_value(loss) OVER w AS v0 FROM s WINDOW w AS (PARTITION BY run_name ORDER BY train_step)),
e AS (SELECT *, sum(loss * power(0.99::DOUBLE, -k)) OVER (PARTITION BY run_name ORDER BY train_step) AS acc FROM k)
SELECT run_name, train_step, round(loss, 9) AS loss, round(power(0.99::DOUBLE, k + 1) * v0 + 0.01 * power(0.99::DOUBLE, k) * acc, 6) AS ema FROM e""")
def telemetry_ema(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.running_average(table(spark, folder, "train_telemetry"), 0.99).withColumn("ema", F.round("ema", 6)).withColumn("loss", F.round("loss", 9))


@query("SELECT run_name, train_step FROM train_telemetry WHERE train_step % 200 = 0")
def periodic_steps(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "train_telemetry").where("train_step % 200 = 0").select("run_name", "train_step")


@query("SELECT run_name, train_step, round(0.1 + 0.8 * train_step / (max(train_step) OVER (PARTITION BY run_name) + 1), 9) AS progress FROM (SELECT DISTINCT run_name, train_step FROM train_telemetry WHERE train_step IS NOT NULL)")
def progress_fraction(spark: SparkSession, folder: str) -> DataFrame:
    steps = table(spark, folder, "train_telemetry").where("train_step is not null").select("run_name", "train_step").distinct()
    lengths = steps.groupBy("run_name").agg((F.max("train_step") + 1).alias("steps"))
    return steps.join(lengths, "run_name").select("run_name", "train_step", F.round(K.progress(F.col("train_step"), F.col("steps")), 9).alias("progress"))


@query("SELECT run_name, train_step // 125 AS interval_no, dataset_id, sum(n_samples)::BIGINT AS n_samples FROM train_telemetry GROUP BY ALL")
def telemetry_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The interval counts as a stream over the table's files, run until all of them are read; its changes and progress go to the shared folder."""
    source = table(spark, folder, "train_telemetry")
    place = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    path = f"{folder}/train_telemetry.parquet"
    stream = spark.readStream.schema(source.schema).parquet(path if _is_folder(spark, path) else f"{folder}/train_telemetr[y].parquet")
    counted = telemetry.interval_counts_stream(stream, 125)
    telemetry.keep_latest(counted, place).awaitTermination()
    return telemetry.latest(spark, place, ["run_name", "interval_no", "dataset_id"], counted.schema)


@query("SELECT run_name, count(*) FILTER (train_step % 200 = 0) AS n_due FROM train_telemetry GROUP BY 1")
def periodic_actions(spark: SparkSession, folder: str) -> DataFrame:
    """What a periodic action of a stream saw: each batch appends its lines that are due."""
    source = table(spark, folder, "train_telemetry")
    place = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    path = f"{folder}/train_telemetry.parquet"
    stream = spark.readStream.schema(source.schema).parquet(path if _is_folder(spark, path) else f"{folder}/train_telemetr[y].parquet")

    def act(batch: DataFrame, number: int) -> None:
        due = batch.groupBy("run_name").agg(F.count_if(F.col("train_step") % 200 == 0).alias("n_due"))
        due.write.mode("overwrite").parquet(f"{place}/due/batch={number}")

    telemetry.on_interval(stream, act, place).awaitTermination()
    return spark.read.parquet(f"{place}/due").groupBy("run_name").agg(F.sum("n_due").alias("n_due"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
