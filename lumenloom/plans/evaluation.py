"""Queries on evaluation windows, prompts and feature statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.functions import kernels as K
from lumenloom.functions import text as T
from lumenloom.functions.hashing import uniform
from lumenloom.operators import algebra, evaluate
from lumenloom.plans.catalogue import query
from lumenloom.plans.curation import U
from lumenloom.sources.readers import table

_PROMPTS = """e AS (SELECT row_id, coalesce(resolution_bucket_id, 1) AS bucket, CASE WHEN len(captions) > 1 THEN captions[2] ELSE captions[1] END AS prompt FROM precomputed WHERE data_split = 'eval'),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY row_id) - 1 AS place, count(*) OVER (PARTITION BY bucket) AS n FROM e)"""


def _prompts(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "precomputed").where("data_split = 'eval'")
    rows = df.select("row_id", F.coalesce("resolution_bucket_id", F.lit(1)).alias("bucket"), T.second_or_first(F.col("captions")).alias("prompt"))
    placed = algebra.place_in_group(algebra.with_position(rows, "row_id"), ["bucket"], "pos")
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return placed.join(sizes, "bucket")


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", K.doubles(F.col("embedding")).alias("v"))


@query(f"""WITH s AS (SELECT row_id, row_number() OVER (ORDER BY {U.format('row_id', 42)}, row_id) - 1 AS pos, count(*) OVER () AS n FROM precomputed WHERE data_split = 'eval')
SELECT row_id FROM s WHERE n <= 16 OR pos >= 400 % greatest(n - 16, 1) AND pos < 400 % greatest(n - 16, 1) + 16""")
def eval_window(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "precomputed").where("data_split = 'eval'").select("row_id", F.struct(uniform(F.col("row_id"), 42).alias("u"), "row_id").alias("_key"))
    shuffled = algebra.with_position(df, "_key")
    begin, end = evaluate.rotating_window(400, shuffled.count(), 16)
    return shuffled.where((F.col("pos") >= begin) & (F.col("pos") < end)).select("row_id")


@query(f"WITH {_PROMPTS} SELECT row_id, bucket, prompt FROM r WHERE place < 4")
def prompts_by_bucket(spark: SparkSession, folder: str) -> DataFrame:
    """The four prompts of each bucket that are shown."""
    df = table(spark, folder, "precomputed").where("data_split = 'eval'")
    rows = df.select("row_id", F.coalesce("resolution_bucket_id", F.lit(1)).alias("bucket"), T.second_or_first(F.col("captions")).alias("prompt"))
    return evaluate.first_per_group(rows, "bucket", "row_id", 4)


@query(f"WITH {_PROMPTS} SELECT row_id, bucket, floor(place / ceil(n / 3.0))::BIGINT AS rank, (place // 32)::BIGINT AS batch_no FROM r")
def prompt_chunks(spark: SparkSession, folder: str) -> DataFrame:
    placed = _prompts(spark, folder)
    return placed.select("row_id", "bucket", evaluate.contiguous_chunk(F.col("place"), F.col("n"), 3).cast("long").alias("rank"), F.floor(F.col("place") / 32).alias("batch_no"))


_SELF = "e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, list_reverse(list_transform(embedding, lambda x: x::DOUBLE)) AS w FROM embeddings)"


@query(f"WITH {_SELF} SELECT round(greatest(avg(100 * list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w)))), 0), 6) AS score FROM e")
def cosine_score(spark: SparkSession, folder: str) -> DataFrame:
    df = _vectors(spark, folder).withColumn("w", F.reverse("v"))
    return evaluate.mean_similarity(df, "v", "w").withColumn("score", F.round("score", 6))


@query(f"WITH {_SELF} SELECT round(sum(list_sum(list_transform(range(len(v)), lambda i: abs(v[i + 1] - w[i + 1])))) / sum(len(v)), 6) AS difference FROM e")
def mean_abs_diff(spark: SparkSession, folder: str) -> DataFrame:
    df = _vectors(spark, folder).withColumn("w", F.reverse("v"))
    return evaluate.mean_absolute_difference(df, "v", "w").withColumn("difference", F.round("difference", 6))


@query("""WITH v AS (SELECT vec_id, vec_id % 2 AS g, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
k AS (SELECT a.g AS ga, b.g AS gb, sum(power(list_dot_product(a.x, b.x) / len(a.x) + 1, 3)) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id GROUP BY 1, 2),
n AS (SELECT sum((g = 0)::INT)::DOUBLE AS n, sum((g = 1)::INT)::DOUBLE AS m FROM v)
SELECT round((SELECT s FROM k WHERE ga = 0 AND gb = 0) / (n * (n - 1)) + (SELECT s FROM k WHERE ga = 1 AND gb = 1) / (m * (m - 1)) - 2 * (SELECT s FROM k WHERE ga = 0 AND gb = 1) / (n * m), 6) AS mmd2 FROM n""")
def kid_full(spark: SparkSession, folder: str) -> DataFrame:
    df = _vectors(spark, folder)
    return evaluate.kernel_distance(df.where("vec_id % 2 = 0"), df.where("vec_id % 2 = 1"), "v").withColumn("mmd2", F.round("mmd2", 6))


@query()
def fid(spark: SparkSession, folder: str) -> DataFrame:
    df = _vectors(spark, folder)
    value = evaluate.frechet_distance(evaluate.gaussian(df.where("vec_id % 2 = 0"), "v"), evaluate.gaussian(df.where("vec_id % 2 = 1"), "v"))
    return spark.createDataFrame([(round(value, 6),)], "distance double")


@query("""WITH v AS (SELECT vec_id % 2 AS g, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), m AS (SELECT g, i, avg(x) AS m, var_samp(x) AS v FROM v GROUP BY 1, 2)
SELECT round(sum(power(a.m - b.m, 2)), 6) AS mean_gap, round(sum(a.v), 6) AS trace_a, round(sum(b.v), 6) AS trace_b FROM m a JOIN m b USING (i) WHERE a.g = 0 AND b.g = 1""")
def fid_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The parts of the distance that need no matrix root."""
    df = _vectors(spark, folder)
    (_, m1, s1), (_, m2, s2) = (evaluate.gaussian(df.where(f"vec_id % 2 = {k}"), "v") for k in (0, 1))
    return spark.createDataFrame([(round(float(((m1 - m2) ** 2).sum()), 6), round(float(s1.trace()), 6), round(float(s2.trace()), 6))], "mean_gap double, trace_a double, trace_b double")


@query("""WITH v AS (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), m AS (SELECT i, avg(x) AS m, var_samp(x) AS v FROM v GROUP BY 1)
SELECT round(sum(power(m + 1, 2)) + sum(v), 4) AS distance FROM m""")
def fid_scaled(spark: SparkSession, folder: str) -> DataFrame:
    """Between vectors and twice themselves plus 1: covariances that commute, so the root is known and the distance is |m + 1|^2 + Tr S."""
    df = _vectors(spark, folder)
    value = evaluate.frechet_distance(evaluate.gaussian(df, "v"), evaluate.gaussian(df.select(F.transform("v", lambda x: 2 * x + 1).alias("v")), "v"))
    return spark.createDataFrame([(round(value, 4),)], "distance double")


@query(f"""WITH v AS (SELECT vec_id, vec_id % 2 AS g, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
u AS (SELECT s, g, vec_id, x, row_number() OVER (PARTITION BY s, g ORDER BY {U.format("(vec_id || ':' || s)", 42)}, vec_id) AS r FROM v, range(20) AS t(s)),
f AS (SELECT * FROM u WHERE r <= 50),
k AS (SELECT a.s AS s, a.g AS ga, b.g AS gb, sum(CASE WHEN a.g <> b.g OR a.vec_id <> b.vec_id THEN power(list_dot_product(a.x, b.x) / len(a.x) + 1, 3) END) AS t FROM f a JOIN f b ON a.s = b.s GROUP BY 1, 2, 3),
d AS (SELECT s, sum(CASE WHEN ga = gb THEN t / 2450.0 WHEN ga = 0 THEN -2 * t / 2500.0 END) AS d FROM k GROUP BY 1)
SELECT round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std, 50 AS size FROM d""")
def kid_subsets(spark: SparkSession, folder: str) -> DataFrame:
    df = _vectors(spark, folder)
    found = evaluate.kernel_distance_subsets(df.where("vec_id % 2 = 0"), df.where("vec_id % 2 = 1"), "vec_id", "v", size=50, subsets=20)
    return found.select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "size")


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, list_reverse(list_transform(embedding, lambda x: x::DOUBLE)) AS w FROM embeddings ORDER BY vec_id LIMIT 256)
SELECT count(*) AS n, round(greatest(avg(100 * list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w)))), 0), 6) AS score FROM e""")
def limited_score(spark: SparkSession, folder: str) -> DataFrame:
    """The score of as many rows as prompts and the limit of 256 allow; the limit is the feature."""
    df = _vectors(spark, folder).withColumn("w", F.reverse("v"))
    some = evaluate.limited(df, "vec_id", 256, 1000)
    return some.agg(F.count(F.lit(1)).alias("n"), F.round(F.greatest(F.avg(100.0 * K.cosine(F.col("v"), F.col("w"))), F.lit(0.0)), 6).alias("score"))


@query("""WITH s AS (SELECT run_name, train_step, row_number() OVER (PARTITION BY run_name ORDER BY train_step) - 1 AS place, count(*) OVER (PARTITION BY run_name) AS n FROM (SELECT DISTINCT run_name, train_step FROM train_telemetry WHERE train_step IS NOT NULL))
SELECT run_name, train_step FROM s WHERE n < 10 OR place IN (SELECT floor(i * (n - 1) / 9.0) FROM range(10) AS t(i))""")
def linspace_pick(spark: SparkSession, folder: str) -> DataFrame:
    """Ten steps of each run, evenly spaced over all that were logged."""
    steps = table(spark, folder, "train_telemetry").where("train_step is not null").select("run_name", "train_step").distinct()
    placed = algebra.place_by(steps, ["run_name"], [F.col("train_step")])
    sizes = steps.groupBy("run_name").agg(F.count(F.lit(1)).alias("n"))
    return placed.join(sizes, "run_name").where(evaluate.is_spaced(F.col("place"), F.col("n"), 10)).select("run_name", "train_step")
