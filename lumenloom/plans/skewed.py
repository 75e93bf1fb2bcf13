"""Results per key of keys that hold most rows (problem 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.functions import kernels as K
from lumenloom.operators.skew import eager_join_aggregate, over_share
from lumenloom.plans.catalogue import query
from lumenloom.session import cut_lineage
from lumenloom.sources.readers import table


def _finite(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def bucket_states(spark: SparkSession, folder: str) -> DataFrame:
    """One state per bucket of the records, joined to that of the bucket table; null buckets and unknown ones keep their row."""
    rows, sizes = table(spark, folder, "precomputed"), table(spark, folder, "resolution_bucket")
    sums = {"n_captions": F.coalesce(F.sum(F.when(F.col("captions").isNotNull(), F.size("captions"))), F.lit(0))}
    return eager_join_aggregate(rows, sizes, "resolution_bucket_id", sums, {"pixels": F.sum(F.col("width") * F.col("height"))}, how="left")


@query("""SELECT resolution_bucket_id FROM (SELECT resolution_bucket_id, count(*) AS n FROM precomputed GROUP BY 1)
WHERE resolution_bucket_id IS NOT NULL AND n > 0.05 * (SELECT count(*) FROM precomputed)""")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    # the states are one row per bucket; they are written, so that the total does not read the records again
    return over_share(cut_lineage(bucket_states(spark, folder)), "resolution_bucket_id", "left_rows", 0.05).select("resolution_bucket_id")


@query("""WITH v AS (SELECT resolution_bucket_id, captions, list_filter(list_transform(latents, lambda x: x::DOUBLE), lambda x: isfinite(x)) AS z FROM precomputed)
SELECT resolution_bucket_id, count(*) AS n_rows, coalesce(sum(len(captions)), 0)::BIGINT AS n_captions,
       round(sum(list_sum(z)) / nullif(sum(len(z)), 0), 6) AS latent_mean FROM v GROUP BY 1""")
def p3_bucket_results(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "precomputed")
    z = _finite(K.doubles(F.col("latents")))
    sums = {
        "n_captions": F.coalesce(F.sum(F.when(F.col("captions").isNotNull(), F.size("captions"))), F.lit(0)).cast("long"),
        "latent_sum": F.sum(K.total(z)),
        "latent_n": F.sum(F.when(F.col("latents").isNotNull(), F.size(z))),
    }
    states = eager_join_aggregate(rows, table(spark, folder, "resolution_bucket"), "resolution_bucket_id", sums, {}, how="left")
    return states.select("resolution_bucket_id", F.col("left_rows").alias("n_rows"), "n_captions", F.round(F.try_divide("latent_sum", "latent_n"), 6).alias("latent_mean"))


@query("""WITH v AS (SELECT resolution_bucket_id, unnest(latents)::DOUBLE AS x, unnest(range(len(latents))) AS i FROM precomputed WHERE latents IS NOT NULL)
SELECT resolution_bucket_id, (i // 4)::INT AS channel, round(avg(x), 6) AS latent_mean FROM v WHERE isfinite(x) GROUP BY 1, 2""")
def p3_channel_means(spark: SparkSession, folder: str) -> DataFrame:
    """Means of each channel of the latents (16 channels of 4 values), summed in place so that no value is ever a row of its own."""
    rows = table(spark, folder, "precomputed").where("latents is not null")
    good = lambda i: F.get("latents", F.lit(i)).cast("double")
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sums = {f"s{c}": F.sum(sum((F.when(ok(good(i)), good(i)).otherwise(0.0) for i in range(4 * c, 4 * c + 4)), F.lit(0.0))) for c in range(16)}
    counts = {f"n{c}": F.sum(sum((F.when(ok(good(i)), 1).otherwise(0) for i in range(4 * c, 4 * c + 4)), F.lit(0))) for c in range(16)}
    states = eager_join_aggregate(rows, table(spark, folder, "resolution_bucket"), "resolution_bucket_id", sums | counts, {}, how="left")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"s{c}").alias("s"), F.col(f"n{c}").alias("n")) for c in range(16)])).alias("c")
    return states.select("resolution_bucket_id", pairs).where("c.n > 0").select("resolution_bucket_id", "c.channel", F.round(F.col("c.s") / F.col("c.n"), 6).alias("latent_mean"))


@query("""WITH a AS (SELECT resolution_bucket_id AS b, count(*) AS n, sum(len(captions)) AS c FROM precomputed WHERE resolution_bucket_id IS NOT NULL GROUP BY 1),
t AS (SELECT resolution_bucket_id AS b, count(*) AS m, sum(n_samples) AS s FROM train_telemetry WHERE resolution_bucket_id IS NOT NULL GROUP BY 1)
SELECT b AS resolution_bucket_id, n AS n_rows, m AS n_lines, (n * m)::BIGINT AS n_pairs, (c * m)::BIGINT AS pair_captions, (s * n)::BIGINT AS pair_samples FROM a JOIN t USING (b)""")
def p3_telemetry_join(spark: SparkSession, folder: str) -> DataFrame:
    """What a join of records and telemetry lines by bucket sums up to, without making its rows."""
    captions = {"captions_sum": F.sum(F.when(F.col("captions").isNotNull(), F.size("captions"))).cast("long")}
    joined = eager_join_aggregate(table(spark, folder, "precomputed"), table(spark, folder, "train_telemetry"), "resolution_bucket_id", captions, {"samples": F.sum("n_samples")})
    return joined.select(
        "resolution_bucket_id", F.col("left_rows").alias("n_rows"), F.col("right_rows").alias("n_lines"), F.col("joined_rows").alias("n_pairs"),
        F.col("joined_captions_sum").alias("pair_captions"), F.col("joined_samples").alias("pair_samples"),
    )
