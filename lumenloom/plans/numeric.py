"""Queries on numeric kernels: latents as the data end of a path, the same latents in reverse order as its noise end."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.functions import kernels as K
from lumenloom.functions.hashing import normal, uniform
from lumenloom.plans.catalogue import query
from lumenloom.plans.curation import U
from lumenloom.sources.readers import table

_P = f"""f AS (SELECT row_id, list_transform(latents, lambda x: x::DOUBLE) AS x FROM precomputed WHERE latents IS NOT NULL AND len(list_filter(latents, lambda x: NOT isfinite(x))) = 0),
p AS (SELECT row_id, x, list_reverse(x) AS z, {U.format('row_id', 42)} AS t FROM f)"""
_Z = "list_transform(range(len(x)), lambda i: {0})"
MEANS, STDS = [(c - 5) / 30 for c in range(16)], [(5 + c) / 30 for c in range(16)]
_LMC = "(-t * t * 19.9 / 4.0 - t * 0.1 / 2.0)"


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "precomputed").select("row_id", "latents").where(K.finite(F.col("latents")))
    x = K.doubles(F.col("latents"))
    return df.select("row_id", x.alias("x"), F.reverse(x).alias("z"), uniform(F.col("row_id"), 42).alias("t"))


def _summed(df: DataFrame, **columns: Column) -> DataFrame:
    """row_id and, per column, the sum and the fifth value of an array."""
    pairs = [K.let(c, lambda v: F.struct(F.round(K.total(v), 5).alias("s"), F.round(F.get(v, F.lit(4)), 6).alias("v"))).alias(name) for name, c in columns.items()]
    return df.select("row_id", *pairs).select("row_id", *[F.col(f"{n}.{f}").alias(f"{n}_{e}") for n in columns for f, e in (("s", "sum"), ("v", "5"))])


def _sql(**columns: str) -> str:
    made = ", ".join(f"{c} AS {n}" for n, c in columns.items())
    shown = ", ".join(f"round(list_sum({n}), 5) AS {n}_sum, round({n}[5], 6) AS {n}_5" for n in columns)
    return f"WITH {_P}, m AS (SELECT row_id, {made} FROM p) SELECT row_id, {shown} FROM m"


@query(_sql(normal=_Z.format("(x[i + 1] - (i // 4 - 5) / 30.0::DOUBLE) / ((5 + i // 4) / 30.0::DOUBLE)"), back=_Z.format("x[i + 1] * ((5 + i // 4) / 30.0::DOUBLE) + (i // 4 - 5) / 30.0::DOUBLE")))
def latent_normalise(spark: SparkSession, folder: str) -> DataFrame:
    x = F.col("x")
    return _summed(_pairs(spark, folder), normal=K.normalise(x, MEANS, STDS, 4), back=K.denormalise(x, MEANS, STDS, 4))


@query(_sql(path=_Z.format("(1 - t) * z[i + 1] + t * x[i + 1]"), velocity=_Z.format("x[i + 1] - z[i + 1] * 0.5")))
def interpolate_ot(spark: SparkSession, folder: str) -> DataFrame:
    df = _pairs(spark, folder)
    return _summed(df, path=K.mix_linear(F.col("z"), F.col("x"), F.col("t")), velocity=K.difference(F.col("x"), F.transform("z", lambda v: v * 0.5)))


@query(_sql(path=_Z.format(f"exp({_LMC}) * x[i + 1] + sqrt(1 - exp(2 * {_LMC})) * z[i + 1]"),
            velocity=_Z.format(f"-0.5 * (0.1 + t * 19.9) * exp({_LMC}) * x[i + 1] + (0.1 + t * 19.9) * exp(2 * {_LMC}) / (2 * sqrt(1 - exp(2 * {_LMC})) + 1e-6) * z[i + 1]")))
def interpolate_vp(spark: SparkSession, folder: str) -> DataFrame:
    df = _pairs(spark, folder)
    return _summed(df, path=K.mix_preserving(F.col("z"), F.col("x"), F.col("t")), velocity=K.preserving_velocity(F.col("z"), F.col("x"), F.col("t")))


@query(f"WITH {_P} SELECT row_id, round(list_avg({_Z.format('power(x[i + 1] - z[i + 1], 2)')}), 6) AS mse, round(list_avg({_Z.format('power(x[i + 1] * t + z[i + 1], 2)')}), 6) AS score FROM p")
def path_losses(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).select("row_id", F.round(K.mean_square(F.col("x"), F.col("z")), 6).alias("mse"), F.round(K.score_loss(F.col("x"), F.col("z"), F.col("t")), 6).alias("score"))


TIMES = [i / 10 for i in range(11)]


def _decay(x: np.ndarray, t: float) -> np.ndarray:
    return -x


@query(_sql(x1=_Z.format("x[i + 1] * power(1 - 0.1, 10)")))
def euler_linear(spark: SparkSession, folder: str) -> DataFrame:
    """Ten Euler steps of dx/dt = -x from 0 to 1, a batch of rows at a time."""
    return _summed(K.solved(_pairs(spark, folder).select("row_id", "x"), "x", _decay, TIMES, "euler", name="x1"), x1=F.col("x1"))


@query(_sql(x1=_Z.format("x[i + 1] * power(1 - 0.1 + 0.005, 10)")))
def heun_linear(spark: SparkSession, folder: str) -> DataFrame:
    return _summed(K.solved(_pairs(spark, folder).select("row_id", "x"), "x", _decay, TIMES, "heun", name="x1"), x1=F.col("x1"))


@query(f"WITH {_P} SELECT row_id, s AS step, round(list_sum({_Z.format('x[i + 1] * power(0.9, s)')}) / 7, 5) AS state_seventh FROM p, range(11) AS t(s)")
def ode_states(spark: SparkSession, folder: str) -> DataFrame:
    """The states of ten steps, with the start, of a solver that is given as a function."""
    step = lambda x, t, dt, field: x + dt * field(x, t)
    made = K.solved(_pairs(spark, folder).select("row_id", "x"), "x", _decay, TIMES, step, intermediates=True, name="states")
    return made.select("row_id", F.posexplode("states").alias("step", "v")).select("row_id", F.col("step").cast("long").alias("step"), F.round(K.total(F.col("v")) / 7, 5).alias("state_seventh"))


@query(_sql(flow=_Z.format("x[i + 1] - 0.5 * (0.1 + t * 19.9) * (x[i + 1] + z[i + 1]) * 0.02")))
def flow_step(spark: SparkSession, folder: str) -> DataFrame:
    return _summed(_pairs(spark, folder), flow=K.flow_step(F.col("x"), F.col("z"), F.col("t"), 0.02))


_NORMAL = "sqrt(-2 * ln(1 - {a})) * cos(2 * pi() * {b})".format(a=U.format("row_id", "9a"), b=U.format("row_id", "9b"))


@query(_sql(sde=_Z.format(f"x[i + 1] + (z[i + 1] - t * t * x[i + 1]) * 0.01 + t * sqrt(0.01) * ({_NORMAL})")))
def euler_maruyama(spark: SparkSession, folder: str) -> DataFrame:
    df = _pairs(spark, folder)
    noise = F.array_repeat(normal(F.col("row_id"), 9), 64)
    return _summed(df, sde=K.euler_maruyama(F.col("x"), F.col("z"), F.col("x"), F.col("t"), 0.01, noise))


@query(_sql(guided=_Z.format("z[i + 1] + 4.5 * (x[i + 1] - z[i + 1])")))
def cfg_combine(spark: SparkSession, folder: str) -> DataFrame:
    return _summed(_pairs(spark, folder), guided=K.guided(F.col("x"), F.col("z"), 4.5))


@query(f"WITH {_P} SELECT row_id, round(list_sum({_Z.format('x[i + 1] * (i < row_id % 64)::INT')}) / greatest(row_id % 64, 1), 6) AS pooled, (row_id % 64)::INT AS n_kept FROM p")
def masked_mean_pool(spark: SparkSession, folder: str) -> DataFrame:
    df = _pairs(spark, folder)
    mask = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i < F.col("row_id") % 64).cast("double"))
    return df.select("row_id", F.round(K.masked_mean(F.col("x"), mask), 6).alias("pooled"), F.size(K.masked_values(F.col("x"), mask)).alias("n_kept"))


@query(_sql(unit=_Z.format("(x[i + 1] + t) / 127.5 - 1"), share=_Z.format("least(greatest((x[i + 1] + t + 1) / 2, 0), 1)"), modulated=_Z.format("x[i + 1] * (1 + z[i + 1]) + t")))
def pixel_scale(spark: SparkSession, folder: str) -> DataFrame:
    df, x = _pairs(spark, folder), F.col("x")
    shift = F.transform(x, lambda v: F.col("t"))
    moved = F.transform(x, lambda v: v + F.col("t"))
    return _summed(df, unit=K.pixels_to_unit(moved), share=K.unit_to_share(moved), modulated=K.modulate(x, shift, F.col("z")))


@query(f"WITH {_P} SELECT row_id, list_sum({_Z.format('trunc(least(greatest(x[i + 1] * (CASE WHEN list_max(x) <= 1 THEN 255 ELSE 1 END), 0), 255))')})::BIGINT AS bytes_sum FROM p")
def to_bytes(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).select("row_id", F.aggregate(K.to_bytes(F.col("x")), F.lit(0).cast("long"), lambda a, v: a + v).alias("bytes_sum"))


@query(f"""WITH {_P}, r AS (SELECT row_id, list_transform(range(32), lambda i: x[2 * i + 1] * cos((row_id % 100) / power(10000.0, 2 * i / 64.0)) - x[2 * i + 2] * sin((row_id % 100) / power(10000.0, 2 * i / 64.0))) AS re,
  list_transform(range(32), lambda i: x[2 * i + 1] * sin((row_id % 100) / power(10000.0, 2 * i / 64.0)) + x[2 * i + 2] * cos((row_id % 100) / power(10000.0, 2 * i / 64.0))) AS im FROM p)
SELECT row_id, round(list_sum(re) + list_sum(im), 5) AS rotated_sum, round(re[3], 6) AS rotated_5 FROM r""")
def rotary_apply(spark: SparkSession, folder: str) -> DataFrame:
    angles = K.rotary_angles((F.col("row_id") % 100).cast("double"), 64)
    return _summed(_pairs(spark, folder), rotated=K.rotate(F.col("x"), angles))


@query(f"WITH {_P} SELECT row_id, round(list_sum(list_transform(range(64), lambda k: (k + 1) * x[(((((k % 16) // 8) * 2 + (k % 4) // 2) * 2 + ((k % 16) // 4) % 2) * 2 + k % 2) * 4 + k // 16 + 1])), 4) AS checksum FROM p")
def unpatchify(spark: SparkSession, folder: str) -> DataFrame:
    """Four patches of 2 x 2 pixels and 4 channels, put together to 4 images of 4 x 4."""
    made = K.unpatched(F.col("x"), 2, 2, 4, 2)
    return _pairs(spark, folder).select("row_id", F.round(K.total(F.transform(made, lambda v, k: (k + 1) * v)), 4).alias("checksum"))


@query(f"""WITH {_P} SELECT row_id, round(list_sum(list_transform(range(64), lambda k: (k + 1) * x[(k % 4) * 16 + ((k // 16) // 2 * 2 + (k // 4) % 4 // 2) * 4 + (k // 16) % 2 * 2 + (k // 4) % 2 + 1])), 4) AS checksum, TRUE AS came_back FROM p""")
def patchify(spark: SparkSession, folder: str) -> DataFrame:
    """4 images of 4 x 4 cut to four patches of 2 x 2 pixels and 4 channels, and put together again."""
    made = K.let(K.patched(F.col("x"), 2, 2, 4, 2), lambda v: F.struct(F.round(K.total(F.transform(v, lambda x, k: (k + 1) * x)), 4).alias("checksum"), (K.unpatched(v, 2, 2, 4, 2) == F.col("x")).alias("came_back")))
    return _pairs(spark, folder).select("row_id", made.alias("m")).select("row_id", "m.*")


@query("""SELECT resolution_bucket_id, round(CASE WHEN height * width / 4.0 <= 256 THEN 1 ELSE 1 + 2 * least(ln(height * width / 4.0 / 256) / ln(16.0), 1) END, 9) AS shift,
  (floor(greatest(width - 7, 64) / 16) * 16)::INT AS sane_width FROM resolution_bucket""")
def time_shift(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "resolution_bucket")
    return df.select("resolution_bucket_id", F.round(K.resolution_shift(F.col("height"), F.col("width")), 9).alias("shift"), K.sane_side(F.col("width") - 7).alias("sane_width"))


@query("WITH s AS (SELECT i, i / 50.0::DOUBLE AS t FROM range(51) AS r(i)) SELECT i AS step, round(2.5 * t / (1 + 1.5 * t), 9) AS t FROM s")
def shift_schedule(spark: SparkSession, folder: str) -> DataFrame:
    times = spark.range(1).select(F.posexplode(K.shifted_schedule(0.0, 1.0, 50, F.lit(2.5))).alias("step", "t"))
    return times.select(F.col("step").cast("long").alias("step"), F.round("t", 9).alias("t"))


@query("""SELECT i AS step, round(1e-4 * CASE WHEN i < 100 THEN 0.01 + 0.99 * (i / 100.0::DOUBLE) ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * least((i - 100) / 900.0::DOUBLE, 1))) END, 12) AS rate FROM range(1200) AS r(i)""")
def lr_schedule(spark: SparkSession, folder: str) -> DataFrame:
    return spark.range(1200).select(F.col("id").alias("step"), F.round(K.learning_rate(F.col("id"), 100, 1000, 1e-5, 1e-4), 12).alias("rate"))


@query("SELECT s AS step, round(least(greatest(2.0 * s / 1000.0::DOUBLE, 0), 1), 9) AS stage FROM range(1000) AS r(s)")
def curriculum_stage(spark: SparkSession, folder: str) -> DataFrame:
    return spark.range(1000).select(F.col("id").alias("step"), F.round(F.least(F.greatest(2.0 * F.col("id") / 1000.0, F.lit(0.0)), F.lit(1.0)), 9).alias("stage"))


@query("SELECT t, k, round(CASE WHEN k < 16 THEN sin(t * exp(-ln(10000.0) * k / 16.0)) ELSE cos(t * exp(-ln(10000.0) * (k - 16) / 16.0)) END, 6) AS v FROM range(50) AS a(t), range(32) AS b(k)")
def sinusoidal(spark: SparkSession, folder: str) -> DataFrame:
    made = spark.range(50).select(F.col("id").alias("t"), F.posexplode(K.sinusoids(F.col("id").cast("double"), 32)).alias("k", "v"))
    return made.select("t", F.col("k").cast("long").alias("k"), F.round("v", 6).alias("v"))


@query("""SELECT p, k, round(p / power(10000.0, 2 * k / 32.0), 6) AS plain, round(p / 4.0 / power(10000.0, 2 * k / 32.0), 6) AS linear, round(p / power(10000.0 * power(4.0, 32 / 30.0), 2 * k / 32.0), 6) AS ntk
FROM range(64) AS a(p), range(16) AS b(k)""")
def rope_freqs(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("id").cast("double")
    zipped = F.arrays_zip(K.rotary_angles(p, 32).alias("a"), K.rotary_angles(p, 32, scaling="linear", factor=4.0).alias("b"), K.rotary_angles(p, 32, scaling="ntk", factor=4.0).alias("c"))
    rows = spark.range(64).select(F.col("id").alias("p"), F.posexplode(zipped).alias("k", "v"))
    return rows.select("p", F.col("k").cast("long").alias("k"), F.round("v.a", 6).alias("plain"), F.round("v.b", 6).alias("linear"), F.round("v.c", 6).alias("ntk"))


@query("""SELECT y, x, k, round(CASE WHEN k < 8 THEN y / power(10000.0, 2 * k / 16.0) ELSE x / power(10000.0, 2 * (k - 8) / 16.0) END, 6) AS angle FROM range(8) AS a(y), range(12) AS b(x), range(16) AS c(k)
UNION ALL SELECT 12 + i, 12 + i, k, round((12 + i) / power(10000.0, 2 * (k % 8) / 16.0), 6) FROM range(5) AS a(i), range(16) AS c(k)""")
def rope_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Angles of an 8 x 12 grid, and of 5 text positions on the diagonal behind it."""
    cells = spark.range(8 * 12).select(F.floor(F.col("id") / 12).alias("y"), (F.col("id") % 12).alias("x")).union(spark.range(5).select(F.col("id") + 12, F.col("id") + 12))
    angles = F.concat(K.rotary_angles(F.col("y").cast("double"), 16), K.rotary_angles(F.col("x").cast("double"), 16))
    return cells.select("y", "x", F.posexplode(angles).alias("k", "a")).select("y", "x", F.col("k").cast("long").alias("k"), F.round("a", 6).alias("angle"))


@query(f"WITH {_P} SELECT row_id, round(1 / (1 + exp(-({_NORMAL}))), 6) AS t FROM p")
def logit_normal(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).select("row_id", F.round(1 / (1 + F.exp(-normal(F.col("row_id"), 9))), 6).alias("t"))


@query("""WITH s AS (SELECT row_id, captions, len(captions) AS n, row_id // 16 AS batch FROM precomputed WHERE captions IS NOT NULL), m AS (SELECT *, greatest(max(n) OVER (PARTITION BY batch), 1) AS size FROM s)
SELECT row_id, n AS n_real, size AS n_padded, array_to_string(list_concat(list_transform(captions, lambda c: coalesce(c, '-')), list_transform(range(size - n), lambda i: '')), '|') AS padded, repeat('1', n) || repeat('0', size - n) AS mask FROM m""")
def pad_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Caption lists padded to the longest of their batch of 16 ids, with the mask of what is real."""
    df = table(spark, folder, "precomputed").where("captions is not null").select("row_id", F.transform("captions", lambda c: F.coalesce(c, F.lit("-"))).alias("captions"), F.floor(F.col("row_id") / 16).alias("batch"))
    most = df.groupBy("batch").agg(F.greatest(F.max(F.size("captions")), F.lit(1)).alias("size"))
    both = df.join(most, "batch").withColumn("full", K.padded(F.col("captions"), F.col("size"), F.lit(""))).withColumn("mask", K.padding_mask(F.col("captions"), F.col("size")))
    return both.select("row_id", F.size("captions").cast("long").alias("n_real"), F.size("full").cast("long").alias("n_padded"), F.array_join("full", "|").alias("padded"), F.array_join(F.transform("mask", lambda m: m.cast("string")), "").alias("mask"))


@query(f"WITH {_P} SELECT row_id, len(x[39:]) AS n, round(list_sum(x[39:]), 5) AS kept_sum FROM p")
def trim_tokens(spark: SparkSession, folder: str) -> DataFrame:
    kept = K.trimmed(F.col("x"), 38, 1024)
    return _pairs(spark, folder).select("row_id", F.size(kept).cast("long").alias("n"), F.round(K.total(kept), 5).alias("kept_sum"))


@query("SELECT resolution_bucket_id, CASE WHEN width >= 1152 THEN 16 WHEN width >= 768 THEN 12 WHEN width >= 640 THEN 10 ELSE 8 END AS heads, ceil(sqrt(height))::INT AS grid_side FROM resolution_bucket")
def width_ladder(spark: SparkSession, folder: str) -> DataFrame:
    w = F.col("width")
    heads = F.when(w >= 1152, 16).when(w >= 768, 12).when(w >= 640, 10).otherwise(8)
    return table(spark, folder, "resolution_bucket").select("resolution_bucket_id", heads.alias("heads"), F.ceil(F.sqrt("height")).cast("int").alias("grid_side"))


@query("""SELECT resolution_bucket_id AS n, ceil(sqrt(resolution_bucket_id))::INT AS square_columns, ceil(resolution_bucket_id / ceil(sqrt(resolution_bucket_id)))::INT AS square_rows, ceil(resolution_bucket_id / 3.0)::INT AS columns_of_three_rows,
  ceil(resolution_bucket_id / 5.0)::INT AS rows_of_five_columns FROM resolution_bucket WHERE resolution_bucket_id > 0""")
def grid_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """Grids for as many pictures as a bucket's number: square, of three rows, of five columns."""
    n = F.col("resolution_bucket_id")
    square, rows, columns = K.grid_shape(n), K.grid_shape(n, rows=F.lit(3)), K.grid_shape(n, columns=F.lit(5))
    return table(spark, folder, "resolution_bucket").where(n > 0).select(n.alias("n"), square["columns"].alias("square_columns"), square["rows"].alias("square_rows"), rows["columns"].alias("columns_of_three_rows"), columns["rows"].alias("rows_of_five_columns"))
