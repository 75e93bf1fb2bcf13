"""Queries on captions, buckets, filters, preparation, unions and profiles."""

from __future__ import annotations

from hashlib import md5

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.functions import text as T
from lumenloom.functions.hashing import uniform
from lumenloom.operators import algebra, buckets, filters, profile
from lumenloom.plans import prepare
from lumenloom.plans.catalogue import query
from lumenloom.sources import readers
from lumenloom.sources.readers import table

#: The buckets of the training runs, by id; a plan-time constant as in the pipeline's arguments.
BUCKETS = {1: (256, 256), 2: (336, 192), 3: (192, 336), 4: (288, 224), 5: (224, 288), 6: (320, 208), 7: (208, 320)}

_S = T.SPACES
_Q = lambda s: s.replace("'", "''")
_OPEN = _Q("^(?:" + "|".join(o for o in T.OPENINGS) + ")")
TOKENS = f"(CASE WHEN {{0}} IS NULL OR {{0}} = '' THEN 0 WHEN regexp_matches({{0}}, '^[a-zA-Z]') THEN trunc(len(regexp_extract_all({{0}}, '[^{_S}]+')) * 1.3)::INT ELSE trunc(length({{0}}) * 0.6)::INT END)"
_BARE = f"regexp_replace(replace(replace(regexp_replace({{0}}, '{_OPEN}', ''), '\"\"\"', ''), '''''''', ''), '^[{_S}]+|[{_S}]+$', '', 'g')"
CLEAN = f"coalesce(upper(left({_BARE}, 1)) || lower(substr({_BARE}, 2)), '')"
_B = ", ".join(f"({i}, {k}, {w}, {h})" for k, (i, (w, h)) in enumerate(BUCKETS.items()))
U = "('0x' || substr(md5({0}::VARCHAR || ':{1}'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
NEAR = f"""near AS (SELECT raw_id, b, bw, bh FROM (SELECT raw_id, b, bw, bh, row_number() OVER (PARTITION BY raw_id ORDER BY abs(bw::DOUBLE / bh - width::DOUBLE / height), k) AS r
  FROM raw_image_text, (VALUES {_B}) AS bk(b, k, bw, bh) WHERE width > 0 AND height > 0) WHERE r = 1)"""
CAPS = f"""caps AS (SELECT raw_id, list_filter(list_concat([caption_text], [CASE WHEN len(human_caption_hq) > 1 THEN human_caption_hq[2].turn_value END]), lambda x: x IS NOT NULL) AS raw_caps FROM raw_image_text),
clean AS (SELECT raw_id, list_transform(raw_caps, lambda c: {CLEAN.format('c')}) AS captions FROM caps)"""
REASONS = f"""{NEAR}, {CAPS}, reasons AS (SELECT r.raw_id, captions, b, CASE
  WHEN lang IS NOT NULL AND lang <> 'zh' AND {U.format('r.raw_id', 42)} < 0.5 THEN 'language'
  WHEN width > 1 AND height > 1 AND (width < bw OR height < bh) THEN 'resolution'
  WHEN len(captions) = 0 OR len(list_filter(captions, lambda c: {TOKENS.format('c')} > 1)) = 0 OR len(list_filter(captions, lambda c: {TOKENS.format('c')} > 1024)) > 0 THEN 'caption'
  WHEN aesthetic_score < 5.0 AND NOT isnan(aesthetic_score) THEN 'score'
  WHEN pwatermark > 0.6 AND NOT isnan(pwatermark) THEN 'watermark' END AS reason
  FROM raw_image_text r LEFT JOIN near USING (raw_id) LEFT JOIN clean USING (raw_id))"""
LIMITS = prepare.Limits(language_probability=0.5, least_score=5.0)


def _raw(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "raw_image_text")


def _prepared(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.prepared(_raw(spark, folder), "raw_id", ["caption_text", "human_caption_hq"], BUCKETS, LIMITS)


@query(f"SELECT raw_id, {TOKENS.format('caption_text')} AS tokens FROM raw_image_text")
def token_estimate(spark: SparkSession, folder: str) -> DataFrame:
    return _raw(spark, folder).select("raw_id", T.token_estimate(F.col("caption_text")).alias("tokens"))


@query(f"SELECT raw_id, {CLEAN.format('caption_text')} AS caption FROM raw_image_text")
def clean_caption(spark: SparkSession, folder: str) -> DataFrame:
    return _raw(spark, folder).select("raw_id", T.clean_caption(F.col("caption_text")).alias("caption"))


@query(r"""SELECT row_id, array_to_string(list_transform(regexp_extract_all(replace(artist, '-', ' '), '([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)', 1),
  lambda r: CASE WHEN left(r, 1) = 'ß' THEN 'Ss' || lower(substr(r, 2)) ELSE upper(left(r, 1)) || lower(substr(r, 2)) END), '') AS artist FROM precomputed""")
def artist_title(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "precomputed").select("row_id", T.artist_title(F.col("artist")).alias("artist"))


@query("SELECT raw_id, human_caption_hq[2].turn_value AS caption FROM raw_image_text WHERE len(human_caption_hq) > 1")
def chat_caption(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("human_caption_hq")
    return _raw(spark, folder).where(F.size(c) > 1).select("raw_id", F.try_element_at(c, F.lit(2))["turn_value"].alias("caption"))


@query(f"WITH {CAPS} SELECT raw_id, len(captions) AS n_captions, coalesce(array_to_string(captions, '|'), '') AS captions FROM clean")
def caption_assembly(spark: SparkSession, folder: str) -> DataFrame:
    raw = _raw(spark, folder)
    captions = prepare.caption_list(raw, ["caption_text", "human_caption_hq"])
    return raw.select("raw_id", captions.alias("c")).select("raw_id", F.size("c").cast("long").alias("n_captions"), F.array_join("c", "|").alias("captions"))


@query(f"WITH {NEAR} SELECT raw_id, b AS resolution_bucket_id, bw AS width, bh AS height FROM near")
def bucket_assign(spark: SparkSession, folder: str) -> DataFrame:
    found = _raw(spark, folder).select("raw_id", buckets.nearest(F.col("width"), F.col("height"), BUCKETS).alias("b")).where("b is not null")
    return found.select("raw_id", F.col("b.bucket_id").alias("resolution_bucket_id"), "b.width", "b.height")


@query("""SELECT raw_id, b.resolution_bucket_id AS resolution_bucket_id FROM (SELECT raw_id, min({'d': abs(w::DOUBLE / h - width::DOUBLE / height), 'resolution_bucket_id': id}) AS b
  FROM raw_image_text, (SELECT resolution_bucket_id AS id, width AS w, height AS h FROM resolution_bucket) WHERE width > 0 AND height > 0 GROUP BY raw_id)""")
def bucket_assign_table(spark: SparkSession, folder: str) -> DataFrame:
    """Against the bucket table, which becomes literals of the plan (48 rows)."""
    rows = table(spark, folder, "resolution_bucket").orderBy("resolution_bucket_id").collect()
    near = buckets.nearest(F.col("width"), F.col("height"), {r["resolution_bucket_id"]: (r["width"], r["height"]) for r in rows})
    return _raw(spark, folder).select("raw_id", near["bucket_id"].alias("resolution_bucket_id")).where("resolution_bucket_id is not null")


@query(f"SELECT raw_id FROM raw_image_text WHERE NOT coalesce(lang IS NOT NULL AND lang <> 'zh' AND {U.format('raw_id', 42)} < 0.8, FALSE)")
def filter_language(spark: SparkSession, folder: str) -> DataFrame:
    return _raw(spark, folder).where(~filters.language_drop(F.col("lang"), F.col("raw_id"), 0.8)).select("raw_id")


@query(f"WITH {NEAR} SELECT raw_id FROM raw_image_text LEFT JOIN near USING (raw_id) WHERE NOT coalesce(width > 1 AND height > 1 AND (width < bw * 1.5 OR height < bh * 1.5), FALSE)")
def filter_resolution(spark: SparkSession, folder: str) -> DataFrame:
    near = buckets.nearest(F.col("width"), F.col("height"), BUCKETS)
    return _raw(spark, folder).where(~filters.resolution_drop(F.col("width"), F.col("height"), near, 1.5)).select("raw_id")


@query(f"""SELECT row_id, len(list_filter(coalesce(captions, []), lambda c: {TOKENS.format('c')} > 1)) = 0 AS too_short, len(list_filter(coalesce(captions, []), lambda c: {TOKENS.format('c')} > 60)) > 0 AS too_long FROM precomputed""")
def filter_caption_length(spark: SparkSession, folder: str) -> DataFrame:
    c = F.coalesce("captions", F.array().cast("array<string>"))
    return table(spark, folder, "precomputed").select("row_id", filters.too_short(c, 1).alias("too_short"), filters.too_long(c, 60).alias("too_long"))


@query("SELECT raw_id FROM raw_image_text WHERE NOT coalesce(aesthetic_score < 5.0 AND NOT isnan(aesthetic_score), FALSE)")
def filter_quality(spark: SparkSession, folder: str) -> DataFrame:
    return _raw(spark, folder).where(~filters.score_drop(F.col("aesthetic_score"), 5.0)).select("raw_id")


@query("SELECT raw_id, NOT coalesce(pwatermark > 0.6 AND NOT isnan(pwatermark), FALSE) AS kept, NOT coalesce(pwatermark > 0.5 AND NOT isnan(pwatermark), FALSE) AS kept_by_mark FROM raw_image_text")
def filter_watermark(spark: SparkSession, folder: str) -> DataFrame:
    """Both kinds of mark: a probability and, made from it, a boolean."""
    raw = _raw(spark, folder).withColumn("mark", (F.col("pwatermark") > 0.5) & ~F.isnan("pwatermark"))
    return raw.select("raw_id", (~filters.watermark_drop(raw, "pwatermark", 0.6)).alias("kept"), (~filters.watermark_drop(raw, "mark", 0.6)).alias("kept_by_mark"))


@query(f"WITH {REASONS} SELECT raw_id, array_to_string(captions, '|') AS captions, b AS resolution_bucket_id FROM reasons WHERE reason IS NULL AND b IS NOT NULL")
def prepare_dataset(spark: SparkSession, folder: str) -> DataFrame:
    kept = prepare.survivors(_prepared(spark, folder), "raw_id")
    return kept.select("raw_id", F.array_join("captions", "|").alias("captions"), "resolution_bucket_id")


@query(f"WITH {REASONS} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n_rows FROM reasons GROUP BY 1")
def drop_report(spark: SparkSession, folder: str) -> DataFrame:
    return filters.drop_report(_prepared(spark, folder))


#: A fetcher and decoder that depend on the address only, as there is no network: by the first digit of its md5 the fetch times out (0), fails (1), finds nothing (2), finds no picture (3), or a picture that cannot be resized (4).
_SIZE = "(150 + ('0x' || substr(md5(url), {0}, 2))::INT * 2)"
_LATE = f"""pos AS (SELECT raw_id, (row_number() OVER (ORDER BY raw_id) - 1)::BIGINT AS pos FROM raw_image_text),
size AS (SELECT raw_id, url, {_SIZE.format(3)} AS dw, {_SIZE.format(5)} AS dh, substr(md5(url), 1, 1) AS f FROM raw_image_text),
post AS (SELECT raw_id, b AS pb, bw AS pw, bh AS ph FROM (SELECT raw_id, b, bw, bh, row_number() OVER (PARTITION BY raw_id ORDER BY abs(bw::DOUBLE / bh - dw::DOUBLE / dh), k) AS r FROM size, (VALUES {_B}) AS bk(b, k, bw, bh)) WHERE r = 1),
late AS (SELECT raw_id, pos, captions, pb, coalesce(reason, CASE WHEN url IS NULL THEN 'invalid_image' WHEN f = '0' THEN 'fetch_timeout' WHEN f = '1' THEN 'fetch_error' WHEN f IN ('2', '3') THEN 'invalid_image' WHEN f = '4' THEN 'bucket_error'
  WHEN dw < pw * 0.7 OR dh < ph * 0.7 THEN 'resolution_post' END) AS reason FROM reasons JOIN pos USING (raw_id) JOIN size USING (raw_id) JOIN post USING (raw_id)),
fails AS (SELECT pos // 50 AS batch_no, pb FROM late WHERE reason IS NULL GROUP BY 1, 2 HAVING min(raw_id) % 9 = 0),
done AS (SELECT raw_id, pos, captions, pos // 50 AS batch_no, late.pb, CASE WHEN reason IS NULL AND fails.pb IS NOT NULL THEN 'encode_error' ELSE reason END AS reason FROM late LEFT JOIN fails ON fails.batch_no = pos // 50 AND fails.pb = late.pb)"""


def _fetch(url: str) -> bytes | None:
    first = md5(url.encode()).hexdigest()[0]
    if first == "0":
        raise TimeoutError(url)
    if first == "1":
        raise OSError(url)
    return None if first == "2" else url.encode()


def _decode(content: bytes) -> tuple[int, int]:
    digits = md5(content).hexdigest()
    if digits[0] == "3":
        raise ValueError("no picture")
    return tuple(150 + int(digits[k : k + 2], 16) * 2 for k in (2, 4))


def _encode(rows: pd.DataFrame) -> list:
    if rows["raw_id"].min() % 9 == 0:
        raise RuntimeError("the encoder fails")
    return [[float(len(c)) for c in captions] for captions in rows["captions"]]


def _encoded(spark: SparkSession, folder: str) -> DataFrame:
    placed = algebra.with_position(_raw(spark, folder), "raw_id")
    prepared = prepare.prepared(placed, "raw_id", ["caption_text", "human_caption_hq"], BUCKETS, LIMITS).select("raw_id", "pos", "url", "captions", "bucket", "drop_reason")
    got = readers.fetched(prepared, "url", _fetch, _decode).drop("content")
    resized = got.withColumn("status", F.when((F.col("status") == "ok") & F.md5("url").startswith("4"), "resize_error").otherwise(F.col("status")))
    return prepare.encode_groups(prepare.fetch_outcomes(resized, BUCKETS, 0.7), _encode, "pos")


@query(f"WITH {REASONS}, {_LATE} SELECT batch_no::BIGINT AS batch_no, coalesce(reason, 'kept') AS reason, count(*) AS n_rows FROM done GROUP BY 1, 2")
def drop_report_batches(spark: SparkSession, folder: str) -> DataFrame:
    """All reasons, from captions to encoding, for each batch of 50 records."""
    return filters.drop_report(_encoded(spark, folder), by=["batch_no"])


@query(f"WITH {REASONS}, {_LATE} SELECT (row_number() OVER (ORDER BY pos) - 1)::BIGINT AS place, raw_id, pb AS resolution_bucket_id, coalesce(list_sum(list_transform(captions, lambda c: length(c))), 0)::DOUBLE AS latent_sum FROM done WHERE reason IS NULL")
def prepare_ordered(spark: SparkSession, folder: str) -> DataFrame:
    """The records that are left after encoding, in the order of the input."""
    kept = _encoded(spark, folder).where("drop_reason is null").select("pos", "raw_id", F.col("bucket.bucket_id").alias("resolution_bucket_id"), F.aggregate("latents", F.lit(0.0), lambda a, x: a + x).alias("latent_sum"))
    return prepare.ordered(kept, "pos").select("place", "raw_id", "resolution_bucket_id", "latent_sum")


@query("SELECT row_id, data_split FROM precomputed ORDER BY row_id LIMIT 500")
def head_range(spark: SparkSession, folder: str) -> DataFrame:
    return readers.split_head(table(spark, folder, "precomputed"), "row_id", "train[:500]").select("row_id", "data_split")


@query("SELECT row_id, resolution_bucket_id, len(captions) AS n_captions FROM precomputed")
def keep_columns(spark: SparkSession, folder: str) -> DataFrame:
    kept = table(spark, folder, "precomputed").select("row_id", "captions", "resolution_bucket_id")
    return kept.select("row_id", "resolution_bucket_id", F.when(F.col("captions").isNotNull(), F.size("captions")).cast("long").alias("n_captions"))


@query("SELECT 'has_' || c AS item, (c IN (SELECT column_name FROM (DESCRIBE precomputed)))::BIGINT AS n FROM (VALUES ('latents'), ('captions'), ('resolution_bucket_id'), ('prompt')) AS t(c) UNION ALL SELECT 'rows', count(*) FROM precomputed")
def basic_info(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "precomputed")
    wanted = ("latents", "captions", "resolution_bucket_id", "prompt")
    missing = set(profile.missing_columns(df, wanted))
    flags = spark.createDataFrame([(f"has_{c}", int(c not in missing)) for c in wanted], "item string, n long")
    return flags.union(df.agg(F.lit("rows").alias("item"), F.count(F.lit(1)).alias("n")))


@query("SELECT row_id, data_split FROM precomputed WHERE data_split <> 'train' UNION ALL SELECT row_id, data_split FROM precomputed WHERE data_split = 'train'")
def concat_union(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "precomputed").select("row_id", "data_split")
    return algebra.union_all([df.where("data_split <> 'train'"), df.where("data_split = 'train'")])


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dedup_first(spark: SparkSession, folder: str) -> DataFrame:
    return algebra.first_of_each(table(spark, folder, "documents").select("doc_id", "lang", "text"), ["text"], "doc_id").select("doc_id", "lang")


@query("SELECT row_id, (CASE data_split WHEN 'train' THEN 0 WHEN 'eval' THEN 1 ELSE 2 END)::INT AS dataset_id FROM precomputed WHERE data_split IN ('train', 'eval', 'test')")
def mix_tagged(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "precomputed").select("row_id", "data_split")
    return algebra.tagged_union([df.where(F.col("data_split") == s) for s in ("train", "eval", "test")]).select("row_id", "dataset_id")


@query("""SELECT mix_id, dataset_id, round(coalesce(weight, 1.0) / sum(coalesce(weight, 1.0)) OVER (PARTITION BY mix_id), 9) AS share,
  regexp_extract(regexp_replace(path, '/+$', ''), '([^/]*)$', 1) AS alias FROM dataset_entry""")
def mix_weights(spark: SparkSession, folder: str) -> DataFrame:
    entries = table(spark, folder, "dataset_entry").select("mix_id", "dataset_id", F.coalesce("weight", F.lit(1.0)).alias("w"), F.regexp_extract(F.regexp_replace("path", "/+$", ""), "([^/]*)$", 1).alias("alias"))
    sums = entries.groupBy("mix_id").agg(F.sum("w").alias("all_w"))
    return entries.join(sums, "mix_id").select("mix_id", "dataset_id", F.round(F.col("w") / F.col("all_w"), 9).alias("share"), "alias")


@query("SELECT resolution_bucket_id, count(*) AS n_rows, round(count(*) * 100.0 / (SELECT count(*) FROM precomputed), 9) AS percent FROM precomputed GROUP BY 1")
def bucket_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return profile.distribution(table(spark, folder, "precomputed"), "resolution_bucket_id").withColumn("percent", F.round("percent", 9))


@query("SELECT round(avg(len(captions)), 9) AS mean_size, min(len(captions))::INT AS least, max(len(captions))::INT AS most FROM precomputed")
def caption_stats(spark: SparkSession, folder: str) -> DataFrame:
    return profile.list_sizes(table(spark, folder, "precomputed"), "captions").withColumn("mean_size", F.round("mean_size", 9))


@query("""WITH v AS (SELECT unnest(latents)::DOUBLE AS v FROM (SELECT latents FROM precomputed ORDER BY row_id LIMIT 1000)), g AS (SELECT v, isfinite(v) AS ok FROM v)
SELECT count(*) FILTER (ok) AS n, round(min(v) FILTER (ok), 6) AS least, round(max(v) FILTER (ok), 6) AS most, round(avg(v) FILTER (ok), 6) AS mean, round(stddev_samp(v) FILTER (ok), 6) AS std FROM g""")
def latent_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Over the first 1000 rows, as the feature asks."""
    first = algebra.head(table(spark, folder, "precomputed").select("row_id", "latents"), "row_id", 1000)
    stats = profile.value_statistics(first, "latents")
    return stats.select("n", *[F.round(c, 6).alias(c) for c in ("least", "most", "mean", "std")])


@query("SELECT (i // 4)::INT AS channel, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std FROM (SELECT unnest(latents)::DOUBLE AS x, unnest(range(len(latents))) AS i FROM precomputed WHERE latents IS NOT NULL) WHERE isfinite(x) GROUP BY 1")
def channel_stats(spark: SparkSession, folder: str) -> DataFrame:
    stats = profile.channel_statistics(table(spark, folder, "precomputed"), "latents", 4)
    return stats.select("channel", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


_CHANNEL = "((i // 4 - 5) / 30.0::DOUBLE)", "((5 + i // 4) / 30.0::DOUBLE)"


@query(f"SELECT (i // 4)::INT AS channel, round(avg((x - {_CHANNEL[0]}) / {_CHANNEL[1]}), 5) AS mean, round(stddev_samp((x - {_CHANNEL[0]}) / {_CHANNEL[1]}), 5) AS std FROM (SELECT unnest(latents)::DOUBLE AS x, unnest(range(len(latents))) AS i FROM precomputed WHERE latents IS NOT NULL) WHERE isfinite(x) GROUP BY 1")
def scaled_latent_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Of latents scaled by the means and deviations of their channels."""
    means, stds = [(c - 5) / 30 for c in range(16)], [(5 + c) / 30 for c in range(16)]
    stats = profile.channel_statistics(table(spark, folder, "precomputed"), "latents", 4, means, stds)
    return stats.select("channel", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


@query("SELECT coalesce(bool_or(isnan(v)), FALSE) AS has_nan, coalesce(bool_or(isinf(v)), FALSE) AS has_inf FROM (SELECT unnest(latents) AS v FROM precomputed)")
def nonfinite_flags(spark: SparkSession, folder: str) -> DataFrame:
    return profile.value_statistics(table(spark, folder, "precomputed"), "latents").select("has_nan", "has_inf")


@query(f"SELECT row_id, (row_number() OVER (ORDER BY {U.format('row_id', 42)}, row_id) - 1)::BIGINT AS pos FROM precomputed")
def seeded_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "precomputed").select("row_id", F.struct(uniform(F.col("row_id"), 42).alias("u"), "row_id").alias("_key"))
    return algebra.with_position(df, "_key").select("row_id", "pos")


@query(f"SELECT row_id FROM precomputed ORDER BY {U.format('row_id', 7)}, row_id LIMIT 100")
def sample_k(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "precomputed").select("row_id")
    return df.orderBy(uniform(F.col("row_id"), 7), "row_id").limit(100)


def _picked(df: DataFrame) -> Column:
    return T.second_or_first(F.col("captions"))


@query("""SELECT row_id, CASE WHEN len(captions) > 1 THEN captions[2] ELSE captions[1] END AS light, CASE WHEN coalesce(captions[2], '') <> '' THEN captions[2] ELSE captions[1] END AS heavy FROM precomputed WHERE captions IS NOT NULL""")
def prompt_pick(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "precomputed").where("captions is not null")
    return df.select("row_id", T.second_or_first(F.col("captions")).alias("light"), T.second_or_first(F.col("captions"), skip_empty=True).alias("heavy"))


@query(f"""SELECT row_id, CASE WHEN len(captions) = 0 THEN '' ELSE array_to_string(list_transform(range(least(len(captions), 2)), lambda i: (i + 1)::VARCHAR || '. ' || regexp_replace(replace(coalesce(captions[i + 1], '-'), chr(10), ' '), '^[{_S}]+|[{_S}]+$', '', 'g')), chr(10) || chr(10))
  || CASE WHEN len(captions) > 2 THEN chr(10) || chr(10) || '... (+' || (len(captions) - 2)::VARCHAR || ' more)' ELSE '' END END AS prompts FROM precomputed WHERE captions IS NOT NULL""")
def prompt_caption_list(spark: SparkSession, folder: str) -> DataFrame:
    filled = F.transform("captions", lambda c: F.coalesce(c, F.lit("-")))
    return table(spark, folder, "precomputed").where("captions is not null").select("row_id", T.numbered_prompts(filled, 2).alias("prompts"))


@query(f"SELECT raw_id, md5('{_Q(T.CHAT.replace('{system}', T.SYSTEM_PROMPT).split('{user}')[0])}' || caption_text || '{_Q(T.CHAT.split('{user}')[1])}') AS prompt FROM raw_image_text")
def chat_prompt(spark: SparkSession, folder: str) -> DataFrame:
    return _raw(spark, folder).select("raw_id", F.md5(T.chat_prompt(F.col("caption_text"))).alias("prompt"))


@query("SELECT raw_id FROM raw_image_text WHERE raw_id NOT IN (SELECT raw_id FROM precomputed WHERE raw_id IS NOT NULL)")
def pending_work(spark: SparkSession, folder: str) -> DataFrame:
    return readers.pending(_raw(spark, folder), table(spark, folder, "precomputed"), "raw_id").select("raw_id")


@query("""SELECT raw_id, array_to_string(p[1:2], '/') AS place, array_to_string(p[3:], '/') AS file FROM (SELECT raw_id, url, string_split(substr(url, 9), '/') AS p FROM raw_image_text)
WHERE starts_with(url, 'https://') AND len(p) > 2""")
def location_parts(spark: SparkSession, folder: str) -> DataFrame:
    found = _raw(spark, folder).select("raw_id", T.location_parts(F.col("url"), "https://").alias("p")).where("p is not null")
    return found.select("raw_id", "p.place", "p.file")


@query("SELECT resolution_bucket_id, printf('bucket%d_%dx%d', resolution_bucket_id, height, width) AS name, printf('step_%06d', resolution_bucket_id * 125) AS step FROM resolution_bucket")
def file_names(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "resolution_bucket")
    return df.select("resolution_bucket_id", T.bucket_name(F.col("resolution_bucket_id"), F.col("width"), F.col("height")).alias("name"), T.step_name(F.col("resolution_bucket_id") * 125).alias("step"))


@query("SELECT count(DISTINCT b) AS n_blocks, max(b) + 1 AS depth FROM (SELECT resolution_bucket_id % 28 AS b FROM resolution_bucket)")
def state_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Block count and depth from parameter names made of the bucket table."""
    keys = table(spark, folder, "resolution_bucket").select(F.concat(F.lit("module.single_blocks."), (F.col("resolution_bucket_id") % 28).cast("string"), F.lit(".norm.weight")).alias("key"))
    return keys.select(T.block_of(F.col("key"), "single_blocks").alias("b")).agg(F.count_distinct("b").alias("n_blocks"), (F.max("b") + 1).alias("depth"))
