"""The dataset preparation pipeline: captions, buckets, filters, encoding, projection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenloom.functions.text import clean_caption
from lumenloom.operators import buckets as B
from lumenloom.operators import filters as R
from lumenloom.operators.algebra import with_position


@dataclass(frozen=True)
class Limits:
    """Parameters of the filters."""

    language_probability: float = 0.0
    wanted_language: str = "zh"
    tolerance: float = 1.0
    least_tokens: int = 1
    most_tokens: int = 1024
    least_score: float = 0.0
    most_watermark: float = 0.6
    seed: int = 42


def caption_list(df: DataFrame, fields: list[str], text_fn: Callable[[Column], Column] | None = clean_caption) -> Column:
    """All captions of the given fields in their order, each passed through text_fn.

    What a field gives depends on its type, settled when the plan is made: a string itself; a list of strings its items; a conversation (list of structs
    with a speaker and a text) the text of its second turn, and nothing if it has one turn; a struct of captions the first of caption, captionEn, captionJp
    that is there. Null gives nothing.
    """
    parts = []
    for name in fields:
        if name not in df.columns:
            continue
        kind, c = df.schema[name].dataType, F.col(name)
        if isinstance(kind, T.StringType):
            parts.append(F.array(c))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            parts.append(F.coalesce(c, F.array().cast("array<string>")))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            value = kind.elementType.fieldNames()[-1]
            parts.append(F.array(F.try_element_at(c, F.lit(2))[value]))
        elif isinstance(kind, T.StructType):
            parts.append(F.array(F.coalesce(*[c[k] for k in ("caption", "captionEn", "captionJp") if k in kind.fieldNames()])))
        else:
            raise ValueError(f"{name} holds no captions")
    found = F.array_compact(F.concat(*parts)) if parts else F.array().cast("array<string>")
    return F.transform(found, text_fn) if text_fn else found


def prepared(df: DataFrame, key: str, fields: list[str], buckets: B.Buckets, limits: Limits = Limits(), text_fn: Callable[[Column], Column] | None = clean_caption) -> DataFrame:
    """df with captions, bucket and drop_reason (language, resolution, caption, score, watermark: the first that holds)."""
    none = F.lit(None)
    width, height = R.first_column(df, ["WIDTH", "width"], none.cast("int")), R.first_column(df, ["HEIGHT", "height"], none.cast("int"))
    label = R.first_column(df, ["LANGUAGE", "lang"], none.cast("string"))
    score = R.first_column(df, ["aesthetic_score", "aesthetic"], none.cast("double"))
    mark = next((n for n in ("watermark", "pwatermark") if n in df.columns), None)

    def judged(p: Column) -> Column:
        rules = [
            ("language", R.language_drop(label, F.col(key), limits.language_probability, limits.wanted_language, limits.seed)),
            ("resolution", R.resolution_drop(width, height, p["bucket"], limits.tolerance)),
            ("caption", R.too_short(p["captions"], limits.least_tokens) | R.too_long(p["captions"], limits.most_tokens)),
            ("score", R.score_drop(score, limits.least_score)),
            ("watermark", R.watermark_drop(df, mark, limits.most_watermark) if mark else F.lit(False)),
        ]
        return F.struct(p["captions"].alias("captions"), p["bucket"].alias("bucket"), R.drop_reason(rules).alias("drop_reason"))

    parts = F.struct(caption_list(df, fields, text_fn).alias("captions"), B.nearest(width, height, buckets).alias("bucket"))
    kept = [c for c in df.columns if c not in ("captions", "bucket", "drop_reason")]
    # made by a generator, so that captions and bucket are worked out once and no filter behind it is moved before it
    return df.select(*kept, F.inline(F.transform(F.array(parts), judged)))


def fetch_outcomes(df: DataFrame, buckets: B.Buckets, tolerance: float = 1.0, key: str = "pos", batch_size: int = 50) -> DataFrame:
    """df with batch_no, and with bucket and drop_reason as they are once pictures have been fetched; df has what prepared and fetched give.

    A record without a reason gets fetch_timeout, fetch_error or invalid_image by its status, resolution_post if the decoded picture is smaller than its
    nearest bucket, or bucket_error if it has no bucket or could not be resized (status resize_error). batch_no counts batches of the position in key.
    """
    near = F.when(F.col("status") == "ok", B.nearest(F.col("decoded_width"), F.col("decoded_height"), buckets))

    def judged(bucket: Column) -> Column:
        by_status = F.when(F.col("status") == "timeout", "fetch_timeout").when(F.col("status") == "error", "fetch_error").when(F.col("status") == "invalid", "invalid_image").when(F.col("status") == "resize_error", "bucket_error")
        late = F.when(bucket.isNull(), "bucket_error").when(B.too_small(F.col("decoded_width"), F.col("decoded_height"), bucket, tolerance), "resolution_post")
        return F.struct(bucket.alias("bucket"), F.coalesce(F.col("drop_reason"), by_status, late).alias("drop_reason"))

    kept = [F.col(c) for c in df.columns if c not in ("bucket", "drop_reason", "batch_no")]
    return df.select(*kept, F.floor(F.col(key) / F.lit(batch_size)).alias("batch_no"), F.inline(F.transform(F.array(near), judged)))


def encode_groups(df: DataFrame, encode: Callable[[pd.DataFrame], list], key: str) -> DataFrame:
    """df with latents and drop_reason after encode has been called for the kept records of each batch and bucket, in the order of key; if a call fails, its whole group is dropped (encode_error).

    encode gets the rows of a group, of which there are no more than a batch holds, and returns a list of values for each.
    """
    schema = T.StructType([f for f in df.schema.fields if f.name not in ("drop_reason", "latents")] + [T.StructField("drop_reason", T.StringType()), T.StructField("latents", T.ArrayType(T.DoubleType()))])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows = part.sort_values(key)
        try:
            return rows.assign(latents=list(encode(rows)), drop_reason=None)[schema.names]
        except Exception:  # noqa: BLE001
            return rows.assign(latents=None, drop_reason="encode_error")[schema.names]

    dropped = df.where("drop_reason is not null")
    empty = F.lit(None).cast("array<double>").alias("latents")
    kept = df.where("drop_reason is null").withColumn("_bucket", F.col("bucket.bucket_id"))
    done = kept.groupBy("batch_no", "_bucket").applyInPandas(lambda part: run(part.drop(columns="_bucket")), schema)
    return done.unionByName(dropped.drop("latents").withColumn("latents", empty))


def ordered(df: DataFrame, key: str, name: str = "place") -> DataFrame:
    """df with places from 0 in the order of key: the input's order among the records that are left."""
    return with_position(df, key, name)


def survivors(df: DataFrame, key: str, encode: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """key, captions, resolution_bucket_id of the kept records; encode may add columns, as a latent, and drop records."""
    kept = df.where("drop_reason is null and bucket is not null")
    kept = encode(kept) if encode else kept
    extra = [c for c in ("latents",) if c in kept.columns]
    return kept.select(key, *extra, "captions", F.col("bucket.bucket_id").alias("resolution_bucket_id"))
