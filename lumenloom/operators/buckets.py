"""Resolution buckets: parsing, checking and nearest-bucket assignment."""

from __future__ import annotations

import ast

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenloom.functions.kernels import let

Buckets = dict[int, tuple[int, int]]


def parse_sizes(spec: str) -> Buckets:
    """'WxH,WxH' to {1: (W, H), ...}."""
    return {i: tuple(int(v) for v in part.lower().split("x")) for i, part in enumerate((p.strip() for p in spec.split(",")), 1)}


def parse_pairs(spec: str, offset: int = 0) -> Buckets:
    """A list literal of pairs, or 'w,h w,h'; ids start at 1 + offset. Items of a list that are no pairs are skipped but use up an id."""
    text = spec.strip()
    if text.startswith("["):
        try:
            items = ast.literal_eval(text)
        except (SyntaxError, ValueError) as e:
            raise ValueError(f"no list of pairs: {spec!r}") from e
        out = {i + offset: (int(x[0]), int(x[1])) for i, x in enumerate(items, 1) if isinstance(x, list | tuple) and len(x) == 2}
    else:
        out = {}
        for i, part in enumerate(text.split(), 1):
            sides = part.split(",")
            if len(sides) != 2:
                raise ValueError(f"no pair: {part!r}")
            out[i + offset] = (int(sides[0]), int(sides[1]))
    if not out:
        raise ValueError("no buckets")
    return out


def usable(buckets: Buckets) -> Buckets:
    """The buckets with a positive height, in their order; an error if there is none."""
    out = {i: (w, h) for i, (w, h) in buckets.items() if h > 0}
    if not out:
        raise ValueError("no bucket with a positive height")
    return out


def nearest(width: Column, height: Column, buckets: Buckets, strict: bool = False) -> Column:
    """struct(distance, place, bucket_id, width, height) of the bucket with the nearest aspect ratio, the first listed of equally near ones.

    The buckets are literals of the plan, so nothing is joined, and distances are worked out once a row. Null where a side is null or not positive, or,
    if strict, an error.
    """
    known = usable(buckets)
    ids, widths, heights = (F.array(*[F.lit(v).cast("int") for v in values]) for values in (known, [w for w, _ in known.values()], [h for _, h in known.values()]))
    distances = lambda aspect: F.array(*[F.abs(F.lit(w / h) - aspect) for w, h in known.values()])

    def chosen(d: Column) -> Column:
        place = lambda k: F.struct(F.get(d, k).alias("distance"), k.alias("place"), F.get(ids, k).alias("bucket_id"), F.get(widths, k).alias("width"), F.get(heights, k).alias("height"))
        return let((F.array_position(d, F.array_min(d)) - 1).cast("int"), place)

    found = F.when((width > 0) & (height > 0), let(width / height, lambda aspect: let(distances(aspect), chosen)))
    return F.coalesce(found, F.raise_error(F.lit("no bucket for a picture without positive sides"))) if strict else found


def too_small(width: Column, height: Column, bucket: Column, tolerance: float) -> Column:
    """Whether a decoded picture falls short of its bucket on a side."""
    return (width < bucket["width"] * tolerance) | (height < bucket["height"] * tolerance)
