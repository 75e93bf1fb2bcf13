"""Randomness that depends on ids and a seed only, never on partitions or engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPAN = float(1 << 52)


def uniform(key: Column, seed: int | str = 0) -> Column:
    """A number in [0, 1) from the first 52 bits of md5(key:seed); null for a null key."""
    text = F.concat(key.cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(_SPAN)


def normal(key: Column, seed: int | str = 0) -> Column:
    """A standard normal number, by Box and Muller from two uniform ones."""
    a, b = uniform(key, f"{seed}a"), uniform(key, f"{seed}b")
    return F.sqrt(-2 * F.ln(1 - a)) * F.cos(2 * F.pi() * b)
