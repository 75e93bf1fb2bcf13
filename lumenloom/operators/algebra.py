"""Dataset algebra: positions, heads, unions, mixing, first-wins duplicates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.operators.skew import join_hot_keys_apart
from lumenloom.session import cut_lineage

_IN_PARTITION = (1 << 33) - 1


def with_position(df: DataFrame, key: str, name: str = "pos") -> DataFrame:
    """df with dense positions from 0 in the order of a key; null keys first, ties in any order.

    Rows are sorted by ranges and kept; a row's position is its place in its partition plus the rows of the partitions before. Only one count per
    partition reaches the driver.
    """
    ordered = cut_lineage(df.repartitionByRange(F.col(key)).sortWithinPartitions(key))
    numbered = ordered.withColumn("_n", F.monotonically_increasing_id())
    counts = sorted((r[0], r[1]) for r in numbered.groupBy(F.shiftright("_n", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, starts = 0, []
    for p, n in counts:
        starts.append((p, before))
        before += n
    if not starts:
        return ordered.withColumn(name, F.lit(0).cast("long"))
    # one row per partition
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "_p long, _start long"))
    placed = numbered.withColumn("_p", F.shiftright("_n", 33)).join(offsets, "_p")
    return placed.withColumn(name, F.col("_n").bitwiseAND(F.lit(_IN_PARTITION)) + F.col("_start")).drop("_n", "_p", "_start")


def place_in_group(df: DataFrame, groups: Sequence[str], pos: str, name: str = "place", step: int = 1 << 16) -> DataFrame:
    """df with each row's place, from 0, within its group in the order of a dense position.

    A group is numbered in steps of the position, each of which holds at most `step` rows, so no group is collected into one task
    however large it is. Null group values form groups.
    """
    slices = df.withColumn("_step", F.floor(F.col(pos) / F.lit(step)))
    counts = slices.groupBy(*groups, "_step").agg(F.count(F.lit(1)).alias("_n"))
    ahead = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*groups).orderBy("_step")) - F.col("_n")).drop("_n")
    keys = [*groups, "_step"]
    other = ahead.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_before")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    joined = slices.join(other, same).drop(*[f"_k{i}" for i in range(len(keys))])
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(pos)) - 1
    return joined.withColumn(name, F.col("_before") + inside).drop("_step", "_before")


def place_by(df: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str = "place") -> DataFrame:
    """df with each row's place, from 0, within its group in the order of any columns; the last of them should tell rows apart.

    All rows are sorted by ranges of group and order, whatever the size of a group; a place is a row's position less the first one of its group.
    """
    key = F.struct(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], *[c.alias(f"_o{i}") for i, c in enumerate(order)])
    placed = with_position(df.withColumn("_key", key), "_key", "_pos").drop("_key")
    if not groups:
        return placed.withColumnRenamed("_pos", name)
    firsts = placed.groupBy(*groups).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_count"))
    coded = [F.coalesce(F.col(g).cast("string"), F.lit("\x00")) for g in groups]
    one = firsts.select(F.concat_ws("\x01", *coded).alias("_group"), "_first", "_count")
    many = placed.withColumn("_group", F.concat_ws("\x01", *coded))
    return join_hot_keys_apart(many, one, ["_group"], "_count").withColumn(name, F.col("_pos") - F.col("_first")).drop("_pos", "_first", "_count", "_group")


def head(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows in the order of a key, or all if there are fewer."""
    return df.orderBy(key).limit(n)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of tables with the same columns, matched by name; differing columns are an error."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def tagged_union(parts: Sequence[DataFrame], name: str = "dataset_id") -> DataFrame:
    """All rows, each with the number of its table."""
    return union_all([df.withColumn(name, F.lit(i).cast("int")) for i, df in enumerate(parts)])


def first_of_each(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row, by order, of each combination of keys; nulls equal each other. Rows are combined before the shuffle, so frequent keys cost nothing."""
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in df.columns if c not in keys]), order).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


@dataclass(frozen=True)
class MixEntry:
    """A source of a mix."""

    path: str
    weight: float
    alias: str


def parse_mix(spec: str) -> list[MixEntry]:
    """'path[:weight] path[:weight]': weights default to 1 and are brought to a sum of 1; the alias is the last part of the path."""
    if not spec or not spec.strip():
        raise ValueError("the mix is empty")
    entries = []
    for part in spec.split():
        path, colon, number = part.rpartition(":")
        if not colon:
            path, number = part, "1"
        try:
            weight = float(number)
        except ValueError as e:
            raise ValueError(f"no weight: {number!r}") from e
        if not weight > 0:
            raise ValueError(f"weights must be above 0: {number!r}")
        entries.append((path, weight))
    total = sum(w for _, w in entries)
    return [MixEntry(path, weight / total, path.rstrip("/").rpartition("/")[2]) for path, weight in entries]
