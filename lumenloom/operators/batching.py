"""Rank shards, bucketed batches, epoch lengths and weighted schedules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.functions.hashing import uniform
from lumenloom.operators.algebra import place_by, place_in_group, with_position
from lumenloom.session import written

#: Slots of a schedule that one row is expanded to at once.
SLOTS = 1 << 16


def rank_of(pos: Column, replicas: int) -> Column:
    """The rank that takes a position when positions are dealt out in turn."""
    return F.pmod(pos, F.lit(replicas))


def shard(df: DataFrame, pos: str, replicas: int, rank: int) -> DataFrame:
    return df.where(rank_of(F.col(pos), replicas) == rank)


def batches(df: DataFrame, groups: Sequence[str], pos: str, size: int, drop_last: bool = True) -> DataFrame:
    """df with the number of each row's batch within its group; incomplete batches are left out unless drop_last is false."""
    placed = place_in_group(df, groups, pos, "_place").withColumn("batch_no", F.floor(F.col("_place") / F.lit(size)))
    if drop_last:
        sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_size"))
        other = sizes.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], "_size")
        same = F.lit(True)
        for i, g in enumerate(groups):
            same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
        placed = placed.join(other, same).where((F.col("batch_no") + 1) * size <= F.col("_size")).drop("_size", *[f"_g{i}" for i in range(len(groups))])
    return placed.drop("_place")


def epoch_length(df: DataFrame, groups: Sequence[str], size: int, by: Sequence[str] = ()) -> DataFrame:
    """n_batches: full batches over all groups, for each value of by."""
    return df.groupBy(*by, *groups).agg(F.floor(F.count(F.lit(1)) / F.lit(size)).alias("n")).groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_batches"))


def index_lists(df: DataFrame, group: str, pos: str, size: int = 1024) -> DataFrame:
    """group, part_no, positions: the positions of each group in order, in lists of a bounded length, so that no group is one value."""
    placed = place_in_group(df.select(group, pos), [group], pos, "_place")
    return placed.groupBy(group, F.floor(F.col("_place") / F.lit(size)).alias("part_no")).agg(F.array_sort(F.collect_list(pos)).alias("positions"))


def collate(df: DataFrame, batch: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """One row per batch with its rows in order; batches whose first column has lists of different lengths are an error of the data and give null."""
    first = columns[0]
    grouped = df.groupBy(*batch).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("rows"), F.count_distinct(F.size(first)).alias("_shapes"))
    return grouped.select(*batch, F.when(F.col("_shapes") <= 1, F.col("rows")).alias("rows"))


def epoch_batches(df: DataFrame, groups: Sequence[str], key: str, size: int, epoch: int, seed: int = 42, drop_last: bool = True) -> DataFrame:
    """df with batch_no: batches of each group whose rows are shuffled anew for every epoch; incomplete ones are left out unless drop_last is false."""
    placed = place_by(df, groups, [uniform(F.col(key), f"{seed}:{epoch}"), F.col(key)], "_place")
    numbered = placed.withColumn("batch_no", F.floor(F.col("_place") / F.lit(size))).drop("_place")
    if not drop_last:
        return numbered
    sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_size")).select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], "_size")
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)], F.lit(True))
    return numbered.join(sizes, same).where((F.col("batch_no") + 1) * size <= F.col("_size")).drop("_size", *[f"_g{i}" for i in range(len(groups))])


def batch_order(batches: DataFrame, batch: Sequence[str], epoch: int, seed: int = 42) -> DataFrame:
    """<batch>, order_no: the batches of an epoch in an order of its own. batches has a row for each."""
    name = F.concat_ws(":", *[F.coalesce(F.col(b).cast("string"), F.lit("null")) for b in batch])
    return with_position(batches.withColumn("_key", F.struct(uniform(name, f"{seed}:{epoch}").alias("u"), name.alias("name"))), "_key", "order_no").drop("_key")


def weighted_schedule(counts: DataFrame, weights: DataFrame, mix: str = "mix_id", source: str = "dataset_id", n: str = "n_batches", weight: str = "weight", seed: int = 42) -> DataFrame:
    """mix, slot, source, pass_no, batch_no: which batch of which source each step of an epoch of each mix takes.

    There are as many slots as batches of all sources. Each slot takes a source by weight among those of the mix with batches; the k-th slot of a source is in pass k div n, in
    which its batches come in an order of that pass, so a source that runs out is shuffled again. counts has a row per source, weights one per mix and source. Sources without
    batches or weight take no part; a mix without any has no slots.
    """
    usable = weights.select(mix, source, weight).join(counts.select(source, n), source).where((F.col(n) > 0) & (F.col(weight) > 0))
    upto = Window.partitionBy(mix).orderBy(source)
    cum = usable.withColumn("cum", F.sum(weight).over(upto) / F.sum(weight).over(Window.partitionBy(mix)))
    # a row per mix; a mix has as many entries as it has sources
    choice = cum.groupBy(mix).agg(F.array_sort(F.collect_list(F.struct(source, "cum", n))).alias("sources"))
    slots = counts.agg(F.coalesce(F.sum(n), F.lit(0))).scalar()
    dealt = choice.withColumn("slots", slots).where("slots > 0").select(mix, "sources", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / SLOTS))).alias("part"), "slots")
    dealt = dealt.select(mix, "sources", F.explode(F.sequence(F.col("part") * SLOTS, F.least((F.col("part") + 1) * SLOTS, F.col("slots")) - 1)).alias("slot"))
    u = uniform(F.concat_ws(":", F.col(mix).cast("string"), F.col("slot").cast("string")), seed)
    taken = F.coalesce(F.get(F.filter("sources", lambda s: F.col("_u") < s["cum"]), F.lit(0)), F.element_at("sources", -1))
    dealt = dealt.withColumn("_u", u).withColumn("_s", taken).select(mix, "slot", F.col("_s")[source].alias(source), F.col("_s")[n].alias("_n"))
    placed = written(place_in_group(dealt, [mix, source], "slot", "k").select(mix, "slot", source, F.floor(F.col("k") / F.col("_n")).alias("pass_no"), (F.col("k") % F.col("_n")).alias("_place"), "_n"))
    # the order of the batches of each source in each pass
    passes = placed.groupBy(source).agg(F.max("pass_no").alias("last"), F.max("_n").alias("_n"))
    each = passes.select(source, F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("pass_no"), "_n").select(source, "pass_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("batch_no"))
    name = F.concat_ws(":", *[F.col(c).cast("string") for c in (source, "pass_no", "batch_no")])
    order = place_by(each, [source, "pass_no"], [uniform(name, seed), F.col("batch_no")], "_place")
    return placed.join(order, [source, "pass_no", "_place"]).select(mix, "slot", source, "pass_no", "batch_no")


def keep_one_per_batch(df: DataFrame, batch: Sequence[str], key: str, probability: float, seed: int = 42) -> DataFrame:
    """df with dropped: each row with a probability, but of a batch all of whose rows would go the one with the smallest hash stays."""
    u = uniform(F.col(key), seed)
    w = Window.partitionBy(*batch)
    marked = df.withColumn("_u", u).withColumn("_all", F.min(F.col("_u") < probability).over(w) & (F.row_number().over(w.orderBy("_u", key)) == 1))
    return marked.withColumn("dropped", (F.col("_u") < probability) & ~F.col("_all")).drop("_u", "_all")
