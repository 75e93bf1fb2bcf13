"""Joins and aggregations that stay balanced when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.session import cut_lineage

#: Rows of a key that one task may be given; a key with more is split.
ROWS_OF_A_KEY = 1 << 20


def join_hot_keys_apart(many: DataFrame, one: DataFrame, keys: Sequence[str], count_col: str, how: str = "inner", rows: int = ROWS_OF_A_KEY) -> DataFrame:
    """Join many to one on keys that are unique in one, without sending all rows of a hot key to one task.

    count_col of one tells how many rows of many have the key. A key with more than `rows` of them is split by measured size: its row of
    one is repeated ceil(count / rows) times under salts, and rows of many draw a salt by a hash of themselves. many is read
    once. What is broadcast are the keys that are split, of which there are at most (rows of many) / rows; one million rows of data make
    one row of broadcast at most. A null key never matches; with how="left" rows of many without a partner are kept.
    """
    keys = list(keys)
    parts = F.ceil(F.col(count_col) / F.lit(rows)).cast("int")
    split = one.where(F.col(count_col) > rows).select(*keys, parts.alias("_parts"))
    others = [c for c in many.columns if c not in keys]
    own = F.xxhash64(*others) if others else F.monotonically_increasing_id()
    null_key = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    salted = many.join(F.broadcast(split), keys, "left").withColumn("_salt", F.when(null_key, F.pmod(own, F.lit(4096))).otherwise(F.pmod(own, F.coalesce("_parts", F.lit(1)))).cast("int")).drop("_parts")
    spread = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    value_cols = [c for c in one.columns if c not in keys]
    return salted.join(spread, [*keys, "_salt"], how).select(*many.columns, *value_cols)


def join_members(members: DataFrame, other: DataFrame, keys: Sequence[str], size_col: str, member: str, rows: int = ROWS_OF_A_KEY) -> DataFrame:
    """Inner join of the members of groups to rows that name a group, where both may have many rows of a key; both tell in size_col how many members a group has.

    Members of a large group are spread over ceil(size / rows) tasks by a hash of the column member, and rows of other are repeated in each. size_col is left out.
    """
    parts = F.ceil(F.col(size_col) / F.lit(rows)).cast("int")
    spread = members.withColumn("_salt", F.pmod(F.xxhash64(member), parts).cast("int")).drop(size_col)
    return spread.join(other.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop(size_col), [*keys, "_salt"]).drop("_salt")


def salted_aggregate(df: DataFrame, keys: Sequence[str], partials: dict[str, Column], finals: dict[str, Column], salts: int = 32) -> DataFrame:
    """Aggregate in two steps, first by key and salt, then by key, for aggregates that Spark cannot combine before its shuffle.

    partials: name -> aggregate over the rows of a key and salt. finals: name -> aggregate over those partial columns.
    Null keys form a group of their own, as in a plain groupBy.
    """
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).alias("_salt")
    first = df.select("*", salt).groupBy(*keys, "_salt").agg(*[c.alias(n) for n, c in partials.items()])
    return first.groupBy(*keys).agg(*[c.alias(n) for n, c in finals.items()])


def eager_join_aggregate(left: DataFrame, right: DataFrame, key: str, left_sums: dict[str, Column], right_sums: dict[str, Column], how: str = "inner") -> DataFrame:
    """Aggregate the join of left and right on key, without ever making the joined rows.

    Both inputs are aggregated by key first (Spark combines each before its shuffle, so a hot key sends one row per task),
    and their one-row states are joined. A sum over the joined rows is the sum of its own side times the row count of the
    other side; the number of joined rows is the product of the counts. Returns key, left_rows, right_rows, joined_rows and
    for each sum both the plain value and, as joined_<name>, its value over the joined rows.

    how: inner, left or full. Where a side has no row its count is 0 and its sums are null; joined values are then 0 or null
    as for an inner join, which has no such rows. Null keys never match each other; with left or full they keep a row of
    their own. Sums ignore nulls. Empty inputs give no rows.
    """
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("left_rows"), *[c.alias(n) for n, c in left_sums.items()])
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("right_rows"), *[c.alias(n) for n, c in right_sums.items()])
    n, m = F.coalesce("left_rows", F.lit(0)), F.coalesce("right_rows", F.lit(0))
    return a.join(b, key, how).select(
        key,
        n.alias("left_rows"),
        m.alias("right_rows"),
        (n * m).alias("joined_rows"),
        *[F.col(c) for c in (*left_sums, *right_sums)],
        *[(F.col(c) * m).alias(f"joined_{c}") for c in left_sums],
        *[(F.col(c) * n).alias(f"joined_{c}") for c in right_sums],
    )


def heavy_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """key, n_rows: the keys that hold more than share of all rows. Null keys count in the total but are not returned.

    One counting pass, whose result (a row per key) is written; the total is the sum of the counts, so the table is read once.
    """
    return over_share(cut_lineage(df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))), key, "n_rows", share)


def over_share(counts: DataFrame, key: str, count_col: str, share: float) -> DataFrame:
    """The rows of a table of counts, one per key, that hold more than share of the sum; counts is used twice."""
    total = counts.agg(F.sum(count_col)).scalar()
    return counts.where(F.col(key).isNotNull() & (F.col(count_col) > F.lit(share) * total))
