"""Mixing sources to target weights (problem 1).

Each source of a mix has a target: its share of the mix's weights times the mix's size. Whole passes over the source fill
most of it; what is left is a budget that a subset of the source's records must meet. Records are counted by exact length,
and a bounded-knapsack search over those counts finds how many records of each length to take so that the budget is met as
nearly as possible; the records themselves are then chosen per length by a seeded hash.

The search begins at a proportional share of each length and looks for exchanges (some records of a length more or fewer)
that make up for what is missing. Sums that exchanges reach are bits of one integer, in a window about the start; states are kept only at
some lengths and worked out again on the way back, so memory is a window times the root of the number of lengths. If the budget is not met,
exchanges and window are widened until they hold all subsets, so that what is returned is the best there is, up to windows of MOST_BITS.

Sizes are rows (every record has length 1) or tokens. With rows the same search also steers the partial pass: of all ways to take
the missing number of rows it looks for one whose token total is the source's mean; it exchanges rows in pairs, up to the widest stage.

Null weights count as 1. Weights that are zero, negative or NaN give a target of 0. A source without rows gets nothing and its
actual share is 0. A null dataset_id names no rows. max_repeats null or below 0 counts as 0. (mix, source) is unique among the entries. Empty tables give no rows. Nothing is ever split over tasks by record: histograms have one row per source and
length, and a task of the search sees those of one source of one mix.
"""

from __future__ import annotations

import math
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.operators.skew import join_hot_keys_apart
from lumenloom.session import written

#: Records of a source and length in one step of their hashes; of each such group one step at most is ranked.
STEP_ROWS = 4096
#: Bits of the widest window of sums (16 MB); and records that may be exchanged of a length at the widest stage if their number stays the same.
MOST_BITS, WIDEST_PAIRS = 1 << 27, 16


def row_tokens(captions: Column) -> Column:
    """Exact number of words of all captions of a record, each Han, kana or Hangul character counting as one."""
    han = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"
    one = lambda c: F.when(c.isNull(), 0).otherwise(F.regexp_count(c, F.lit(han + r"|[^\s\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]+")))
    return F.coalesce(F.aggregate(F.transform(captions, one), F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0).cast("long"))


def fit_budget(lengths: list[int], counts: list[int], budget: int, rows: int | None = None) -> list[int]:
    """How many records of each length to take, so that the sum of lengths is as near the budget as possible.

    lengths are distinct and positive, counts how many records have each. With rows exactly that many records are taken.
    """
    total_rows, total = sum(counts), sum(a * b for a, b in zip(lengths, counts, strict=True))
    if rows is None and budget <= 0 or rows is not None and rows <= 0 or not total:
        return [0] * len(lengths)
    if rows is None and budget >= total or rows is not None and rows >= total_rows:
        return list(counts)
    part = Fraction(budget, total) if rows is None else Fraction(rows, total_rows)
    exact = [c * part for c in counts]
    base = [int(x) for x in exact]
    by_rest = sorted(range(len(counts)), key=lambda i: (base[i] - exact[i], i))
    if rows is not None:
        for i in by_rest[: rows - sum(base)]:
            base[i] += 1
    missing = budget - sum(a * b for a, b in zip(lengths, base, strict=True))
    if rows is None:
        for i in by_rest:  # what rounding took away, as long as it fits
            if base[i] < counts[i] and lengths[i] <= missing:
                base[i] += 1
                missing -= lengths[i]
    # no sum comes nearer than the lengths' common divisor lets it
    step = math.gcd(*(lengths if rows is None else [x - lengths[0] for x in lengths]))
    least = min(missing % step, -missing % step) if step else abs(missing)
    best, gap = base, abs(missing)
    most, width = 2, 4 * max(lengths)
    reach = max(sum(a * b for a, b in zip(lengths, base, strict=True)), total - sum(a * b for a, b in zip(lengths, base, strict=True)))
    while gap > least:
        whole = most >= max(counts) and width >= reach
        change, found = _exchange(lengths, base, counts, missing, most, min(width, reach), None if rows is None else most)
        if found < gap:
            best, gap = [b + c for b, c in zip(base, change, strict=True)], found
        if whole or width >= MOST_BITS or rows is not None and most >= WIDEST_PAIRS:
            break
        most, width = most * 8 if rows is None else most * 2, width * 8
    return best


def _exchange(lengths: list[int], base: list[int], counts: list[int], missing: int, most: int, width: int, net: int | None) -> tuple[list[int], int]:
    """(how many records of each length to take more or, if negative, fewer; what is then still missing or too much). At most `most` of a length, on sums no further than width from the start.

    net None: any number of records; else their number stays the same, and while exchanges are put together it may differ by net.
    """
    n = len(lengths)
    size = width + max(lengths)
    mask = (1 << (2 * size + 1)) - 1
    more = [min(c - b, most) for b, c in zip(base, counts, strict=True)]
    fewer = [min(b, most) for b in base]

    def after(state: dict[int, int], i: int) -> dict[int, int]:
        if net is None:
            bits = state[0]
            for amount, up in ((more[i], True), (fewer[i], False)):
                step = 1
                while amount:
                    take = min(step, amount)
                    bits |= (bits << take * lengths[i]) & mask if up else bits >> take * lengths[i]
                    amount, step = amount - take, step * 2
            return {0: bits}
        out = dict(state)
        for k in range(-fewer[i], more[i] + 1):
            for used, bits in state.items() if k else ():
                if abs(used + k) <= net:
                    out[used + k] = out.get(used + k, 0) | ((bits << k * lengths[i]) & mask if k > 0 else bits >> -k * lengths[i])
        return out

    goal = size + missing
    stride = max(1, math.isqrt(n))
    state, kept, last = {0: 1 << size}, {}, n
    for i in range(n):
        if i % stride == 0:
            kept[i] = state
        state = after(state, i)
        if 0 <= goal <= 2 * size and state.get(0, 0) >> goal & 1:
            last = i + 1
            break
    bits, at = state[0], min(max(goal, 0), 2 * size)
    below = (bits & ((1 << (at + 1)) - 1)).bit_length() - 1
    above = bits >> at
    up = at + (above & -above).bit_length() - 1 if above else None
    best = up if below < 0 or up is not None and abs(up - goal) < abs(below - goal) else below
    change, used, found = [0] * n, 0, abs(best - goal)
    for begin in range((last - 1) // stride * stride, -1, -stride):
        states = [kept[begin]]
        for i in range(begin, min(begin + stride, last) - 1):
            states.append(after(states[-1], i))
        for i in range(min(begin + stride, last) - 1, begin - 1, -1):
            before = states[i - begin]
            for k in sorted(range(-fewer[i], more[i] + 1), key=abs):
                rest = best - k * lengths[i]
                if 0 <= rest <= 2 * size and before.get(used - k if net is not None else 0, 0) >> rest & 1:
                    change[i], best = k, rest
                    used -= k if net is not None else 0
                    break
    return change, found


def length_histogram(records: DataFrame, source: str, length: Column) -> DataFrame:
    """<source>, length, n: records of each source by exact length; aggregated before the shuffle, so a hot source costs nothing."""
    return records.where(F.col(source).isNotNull()).groupBy(source, length.cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n"))


def mix_targets(entries: DataFrame, runs: DataFrame, unit: Column | None = None) -> DataFrame:
    """mix_id, dataset_id, max_repeats, weight, weight_sum, target_rows: the entries with what their targets are made of.

    A cleared alias (or, without one, the last part of the path) names the source in reports.
    """
    w = F.coalesce("weight", F.lit(1.0))
    weight = F.when(F.isnan(w) | (w < 0), 0.0).otherwise(w)
    name = F.coalesce(F.nullif(F.lower(F.trim("alias")), F.lit("")), F.element_at(F.split(F.regexp_replace(F.trim("path"), "/+$", ""), "/"), -1))
    slim = entries.select("mix_id", "dataset_id", F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"), weight.alias("weight"), name.alias("source"))
    sums = slim.groupBy("mix_id").agg(F.sum("weight").alias("weight_sum"))
    return slim.join(sums, "mix_id").join(runs.select("mix_id", F.col("target_rows").alias("target_rows")), "mix_id")


def plan_mix(records: DataFrame, entries: DataFrame, runs: DataFrame, length: Column, by_rows: bool = True, source: str = "dataset_id") -> DataFrame:
    """One row per entry and length: mix_id, dataset_id, source, target, capacity, length, n, copies (whole passes), extra (records taken once more).

    by_rows: targets and capacities are rows, as in target_rows; else they are tokens, and a mix of target_rows rows is taken to have
    as many tokens as that many average records of its sources. An entry without rows has one row with length null.
    """
    histogram = length_histogram(records, source, length)
    joined = mix_targets(entries, runs).join(histogram, source, "left")
    schema = f"mix_id int, {source} int, source string, target double, capacity double, length long, n long, copies long, extra long"

    def plan(key: tuple, entry: pd.DataFrame) -> pd.DataFrame:
        first = entry.iloc[0]
        mean = first["mean_tokens"]
        target = (first["weight"] / first["weight_sum"] if first["weight_sum"] else 0.0) * first["target_rows"]
        have = entry[entry["length"].notna()].sort_values("length")
        lengths, counts = [int(x) for x in have["length"]], [int(x) for x in have["n"]]
        repeats = int(first["max_repeats"])
        if not by_rows:
            target *= mean if mean == mean else 0.0
        total = sum(counts) if by_rows else sum(a * b for a, b in zip(lengths, counts, strict=True))
        goal = min(round(target), repeats * total)
        copies, rest = divmod(goal, total) if total else (0, 0)
        if not lengths:
            extra: list[int] = []
        elif by_rows:
            positive = [max(x, 1) for x in lengths]
            weight = sum(a * b for a, b in zip(positive, counts, strict=True))
            extra = fit_budget(*_merged(positive, counts), round(weight * rest / total), rest) if rest else [0] * len(lengths)
            extra = _unmerged(positive, counts, extra) if rest else extra
        else:
            usable = [i for i, x in enumerate(lengths) if x > 0]
            fitted = fit_budget([lengths[i] for i in usable], [counts[i] for i in usable], rest)
            extra = [0] * len(lengths)
            for i, e in zip(usable, fitted, strict=True):
                extra[i] = e
        base = {"mix_id": first["mix_id"], source: first[source], "source": first["source"], "target": target, "capacity": float(repeats * total)}
        if not lengths:
            rows = [base | {"length": None, "n": 0, "copies": 0, "extra": 0}]
        else:
            rows = [base | {"length": a, "n": b, "copies": copies, "extra": e} for a, b, e in zip(lengths, counts, extra, strict=True)]
        out = pd.DataFrame(rows)
        for c in ("mix_id", source):
            out[c] = out[c].astype("Int32")
        for c in ("length", "n", "copies", "extra"):
            out[c] = out[c].astype("Int64")
        return out[["mix_id", source, "source", "target", "capacity", "length", "n", "copies", "extra"]]

    means = joined.groupBy("mix_id").agg((F.sum(F.col("length") * F.col("n")) / F.sum("n")).alias("mean_tokens"))
    return joined.join(means, "mix_id").groupBy("mix_id", source).applyInPandas(plan, schema)


def _merged(lengths: list[int], counts: list[int]) -> tuple[list[int], list[int]]:
    """Lengths 0 and 1 both weigh 1 in a search by rows; equal lengths are put together."""
    sums: dict[int, int] = {}
    for a, b in zip(lengths, counts, strict=True):
        sums[a] = sums.get(a, 0) + b
    return list(sums), list(sums.values())


def _unmerged(lengths: list[int], counts: list[int], extra: list[int]) -> list[int]:
    left = dict(zip(dict.fromkeys(lengths), extra, strict=True))
    out = []
    for a, b in zip(lengths, counts, strict=True):
        take = min(b, left[a])
        left[a] -= take
        out.append(take)
    return out


def mix_report(plan: DataFrame, source: str = "dataset_id", by_rows: bool = True) -> DataFrame:
    """mix_id, dataset_id, source, target, capacity, actual, actual_share, target_share: what each source really contributes."""
    size = F.lit(1) if by_rows else F.col("length")
    entry = plan.groupBy("mix_id", source, "source", "target", "capacity").agg(F.coalesce(F.sum((F.col("n") * F.col("copies") + F.col("extra")) * size), F.lit(0)).alias("actual"))
    totals = entry.groupBy("mix_id").agg(F.sum("actual").alias("all_actual"), F.sum("target").alias("all_target"))
    return entry.join(totals, "mix_id").select(
        "mix_id", source, "source", "target", "capacity", "actual",
        F.try_divide("actual", "all_actual").alias("actual_share"), F.try_divide("target", "all_target").alias("target_share"),
    )


def unreachable(plan: DataFrame, source: str = "dataset_id") -> DataFrame:
    """mix_id, dataset_id: entries for which the plan takes all there is, as often as it may, and still stays below the target."""
    taken = F.coalesce(F.sum(F.col("n") * F.col("copies") + F.col("extra")), F.lit(0))
    entry = plan.groupBy("mix_id", source, "target", "capacity").agg(taken.alias("taken"))
    return entry.where("taken >= capacity and taken < target").select("mix_id", source)


def draw(records: DataFrame, plan: DataFrame, id_col: str, length: Column, seed: int = 0, source: str = "dataset_id") -> DataFrame:
    """mix_id, <id>, copies: the records of every mix and how often each is repeated.

    The extra records of a length are those with the smallest seeded hashes. Hash values are counted in steps of about STEP_ROWS records; whole
    steps are taken or left, and of each source and length only the step in which a mix ends is ranked.
    """
    keys = [source, "length"]
    wanted = plan.where("length is not null and (copies > 0 or extra > 0)")
    groups = wanted.groupBy(*keys).agg(F.max("n").alias("n"), F.collect_list(F.struct("mix_id", "copies", "extra")).alias("mixes"))
    coded = records.where(F.col(source).isNotNull()).select(F.col(id_col), F.col(source), length.cast("long").alias("length"), F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 40)).alias("h"))
    u = F.col("h") / F.lit(float(1 << 40))
    placed = written(join_hot_keys_apart(coded, groups.select(*keys, "n"), keys, "n").select(id_col, *keys, "h", F.floor(u * F.ceil(F.col("n") / F.lit(STEP_ROWS))).alias("step")))
    # where each mix ends: a row per mix, source and length; a group has n / STEP_ROWS steps
    steps = placed.groupBy(*keys, "step").agg(F.count(F.lit(1)).alias("k"))
    before = F.sum("k").over(Window.partitionBy(*keys).orderBy("step")) - F.col("k")
    ends = steps.withColumn("before", before).join(groups.select(*keys, F.explode("mixes").alias("m")), keys).where("before < m.extra and m.extra <= before + k")
    ends = ends.select(*keys, F.col("m.mix_id").alias("mix_id"), F.col("step").alias("border"), (F.col("m.extra") - F.col("before")).alias("take"))
    planned = wanted.select(*keys, "n", "mix_id", "copies").join(ends, [*keys, "mix_id"], "left")
    mixes = planned.groupBy(*keys).agg(F.max("n").alias("n"), F.collect_list(F.struct("mix_id", "copies", F.coalesce("border", F.lit(-1)).alias("border"), "take")).alias("mixes"))
    each = join_hot_keys_apart(placed, mixes, keys, "n").select(id_col, *keys, "h", "step", F.explode("mixes").alias("m")).select(id_col, *keys, "h", "step", "m.*")
    inside = each.where("step <> border").select("mix_id", id_col, (F.col("copies") + F.when(F.col("step") < F.col("border"), 1).otherwise(0)).alias("copies"))
    rank = F.row_number().over(Window.partitionBy("mix_id", *keys).orderBy("h", id_col))
    edge = each.where("step = border").withColumn("rank", rank).select("mix_id", id_col, (F.col("copies") + F.when(F.col("rank") <= F.col("take"), 1).otherwise(0)).alias("copies"))
    return inside.unionByName(edge).where("copies > 0")
