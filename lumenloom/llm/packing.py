"""Filling containers of fixed capacity with items of varying length (problem 8).

Bounded-space online best-fit. A task keeps OPEN bins open. Their free space is a set of bits, one for each amount, so the
fullest bin that still takes an item is the lowest bit from the item's size on. If none takes it, a new bin is opened, and if too many are
open the fullest one is closed first. Items are documents measured in tokens of a public tokenizer; only a document that exceeds the
capacity is split, into full containers and a rest that is packed like any item.

Every task packs its own documents, so nothing is shuffled and no task sees more than its share; at most OPEN bins per task stay
partly filled. Containers are named by the task's partition and a number, so the same files read in the same splits give the same containers.

Null and empty texts have no tokens and go into no container; documents with a null id are packed like others. A capacity
that is null or below 1 holds nothing. Equal documents are packed each by itself.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN = 64
#: Share of the space of closed bins that is used at least.
GOOD_FILL = 0.95
#: Name of a tokenizer file in the folder of public tokenizers.
TOKENIZER = "byte_bpe_50k.tiktoken"


def tokenizer(path: str | None = None):
    """The tokenizer whose ranks are in the file at path; by default one of the public tokenizers' folder."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(TOKENIZER), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Bins:
    """Open bins of one capacity."""

    def __init__(self, capacity: int, most: int = OPEN):
        self.capacity, self.most = capacity, most
        self.bits, self.by_free = 0, {}
        self.opened = self.open = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            del self.by_free[free]
            self.bits ^= 1 << free
        self.open -= 1
        return number

    def _put(self, free: int, number: int) -> None:
        self.by_free.setdefault(free, []).append(number)
        self.bits |= 1 << free
        self.open += 1

    def add(self, size: int) -> int:
        """The number of the bin that takes an item of at most the capacity."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.open >= self.most:  # the fullest bin closes
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, number = self.capacity, self.opened
            self.opened += 1
        if free > size:
            self._put(free - size, number)
        return number

    def place(self, size: int) -> list[tuple[int, int, int]]:
        """(bin, first token, tokens) of the pieces of an item: one, unless it exceeds the capacity."""
        out, at = [], 0
        while size - at > self.capacity:
            out.append((self.opened, at, self.capacity))
            self.opened += 1
            at += self.capacity
        if size > at:
            out.append((self.add(size - at), at, size - at))
        return out


def pack(documents: DataFrame, containers: DataFrame, id_col: str = "doc_id", text: str = "text", name: str = "container_name", capacity: str = "capacity_tokens", tokenizer_path: str | None = None, most: int = OPEN) -> DataFrame:
    """<name>, bin_id, <id>, first_token, n_tokens: where each document, or each piece of one that exceeds the capacity, goes.

    bin_id is unique among the containers of a name. The containers are a bounded table and come to the driver.
    """
    specs = [(r[0], int(r[1])) for r in containers.where(F.col(capacity) >= 1).select(name, capacity).orderBy(capacity, name).collect()]
    id_type, name_type = documents.schema[id_col].dataType.simpleString(), containers.schema[name].dataType.simpleString()

    def fill(batches):
        encode = tokenizer(tokenizer_path).encode_ordinary  # the tokenizer's own batches take twice the time
        first = TaskContext.get().partitionId() << 40
        bins = [Bins(c, most) for _, c in specs]
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            for k, (label, _) in enumerate(specs):
                placed = [(row, *p) for row, size in enumerate(sizes) for p in bins[k].place(size)]
                rows = np.array(placed, dtype=np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([label] * len(rows)), pa.array(rows[:, 1] + first), batch.column(0).take(pa.array(rows[:, 0])), pa.array(rows[:, 2]), pa.array(rows[:, 3].astype(np.int32))],
                    [name, "bin_id", id_col, "first_token", "n_tokens"],
                )

    return documents.select(id_col, text).mapInArrow(fill, f"{name} {name_type}, bin_id long, {id_col} {id_type}, first_token long, n_tokens int")


def placement_report(packed: DataFrame, containers: DataFrame, id_col: str = "doc_id", name: str = "container_name", capacity: str = "capacity_tokens") -> DataFrame:
    """<name>, n_documents, n_overfull (bins with more than their capacity), n_broken (documents of which a token is missing, stands twice or was split without need), well_filled (whether bins are full to GOOD_FILL but for those that a task leaves open)."""
    size = containers.select(name, capacity)
    pieces = packed.groupBy(name, id_col).agg(F.count(F.lit(1)).alias("k"), F.sum("n_tokens").alias("n"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"), F.count_distinct("first_token").alias("starts"), F.sum(F.when(F.col("first_token") == 0, 1).otherwise(0)).alias("heads"))
    # the pieces of a document that exceeds the capacity are full but for the last one
    need = F.ceil(F.col("n") / F.col(capacity))
    broken = (F.col("n") != F.col("end")) | (F.col("k") != need) | (F.col("starts") != F.col("k")) | (F.col("heads") != 1)
    documents = pieces.join(size, name).groupBy(name).agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(broken).alias("n_broken"))
    bins = packed.groupBy(name, "bin_id").agg(F.sum("n_tokens").alias("used")).join(size, name)
    closed = bins.groupBy(name).agg(F.count_if(F.col("used") > F.col(capacity)).alias("n_overfull"), F.sum("used").alias("used"), F.count(F.lit(1)).alias("n_bins"), F.first(capacity).alias("c"), F.count_distinct(F.shiftright("bin_id", 40)).alias("tasks"))
    good = F.col("used") >= GOOD_FILL * F.col("c") * (F.col("n_bins") - OPEN * F.col("tasks"))
    return documents.join(closed, name).select(name, "n_documents", "n_overfull", "n_broken", good.alias("well_filled"))


def fill_report(packed: DataFrame, containers: DataFrame, name: str = "container_name", capacity: str = "capacity_tokens") -> DataFrame:
    """<name>, n_bins, n_pieces, n_tokens, fill: how full the containers of each kind are."""
    bins = packed.groupBy(name, "bin_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("pieces"))
    kinds = bins.groupBy(name).agg(F.count(F.lit(1)).alias("n_bins"), F.sum("pieces").alias("n_pieces"), F.sum("used").alias("n_tokens"))
    return kinds.join(containers.select(name, capacity), name).select(name, "n_bins", "n_pieces", "n_tokens", F.round(F.col("n_tokens") / (F.col("n_bins") * F.col(capacity)), 6).alias("fill"))
