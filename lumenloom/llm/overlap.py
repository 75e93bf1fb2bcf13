"""Exact and near overlaps of evaluation records with training records (problem 7).

Texts. Of n words fewer than one in ten may be changed, so a near record is at most k = (n - 1) // 9 edits away. The words of a record, a repeated one
told by its number, are a set of which an edit takes away no more than one. If all words are ordered in one way, the k + 1 first of two near
records share one, as each has at most k that the other lacks. The order is by how many evaluation records have a word, rarest first, and words
that no evaluation record has come first and are never sent. No near pair is lost, wherever the changes stand. (Chunks cut at content-defined
places and joined by digest lose pairs whose changes are scattered, as no chunk stays whole.) What is sent are a word, with a class of length that
near records share, the record's key, its length and 256 bits: each word turns one of them over, so more differing bits than twice the allowed
edits prove that a pair is none. What is left is checked exactly, by word edits of the best alignment of captions.

Latent vectors never shift, so they are cut at fixed places into CHUNKS runs, whose values are rounded to bins of most of a spread, at OFFSETS
offsets, so that small differences leave some chunk unchanged. Widths of bins follow the record's own spread, in classes that evaluation records try
on both sides. This search is not exact: in a simulation it misses no pair with a gap of 0.05 or 0.1 spreads, 0.1 % if every value differs by just 0.1, and 0.6 % at 0.14. Candidates are checked by their values.

What evaluation records hold is kept in a table of fixed size: a filter of 2**MAP bits, and twice 2**COUNTERS counters of one byte, which order words and tell
which words and chunks very many records share. When it is full, more is shuffled and no pair is lost. Of what more than 2**SPLIT evaluation records share,
training records are spread over tasks by their keys, and evaluation records are sent to each of them.

Copies (the same letters and digits, caption order aside, or the same values) are one class, named by two hashes; a class is searched and checked
once, and its links hold for the members. Nulls: a record without a non-blank caption takes no part, whatever its latents; null captions
and values that are NaN or infinite match nothing; null ids or splits take no part. Empty tables give no pairs.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.textform import words
from lumenloom.operators.skew import join_hot_keys_apart, join_members
from lumenloom.session import written

#: Largest share of words that may be changed, added or missing; k = (n - 1) // EDIT_IN edits follow from it.
CHANGED, EDIT_IN = 0.1, 9
#: Ratio of one class of length to the next: the lengths that a near record may have lie in two classes at most.
LENGTHS = 1.25
#: Sizes of the table of what evaluation records hold, as powers of 2: bits, and counters of one byte.
MAP, COUNTERS = 27, 22
#: Evaluation records that share a word or chunk in one task, as a power of 2.
SPLIT = 17
#: Bins of latent values, the ratio of one class of spreads to the next, and the most that same pictures differ by (root mean square), in spreads.
BIN, SPREADS, NEAR = 0.9, 1.5, 0.15
CHUNKS, OFFSETS = 6, 3
#: Pairs to be checked, counted, up to which the ids of their records are broadcast (two numbers each).
FEW = 500_000
#: Keys of copies that a task remembers.
SENT = 200_000
#: Columns of the 256 bits that say which words a record has.
BITS = ("b1", "b2", "b3", "b4")
_BLOCK = 1 << 13
_P = np.uint64(0x9E3779B97F4A7C15)
TEXT, VALUES = 0, 1


class _Hashes(dict):
    """Words to 62-bit hashes; forgets all when it has grown too large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 2
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _ranges(starts: np.ndarray) -> np.ndarray:
    """Places from 0 within each run, where starts marks the first of each."""
    at = np.arange(len(starts))
    return at - np.maximum.accumulate(np.where(starts, at, 0))


def _changes(*columns: np.ndarray) -> np.ndarray:
    out = np.ones(len(columns[0]), dtype=bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


class Texts:
    """Records given by the word hashes of their captions, as flat arrays. Every record has a word."""

    def __init__(self, records: list[list[list[int]]]):
        self.n = len(records)
        self.lengths = np.array([len(t) for r in records for t in r], dtype=np.int64)
        self.captions = np.array([len(r) for r in records], dtype=np.int64)
        self.flat = np.fromiter((h for r in records for t in r for h in t), dtype=np.uint64, count=int(self.lengths.sum()))
        self.sizes = np.bincount(np.repeat(np.arange(self.n), self.captions), weights=self.lengths, minlength=self.n).astype(np.int64)
        self.row = np.repeat(np.arange(self.n), self.sizes)
        self.edits = (self.sizes - 1) // EDIT_IN
        # words, each with how often it has been met in its record, in the order of records and hashes
        order = np.lexsort((self.flat, self.row))
        h, self.of = self.flat[order], self.row[order]
        times = _ranges(_changes(h, self.of)).astype(np.uint64)
        self.words = _mix(h * _P + times * np.uint64(0xD6E8FEB86659FD93))

    def bits(self) -> np.ndarray:
        """BITS of the records: each word turns one over."""
        bit = self.words & np.uint64(255)
        out = np.zeros((self.n, len(BITS)), dtype=np.uint64)
        np.bitwise_xor.at(out, (self.of, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
        return out.view(np.int64)

    def classes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The class of length of each record, and the first and the last one of near records."""
        log = lambda n: np.floor(np.log(n) / math.log(LENGTHS) + 1e-9).astype(np.int64)
        return log(self.sizes), log(self.sizes - self.edits), log(self.sizes + self.edits)


class Asked:
    """The table of what evaluation records hold."""

    def __init__(self, bits: np.ndarray, counters: np.ndarray, split: int = SPLIT):
        self.bits, self.counters, self.split = bits, counters, split

    def spread(self, rows: np.ndarray, digests: np.ndarray, counts: np.ndarray, wide: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(record, digest) with what very many records share in parts: a record of wide takes all parts, another one that of its key. counts are counters, which hold 8 log2 + 1."""
        parts = np.int64(1) << np.maximum((counts.astype(np.int64) - 1) // 8 - self.split, 0)
        if len(parts) == 0 or parts.max() == 1:
            return rows, digests
        times = np.where(wide[rows], parts, 1)
        of = np.repeat(np.arange(len(rows)), times)
        part = np.where(wide[rows[of]], np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times), (keys[rows[of]] % parts[of].astype(np.uint64)).astype(np.int64))
        return rows[of], np.where(parts[of] > 1, _mix(digests[of] + (part + 1).astype(np.uint64) * _P), digests[of])

    def has(self, hashes: np.ndarray) -> np.ndarray:
        x = hashes & np.uint64(2**MAP - 1)
        return (self.bits[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63)) & np.uint64(1)).astype(bool)

    def chunks(self, rows: np.ndarray, digests: np.ndarray, wide: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(record, digest) of the chunks of values that evaluation records have."""
        met = self.has(digests)
        rows, digests = rows[met], digests[met]
        return self.spread(rows, digests, self.counters[2**COUNTERS + (digests >> np.uint64(64 - COUNTERS)).astype(np.int64)], wide, keys)

    def first(self, texts: Texts, wide: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(record, digest) of the first words of each record, but for those that no evaluation record has; under its own class of length, for records of wide under those of near records."""
        some = np.flatnonzero(texts.edits[texts.of] > 0)
        of, h = texts.of[some], texts.words[some]
        met = self.counters[(h >> np.uint64(64 - COUNTERS)).astype(np.int64)]
        order = np.lexsort((h, met, of))
        of, h, met = of[order], h[order], met[order]
        kept = (_ranges(_changes(of)) <= texts.edits[of]) & (met > 0)
        of, h, met = of[kept], h[kept], met[kept]
        own, low, high = texts.classes()
        rows, out, counts = [], [], []
        for step in range(3):
            kind = np.where(wide, low + step, own)[of]
            good = np.where(wide[of], kind <= high[of], step == 0)
            rows.append(of[good])
            out.append(_mix(h[good] + kind[good].astype(np.uint64)))
            counts.append(met[good])
        return self.spread(np.concatenate(rows), np.concatenate(out), np.concatenate(counts), wide, keys)


def _read(captions: list[str | None], known: _Hashes) -> tuple[list[list[int]], bytes] | None:
    """Word hashes of the captions with words and the key of copies; None without a word."""
    texts = [w for w in (words(t) for t in captions if t) if w]
    if not texts:
        return None
    return [[known[w] for w in x] for x in texts], _key("\x1f".join(sorted("".join(w) for w in texts)).encode("utf-8", "surrogatepass"))


def _key(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


def _keys(found: list[bytes], kind: int) -> np.ndarray:
    """Two numbers of each key; the lowest bit of the first tells its kind."""
    out = np.frombuffer(b"".join(found), dtype=np.uint64).reshape(-1, 2).copy()
    out[:, 0] = out[:, 0] & ~np.uint64(1) | np.uint64(kind)
    return out


def vectors(values: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vector, of rows half of whose values at least are finite."""
    sizes = np.where(values.is_null(), 0, np.diff(values.offsets.to_numpy()))
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    starts = np.cumsum(sizes) - sizes
    out = []
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        x = flat[starts[rows][:, None] + np.arange(size)]
        good = np.isfinite(x).sum(1) * 2 >= size
        out.append((rows[good], x[good]))
    return [(rows, x) for rows, x in out if len(rows)]


def latent_digests(x: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, digest): each stands for a class of spread, a place, an offset and the bins of a run of values. Rows of wide try the classes of spread of all near records."""
    fine = np.isfinite(x)
    n = fine.sum(1)
    z = np.where(fine, x, 0).astype(np.float64)
    mean = z.sum(1) / n
    spread = np.sqrt((np.where(fine, z - mean[:, None], 0) ** 2).sum(1) / n)
    scale = np.log(np.where(spread > 0, spread, 1)) / math.log(SPREADS)
    own = np.floor(scale).astype(np.int64)
    low, high = (np.floor(scale + math.log(f) / math.log(SPREADS)).astype(np.int64) for f in (1 - NEAR, 1 / (1 - NEAR)))
    edges = np.unique(np.linspace(0, x.shape[1], CHUNKS + 1).astype(int))
    whole = np.stack([fine[:, lo:hi].all(1) for lo, hi in zip(edges[:-1], edges[1:], strict=True)], 1)
    rows, out = [], []
    steps = int((high - low).max()) if len(x) else 0
    for step in range(steps + 1):
        kind = np.where(wide, low + step, own)
        some = np.flatnonzero((spread > 0) & np.where(wide, kind <= high, step == 0))
        width = BIN * SPREADS ** (kind[some] + 0.5)
        scaled = z[some] / width[:, None]
        for k in range(OFFSETS):
            bins = np.floor(scaled + k / OFFSETS).astype(np.int64).astype(np.uint64)
            for j, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                h = _mix(kind[some].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64((x.shape[1] << 20) + (lo << 4) + k))
                for c in range(lo, hi):
                    h = (h ^ bins[:, c]) * np.uint64(6364136223846793005) + np.uint64(1442695040888963407)
                    h ^= h >> np.uint64(29)
                good = whole[some, j]
                rows.append(some[good])
                out.append(_mix(h[good]))
    return (np.concatenate(rows), np.concatenate(out)) if out else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64))


def _value_keys(x: np.ndarray) -> np.ndarray:
    return _keys([_key(r.tobytes()) for r in x], VALUES)


def asked_table(evaluation: DataFrame, column: str, latents: str) -> Asked:
    """The table of the words, chunks and keys of all evaluation records; its size is fixed, whatever there is of them."""

    def held(batches):
        known = _Hashes()
        for batch in batches:
            set_bits, counts, chunks = [], [], []
            read = [x for x in (_read(t, known) for t in batch.column(0).to_pylist()) if x]
            if read:
                counts.append(Texts([x for x, _ in read]).words)
                set_bits.append(_keys([key for _, key in read], TEXT)[:, 0])
            for _, x in vectors(batch.column(1)):
                chunks.append(latent_digests(x, np.ones(len(x), dtype=bool))[1])
                set_bits.append(chunks[-1])
                set_bits.append(_value_keys(x)[:, 0])
            for bits in (np.unique(np.concatenate(set_bits) & np.uint64(2**MAP - 1)) if set_bits else None,):
                if bits is not None:
                    place, first = np.unique((bits >> np.uint64(6)).astype(np.int32), return_index=True)
                    m = np.bitwise_or.reduceat(np.uint64(1) << (bits & np.uint64(63)), first)
                    yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(m.view(np.int64)), pa.array(np.zeros(len(m), dtype=np.int64))], ["w", "m", "n"])
            for base, found, least in ((0, counts, 1), (2**COUNTERS, chunks, 4)):
                # chunks need no order, so only what is frequent in a batch is counted
                place, n = np.unique((np.concatenate([np.zeros(0, dtype=np.uint64), *found]) >> np.uint64(64 - COUNTERS)).astype(np.int32), return_counts=True)
                place, n = place[n >= least] + np.int32(base), n[n >= least]
                yield pa.RecordBatch.from_arrays([pa.array(place + np.int32(2 ** (MAP - 6))), pa.array(np.zeros(len(n), dtype=np.int64)), pa.array(n.astype(np.int64))], ["w", "m", "n"])

    slots = evaluation.select(column, latents).mapInArrow(held, "w int, m long, n long").groupBy("w").agg(F.bit_or("m").alias("m"), F.sum("n").alias("n"))
    per = 2 ** (MAP - 6)

    def block(key, pdf):
        import pandas as pd

        first = key[0] * _BLOCK
        out = np.zeros(_BLOCK, dtype=np.uint64 if first < per else np.uint8)
        # counts by their logarithm: they need only be ordered
        out[pdf["w"].to_numpy() - first] = pdf["m"].to_numpy().view(np.uint64) if first < per else np.minimum(1 + 8 * np.log2(pdf["n"].to_numpy()), 255).astype(np.uint8)
        return pd.DataFrame({"block": [key[0]], "data": [out.tobytes()]})

    blocks = slots.groupBy(F.expr(f"cast(w div {_BLOCK} as int)").alias("block")).applyInPandas(block, "block int, data binary")
    bits, counters = np.zeros(per, dtype=np.uint64), np.zeros(2 * 2**COUNTERS, dtype=np.uint8)
    for number, data in zip(*(c.to_pylist() for c in blocks.toArrow().columns), strict=True):  # a table of fixed size
        at = number * _BLOCK
        if at < per:
            bits[at : at + _BLOCK] = np.frombuffer(data, dtype=np.uint64)
        else:
            counters[at - per : at - per + _BLOCK] = np.frombuffer(data, dtype=np.uint8)
    return Asked(bits, counters)


def _lists(row: np.ndarray, values: np.ndarray, n: int, kind: pa.DataType = pa.int64()) -> pa.ListArray:
    """Lists of the values of rows 0 to n - 1; row may be in any order."""
    order = np.argsort(row, kind="stable")
    offsets = np.searchsorted(row[order], np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[order], kind))


def records(df: DataFrame, id_col: str, train: Column, column: str, latents: str, split: int = SPLIT) -> DataFrame:
    """<id>, train, k1, k2 (copies' key), n words, b1 to b4, ds (words or chunks to search by), words (with 0 between captions) or x (values) of each record, once for its text and once for its values.

    Training records of which the evaluation records hold neither a word or chunk to search by nor the key are left out.
    """
    asked = asked_table(df.where(~train), column, latents)
    held = df.sparkSession.sparkContext.broadcast((asked.bits, asked.counters))  # of fixed size
    id_type = df.schema[id_col].dataType.simpleString()
    names = [id_col, "train", "k1", "k2", "n", *BITS, "ds", "words", "x"]
    ddl = f"{id_col} {id_type}, train boolean, k1 long, k2 long, n int, {', '.join(f'{b} long' for b in BITS)}, ds array<long>, words array<int>, x array<float>"

    def relevant(batches):
        asked, known = Asked(*held.value, split), _Hashes()
        sent: set[tuple[bool, int, int]] = set()

        def rows_of(batch, rows, keys, row, ds, n, bits, words, x):
            """The kept rows of a batch, of which rows gives the place in it of each record. Copies of what the task has sent are searched no more."""
            again = np.zeros(len(rows), dtype=bool)
            for k, key in enumerate(zip(batch.column(1).take(pa.array(rows)).to_pylist(), *keys.T.tolist(), strict=True)):
                again[k] = key in sent
                sent.add(key)
            if len(sent) > SENT:
                sent.clear()
            evaluation = ~batch.column(1).to_numpy(zero_copy_only=False).astype(bool)[rows]
            kept = np.flatnonzero(evaluation | (np.bincount(row, minlength=len(rows)) > 0) | asked.has(keys[:, 0]))
            row, ds = row[~again[row]], ds[~again[row]]
            of, some = pa.array(rows[kept]), pa.array(kept)
            columns = [batch.column(0).take(of), batch.column(1).take(of), *(pa.array(keys[kept, k].view(np.int64)) for k in (0, 1)), pa.array(n[kept].astype(np.int32)), *(pa.array(bits[kept, k].copy()) for k in range(len(BITS)))]
            return pa.RecordBatch.from_arrays([*columns, _lists(row, ds.view(np.int64), len(rows)).take(some), words.take(some), x.take(some)], names)

        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                wide = ~batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
                read = [_read(t, known) for t in batch.column(2).to_pylist()]
                rows = np.array([k for k, x in enumerate(read) if x], dtype=np.int64)
                if len(rows):
                    texts = Texts([read[k][0] for k in rows])
                    keys = _keys([read[k][1] for k in rows], TEXT)
                    row, ds = asked.first(texts, wide[rows], keys[:, 0])
                    spelt = pa.array([_spelt(read[k][0]) for k in rows], pa.list_(pa.int32()))
                    yield rows_of(batch, rows, keys, row, ds, texts.sizes, texts.bits(), spelt, pa.nulls(len(rows), pa.list_(pa.float32())))
                for rows, x in vectors(batch.column(3)):
                    keys = _value_keys(x)
                    row, ds = asked.chunks(*latent_digests(x, wide[rows]), wide[rows], keys[:, 0])
                    values = batch.column(3).take(pa.array(rows)).cast(pa.list_(pa.float32()))
                    yield rows_of(batch, rows, keys, row, ds, np.zeros(len(rows)), np.zeros((len(rows), len(BITS)), dtype=np.int64), pa.nulls(len(rows), pa.list_(pa.int32())), values)

    return df.select(id_col, train.alias("train"), column, latents).mapInArrow(relevant, ddl)


def classes(found: DataFrame, id_col: str) -> DataFrame:
    """k1, k2, n_train, n_eval, train_id, eval_id: each class of copies with its members on each side and the smallest id of either."""
    inside = F.col("train")
    return found.groupBy("k1", "k2").agg(
        F.count_if(inside).alias("n_train"), F.count_if(~inside).alias("n_eval"), F.min(F.when(inside, F.col(id_col))).alias("train_id"), F.min(F.when(~inside, F.col(id_col))).alias("eval_id")
    )


def candidate_pairs(found: DataFrame) -> DataFrame:
    """ka, kb: the first keys of a class in train and one in evaluation splits that share a word or chunk and are within the bounds on length and differing bits.

    A class in both splits stands on both sides; a pair of a class with itself is left out. Each task has sent a class once, and they are put together
    where they meet, so that what is shuffled is already where the join wants it.
    """
    side = lambda split, name: (
        found.where(split).select(F.col("k1").alias(f"k{name}"), F.col("n").alias(f"n{name}"), *[F.col(c).alias(f"{name}{c}") for c in BITS], F.explode("ds").alias("d"))
        .repartition("d").groupBy("d", f"k{name}").agg(*[F.first(c).alias(c) for c in (f"n{name}", *(f"{name}{c}" for c in BITS))])
    )
    a, b = side(F.col("train"), "a"), side(~F.col("train"), "b")
    longer = F.greatest("na", "nb")
    # less than one in ten of the longer one, in whole words
    most = F.expr("greatest(0, (greatest(na, nb) + 9) div 10 - 1)")
    differ = [F.bit_count(F.col(f"a{c}").bitwiseXOR(F.col(f"b{c}"))) for c in BITS]
    near = (longer - F.least("na", "nb") <= most) & (differ[0] <= 2 * most) & (sum(differ) <= 2 * most)
    return a.join(b, "d").where((F.col("ka") != F.col("kb")) & near).select("ka", "kb").distinct()


def edits(a: list, b: list, most: int) -> int:
    """Words to change, add or leave out to make b of a; more than most is returned as most + 1. Only the band of most about the diagonal is worked out."""
    lo, top = 0, min(len(a), len(b))
    while lo < top and a[lo] == b[lo]:
        lo += 1
    cut = 0
    while cut < top - lo and a[-1 - cut] == b[-1 - cut]:
        cut += 1
    n, m = len(a) - lo - cut, len(b) - lo - cut
    if abs(n - m) > most:
        return most + 1
    if not n or not m:
        return max(n, m)
    far = most + 1
    before = [min(j, far) for j in range(m + 1)]
    for i in range(1, n + 1):
        x = a[lo + i - 1]
        begin, end = max(1, i - most), min(m, i + most)
        now = [far] * (m + 1)
        if i <= most:
            now[0] = i
        least = now[0]
        for j in range(begin, end + 1):
            now[j] = v = min(before[j] + 1, now[j - 1] + 1, before[j - 1] + (x != b[lo + j - 1]), far)
            least = min(least, v)
        if least > most:
            return far
        before = now
    return min(before[m], far)


def assignment(cost: list[list[int]]) -> int:
    """The least sum of a square matrix with one entry from each row and column (shortest augmenting paths)."""
    n = len(cost)
    u, v, of = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        of[0], j0 = i, 0
        least, way, done = [math.inf] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while of[j0]:
            done[j0] = True
            i0, step, j1 = of[j0], math.inf, 0
            for j in range(1, n + 1):
                if not done[j]:
                    gap = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if gap < least[j]:
                        least[j], way[j] = gap, j0
                    if least[j] < step:
                        step, j1 = least[j], j
            for j in range(n + 1):
                if done[j]:
                    u[of[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            j0 = j1
        while j0:
            of[j0] = of[way[j0]]
            j0 = way[j0]
    return sum(cost[of[j] - 1][j - 1] for j in range(1, n + 1))


def record_edits(a: list[list], b: list[list]) -> tuple[int, int]:
    """Word edits between two records given by the words of their captions, each caption with a partner, or none, in the best way whatever the order; and the words of the longer record.

    What is certainly too much is returned as soon as that is clear: edits are no fewer than the words that one record has and the other lacks.
    """
    total = max(sum(map(len, a)), sum(map(len, b)))
    most = int(CHANGED * total) + 1
    left = Counter(itertools.chain.from_iterable(a))
    left.subtract(itertools.chain.from_iterable(b))
    least = max(sum(n for n in left.values() if n > 0), -sum(n for n in left.values() if n < 0))
    if least > most:
        return least, total
    if len(a) == len(b) == 1:
        return edits(a[0], b[0], most), total
    n = max(len(a), len(b))
    return assignment([[edits(a[i] if i < len(a) else [], b[j] if j < len(b) else [], most) for j in range(n)] for i in range(n)]), total


def _spelt(captions: list[list[int]]) -> list[int]:
    """Words as 31 bits of their hashes, with 0 between captions."""
    out: list[int] = []
    for k, t in enumerate(captions):
        if k:
            out.append(0)
        out += [h & 0x7FFFFFFF or 1 for h in t]
    return out


def _captions(spelt: list[int]) -> list[list[int]]:
    out: list[list[int]] = [[]]
    for h in spelt:
        if h:
            out[-1].append(h)
        else:
            out.append([])
    return out


def _gaps(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether vectors are of the same picture, and 1 less their gap in spreads."""
    fine = np.isfinite(x) & np.isfinite(y)
    k = np.maximum(fine.sum(1), 1)
    u, v = np.where(fine, x, 0).astype(np.float64), np.where(fine, y, 0).astype(np.float64)
    gap = np.sqrt(((u - v) ** 2).sum(1) / k)
    own = np.sqrt(np.maximum((u**2).sum(1) / k - (u.sum(1) / k) ** 2, 0))
    return (fine.sum(1) * 2 >= x.shape[1]) & ((gap <= NEAR * own) | (gap == 0)), 1 - gap / np.where(own > 0, own, 1)


def near_pairs(found: DataFrame, groups: DataFrame, id_col: str, few: int = FEW) -> DataFrame:
    """ka1, ka2, kb1, kb2, na, nb (members of the classes on their sides), shared: pairs of classes that are near, checked word by word or value by value; shared is the fraction of the longer record that is the same.

    Where the records to be checked, counted, are no more than few, their ids are broadcast, so that no other record is shuffled with its words.
    """
    side = lambda name, split: groups.where(f"n_{split} > 0").select(F.col("k1").alias(f"k{name}"), F.col("k2").alias(f"k{name}2"), F.col(f"n_{split}").alias(f"n{name}"), F.col(f"{split}_id").alias(f"i{name}"))
    pairs = written(candidate_pairs(found).join(side("a", "train"), "ka").join(side("b", "eval"), "kb"))
    send = F.broadcast if pairs.count() <= few else lambda ids: ids

    def what(name: str, split: Column) -> DataFrame:
        # a record has a text and values under one id, told apart by the key
        rows = found.where(split).select(F.col(id_col).alias(f"i{name}"), F.col("k1").alias(f"k{name}"), F.col("words").alias(f"w{name}"), F.col("x").alias(f"x{name}"))
        return rows.join(send(pairs.select(f"i{name}", f"k{name}").distinct()), [f"i{name}", f"k{name}"], "left_semi")

    both = pairs.join(what("b", ~F.col("train")), ["ib", "kb"]).join(what("a", F.col("train")), ["ia", "ka"])
    keys = ["ka", "ka2", "kb", "kb2", "na", "nb"]

    def check(batches):
        for batch in batches:
            ok, share = np.zeros(batch.num_rows, dtype=bool), np.zeros(batch.num_rows)
            kind = batch.column(0).to_numpy() & 1
            texts = np.flatnonzero(kind == TEXT)
            sides = (batch.column(k).take(pa.array(texts)).to_pylist() for k in (6, 7))
            for row, a, b in zip(texts.tolist(), *sides, strict=True):
                done, total = record_edits(_captions(a), _captions(b))
                ok[row], share[row] = done < CHANGED * total, 1 - done / total
            rows = np.flatnonzero(kind == VALUES)
            if len(rows):
                x, y = (batch.column(k).take(pa.array(rows)) for k in (8, 9))
                sizes, others = (np.diff(v.offsets.to_numpy()) for v in (x, y))
                xs, ys = (v.flatten().to_numpy(zero_copy_only=False) for v in (x, y))
                x0, y0 = np.cumsum(sizes) - sizes, np.cumsum(others) - others
                for size in np.unique(sizes[sizes == others]):
                    some = np.flatnonzero((sizes == size) & (others == size))
                    ok[rows[some]], share[rows[some]] = _gaps(xs[x0[some][:, None] + np.arange(size)], ys[y0[some][:, None] + np.arange(size)])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(6)), pa.array(share)], names).filter(pa.array(ok))

    names = ["ka1", "ka2", "kb1", "kb2", "na", "nb", "shared"]
    return both.select(*keys, "wa", "wb", "xa", "xb").mapInArrow(check, "ka1 long, ka2 long, kb1 long, kb2 long, na long, nb long, shared double")


class Overlaps:
    """What is found of one table: records that can take part, classes of copies, and links between classes. All three are written to the shared folder."""

    def __init__(self, df: DataFrame, id_col: str, split: str, column: str, latents: str, train: str, few: int = FEW, split_at: int = SPLIT):
        self.id = id_col
        usable = df.where(F.col(id_col).isNotNull() & F.col(split).isNotNull() & F.exists(column, lambda c: c.rlike(r"[^\s\p{Z}\p{Cf}]")))
        self.records = written(records(usable, id_col, F.col(split) == train, column, latents, split_at))
        self.groups = written(classes(self.records, id_col))
        self.links = written(near_pairs(self.records, self.groups, id_col, few))

    def members(self, wanted: DataFrame, split: Column) -> DataFrame:
        """k1, k2, size, <id> of the records of one side of wanted classes; size is how many these are."""
        slim = self.records.where(split).select("k1", "k2", self.id)
        return join_hot_keys_apart(slim, wanted.select("k1", "k2", "size"), ["k1", "k2"], "size").select("k1", "k2", "size", self.id)

    def side(self, name: str, split: str) -> DataFrame:
        """k1, k2, size: the classes of which members of one side take part in a pair: those in both splits, and those that are linked."""
        linked = self.links.select(F.col(f"k{name}1").alias("k1"), F.col(f"k{name}2").alias("k2"), F.col(f"n{name}").alias("size"))
        return self.groups.where("n_train > 0 and n_eval > 0").select("k1", "k2", F.col(f"n_{split}").alias("size")).union(linked).distinct()

    def overlapping(self) -> DataFrame:
        """<id> of the evaluation records that are in train as well, exactly or nearly; from classes and links, no pair of records is made."""
        return self.members(self.side("b", "eval"), ~F.col("train")).select(self.id).distinct()


def cross_split_pairs(df: DataFrame, id_col: str = "row_id", split: str = "data_split", column: str = "captions", latents: str = "latents", train: str = "train", few: int = FEW, split_at: int = SPLIT) -> DataFrame:
    """<id>_a, <id>_b: each pair of a training and an evaluation record that are the same or nearly so, by captions or by latents."""
    o = Overlaps(df, id_col, split, column, latents, train, few, split_at)
    x = o.members(o.side("a", "train"), F.col("train")).withColumnRenamed(id_col, "x")
    y = o.members(o.side("b", "eval"), ~F.col("train")).withColumnRenamed(id_col, "y")
    of = lambda name, kept: [F.col(f"k{name}1").alias("k1"), F.col(f"k{name}2").alias("k2"), F.col(f"n{name}").alias("size"), *kept]
    mixed = o.groups.where("n_train > 0 and n_eval > 0").select(F.col("k1").alias("ka1"), F.col("k2").alias("ka2"), F.col("k1").alias("kb1"), F.col("k2").alias("kb2"), F.col("n_train").alias("na"), F.col("n_eval").alias("nb"))
    links = o.links.drop("shared").union(mixed)
    met = join_members(y, links.select(*of("b", ["ka1", "ka2", "na"])), ["k1", "k2"], "size", "y")
    pairs = join_members(x, met.select(*of("a", ["y"])), ["k1", "k2"], "size", "x")
    return pairs.where("x <> y").select(F.least("x", "y").alias(f"{id_col}_a"), F.greatest("x", "y").alias(f"{id_col}_b")).distinct()


def overlap_report(df: DataFrame, id_col: str = "row_id", split: str = "data_split", source: str = "dataset_id", column: str = "captions", latents: str = "latents", train: str = "train") -> DataFrame:
    """<split>, <source>, n_rows, n_overlapping, share: per evaluation split and source, how many records stand in training as well."""
    touched = Overlaps(df, id_col, split, column, latents, train).overlapping()
    evaluation = df.where(F.col(split).isNotNull() & (F.col(split) != train)).select(id_col, split, source)
    marked = evaluation.join(touched.withColumn("_hit", F.lit(1)), id_col, "left")
    n, k = F.count(F.lit(1)), F.coalesce(F.sum("_hit"), F.lit(0))
    return marked.groupBy(split, source).agg(n.alias("n_rows"), k.alias("n_overlapping"), F.round(k / n, 6).alias("share"))
