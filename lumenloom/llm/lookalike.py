"""One consistent form for texts that look alike but are made of different characters (problem 2).

After compatibility normalisation and deletion of ignorable characters, each word is a lattice: every position holds the
letters that have its shape. Viterbi takes the best path under character bigram scores, with a penalty for changing script
and a start score by the scripts of the text's unmistakable letters. The lattice, and with it the result, depends on shapes
only, so texts that look alike come out equal; the bigram scores decide which of the equal-looking spellings is written.

Nulls stay null, in the list and as a whole list; empty texts stay empty. Tabs and line breaks are kept, every kind of space
becomes U+0020. Letter case, accents and punctuation are never changed.
"""

from __future__ import annotations

import math
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.textform import LOOKALIKES, TO_LATIN, compatible, script
from lumenloom.operators.skew import join_hot_keys_apart, join_members
from lumenloom.session import written

#: Code points below this bound hold all letters of the three scripts with look-alikes; the bigram table is at most its square.
ALPHABET = 0x530
SWITCH = -12.0
_FOREIGN = re.compile("[Ͱ-ϿЀ-ԯ]")
_LETTERS = re.compile(r"[^\W\d_]+")
_CLASSES = {m: latin + others for latin, others in LOOKALIKES.items() for m in latin + others}
_INTO = {s: {ord(m): c for latin, others in LOOKALIKES.items() for c in (latin + others) if script(c) == s for m in latin + others} for s in "LCG"}
for _s in "LCG":  # of several letters of one script with one shape, the first listed stands for all
    for _latin, _others in LOOKALIKES.items():
        _same = [c for c in _latin + _others if script(c) == _s]
        for _m in _latin + _others:
            if _same:
                _INTO[_s][ord(_m)] = _same[0]


def _texts(batch: pa.RecordBatch, column: str) -> list[str]:
    values = batch.column(column)
    return [t for t in (values.flatten() if pa.types.is_list(values.type) else values).to_pylist() if t]


def bigram_scores(df: DataFrame, column: str) -> dict[tuple[int, int], float]:
    """Log scores of letter pairs, counted over every text of the column.

    At most ALPHABET squared sums reach the driver, whatever the size of the data; pairs that include 0 are word edges.
    """

    def count(batches):
        for batch in batches:
            joined = " ".join(_texts(batch, column))
            cps = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
            letter = np.zeros(ALPHABET, dtype=bool)
            letter[[cp for cp in range(ALPHABET) if script(chr(cp))]] = True
            small = np.where((cps < ALPHABET) & letter[np.minimum(cps, ALPHABET - 1)], cps, 0).astype(np.int64)
            if len(small) < 2:
                continue
            pairs = small[:-1] * ALPHABET + small[1:]
            counts = np.bincount(pairs, minlength=ALPHABET * ALPHABET)
            keys = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts[keys], pa.int64())], ["pair", "n"])

    rows = df.select(column).mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    totals: dict[int, int] = {}
    for pair, n in rows:
        totals[pair // ALPHABET] = totals.get(pair // ALPHABET, 0) + n
    return {(pair // ALPHABET, pair % ALPHABET): math.log((n + 0.5) / (totals[pair // ALPHABET] + 50)) for pair, n in rows}


class Lattice:
    """Rewrites texts; keeps the words it has solved."""

    def __init__(self, scores: dict[tuple[int, int], float]):
        self.scores, self.solved = scores, {}

    def _pair(self, a: int, b: int) -> float:
        return self.scores.get((a if a < ALPHABET else 0, b if b < ALPHABET else 0), -14.0)

    def word(self, shape: str, prior: str) -> str:
        """The best path through the lattice of a word given in Latin shapes. prior: the scripts of the text's unmistakable letters, most frequent first."""
        key = (shape, prior)
        if key in self.solved:
            return self.solved[key]
        paths: dict[str, tuple[float, str]] = {}
        for i, ch in enumerate(shape):
            options = [c for c in dict.fromkeys(_CLASSES.get(ch, ch)) if not script(c) or ch not in _CLASSES or script(c) in prior or script(c) == "L"]
            options = options or [ch]
            step: dict[str, tuple[float, str]] = {}
            for c in options:
                s = script(c)
                if not i:
                    rank = prior.find(s)
                    step[c] = (self._pair(0, ord(c)) - 2.0 * (rank if rank >= 0 else len(prior) + 1), c)
                else:
                    step[c] = max(((score + self._pair(ord(p), ord(c)) + (SWITCH if script(p) != s else 0.0), path + c) for p, (score, path) in paths.items()), key=lambda x: (x[0], x[1]))
            paths = step
        best = max(((score + self._pair(ord(path[-1]), 0), path) for score, path in paths.values()), key=lambda x: (x[0], x[1]))[1]
        if len(self.solved) < 200_000:
            self.solved[key] = best
        return best

    def text(self, text: str) -> str:
        text = compatible(text)
        if text.isascii() or not _FOREIGN.search(text):
            return text
        shape = unicodedata.normalize("NFC", text.translate(TO_LATIN))
        found = {"L": 0, "C": 0, "G": 0}
        for ch in shape:
            if ch not in _CLASSES and (s := script(ch)):
                found[s] += 1
        prior = "".join(sorted((s for s in "LCG" if found[s]), key=lambda s: -found[s]))
        if prior in ("", "L"):
            return shape
        return _LETTERS.sub(lambda m: self.word(m[0], prior), shape)


def normalise(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """keep columns and the list column, each of its texts in the consistent form. Two passes over the texts: scores, then rewriting."""
    scores = bigram_scores(df, column)
    slim = df.select(*keep, column)

    def rewrite(batches):
        lattice = Lattice(scores)
        for batch in batches:
            values = batch.column(column)
            flat = values.flatten()
            new = pa.array([None if t is None else lattice.text(t) for t in flat.to_pylist()], pa.string())
            sizes = np.where(values.is_null(), 0, np.diff(values.offsets.to_numpy()))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            mask = pa.array(values.is_null().to_numpy(zero_copy_only=False))
            lists = pa.ListArray.from_arrays(pa.array(offsets), new, mask=mask)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [lists], [*keep, column])

    return slim.mapInArrow(rewrite, slim.schema)


def lookalike_pairs(df: DataFrame, id_col: str = "row_id", column: str = "captions") -> DataFrame:
    """<id>_a, <id>_b: pairs of rows whose lists look the same, caption by caption, and differ in at least one character.

    Rows are grouped by two 64-bit hashes of the consistent form; only forms met in more than one spelling go on, so any
    number of plain copies costs nothing. Spellings are paired, and only then expanded to their rows, large spellings in parts. Null captions equal null captions at the same position. Rows without a non-blank
    caption take no part. Rows with a null id give no pairs.
    """
    with_raw = df.where(F.exists(column, lambda c: c.rlike(r"[^\s\p{Z}\p{Cf}]"))).select(F.col(id_col), F.col(column), F.col(column).alias("_raw"))
    scores = bigram_scores(df, column)

    def rewrite(batches):
        lattice = Lattice(scores)
        for batch in batches:
            lists = batch.column(1).to_pylist()
            form = ["\x1f".join("\x00" if t is None else lattice.text(t) for t in texts) for texts in lists]
            raw = ["\x1f".join("\x00" if t is None else t for t in texts) for texts in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(form, pa.string()), pa.array(raw, pa.string())], [id_col, "form", "raw"])

    id_type = df.schema[id_col].dataType.simpleString()
    hashed = (
        with_raw.drop("_raw")
        .mapInArrow(rewrite, f"{id_col} {id_type}, form string, raw string")
        .select(id_col, F.xxhash64("form").alias("f1"), F.xxhash64(F.lit(7), "form").alias("f2"), F.xxhash64("raw").alias("r"))
    )
    hashed = written(hashed)
    # spellings of a form with the number of their rows; forms with one spelling go no further
    spelt = hashed.groupBy("f1", "f2", "r").agg(F.count(F.lit(1)).alias("size"))
    varied = spelt.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("spellings"), F.sum("size").alias("rows")).where("spellings > 1")
    some = written(join_hot_keys_apart(hashed, varied, ["f1", "f2"], "rows").select("f1", "f2", "r", id_col))
    kept = written(some.groupBy("f1", "f2", "r").agg(F.count(F.lit(1)).alias("size")))
    x, y = (kept.select("f1", "f2", F.col("r").alias(f"r{k}"), F.col("size").alias(f"s{k}")) for k in "xy")
    pairs = x.join(y, ["f1", "f2"]).where("rx < ry")
    members = join_hot_keys_apart(some, kept, ["f1", "f2", "r"], "size")
    met = join_members(members.withColumnRenamed(id_col, "i"), pairs.select("f1", "f2", F.col("rx").alias("r"), F.col("sx").alias("size"), "ry", "sy"), ["f1", "f2", "r"], "size", "i")
    both = join_members(members.withColumnRenamed(id_col, "j"), met.select("f1", "f2", F.col("ry").alias("r"), F.col("sy").alias("size"), "i"), ["f1", "f2", "r"], "size", "j")
    return both.where("i <> j").select(F.least("i", "j").alias(f"{id_col}_a"), F.greatest("i", "j").alias(f"{id_col}_b"))
