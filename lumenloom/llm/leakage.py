"""Passages of held-out items inside a corpus (problem 9).

Latent semantic retrieval. Words (characters of Chinese, Japanese and Korean text in pairs) are hashed to TERMS terms whose document frequencies are counted over the whole
corpus. A randomised SVD of TF-IDF passages, distributed over tasks, gives RANK latent directions; it is fitted on passages of items and
a bounded sample of documents (SAMPLE_PASSAGES; SAMPLE_DOCUMENTS, by hash of the id), and then every passage of every document is projected and held
against the items' passages by cosine. As an item may stand in two short pieces, which half fill a passage and need not be near, the cosine leaves
nothing out: a document is checked against every item of which it has runs of RUN words that together are long enough. The check is a longest
common subsequence of runs, in the item's order: runs with little changed between them make pieces, every part of which is tried, and the best one or two
pieces, in order, must hold WORDS words of the item (CHARACTERS of a Chinese, Japanese or Korean one, in which changes are counted by characters, as a
changed character splits a name or number). Its gaps are bounded, as a plain common subsequence grows with any long text.
A piece of WORDS and more with more changes than allowed counts if it keeps its answers: the rarest fifth of its terms, each of which stands in it.

Items are held by every task in blocks of about BLOCK_ITEMS; more items make more passes over the documents, never a larger task. The corpus is never
collected or shuffled. A first line of an item that other items share is an instruction and not part of its passage.

Null and empty texts match nothing; null ids of documents and items are kept out; items with fewer words than asked for match nothing. Repeated documents
are all reported. Whole texts are searched, however long.
"""

from __future__ import annotations

import itertools
import math
from bisect import bisect_right
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.textform import compatible, fold, words

WORDS, CHARACTERS = 24, 36
TERMS, RANK, OVERSAMPLING = 1 << 13, 40, 8
#: Words of a block; a passage is two blocks that follow each other, and the next one begins a block later.
BLOCK = 12
#: Cosine from which a passage is near an item by the latent search; pairs below are checked as well, by their runs. And at most so many groups of items' passages in the first look.
NEAR, GROUPS = 0.8, 64
#: The fit reads so many documents, and so many passages of items, at most.
SAMPLE_DOCUMENTS, SAMPLE_PASSAGES = 600, 20_000
#: Items that a task holds at once.
BLOCK_ITEMS = 20_000
#: Runs that lie on neighbouring diagonals if a text holds enough of an item. The larger one of two pieces has 12 words, on one diagonal if it has less than 24, so 9 runs.
#: In a piece of n words from 24 on, of which a fifth at most is changed, n - 3 (n // 5 + 1) runs drift over n // 5 diagonals; 7 of them lie within 8 diagonals, whatever n.
ALIGNED = 7
#: Rare terms that a reworded piece must keep at least.
ANSWERS = 4
#: Words of a run; words of a gap within a piece; words of the shortest piece.
RUN, GAP, SHORTEST_PIECE = 4, 4, 8


class Vocabulary(dict):
    """Word -> number, with what is asked of words as arrays: hash, letters, whether it is a character of Chinese, Japanese or Korean, and its number among the items' words or -1."""

    def __init__(self, numbers: dict[str, int] | None = None):
        self.numbers = numbers or {}
        self._begin()

    def _begin(self) -> None:
        self.clear()
        self._new: list[tuple[int, int, bool, int]] = []
        self._known = np.zeros((4, 0), dtype=np.uint64)

    def __missing__(self, word: str) -> int:
        h = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        self[word] = n = len(self)
        self._new.append((h, len(word), word >= "⺀", self.numbers.get(word, -1) + 1))
        return n

    def begin(self) -> None:
        """Forget all words when there are too many; numbers given so far mean nothing after that."""
        if len(self) > 500_000:
            self._begin()

    def facts(self) -> np.ndarray:
        if self._new:
            self._known = np.concatenate([self._known, np.array(self._new, dtype=np.uint64).T], axis=1)
            self._new = []
        return self._known


class Words:
    """The words of texts as flat arrays: numbers, sizes (words of each text), doc (the text of each word), terms, codes (numbers among the items' words or -1), cjk (of each text)."""

    def __init__(self, tokens: list[list[str]], known: Vocabulary):
        known.begin()
        self.sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        ids = np.fromiter(map(known.__getitem__, itertools.chain.from_iterable(tokens)), dtype=np.int64, count=int(self.sizes.sum()))
        h, letters, wide, code = known.facts()[:, ids] if len(ids) else np.zeros((4, 0), dtype=np.uint64)
        self.doc = np.repeat(np.arange(len(tokens)), self.sizes)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.codes = code.astype(np.int64) - 1
        total = lambda x: np.bincount(self.doc, weights=x, minlength=len(tokens))
        # most of the words are single characters, names in other letters between them aside
        self.cjk = (total(letters) < 2.2 * self.sizes) & (total(wide) * 2 > self.sizes)
        following = np.append(h[1:], np.uint64(0)) if len(h) else h
        following[np.flatnonzero(self.doc[1:] != self.doc[:-1])] = 0
        # a character of a language without blanks is taken together with the next one
        mixed = h ^ ((following * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(7)) + np.uint64(1))
        self.terms = (np.where(self.cjk[self.doc], mixed, h) % np.uint64(TERMS)).astype(np.int64)

    def lists(self) -> list[np.ndarray]:
        return np.split(self.terms, np.cumsum(self.sizes)[:-1]) if len(self.sizes) else []


def _own(items: DataFrame, id_col: str, text: str) -> DataFrame:
    """<id>, passage: the own passage of each item, without a first line that other items share."""
    rows = items.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(id_col, text)
    cut = rows.select(id_col, text, F.when(F.instr(text, "\n") > 0, F.trim(F.substring_index(text, "\n", 1))).alias("head"))
    shared = cut.groupBy("head").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and head is not null").select("head", F.lit(True).alias("is_shared"))
    rest = F.expr(f"substring({text}, instr({text}, '\n') + 1)")
    return cut.join(shared, "head", "left").select(id_col, F.when(F.col("is_shared") & (rest != ""), rest).otherwise(F.col(text)).alias("passage"))


def item_passages(own: DataFrame, id_col: str, blocks: int, block: int) -> list[tuple[int, list[str], np.ndarray, bool]]:
    """(id, words, sizes before each word, whether it is of a language without blanks) of the items of a block; only these come to the driver."""
    some = own.where(F.pmod(F.xxhash64(id_col), F.lit(blocks)) == block) if blocks > 1 else own
    out = []
    for i, passage in sorted((tuple(r) for r in some.collect()), key=lambda r: r[0]):
        tokens = words(passage)
        cjk = bool(tokens) and sum(map(len, tokens)) < 2.2 * len(tokens) and sum(t >= "⺀" for t in tokens) * 2 > len(tokens)
        out.append((i, tokens, item_sizes(passage, tokens, cjk), cjk))
    return out


def document_frequencies(documents: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Documents with each term, and all documents with words; at most TERMS sums reach the driver."""

    def count(batches):
        known = Vocabulary()
        seen, n = np.zeros(TERMS, dtype=np.int64), 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo in range(0, len(texts), 200):
                w = Words([words(t) if t else [] for t in texts[lo : lo + 200]], known)
                n += int((w.sizes > 0).sum())
                seen += np.bincount(np.unique(w.doc * TERMS + w.terms) % TERMS, minlength=TERMS)
        keys = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(keys, -1)), pa.array(np.append(seen[keys], n))], ["term", "n"])

    found = documents.select(text).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(TERMS), 0
    for term, n in found:
        if term < 0:
            total = n
        else:
            df[term] = n
    return df, total


def _passages(term_list: np.ndarray, width: int = 2 * BLOCK, step: int = BLOCK) -> list[np.ndarray]:
    return [term_list[k : k + width] for k in range(0, max(1, len(term_list) - width + step), step)]


def _rows(passages: list[np.ndarray], weight: np.ndarray) -> np.ndarray:
    """TF-IDF rows of unit length."""
    out = np.zeros((len(passages), TERMS), dtype=np.float32)
    for k, p in enumerate(passages):
        np.add.at(out[k], p, weight[p])
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def latent_directions(documents: DataFrame, text: str, id_col: str, passages: list[np.ndarray], weight: np.ndarray, n_documents: int, seed: int = 0) -> np.ndarray:
    """(TERMS, RANK): right singular vectors of the TF-IDF passages of the sample and the items, by randomised subspace iteration.

    Each of a bounded number of tasks multiplies its own passages twice with the current subspace and sends one matrix of that size.
    """
    u = F.pmod(F.xxhash64(id_col, F.lit(31)), F.lit(1 << 40))
    limit = min(1 << 40, int((1 << 40) * SAMPLE_DOCUMENTS / max(1, n_documents)))
    sample = documents.where(F.col(id_col).isNotNull() & F.col(text).isNotNull() & (u < F.lit(limit))).select(text).limit(4 * SAMPLE_DOCUMENTS).repartition(4)
    size = RANK + OVERSAMPLING
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((TERMS, size)))[0].astype(np.float32)

    def apply(rows: list[np.ndarray], basis: np.ndarray) -> np.ndarray:
        out = np.zeros((TERMS, size), dtype=np.float32)
        for lo in range(0, len(rows), 256):
            a = _rows(rows[lo : lo + 256], weight)
            out += a.T @ (a @ basis)
        return out

    for last in (False, True):

        def multiply(batches, basis=basis):
            known = Vocabulary()
            rows: list[np.ndarray] = []
            total = np.zeros((TERMS, size), dtype=np.float32)
            for batch in batches:
                for t in batch.column(0).to_pylist():
                    for terms in Words([words(t)], known).lists():
                        if len(terms):
                            rows += _passages(terms, 4 * BLOCK, 4 * BLOCK)
                    if len(rows) > 256:
                        total += apply(rows, basis)
                        rows = []
            total += apply(rows, basis)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

        image = apply(passages, basis) + sum(np.frombuffer(r[0], dtype=np.float32).reshape(TERMS, size) for r in sample.mapInArrow(multiply, "m binary").collect())
        if last:
            _, rotation = np.linalg.eigh((basis.T @ image).astype(np.float64))
            return (basis @ rotation[:, ::-1][:, :RANK].astype(np.float32)).astype(np.float32)
        basis = np.linalg.qr(image)[0].astype(np.float32)
    raise AssertionError


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _group(vectors: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Centres and members of at most k groups of unit vectors, by a few rounds of spherical k-means."""
    k = min(k, len(vectors))
    centres = vectors[np.random.default_rng(seed).permutation(len(vectors))[:k]]
    for _ in range(6):
        member = (vectors @ centres.T).argmax(1)
        centres = _unit(np.stack([vectors[member == j].sum(0) if (member == j).any() else centres[j] for j in range(k)]))
    return centres, (vectors @ centres.T).argmax(1)


def distance(a, b) -> int:
    """Items to change, add or leave out to make b of a; of what stands in a gap, so both are short."""
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def chains(item: list, text: list, seeds: list[tuple[int, int]], gap: int = GAP, joined: bool = False) -> list[tuple[list[tuple[int, int, int]], list[int]]]:
    """Chains of runs (item place, text place, words) that follow each other in both, no more than gap words apart, with what changed in each gap (words; if joined, characters).

    seeds are the places (item, text) where RUN words agree. A run continues the nearest chain that ends before it, looked up by the difference of its ends,
    so any number of repetitions may stand between.
    """
    runs, done = [], set()
    for p, q in sorted(seeds, key=lambda s: (s[1], s[0])):
        if (p - q, q) in done:
            continue
        n = RUN
        while p + n < len(item) and q + n < len(text) and item[p + n] == text[q + n]:
            n += 1
        done.update((p - q, q + k) for k in range(n))
        runs.append((p, q, n))
    out: list[tuple[list[tuple[int, int, int]], list[int]]] = []
    last: dict[int, tuple[int, int, int]] = {}
    for p, q, n in sorted(runs):
        best = None
        for diagonal in range(p - q - gap, p - q + gap + 1):
            if (c := last.get(diagonal)) is not None:
                over = max(c[0] - p, c[1] - q, 0)  # words that would be counted twice
                apart = max(p + over - c[0], q + over - c[1])
                if over < n and apart <= gap and (best is None or apart < best[0]):
                    best = apart, over, diagonal, c
        if best is None:
            out.append(([(p, q, n)], []))
            last[p - q] = (p + n, q + n, len(out) - 1)
            continue
        _, over, diagonal, (p0, q0, k) = best
        del last[diagonal]
        a, b = item[p0 : p + over], text[q0 : q + over]
        out[k][0].append((p + over, q + over, n - over))
        out[k][1].append(distance("".join(a), "".join(b)) if joined else distance(a, b))
        last[p - q] = (p + n, q + n, k)
    return out


def allowed(agreeing: int, cjk: bool) -> int:
    """Changed words, or characters, that a piece may hold for so many that agree. Short pieces are strict, as phrases that many texts share differ in a name or two."""
    if cjk:
        return agreeing // 9 if agreeing >= 72 else agreeing // 14 if agreeing >= CHARACTERS else 0
    return agreeing // 7 if agreeing >= 40 else agreeing // 12 if agreeing >= WORDS else 0


def spans(found: list[tuple[list[tuple[int, int, int]], list[int]]], sizes: list[int], cjk: bool) -> list[tuple[int, int, int, int, int, int]]:
    """(agreeing, changed, item begin, item end, text begin, text end) of every part of a chain, from a run to a later one, of at least SHORTEST_PIECE words that agree. What agrees is counted as sizes are: words or characters."""
    out = []
    for runs, costs in found:
        for i, (p, q, _) in enumerate(runs):
            changed = tokens = 0
            for j in range(i, len(runs)):
                a, b, n = runs[j]
                tokens += n
                changed += costs[j - 1] if j > i else 0
                if tokens >= SHORTEST_PIECE:
                    out.append((sizes[a + n] - sizes[p] - changed, changed, p, a + n, q, b + n))
    return out


def held(found: list[tuple[int, int, int, int, int, int]]) -> int:
    """The most that one or two of the pieces hold, apart from each other and in the same order in both texts."""
    best = max((x[0] for x in found), default=0)
    ends, tops = [], []  # text ends and the most that a piece which ends there or before holds, both rising
    waiting = sorted(found, key=lambda x: x[3])
    k = 0
    for n, _, begin, _, text_begin, _ in sorted(found, key=lambda x: x[2]):
        while k < len(waiting) and waiting[k][3] <= begin:
            m, end = waiting[k][0], waiting[k][5]
            at = bisect_right(ends, end)
            if not at or tops[at - 1] < m:
                while at < len(ends) and tops[at] <= m:
                    del ends[at], tops[at]
                ends.insert(at, end)
                tops.insert(at, m)
            k += 1
        at = bisect_right(ends, text_begin)
        if at:
            best = max(best, n + tops[at - 1])
    return best


def _run_hashes(codes: list[np.ndarray] | np.ndarray) -> np.ndarray:
    """A hash of each run, given by its first, second, and further words."""
    h = np.zeros(len(codes[0]), dtype=np.uint64)
    for w in codes:
        h = (h + w.astype(np.uint64)) * np.uint64(6364136223846793005)
        h ^= h >> np.uint64(29)
    return h


def item_sizes(passage: str, tokens: list[str], cjk: bool) -> list[int]:
    """The size of an item before each of its words, and its whole size."""
    if not cjk:
        return list(range(len(tokens) + 1))
    folded, at, out, seen = fold(passage), 0, [], 0
    visible = "".join(c for c in compatible(passage) if not c.isspace())
    for token in tokens:
        place = folded.find(token, at)
        seen += place - at - folded.count(" ", at, place) if place >= 0 else 0
        out.append(seen)
        seen += len(token)
        at = max(place, at) + len(token)
    # what is no word (punctuation) folds to blanks; it is spread over the words, as only sums over long pieces count
    rest = max(0, len(visible) - seen)
    return [n + rest * k // max(1, len(tokens)) for k, n in enumerate([*out, seen])]


def _aligned(bounds: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """Of each group of runs, which begins at a bound and ends before the next, the most that lie within 16 diagonals (differences of places), in either of two rows of such strips."""
    n = len(bounds) - 1
    out = np.zeros(n, dtype=np.int64)
    if n <= 0:
        return out
    group = np.repeat(np.arange(n), np.diff(bounds))
    for shift in (0, 8):
        strip = (diagonals + shift) >> 4
        low, high = int(strip.min()), int(strip.max())
        code, count = np.unique(group * (high - low + 1) + (strip - low), return_counts=True)
        np.maximum.at(out, code // (high - low + 1), count)
    return out


class Index:
    """The runs of the items' words, sorted by hash."""

    def __init__(self, coded: list[list[int]]):
        of = [(k, p) for k, codes in enumerate(coded) for p in range(len(codes) - RUN + 1)]
        self.item, self.place = np.array(of, dtype=np.int64).reshape(-1, 2).T
        h = _run_hashes([np.array([coded[k][p + j] for k, p in of], dtype=np.int64) for j in range(RUN)])
        order = np.argsort(h, kind="stable")
        self.hashes, self.item, self.place = h[order], self.item[order], self.place[order]
        self.known = np.zeros(1 << 20, dtype=bool)
        self.known[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def seeds(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, place in the item, place in the text) of all runs of the texts that are runs of items."""
        n = len(w.codes) - RUN + 1
        if n <= 0 or not len(self.hashes):
            return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
        good = (w.doc[:n] == w.doc[RUN - 1 :]) & (w.codes[:n] >= 0)
        for j in range(1, RUN):
            good &= w.codes[j : n + j] >= 0
        at = np.flatnonzero(good)
        h = _run_hashes([w.codes[at + j] for j in range(RUN)])
        some = self.known[(h >> np.uint64(44)).astype(np.int64)]
        at, h = at[some], h[some]
        lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        times = hi - lo
        q = np.repeat(at, times)
        which = np.repeat(lo - (np.cumsum(times) - times), times) + np.arange(len(q))
        return w.doc[q], self.item[which], self.place[which], q - w.begin[w.doc[q]]


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """<item>, <doc>, n_words, leaked_share, answer_share, cosine: each document with the items of which it holds a passage.

    Items are held by every task in blocks of about block_items; each block is one pass over the documents.
    """
    doc_type, item_type = documents.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    ddl = f"{item_id} {item_type}, {doc_id} {doc_type}, n_words int, leaked_share double, answer_share double, cosine double"
    nothing = documents.sparkSession.createDataFrame([], ddl)
    passages = _own(items, item_id, text)
    blocks = max(1, -(-items.count() // block_items))
    df, n_documents = document_frequencies(documents, text)
    if not n_documents:
        return nothing
    weight = np.maximum(np.log((n_documents + 1) / (df + 0.5)), 0.05).astype(np.float32)
    directions, parts = None, []
    for block in range(blocks):
        own = item_passages(passages, item_id, blocks, block)
        lists = Words([tokens for _, tokens, _, _ in own], Vocabulary()).lists()
        windows = [(k, p) for k, x in enumerate(lists) if len(x) for p in _passages(x, 2 * BLOCK, BLOCK // 2)]
        if not windows:
            continue
        if directions is None:  # fitted once, on the documents of the sample and passages of the first items
            directions = latent_directions(documents, text, doc_id, [p for _, p in windows[:SAMPLE_PASSAGES]], weight, n_documents)
        parts.append(_search(documents, own, lists, windows, directions, weight, df, (doc_id, item_id, text), (items.schema[item_id].dataType, documents.schema[doc_id].dataType), ddl))
    return reduce(DataFrame.union, parts) if parts else nothing


def _search(documents: DataFrame, own: list, lists: list[np.ndarray], windows: list, directions: np.ndarray, weight: np.ndarray, df: np.ndarray, names: tuple[str, str, str], types: tuple, ddl: str) -> DataFrame:
    """The leaks of a block of items."""
    from pyspark.sql.pandas.types import to_arrow_type

    doc_id, item_id, text = names
    into = (directions * weight[:, None]).astype(np.float32)
    vectors = _unit(np.stack([into[p].sum(0) for _, p in windows]))
    owner = np.array([k for k, _ in windows])
    centres, member = _group(vectors, GROUPS)
    # a passage within NEAR of a vector is within this cosine of the centre of its group
    spread = np.array([float((vectors[member == j] @ centres[j]).min()) if (member == j).any() else 1.0 for j in range(len(centres))])
    reach = np.cos(np.minimum(np.arccos(NEAR) + np.arccos(np.clip(spread, -1, 1)), math.pi)).astype(np.float32)
    grouped = [(np.ascontiguousarray(vectors[member == j].T), owner[member == j]) for j in range(len(centres))]
    numbers: dict[str, int] = {}
    coded = [[numbers.setdefault(w, len(numbers)) for w in tokens] for _, tokens, _, _ in own]
    spelt = [tokens if cjk else codes for codes, (_, tokens, _, cjk) in zip(coded, own, strict=True)]
    rare = [_rarest(x, df) for x in lists]
    kinds = [*map(to_arrow_type, types), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
    n_items = len(own)
    # words that runs cover at least; characters are fewer words if names stand between them
    least = [SHORTEST_PIECE if cjk else WORDS for _, _, _, cjk in own]

    def search(batches):
        index, known = Index(coded), Vocabulary(numbers)
        for batch in batches:
            out: list[tuple] = []
            texts = batch.column(1).to_pylist()
            for lo in range(0, len(texts), 200):
                tokens = [words(t) if t else [] for t in texts[lo : lo + 200]]
                w = Words(tokens, known)
                blocks = -(-w.sizes // BLOCK)
                if not blocks.sum():
                    continue
                starts = np.repeat(w.begin, blocks) + (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK
                sums = np.add.reduceat(into[w.terms], starts, axis=0)
                of = np.repeat(np.arange(len(tokens)), blocks)
                passage = sums.copy()
                following = np.flatnonzero(of[:-1] == of[1:])
                passage[following] += sums[following + 1]
                passage = _unit(passage)
                reached = passage @ centres.T >= reach
                near = np.full((len(tokens), n_items), -1.0, dtype=np.float32)
                for j in np.flatnonzero(reached.any(0)):
                    rows = np.flatnonzero(reached[:, j])
                    cosine = passage[rows] @ grouped[j][0]
                    hit = np.flatnonzero(cosine >= NEAR)
                    row, column = np.divmod(hit, cosine.shape[1])
                    np.maximum.at(near, (of[rows[row]], grouped[j][1][column]), cosine.ravel()[hit])
                doc, item, p, q = index.seeds(w)
                pair = doc * n_items + item
                order = np.lexsort((q, pair))
                pair, p, q = pair[order], p[order], q[order]
                bounds = np.concatenate([[0], np.flatnonzero(pair[1:] != pair[:-1]) + 1, [len(pair)]]) if len(pair) else np.zeros(1, dtype=np.int64)
                # what pieces hold of words stands at places of the document that their runs cover
                covered = np.minimum(np.diff(q, append=0), RUN)
                covered[bounds[1:] - 1] = RUN
                covered = np.add.reduceat(covered, bounds[:-1]) if len(pair) else covered
                aligned = _aligned(bounds, p - q)
                for a, b, size, most in zip(bounds.tolist(), bounds[1:].tolist(), covered.tolist(), aligned.tolist(), strict=False):
                    d, k = divmod(int(pair[a]), n_items)
                    _, _, sizes, cjk = own[k]
                    if size < least[k] or not cjk and most < ALIGNED:
                        continue
                    said = tokens[d] if cjk else w.codes[w.begin[d] : w.begin[d] + w.sizes[d]].tolist()
                    found = spans(chains(spelt[k], said, list(zip(p[a:b].tolist(), q[a:b].tolist(), strict=True)), 2 * GAP if cjk else GAP, cjk), sizes, cjk)
                    terms = w.terms[w.begin[d] : w.begin[d] + w.sizes[d]]
                    n = held([x for x in found if x[1] <= allowed(x[0], cjk) or _answers(x, lists[k], terms, df)])
                    if n >= (CHARACTERS if cjk else WORDS):
                        cosine = float(near[d, k])
                        if cosine < NEAR:
                            cosine = float((passage[of == d] @ vectors[owner == k].T).max())
                        out.append((own[k][0], batch.column(0)[lo + d].as_py(), n, n / sizes[-1], len(rare[k] & set(terms.tolist())) / len(rare[k]), round(cosine, 4)))
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [item_id, doc_id, "n_words", "leaked_share", "answer_share", "cosine"])

    return documents.where(F.col(doc_id).isNotNull()).select(doc_id, text).mapInArrow(search, ddl)


def _rarest(terms: np.ndarray, df: np.ndarray) -> set[int]:
    """The rarest fifth of the terms of a text, its answers; ANSWERS at least."""
    own = sorted(set(terms.tolist()), key=lambda t: (df[t], t))
    return set(own[: max(ANSWERS, len(own) // 5)])


def _answers(span: tuple[int, int, int, int, int, int], item: np.ndarray, text: np.ndarray, df: np.ndarray) -> bool:
    """Whether a reworded piece keeps its answers: all of its rarest terms stand in the document's piece as well, and no more than a fifth is changed. A short piece has too few of them to tell."""
    agreeing, changed, p0, p1, q0, q1 = span
    return agreeing >= WORDS and changed * 5 <= agreeing and _rarest(item[p0:p1], df) <= set(text[q0:q1].tolist())
