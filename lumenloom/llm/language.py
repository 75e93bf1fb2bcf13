"""The language of each record and of each of its segments, with a confidence (problem 6).

String-kernel classification: a segment (a sentence, or what stands between line breaks) is the set of its character 1-, 2-
and 3-grams; the blended-spectrum presence kernel of two segments is the cosine of those sets. A bounded, labelled sample of
segments gives the Nyström landmarks, one-versus-rest kernel ridge regression is fitted in their feature space, and since
the kernel is a scalar product of presence vectors, landmarks and weights fold into one matrix: a batch of segments is scored by
one product of its presence matrix with that matrix.

The sample holds at most SAMPLE_ROWS rows per language, chosen by a hash of the id; segments that the first fit contradicts
(wrong labels) are left out of the second. Every row of the data is scored, with all its text.

Null and empty captions have no segments; rows without a segment that is a running sentence get no language. Null ids are kept as they are; rows that share an id are one record.
A segment whose best score is below OTHER is in none of the languages: "other" among segments, and no evidence for its record.
An input without a single labelled sentence cannot be fitted and gives null languages.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("en", "zh", "ja", "de", "fr", "es", "ru")
#: Spellings of the languages in labels.
SPELLINGS = {
    "en": "en eng english anglais englisch", "zh": "zh zho chi chinese mandarin cmn 中文", "ja": "ja jpn japanese jp 日本語", "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français francais", "es": "es spa spanish español espanol castellano", "ru": "ru rus russian русский",
}
#: Labels that name no language.
NOTHING = ("", "und", "unknown", "n/a", "na", "none", "null", "mul", "zxx", "mis", "?", "-")

SAMPLE_ROWS, LANDMARKS, RIDGE = 120, 40, 0.05
#: Captions and letters of a sampled row that the fit reads.
SAMPLE_CAPTIONS, SAMPLE_LETTERS = 16, 4000
#: Score of a segment, between -1 and 1 for what the fit has seen, below which it is in none of the languages.
OTHER = -0.3
BITS = 12
DIMS = 1 << BITS
BLOCK = 512
_TERMINATORS = ".!?。！？…\n\r\x1e"


def label_language(label: Column) -> Column:
    """The language that a label names, whatever its spelling or region; null for labels that name none; other labels as they are, in lower case."""
    low = F.lower(F.trim(label))
    head = F.regexp_extract(low, r"^([^-_ (]+)", 1)
    named = None
    for language, spellings in SPELLINGS.items():
        hit = head.isin(spellings.split())
        named = F.when(hit, language) if named is None else named.when(hit, language)
    return F.when(low.isNull() | low.isin(*NOTHING), F.lit(None)).otherwise(named.otherwise(low))


def _letter_table() -> np.ndarray:
    kinds = np.zeros(0x10000, dtype=np.uint8)
    for cp in range(0x10000):
        if chr(cp).isalpha():
            kinds[cp] = 2 if 0x2E80 <= cp <= 0x9FFF or 0xF900 <= cp <= 0xFAFF or 0x3040 <= cp <= 0x30FF else 1
    kinds[0x30FC] = 2
    return kinds


_TABLES: dict[str, np.ndarray] = {}


class Segments:
    """The segments of a list of texts: for each its text, its letters, words and whether it ends as a sentence does."""

    def __init__(self, texts: list[str]):
        if not _TABLES:
            _TABLES["kinds"] = _letter_table()
            ends = np.zeros(0x10000, dtype=bool)
            ends[[ord(c) for c in _TERMINATORS]] = True
            _TABLES["ends"] = ends
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.raw = "\x1e".join(texts) + "\x1e" if texts else ""
        raw = np.minimum(np.frombuffer(self.raw.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 0xFFFF)
        low = self.raw.lower()
        cps = np.minimum(np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 0xFFFF) if len(low) == len(self.raw) else raw
        kind = _TABLES["kinds"][raw]
        stop = _TABLES["ends"][raw]
        # a stop between letters or digits (3.5, a.m) ends nothing; a run of stops ends once
        after = np.append(raw[1:], 0x1E)
        ends = stop & ~((raw == 0x2E) & (after != 0x20) & ~_TABLES["ends"][np.minimum(after, 0xFFFF)] & (_TABLES["kinds"][after] != 0))
        seg = np.concatenate([[0], np.cumsum(ends)[:-1]]) if len(ends) else np.zeros(0, dtype=np.int64)
        self.n = int(seg[-1]) + 1 if len(seg) else 0
        text_of = np.repeat(np.arange(len(texts)), lengths) if len(texts) else np.zeros(0, dtype=np.int64)
        self.text = np.zeros(self.n, dtype=np.int64)
        self.text[seg] = text_of
        letter = kind > 0
        start = letter & ~np.concatenate([[False], (letter | (raw == 0x27) | (raw == 0x2019))[:-1]])
        self.letters = np.bincount(seg, weights=letter, minlength=self.n).astype(np.int64)
        self.han = np.bincount(seg, weights=kind == 2, minlength=self.n).astype(np.int64)
        self.words = np.bincount(seg, weights=start & (kind == 1), minlength=self.n).astype(np.int64)
        last = np.flatnonzero(ends)
        self.whole = np.zeros(self.n, dtype=bool)
        self.whole[: len(last)] = np.isin(raw[last], [ord(c) for c in ".!?。！？"])
        self.offsets = np.concatenate([[0], last + 1])[: self.n]
        self._seg, self._cps = seg, np.where(letter, cps, 32)

    def presence(self, only: np.ndarray):
        """Blocks of (segment numbers, presence matrix) of the segments in only, in order."""
        gram = self._cps.astype(np.uint32)
        n = len(gram)
        with np.errstate(over="ignore"):
            one = gram * np.uint32(2654435761)
            two = (gram[:-1] * np.uint32(2246822519) + gram[1:] * np.uint32(3266489917)) ^ np.uint32(0x9E3779B9) if n > 1 else gram[:0]
            three = (two[:-1] ^ (gram[2:] * np.uint32(668265263))) * np.uint32(374761393) if n > 2 else gram[:0]
            two = two * np.uint32(2654435761)
        starts = np.append(self.offsets, n)
        for lo in range(0, len(only), BLOCK):
            part = only[lo : lo + BLOCK]
            block = np.zeros((len(part), DIMS), dtype=np.float32)
            a, b = int(starts[part[0]]), int(starts[part[-1] + 1])
            place = np.full(int(part[-1] - part[0]) + 1, -1, dtype=np.int64)
            place[part - part[0]] = np.arange(len(part))
            seg = self._seg[a:b]
            row = place[seg - part[0]]
            for size, codes in ((1, one), (2, two), (3, three)):
                k = max(0, b - a - size + 1)
                inside = row[:k] >= 0
                if size > 1:
                    inside &= seg[:k] == seg[size - 1 :]
                block[row[:k][inside], (codes[a : a + k][inside] >> np.uint32(32 - BITS)).astype(np.int64)] = 1.0
            yield part, block


def running(segments: Segments) -> np.ndarray:
    """2 for a whole sentence, 1 for a long piece of text without its end, 0 for titles, names and tags."""
    size = segments.words + segments.han // 2
    whole = segments.whole & (size >= 4)
    return np.where(whole, 2, np.where(size >= 9, 1, 0))


def fit(sample: list[tuple[str, list[str]]], seed: int = 0) -> np.ndarray | None:
    """The matrix (DIMS + 1, languages) of scores from labelled records; the last row is the intercept. None without any sentence."""
    texts = [t for _, captions in sample for t in captions]
    labels = np.array([LANGUAGES.index(label) for label, captions in sample for _ in captions], dtype=np.int64)
    segments = Segments(texts)
    only = np.flatnonzero(running(segments) == 2)
    if not len(only):
        return None
    presence = np.empty((len(only), DIMS), dtype=np.float32)
    at = 0
    for part, block in segments.presence(only):
        presence[at : at + len(part)] = block / np.sqrt(np.maximum(block.sum(1, keepdims=True), 1))
        at += len(part)
    truth = labels[segments.text[only]]
    random = np.random.default_rng(seed)
    keep = np.ones(len(only), dtype=bool)
    for _ in range(2):
        y = truth[keep]
        marks = np.concatenate([random.permutation(np.flatnonzero(keep & (truth == k)))[:LANDMARKS] for k in range(len(LANGUAGES))])
        landmarks = presence[marks]
        values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
        good = values > 1e-6
        half = vectors[:, good] / np.sqrt(values[good])
        into = landmarks.T @ half.astype(np.float32)  # the Nyström map of a presence vector
        z = np.column_stack([presence @ into, np.ones(len(truth))])[keep]
        target = np.where(y[:, None] == np.arange(len(LANGUAGES)), 1.0, -1.0)
        balance = 1.0 / np.maximum(np.bincount(y, minlength=len(LANGUAGES)), 1)[y]
        balance *= len(y) / balance.sum()
        ridge = np.eye(z.shape[1]) * RIDGE
        ridge[-1, -1] = 1e-6
        weights = np.linalg.solve(z.T @ (z * balance[:, None]) + ridge, z.T @ (target * balance[:, None]))
        matrix = np.vstack([into @ weights[:-1], weights[-1:]]).astype(np.float32)
        scores = presence @ matrix[:-1] + matrix[-1]
        keep = scores[np.arange(len(truth)), truth] > scores.max(1) - 0.4
    return matrix


def classify(segments: Segments, only: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language number, -1 for none of them, and confidence of each of the segments in only."""
    best, sure = np.zeros(len(only), dtype=np.int64), np.zeros(len(only))
    at = 0
    for part, block in segments.presence(only):
        scores = (block @ matrix[:-1]) / np.sqrt(np.maximum(block.sum(1, keepdims=True), 1)) + matrix[-1]
        e = np.exp(4 * (scores - scores.max(1, keepdims=True)))
        best[at : at + len(part)] = np.where(scores.max(1) < OTHER, -1, scores.argmax(1))
        sure[at : at + len(part)] = 1 / e.sum(1)
        at += len(part)
    return best, sure


def labelled_sample(df: DataFrame, id_col: str, label: str, column: str, rows: int = SAMPLE_ROWS) -> list[tuple[str, list[str]]]:
    """At most rows records per language, those with the smallest hashes of their ids; the hash is cut off at a share that leaves about twice as many."""
    named = df.where(F.col(id_col).isNotNull()).withColumn("_language", label_language(F.col(label))).where(F.col("_language").isin(*LANGUAGES))
    counts = {r["_language"]: r["n"] for r in named.groupBy("_language").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    u = F.pmod(F.xxhash64(id_col, F.lit(97)), F.lit(1 << 40))
    cut = None
    for language, n in counts.items():
        limit = F.lit(min(1 << 40, int((1 << 40) * 2 * rows / n)))
        cut = F.when(F.col("_language") == language, limit) if cut is None else cut.when(F.col("_language") == language, limit)
    # the fit reads the beginning of very long texts only; what is scored is always whole
    texts = F.transform(F.slice(F.filter(column, lambda c: c.isNotNull()), 1, SAMPLE_CAPTIONS), lambda c: F.substring(c, 1, SAMPLE_LETTERS))
    found = named.where(u < cut).select("_language", u.alias("u"), F.col(id_col).alias("i"), texts.alias("texts")).where("texts is not null")
    by: dict[str, list] = {}
    for r in sorted(found.limit(len(LANGUAGES) * rows * 4).collect(), key=lambda r: (r["u"], r["i"])):
        by.setdefault(r["_language"], []).append((r["_language"], list(r["texts"])))
    return [x for language in sorted(by) for x in by[language][:rows]]


def _flat(batch: pa.RecordBatch, column: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, with the number of the row and the position in its list, of a batch's list column."""
    values = batch.column(column)
    sizes = np.where(values.is_null(), 0, np.diff(values.offsets.to_numpy()))
    row = np.repeat(np.arange(len(values)), sizes)
    position = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return [t or "" for t in values.flatten().to_pylist()], row, position


def segment_languages(df: DataFrame, id_col: str = "row_id", label: str = "lang", column: str = "captions") -> DataFrame:
    """<id>, caption_no, segment_no, n_letters, whole, language, confidence: every segment with letters; numbers start at 1."""
    matrix = fit(labelled_sample(df, id_col, label, column))
    id_type = df.schema[id_col].dataType.simpleString()

    def score(batches):
        for batch in batches:
            texts, row, position = _flat(batch, column)
            s = Segments(texts)
            only = np.flatnonzero(s.letters > 0)
            best, sure = classify(s, only, matrix) if matrix is not None else (None, None)
            text = s.text[only]
            first = np.searchsorted(s.text, np.arange(len(texts)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_col).take(pa.array(row[text])),
                    pa.array(position[text] + 1, pa.int32()),
                    pa.array(only - first[text] + 1, pa.int32()),
                    pa.array(s.letters[only], pa.int64()),
                    pa.array(s.whole[only]),
                    pa.nulls(len(only), pa.string()) if best is None else pa.array(np.array([*LANGUAGES, "other"], dtype=object)[best], pa.string()),
                    pa.nulls(len(only), pa.float64()) if sure is None else pa.array(np.round(sure, 6)),
                ],
                [id_col, "caption_no", "segment_no", "n_letters", "whole", "language", "confidence"],
            )

    return df.select(id_col, column).mapInArrow(score, f"{id_col} {id_type}, caption_no int, segment_no int, n_letters long, whole boolean, language string, confidence double")


def row_languages(df: DataFrame, id_col: str = "row_id", label: str = "lang", column: str = "captions") -> DataFrame:
    """<id>, label, language, confidence, main: one row for each language that a record's running text holds.

    The main language has most letters. Another one counts if at least two whole, confidently classified sentences are in it. label is
    the language that the record's label names, or null.
    """
    matrix = fit(labelled_sample(df, id_col, label, column))
    id_type = df.schema[id_col].dataType.simpleString()
    k = len(LANGUAGES)

    def score(batches):
        for batch in batches:
            n = batch.num_rows
            texts, row, _ = _flat(batch, column)
            s = Segments(texts)
            kind = running(s)
            only = np.flatnonzero(kind > 0)
            if matrix is None or not len(only):
                continue
            best, sure = classify(s, only, matrix)
            only, best, sure = only[best >= 0], best[best >= 0], sure[best >= 0]
            at = row[s.text[only]] * k + best
            size = s.letters[only] + s.han[only]  # a Han or kana character says as much as two letters
            letters = np.bincount(at, weights=size * np.where(kind[only] == 2, 1.0, 0.5), minlength=n * k).reshape(n, k)
            sentences = np.bincount(at, weights=(kind[only] == 2) & (sure > 0.6), minlength=n * k).reshape(n, k)
            trust = np.bincount(at, weights=size * np.where(kind[only] == 2, 1.0, 0.5) * sure, minlength=n * k).reshape(n, k)
            main = letters.argmax(1)
            held = (sentences >= 2) & (letters > 0)
            some = letters.max(1) > 0
            held[np.flatnonzero(some), main[some]] = True
            r, c = np.nonzero(held)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_col).take(pa.array(r)),
                    batch.column("label").take(pa.array(r)),
                    pa.array(np.array(LANGUAGES, dtype=object)[c], pa.string()),
                    pa.array(np.round(trust[r, c] / np.maximum(letters[r, c], 1e-9), 6)),
                    pa.array(c == main[r]),
                ],
                [id_col, "label", "language", "confidence", "main"],
            )

    slim = df.select(id_col, label_language(F.col(label)).alias("label"), column)
    return slim.mapInArrow(score, f"{id_col} {id_type}, label string, language string, confidence double, main boolean")


def wrong_labels(df: DataFrame, id_col: str = "row_id", label: str = "lang", column: str = "captions") -> DataFrame:
    """<id>, true_lang: the languages of each record whose label names none or another one, or which holds two."""
    rows = row_languages(df, id_col, label, column)
    # all rows of a record come out of one batch, but Spark need not know; a record has at most one row per language
    both = rows.groupBy(id_col).agg(F.first("label").alias("label"), F.array_sort(F.collect_set("language")).alias("held"))
    wrong = both.where((F.size("held") > 1) | F.col("label").isNull() | ~F.array_contains("held", F.coalesce("label", F.lit(""))))
    return wrong.select(id_col, F.explode("held").alias("true_lang"))
