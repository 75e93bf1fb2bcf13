"""Reading level of each document (problem 10).

The words of the whole corpus are ranked by frequency. A document's coverage rank is the smallest r such that the r most frequent
words make up SHARE of its words: easy texts need few and common words, hard ones many rare ones. With the length of its sentences and of
its words it says how demanding a text is. Labelled documents calibrate this in SQL: per band the median and the spread of each
measure, which a few labels that are off do not move; a document gets the band under which its measures are most likely.

The ranking counts all words of all documents; the table that tasks hold has the VOCABULARY most frequent words. A document whose coverage rank lies beyond
sends its other words, and they are joined to the ranks of all words, so the bound changes no rank. Each character of Chinese, Japanese and Korean is a word. Documents are measured whole. A document is English if its words are in plain Latin
letters and at least as many of them are English function words as German, French, Spanish and other ones, whatever its label says.

Null and empty texts and texts without a word have null measures and no band. Labels that are null, of unknown documents, or of
documents without measures do not calibrate; a label on several rows counts several times. Without labels there are no bands. Rows
with a null id are measured, but never labelled.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.textform import words
from lumenloom.operators.algebra import place_by
from lumenloom.session import written

SHARE, VOCABULARY = 0.9, 30_000
#: Words that hold English sentences together.
FUNCTION_WORDS = frozenset("the of and is to was with that it for by this from are were but not can you her his they which has had".split())
#: The same of other languages in Latin letters, without accents.
FOREIGN_WORDS = frozenset("der das und ein eine einen einem dem den im mit auf ist nicht von zu le les une des dans et du est aux que au el los las una del con y por para es il della di che uma os na".split())
MEASURES = ("coverage", "sentence_words", "word_letters", "long_words")
_SENTENCE = re.compile(r"[.!?]+(?=\s|$)|\n\s*\n")


def word_counts(documents: DataFrame, text: str) -> DataFrame:
    """word, n over the whole corpus; counted within each task first."""

    def count(batches):
        counts: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    counts.update(words(t))
            if len(counts) > 200_000:
                yield _counted(counts)
                counts = Counter()
        yield _counted(counts)

    return documents.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


def measure(documents: DataFrame, id_col: str, text: str, share: float = SHARE, vocabulary: int = VOCABULARY) -> DataFrame:
    """<id>, n_words, english, coverage (ln of the coverage rank), sentence_words (ln of words per sentence), word_letters, long_words (share of words from 8 letters on)."""
    counts = word_counts(documents, text)
    # the candidates of all tasks meet in one task, not on the driver, which gets the bounded table only
    top = counts.orderBy(F.col("n").desc(), "word").limit(vocabulary).repartition(1)
    ranks = {r["word"]: k for k, r in enumerate(sorted(top.collect(), key=lambda r: (-r["n"], r["word"])), 1)}
    held = documents.sparkSession.sparkContext.broadcast(ranks)  # at most VOCABULARY words
    id_type = documents.schema[id_col].dataType.simpleString()
    names = [id_col, "n_words", "english", "rank", *MEASURES[1:], "beyond", "nth"]

    def score(batches):
        ranks = held.value
        for batch in batches:
            rows: list[tuple] = []
            for t in batch.column(1).to_pylist():
                found = words(t) if t else []
                n = len(found)
                if not n:
                    rows.append((0, False, *[None] * 6))
                    continue
                known = sorted([r for w in found if (r := ranks.get(w))])
                nth = min(n - 1, math.ceil(share * n) - 1)
                beyond = None if nth < len(known) else [w for w in found if w not in ranks]
                sizes = [len(w) for w in found]
                latin = sum(map(str.isascii, found)) / n
                english = latin >= 0.6 and sum(map(FUNCTION_WORDS.__contains__, found)) >= sum(map(FOREIGN_WORDS.__contains__, found))
                sentences = sum(1 for s in _SENTENCE.split(t) if s and s.strip())
                rows.append((n, english, known[nth] if beyond is None else None, math.log(n / max(1, sentences)), sum(sizes) / n, sum(s >= 8 for s in sizes) / n, beyond, None if beyond is None else nth - len(known)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [pa.int64(), pa.bool_(), pa.int64()] + [pa.float64()] * 3 + [pa.list_(pa.string()), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    ddl = f"{id_col} {id_type}, n_words long, english boolean, rank long, {', '.join(f'{m} double' for m in MEASURES[1:])}, beyond array<string>, nth int"
    scored = written(documents.select(id_col, text).mapInArrow(score, ddl).withColumn("_row", F.monotonically_increasing_id()))
    rest = scored.where("beyond is not null").select("_row", "beyond", "nth")
    if not rest.isEmpty():
        # the ranks of all words; those beyond the table are rare, so no key of this join is hot
        every = place_by(counts, [], [-F.col("n"), F.col("word")], "place").select("word", (F.col("place") + 1).alias("r"))
        far = rest.select("_row", "nth", F.explode("beyond").alias("word")).join(every, "word").groupBy("_row").agg(F.get(F.array_sort(F.collect_list("r")), F.first("nth")).alias("far"))
        scored = scored.join(far, "_row", "left").withColumn("rank", F.coalesce("rank", "far"))
    return scored.select(id_col, "n_words", "english", F.ln("rank").alias(MEASURES[0]), *MEASURES[1:])


def calibrate(measured: DataFrame, labels: DataFrame, id_col: str, band: str) -> list:
    """One row per band: its share of the labels, and the median and half the central 68 % of each measure. As many rows as there are bands."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(band).isNotNull()).select(F.col(id_col), F.col(band).alias("band"))
    stats = ", ".join(f"percentile_approx({m}, 0.5, 2000) AS {m}_mid, percentile_approx({m}, 0.84, 2000) - percentile_approx({m}, 0.16, 2000) AS {m}_wide" for m in MEASURES)
    return measured.sparkSession.sql(
        f"""
        SELECT band, count(*) AS n, {stats}
        FROM {{measured}} JOIN {{known}} USING ({id_col})
        WHERE n_words > 0 GROUP BY band ORDER BY band""",
        measured=measured, known=known,
    ).collect()


def band_expression(stats: list) -> Column:
    """The band under which the measures are most likely (each by itself, with tails as of Student's t with two degrees of freedom, so that a quoted passage does not decide); null without measures. Of equal bands the lower."""
    if not stats:
        return F.lit(None).cast("int")
    total = sum(r["n"] for r in stats)
    scored = []
    for r in stats:
        terms = [f"{math.log(r['n'] / total):.12f}D"]
        for m in MEASURES:
            wide = max((r[f"{m}_wide"] or 0.0) / 2, 0.05)
            terms.append(f"- 1.5D * ln(1 + power(({m} - {r[f'{m}_mid']:.12f}D) / {wide:.12f}D, 2) / 2) - {math.log(wide):.12f}D")
        scored.append(f"struct({' '.join(terms)} AS s, {-r['band']} AS b)")
    return F.expr(f"CASE WHEN n_words > 0 THEN -array_max(array({', '.join(scored)})).b END").cast("int")


def reading_bands(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", band: str = "reading_band") -> DataFrame:
    """<id>, n_words, is_english, the measures and band of each document. A band of a text in another language says how it would read by the same measures."""
    measured = written(measure(documents, id_col, text))
    stats = calibrate(measured.where("english"), labels, id_col, band)
    return measured.select(id_col, "n_words", F.col("english").alias("is_english"), *MEASURES, band_expression(stats).alias("band"))


def unlabelled_in_band(documents: DataFrame, labels: DataFrame, wanted: int, id_col: str = "doc_id", text: str = "text", band: str = "reading_band") -> DataFrame:
    """<id> of the English documents of a band that have no label of their own."""
    found = reading_bands(documents, labels, id_col, text, band).where(F.col("is_english") & (F.col("band") == wanted)).select(id_col)
    return found.join(labels.select(id_col), id_col, "left_anti")
