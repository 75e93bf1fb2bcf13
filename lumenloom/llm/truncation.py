"""Texts that were cut off before their end (problem 5).

The corpus gives its vocabulary, as a trie kept in sorted order, and what its whole sentences
look like: how each opening of two words goes on to end. A text without a final stop is held against both. It is cut if

* its final token is unknown and a proper prefix of known words, or a broken character ends it,
* no whole sentence with its opening and as many commas ends in its last word (for rare words: in its last letters), and, where
  the opening is too rare to tell or the piece longer than any whole sentence that opens so, no sentence ends in its last
  two words, or
* it is as long as a field limit: far more texts without a stop have that length than the neighbouring ones.

Texts that are no running text are left alone: names, titles, tag lists and quoted titles, told from sentences by how often their opening
starts whole sentences and how often it starts short texts without a stop. A whole sentence that only lacks its stop ends as others do, and is none.

Chinese, Japanese and Korean characters count as words, and three of them as a last word. Null, empty and blank texts are never cut. All
statistics cover all texts; they are joined by key, never broadcast, but for keys of proven number.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.llm.overlap import _Hashes
from lumenloom.llm.textform import compatible
from lumenloom.operators.skew import join_hot_keys_apart
from lumenloom.session import cut_lineage

#: A word is known if it stands inside texts at least so often; a last word is rare, and judged by its letters, below RARE.
KNOWN, RARE = 2, 30
#: An opening tells something about sentence ends from so many whole sentences on.
TELLING = 5
#: Words up to which a text without a stop may be a title, and from which on it is running text in any case.
SHORT, LONG = 8, 12
#: A length is a field limit if so many times more texts without a stop have it than a neighbouring length, and such a share of all of them.
SPIKE, SPIKE_SHARE = 4.0, 0.003

_TOKEN = re.compile(r"[⺀-〇〡-鿿가-힯豈-﫿]|[^\W_⺀-鿿가-힯豈-﫿]+(?:['’-][^\W_⺀-鿿가-힯豈-﫿]+)*")
_CJK = re.compile(r"[⺀-〇〡-鿿가-힯豈-﫿]")
_STOP = re.compile(r"[.!?。]+(?=[\s\"'”’»)」』]|$)|(?<=[^\x00-\x7f])[.!?。]+|[\r\n]+")
_CLOSING = " \t\r\n\"'”’»«“„`)]}」』"
#: What may mark that a text goes on elsewhere.
_MARK = re.compile(r"(?:\.\.\.+|[\[(<]\s*(?:\.\.\.|more|read more|continued|cont\.?|cut|truncated)\s*[\])>]|\b(?:read|see) more|>>+)\s*$", re.IGNORECASE)
_COMMA = re.compile(r"[,;:、]")


def _sentence(tokens: list[str], known: _Hashes, commas: int) -> tuple[int, int, int, int]:
    """Keys of a sentence: its opening; its opening, commas and last word; the same with last letters; its last two words."""
    cjk = len(tokens) > 2 and bool(_CJK.match(tokens[-1]))
    last = "".join(tokens[-3:]) if cjk else tokens[-1]
    ending = "".join(tokens[-2:]) if cjk else tokens[-1][-3:]
    opening = hash((1, known[tokens[0]], known[tokens[1]] if len(tokens) > 1 else 0))
    return opening, hash((2, opening, commas, known[last])), hash((3, opening, commas, known[ending])), hash((4, known[tokens[-2]] if len(tokens) > 1 else 0, known[tokens[-1]]) + ((known[tokens[-3]],) if cjk else ()))


def _pieces(text: str) -> list[tuple[str, bool]]:
    """The sentences of a text and whether each ends with a stop."""
    out, at = [], 0
    for m in _STOP.finditer(text):
        out.append((text[at : m.start()], m[0][0] not in "\r\n"))
        at = m.end()
    out.append((text[at:], False))
    return [(piece, whole) for piece, whole in out if _TOKEN.search(piece)]


_FIELDS = ["kind", "key", "n", "m", "word", "id", "no", "source", "k2", "k3", "k4", "tokens", "single", "broken", "marked", "length"]


def _scan(df: DataFrame, id_col: str, column: str, source: str) -> DataFrame:
    """One pass over all texts. kind 0: words; 1: openings (n whole sentences, m most tokens); 2, 3, 4: ends; 5: openings of short texts without a stop; 9: texts without a final stop."""
    id_type, source_type = df.schema[id_col].dataType.simpleString(), df.schema[source].dataType.simpleString()
    ddl = f"kind int, key long, n long, m int, word string, id {id_type}, no int, source {source_type}, k2 long, k3 long, k4 long, tokens int, single boolean, broken boolean, marked boolean, length int"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def scan(batches):
        known = _Hashes()
        for batch in batches:
            words: Counter = Counter()
            counts: dict[tuple[int, int], list[int]] = {}
            open_texts: list[tuple] = []

            def count(kind: int, key: int, size: int) -> None:
                if (x := counts.get((kind, key))) is None:
                    counts[kind, key] = [1, size]
                else:
                    x[0] += 1
                    x[1] = max(x[1], size)

            for i, src, texts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for no, raw in enumerate(texts or [], 1):
                    if not raw or not raw.strip():
                        continue
                    text = compatible(raw)
                    bare = text.rstrip(_CLOSING)
                    broken = bare.endswith("�")
                    unmarked = _MARK.sub("", bare)
                    marked = len(unmarked) < len(bare)
                    low = unmarked.lower().rstrip("�" + _CLOSING) if marked or broken else bare.lower()
                    pieces = _pieces(low)
                    if not pieces:
                        continue
                    ended = pieces[-1][1] or (not marked and not broken and low[-1:] in ".!?。")
                    final = None
                    for k, (piece, whole) in enumerate(pieces):
                        tokens = _TOKEN.findall(piece)
                        commas = len(_COMMA.findall(piece))
                        is_final = k == len(pieces) - 1 and not ended
                        words.update(tokens[:-1] if is_final else tokens)
                        if is_final:
                            final = (tokens, commas, piece)
                        elif whole and len(tokens) > 2:
                            keys = _sentence(tokens, known, commas)
                            for kind, key in enumerate(keys, 1):
                                count(kind, key, len(tokens))
                    if final is None:
                        continue
                    tokens, commas, piece = final
                    single = len(pieces) == 1
                    quoted = single and text.strip()[:1] in "\"'“„«「『" and len(bare) < len(text.rstrip())
                    opening, k2, k3, k4 = _sentence(tokens, known, commas)
                    if single and (quoted or len(tokens) <= SHORT and not broken and not marked):
                        count(5, opening, len(tokens))
                    if quoted or single and len(tokens) < 3:
                        continue
                    open_texts.append((9, opening, 0, 0, tokens[-1], i, no, src, k2, k3, k4, len(tokens), single, broken, marked, len(raw)))
            rows = [(0, known[w], n, 0, w) + (None,) * 11 for w, n in words.items()]
            rows += [(kind, key, n, m, None) + (None,) * 11 for (kind, key), (n, m) in counts.items()]
            rows += open_texts
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(_FIELDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return df.where(F.col(id_col).isNotNull()).select(id_col, source, column).mapInArrow(scan, ddl)


def _trie(words: DataFrame, last: DataFrame) -> DataFrame:
    """word, inner: whether each final token is a proper prefix of a known word.

    A sorted vocabulary is a trie: what begins with a token stands right behind it, so it is an inner node if its successor begins with it. No prefix is ever written
    out, so a very long word costs no more than itself. Sorted by first letter, which every word behind a token shares with it.
    """
    known = words.where(F.col("n") >= KNOWN).select("word", F.lit(True).alias("known"))
    both = known.unionByName(last.select("word", F.lit(False).alias("known"))).withColumn("_letter", F.substring("word", 1, 1))
    behind = Window.partitionBy("_letter").orderBy(F.col("word").desc(), "known").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    follower = both.withColumn("_next", F.last(F.when(F.col("known"), F.col("word")), ignorenulls=True).over(behind)).where("not known")
    return follower.select("word", F.coalesce(F.startswith("_next", "word") & (F.col("_next") != F.col("word")), F.lit(False)).alias("inner"))


def judged(df: DataFrame, id_col: str = "row_id", column: str = "captions", source: str = "dataset_id") -> DataFrame:
    """<id>, caption_no, source, cut and what speaks for it, of each text that lacks a final stop; caption_no counts from 1."""
    scanned = cut_lineage(_scan(df, id_col, column, source))
    words = scanned.where("kind = 0").groupBy("word").agg(F.sum("n").alias("n"), F.first("key").alias("key"))
    counts = scanned.where("kind between 1 and 5").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.max("m").alias("m"))
    texts = scanned.where("kind = 9").select("id", "no", "source", "word", F.col("key").alias("k1"), "k2", "k3", "k4", "tokens", "single", "broken", "marked", "length")

    last = texts.groupBy("word").agg(F.count(F.lit(1)).alias("uses"))
    tokens = last.join(words.select("word", "n"), "word", "left").join(_trie(words, last), "word", "left")
    token_facts = tokens.select("word", "uses", F.coalesce("n", F.lit(0)).alias("known"), F.coalesce(F.col("inner").cast("int"), F.lit(0)).alias("below"))

    by_length = texts.where(f"not single or tokens > {SHORT}").groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    around = by_length.select(F.explode(F.array(*[F.col("length") + k for k in (-4, -3, -2, -1, 1, 2, 3, 4)])).alias("length"), "n").groupBy("length").agg((F.sum("n") / 8).alias("near"))
    enough = F.greatest(F.lit(4.0), SPIKE_SHARE * by_length.agg(F.sum("n")).scalar())
    spikes = by_length.join(around, "length", "left").where((F.col("n") >= enough) & (F.col("n") >= SPIKE * F.coalesce("near", F.lit(0)))).select("length", F.col("n").alias("spike"))

    asked = texts.select("id", "no", F.explode(F.expr("array(named_struct('kind', 1, 'key', k1), named_struct('kind', 2, 'key', k2), named_struct('kind', 3, 'key', k3), named_struct('kind', 4, 'key', k4), named_struct('kind', 5, 'key', k1))")).alias("q"))
    answers = join_hot_keys_apart(asked.select("id", "no", F.col("q.kind").alias("kind"), F.col("q.key").alias("key")), counts, ["kind", "key"], "n")
    number = lambda kind, value="n": F.coalesce(F.max(F.when(F.col("kind") == kind, F.col(value))), F.lit(0))
    found = answers.groupBy("id", "no").agg(number(1).alias("openings"), number(1, "m").alias("longest"), number(2).alias("ends"), number(3).alias("endings"), number(4).alias("pairs"), number(5).alias("titles"))

    facts = join_hot_keys_apart(texts.drop("k1", "k2", "k3", "k4"), token_facts, ["word"], "uses", how="left")
    facts = facts.join(spikes, "length", "left").join(found, ["id", "no"], "left").fillna(0, ["openings", "longest", "ends", "endings", "pairs", "titles", "spike"])

    running = f"(not single or openings >= 3 and openings > titles or openings + titles < 3 and tokens > {SHORT} or broken or marked or tokens > {LONG})"
    piece = f"known < {KNOWN} and below > 0"
    merged = f"(openings < {TELLING} or tokens > longest)"
    ends = f"(ends > 0 or known < {RARE} and known >= {KNOWN} and endings > 1)"
    untold = f"openings < {TELLING} and pairs = 0 and known < {KNOWN} and below = 0"
    limit = f"(spike > 0 and (not single or tokens > {SHORT}))"
    cut = f"{running} and (broken or {limit} or case when {piece} then true when {untold} then marked when {merged} then pairs = 0 else not {ends} end)"
    why = f"case when {piece} then 'prefix' when broken then 'broken' when {limit} then 'length' else 'ending' end"
    return facts.select(F.col("id").alias(id_col), F.col("no").alias("caption_no"), F.col("source").alias(source), F.expr(cut).alias("cut"), F.expr(why).alias("evidence"), "word", "known", "below", "openings", "titles", "longest", "ends", "endings", "pairs", "tokens", "single", "broken", "marked", "length", "spike")


def cut_texts(df: DataFrame, id_col: str = "row_id", column: str = "captions", source: str = "dataset_id") -> DataFrame:
    """<id>, caption_no of each text whose rest is lost."""
    return judged(df, id_col, column, source).where("cut").select(id_col, "caption_no")


def cut_rates(df: DataFrame, id_col: str = "row_id", column: str = "captions", source: str = "dataset_id") -> DataFrame:
    """<source>, n_captions (neither null nor blank), n_cut, rate: how often each source truncates. A null source is one of its own."""
    totals = df.select(source, F.size(F.filter(F.coalesce(column, F.array()), lambda c: c.rlike(r"\S"))).alias("k")).groupBy(source).agg(F.sum("k").alias("n_captions"))
    found = judged(df, id_col, column, source).where("cut").groupBy(source).agg(F.count(F.lit(1)).alias("n_cut"))
    n = F.coalesce("n_cut", F.lit(0))
    return totals.join(found, totals[source].eqNullSafe(found[source]), "left").select(totals[source], "n_captions", n.alias("n_cut"), F.round(F.try_divide(n, F.col("n_captions")), 6).alias("rate"))
