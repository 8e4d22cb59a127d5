"""Phrases whose words come together more often than apart, for each language.

Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends and into words at blanks and
tabs. Each word leads one window: its next three words within the piece, padded where the piece ends
or where a word or a pair follows that is too rare for any candidate (a phrase is no more frequent
than what it holds; pairs are counted first, as windows of two). Only these longest windows are
counted; Spark's ROLLUP sums them over their shorter prefixes, and each phrase has its count, since a
phrase is a prefix of one window for each occurrence.

Null and empty texts have no words; a null language is ``und``, together with texts that say so.
Repeated rows count again. Words of any bytes and any length are exact: they are compared as they are,
not by hash. An empty table has no phrases. Columns other than text and language play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from archivist.llm.common import FEW, Words, small_batches, text_bytes, written

#: Occurrences of a candidate, share (percent) of a phrase's occurrences within a longer one that drops it, and phrases of a language.
LEAST, WITHIN, BEST = 30, 80, 2000
#: Words that are sent to the tasks at once; more are looked up one part after another.
AT_ONCE = 500_000
#: Pairs that are sent to the tasks (8 MB); with more of them windows are not cut after rare pairs, which changes no count of a candidate.
PAIRS = 1_000_000
#: Windows that a task counts before they leave it.
HELD = 1 << 20

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_WORD = ~_BREAK
_WORD[[32, 9]] = False


class Pieces:
    """The words of a batch of texts: which (language, word) each is, and whether the next word
    follows in the same piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array) -> None:
        data, at = text_bytes(texts)
        words = Words(_WORD)
        start, end = words.bounds(data, at)
        size = np.zeros(len(start) + 1, np.int64)
        np.cumsum(end - start, out=size[1:])
        letters = words.lower[data[_WORD[data]]]
        codes = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(size), pa.py_buffer(letters)).dictionary_encode()
        self.first = np.searchsorted(start, at)  # word of each text, and after the last
        text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        piece = np.searchsorted(np.flatnonzero(_BREAK[data]), start)
        self.follows = np.zeros(len(start), bool)
        self.follows[:-1] = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])
        named = pc.fill_null(langs.cast(pa.string()), "und").dictionary_encode()
        n = max(len(codes.dictionary), 1)
        lang = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        key = lang[text] * n + codes.indices.to_numpy(zero_copy_only=False)
        distinct, self.of, self.counts = np.unique(key, return_inverse=True, return_counts=True)
        self.langs, self.words = named.dictionary.take(pa.array(distinct // n)), codes.dictionary.take(pa.array(distinct % n))


def vocabulary(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, word and n, the number of its occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Pieces(batch.column(0), batch.column(1))
            yield pa.RecordBatch.from_arrays([found.langs, found.words.cast(pa.string()), pa.array(found.counts)], ["lang", "word", "n"])

    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    return rows.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _numbered(words: DataFrame) -> DataFrame:
    """``words`` with different ids from 1 on that fit 31 bits, numbered within buckets of bounded size."""
    buckets = max(256, words.count() // 1000)
    rows = words.withColumn("bucket", F.pmod(F.xxhash64("lang", "word"), F.lit(buckets)))
    place = F.row_number().over(W.partitionBy("bucket").orderBy("lang", "word"))
    return rows.select("lang", "word", "n", ((place - 1) * buckets + F.col("bucket") + 1).alias("id"))


# --- windows ----------------------------------------------------------------------------------


def _ahead(values: np.ndarray, k: int) -> np.ndarray:
    """Each place's value ``k`` places on; 0 after the last."""
    return np.r_[values[k:], np.zeros(min(k, len(values)), values.dtype)]


def _leads(ids: np.ndarray, linked: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first two words, third word, fourth word) of the windows of three words and more, or of two with
    ``order`` 2, padded by 0 after ``order`` words and after a word that isn't ``linked`` to the next."""
    columns, goes_on = [ids], np.ones(len(ids), bool)
    for k in range(1, 4):
        goes_on = goes_on & _ahead(linked, k - 1) if k < order else np.zeros(len(ids), bool)
        columns.append(np.where(goes_on, _ahead(ids, k), 0))
    some = columns[1 if order == 2 else 2] > 0
    return (columns[0][some] << 32) | columns[1][some], columns[2][some], columns[3][some]


def _counted(pair: np.ndarray, tail: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((tail, pair))
    pair, tail, n = pair[order], tail[order], n[order]
    new = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (tail[1:] != tail[:-1])]) if len(pair) else np.zeros(0, np.int64)
    return pair[new], tail[new], np.add.reduceat(n, new) if len(new) else n


def _look_up(rows: DataFrame, words: list, last: bool, order: int, pairs: np.ndarray | None) -> DataFrame:
    """``rows`` (text, lang, ids) with the ids of these words; at the last the windows' counts instead."""
    table: dict[str, dict[str, int]] = {}
    for r in words:
        table.setdefault(r.lang, {})[r.word] = r.id
    sent = rows.sparkSession.sparkContext.broadcast((table, pairs))

    def numbered(batch: pa.RecordBatch) -> tuple[Pieces, np.ndarray]:
        known, found = sent.value[0], Pieces(batch.column(0), batch.column(1))
        ids = np.array([known.get(g, {}).get(w, 0) for g, w in zip(found.langs.to_pylist(), found.words.to_pylist(), strict=True)], np.int64)[found.of] if len(found.of) else np.zeros(0, np.int64)
        before = b"".join(batch.column(2).drop_null().to_pylist())
        return found, ids + np.frombuffer(before, "<i4") if before else ids

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, ids = numbered(batch)
            raw = ids.astype("<i4")
            each = [raw[a:b].tobytes() for a, b in zip(found.first[:-1], found.first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(each, pa.binary())], ["text", "lang", "ids"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [(np.zeros(0, np.int64),) * 3], 0

        def sent_on() -> pa.RecordBatch:
            pair, tail, n = _counted(*map(np.concatenate, zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(tail >> 32), pa.array(tail & 0xFFFFFFFF), pa.array(n)], ["pair", "third", "fourth", "n"])

        for batch in batches:
            found, ids = numbered(batch)
            linked, pairs = found.follows & (ids > 0) & (_ahead(ids, 1) > 0), sent.value[1]
            if pairs is not None:
                both = (ids[linked] << 32) | _ahead(ids, 1)[linked]
                place = np.searchsorted(pairs, both)
                linked[linked] = pairs[np.minimum(place, len(pairs) - 1)] == both if len(pairs) else False
            pair, third, fourth = _leads(ids, linked, order)
            held.append(_counted(pair, (third << 32) | fourth, np.ones(len(pair), np.int64)))
            size += len(held[-1][0])
            if size > HELD:
                yield sent_on()
                held, size = held[:1], 0
        yield sent_on()

    if last:
        return rows.mapInArrow(count, "pair long, third long, fourth long, n long")
    return written(rows.mapInArrow(add, "text string, lang string, ids binary"))


def windows(docs: DataFrame, words: DataFrame, text: str = "text", lang: str = "lang", order: int = 4, pairs: np.ndarray | None = None) -> DataFrame:
    """pair (the first two words), third, fourth and n of the windows of three or four of ``words`` (lang,
    word, id), without words after a pair that isn't among ``pairs`` (sorted), if given; with ``order`` 2
    of all pairs.

    0 is a pad. A window can have several rows. Words are sent to the tasks ``AT_ONCE`` at most."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.lit(None).cast("binary").alias("ids"))
    parts = -(-words.count() // AT_ONCE) or 1
    for k in range(parts):
        mine = words if parts == 1 else words.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == k)
        rows = _look_up(rows, mine.select("lang", "word", "id").collect(), k == parts - 1, order, pairs)
    return rows


def frequent_pairs(docs: DataFrame, words: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST) -> tuple[DataFrame, np.ndarray | None]:
    """pair and f of the pairs of ``words`` that are as frequent as a candidate must be, and these pairs
    sorted; None if they are more than ``PAIRS``."""
    sums = windows(docs, words, text, lang, 2).groupBy("pair").agg(F.sum("n").alias("f"))
    pairs = written(sums.where(F.col("f") >= least))
    few = pairs.count() <= PAIRS
    return pairs, np.sort(np.array([r.pair for r in pairs.select("pair").toLocalIterator()], np.int64)) if few else None


# --- phrases ----------------------------------------------------------------------------------


def _joined(a: Column, b: Column) -> Column:
    return F.shiftleft(a, 32).bitwiseOR(b)


def _key(*words: Column) -> Column:
    """Up to four words as two numbers."""
    w = [*words, *[F.lit(0).cast("long")] * (4 - len(words))]
    return F.struct(_joined(w[0], w[1]).alias("head"), _joined(w[2], w[3]).alias("tail"))


def _words_of(key: str = "key") -> list[Column]:
    low = F.lit(0xFFFFFFFF).cast("long")
    return [f(F.col(f"{key}.{part}")) for part in ("head", "tail") for f in (lambda c: F.shiftright(c, 32), lambda c: c.bitwiseAND(low))]


def _sent(df: DataFrame) -> DataFrame:
    """``df``, for every task if its rows, which are counted, are few."""
    return F.broadcast(df) if df.count() <= FEW else df


def phrases(counted: DataFrame, pairs: DataFrame, least: int = LEAST) -> DataFrame:
    """key, size and f of all phrases of two to four words with f >= ``least``, from the windows of three
    and four words and from ``pairs`` (pair, f)."""
    sums = counted.sparkSession.sql(f"SELECT pair, third, fourth, sum(n) AS f, grouping(fourth) AS gone FROM {{counted}} GROUP BY pair, third, ROLLUP(fourth) HAVING sum(n) >= {int(least)}", counted=counted)
    none = F.lit(0).cast("long")
    found = sums.where("gone = 1 or fourth > 0").select("pair", "third", F.coalesce("fourth", none).alias("fourth"), (4 - F.col("gone")).cast("int").alias("size"), "f")
    found = found.unionByName(pairs.select("pair", none.alias("third"), none.alias("fourth"), F.lit(2).alias("size"), "f"))
    return found.select(F.struct(F.col("pair").alias("head"), _joined(F.col("third"), F.col("fourth")).alias("tail")).alias("key"), "size", "f")


def scored(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` (key, size, f) with score, l and r of its lowest-scoring cut; ``words``: id and n."""
    w1, w2, w3, w4 = _words_of()
    cut = lambda k, first, rest: F.struct(F.lit(k).alias("k"), first.alias("first"), rest.alias("rest"))
    cuts = F.array(cut(1, _key(w1), _key(w2, w3, w4)), cut(2, _key(w1, w2), _key(w3, w4)), cut(3, _key(w1, w2, w3), _key(w4)))
    parts = _sent(written(found.select("key", "f").unionByName(words.select(_key(F.col("id")).alias("key"), F.col("n").alias("f")))))
    rows = found.withColumn("cut", F.explode(F.slice(cuts, F.lit(1), F.col("size") - 1)))
    rows = rows.join(parts.toDF("first", "l"), F.col("cut.first") == F.col("first"))
    rows = rows.join(parts.toDF("rest", "r"), F.col("cut.rest") == F.col("rest"))
    wide = lambda c: f"cast({c} as decimal(19,0))"
    rows = rows.withColumn("score", F.expr(f"{wide('f')} * 2000000BD div ({wide('l')} + {wide('r')})"))
    low = rows.groupBy("key", "size", "f").agg(F.min(F.struct("score", "cut.k", "l", "r")).alias("low"))
    return low.select("key", "size", "f", "low.score", "low.l", "low.r")


def outside_longer(found: DataFrame, within: int = WITHIN) -> DataFrame:
    """``found`` without phrases that stand in a longer one at least ``within`` percent of the time."""
    w1, w2, w3, w4 = _words_of()
    inner = F.when(F.col("size") == 3, F.array(_key(w1, w2), _key(w2, w3)))
    inner = inner.when(F.col("size") == 4, F.array(_key(w1, w2), _key(w2, w3), _key(w3, w4), _key(w1, w2, w3), _key(w2, w3, w4)))
    longer = found.select(F.explode(inner).alias("inner"), F.col("f").alias("longer")).groupBy("inner").agg(F.max("longer").alias("longer"))
    rows = found.join(longer, F.col("key") == F.col("inner"), "left")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    return rows.where(F.col("longer").isNull() | (wide("longer") * 100 < wide("f") * within)).select(*found.columns)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", best: int = BEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first ``best`` phrases by score, then
    a, then phrase."""
    small_batches(docs.sparkSession)
    every = written(vocabulary(docs, text, lang))
    words = written(_numbered(every.where(F.col("n") >= LEAST)))
    pairs, cut = frequent_pairs(docs, words, text, lang)
    found = written(phrases(windows(docs, words, text, lang, pairs=cut), pairs))
    rows = written(outside_longer(scored(found, words)))
    names = _sent(words.select("id", "word", "lang"))
    for k, word in enumerate(_words_of()):
        mine = names.toDF(f"id{k}", f"word{k}", f"lang{k}")
        rows = rows.join(mine, word == F.col(f"id{k}"), "left")
    rows = rows.select(F.col("lang0").alias("lang"), F.concat_ws(" ", *[f"word{k}" for k in range(4)]).alias("phrase"), F.col("f").alias("a"), "l", "r", "score")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= best)
    totals = every.groupBy("lang").agg(F.sum("n").alias("n"))
    return rows.join(_sent(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
