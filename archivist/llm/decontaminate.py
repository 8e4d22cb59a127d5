"""Passages of benchmark items in documents, and documents without them.

Words are lower-cased (A-Z) runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``. The windows of all items, of
``width`` words, are a set of hashes that each task gets; the windows of whole texts are looked up in
it, and what is found is compared with the window byte by byte. A word inside any occurrence is hit.

An item with fewer words is one window; one without words, or null, has none. Null and empty texts
have no words. Rows are kept as they are, repeated ids and texts included; an item of a null id hits
words but is not counted among the items. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivist.llm.common import alnum_words, mix64, small_batches, text_bytes, unpacked, written

#: Words of a window.
WIDTH = 10
#: Windows of items that are sent to the tasks at once; more are looked up one part after another.
AT_ONCE = 250_000
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _lowered(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


class Texts:
    """The words of an Arrow column of texts: hashes, and the bytes of all words with a blank after each."""

    def __init__(self, column: pa.Array) -> None:
        words = alnum_words()
        data, at = text_bytes(column)
        self.start, self.end = words.bounds(data, at)
        self.first = np.searchsorted(self.start, at)  # of each text, and after the last
        self.offset = at
        self.hashes = words.hashes(data, self.start, self.end)
        keep = words.is_word[data]
        size = self.end - self.start
        self.place = np.zeros(len(size) + 1, np.int64)  # of each word among the joined ones
        np.cumsum(size + 1, out=self.place[1:])
        self.joined = np.full(self.place[-1], 32, np.uint8)
        if len(size):
            self.joined[np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)] = _lowered(data[keep])

    def windows(self, width: int) -> np.ndarray:
        """A hash of the ``width`` words from each word on (of the first words that have so many)."""
        n = max(len(self.hashes) - width + 1, 0)
        out = np.zeros(n, np.uint64)
        for k in range(width):
            out = out * _STEP + self.hashes[k : k + n]
        return mix64(out)

    def joined_words(self, first: int, width: int) -> bytes:
        return self.joined[self.place[first] : self.place[first + width]].tobytes()


@dataclass
class Windows:
    """Different windows of one width: sorted hashes, their words, and which items have them."""

    width: int
    hashes: np.ndarray
    words: list[bytes]
    owner_at: np.ndarray  # where a window's items begin in owners
    owners: np.ndarray
    seen: np.ndarray  # for each beginning of 20 bits whether a hash has it

    @staticmethod
    def of(width: int, found: dict[tuple[int, bytes], list[int]]) -> Windows:
        keys = sorted(found)
        hashes, seen = np.array([h for h, _ in keys], np.uint64), np.zeros(1 << 20, bool)
        seen[(hashes >> np.uint64(44)).astype(np.int64)] = True
        at = np.cumsum([0, *(len(found[k]) for k in keys)])
        return Windows(width, hashes, [w for _, w in keys], at, np.array([i for k in keys for i in found[k]], np.int64), seen)

    def find(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(first word, number of the window) of every occurrence in a text."""
        keys = texts.windows(self.width)
        at = np.flatnonzero(self.seen[(keys >> np.uint64(44)).astype(np.int64)])
        last = texts.first[np.searchsorted(texts.first, at, "right")]  # after the text's words
        at = at[at + self.width <= last]
        low, high = (np.searchsorted(self.hashes, keys[at], side) for side in ("left", "right"))
        where, which = [at[:0]], [low[:0]]
        for k in range(int((high - low).max(initial=0))):  # more than one only if different windows share a hash
            more = low + k < high
            where.append(at[more])
            which.append(low[more] + k)
        where, which = np.concatenate(where), np.concatenate(which)
        order = np.argsort(which, kind="stable")
        where, which = where[order], which[order]
        good = np.zeros(len(which), bool)
        bounds = np.flatnonzero(np.r_[True, which[1:] != which[:-1], True]) if len(which) else []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            want = np.frombuffer(self.words[which[a]], np.uint8)
            step = max(1, (1 << 24) // len(want))
            for lo in range(a, b, step):
                some = where[lo : min(lo + step, b)]
                place = texts.place[some]
                fits = texts.place[some + self.width] - place == len(want)
                fits[fits] = (texts.joined[place[fits, None] + np.arange(len(want))] == want).all(axis=1)
                good[lo : lo + len(some)] = fits
        return where[good], which[good]

    def of_items(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of ``which`` the number of its items, and all these items."""
        n = self.owner_at[which + 1] - self.owner_at[which]
        skip = np.cumsum(n) - n
        return n, self.owners[np.arange(n.sum()) - np.repeat(skip, n) + np.repeat(self.owner_at[which], n)]


def item_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """id, width, hash and words of the different windows of items (id as string, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = Texts(batch.column(1)), []
            for name, first, after in zip(batch.column(0).to_pylist(), texts.first[:-1].tolist(), texts.first[1:].tolist(), strict=True):
                size = min(after - first, width)
                if size:
                    places = range(first, after - size + 1)
                    rows += [(name, size, texts.joined_words(k, size)) for k in places]
            names, sizes, words = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(words, pa.binary())], ["id", "width", "words"])

    return items.select("id", "text").mapInArrow(run, "id string, width long, words binary").distinct()


_FOUND = "n_words:long,hits:array<long>,items:array<string>,spans:array<struct<start:long,stop:long>>"
_FOUND_TYPE = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])


def _lookup(rows: DataFrame, windows: list, keep_text: bool) -> DataFrame:
    """``rows`` (row, text, found or null) with what these windows add to found: hits are the numbers
    of hit words."""
    ids = sorted({r.id for r in windows if r.id is not None})
    number = {name: k for k, name in enumerate(ids)}
    by_width: dict[int, dict[bytes, list[int]]] = {}
    for r in windows:
        by_width.setdefault(r.width, {}).setdefault(bytes(r.words), []).extend([number[r.id]] if r.id is not None else [])
    tables = []
    for size, found in sorted(by_width.items()):
        texts = Texts(pa.array([w.decode() for w in found], pa.string()))
        hashes = texts.windows(size)[texts.first[:-1]].tolist()
        tables.append(Windows.of(size, {(h, w): found[w] for h, w in zip(hashes, found, strict=True)}))
    sent = rows.sparkSession.sparkContext.broadcast((ids, tables))
    kind = dict(rows.dtypes)["row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, windows = sent.value
        for batch in batches:
            texts, none = Texts(batch.column(1)), np.zeros(0, np.int64)
            edge = np.zeros(len(texts.hashes) + 1, np.int64)
            starts, owners = [none], [none]
            for w in windows:
                where, which = w.find(texts)
                n, own = w.of_items(which)
                np.add.at(edge, where, 1)
                np.add.at(edge, where + w.width, -1)
                starts.append(np.repeat(where, n))
                owners.append(own)
            hit = np.cumsum(edge)[:-1] > 0
            start, owner = np.concatenate(starts), np.concatenate(owners)
            text = np.searchsorted(texts.first, start, "right") - 1
            order = np.argsort(text, kind="stable")
            cuts = np.searchsorted(text[order], np.arange(len(batch) + 1))
            out = []
            for k, old in enumerate(batch.column(2).to_pylist()):
                first, after = texts.first[k], texts.first[k + 1]
                here = hit[first:after].copy()
                own = {names[i] for i in np.unique(owner[order[cuts[k] : cuts[k + 1]]])}
                if old:
                    here[old["hits"]] = True
                    own.update(old["items"])
                words = np.flatnonzero(here)
                ends = np.flatnonzero(np.r_[True, np.diff(words) > 1, True]) if len(words) else words
                spans = [{"start": int(texts.start[first + words[a]] - texts.offset[k]), "stop": int(texts.end[first + words[b - 1]] - texts.offset[k])} for a, b in zip(ends[:-1], ends[1:], strict=True)]
                out.append({"n_words": int(after - first), "hits": words.tolist(), "items": sorted(own), "spans": spans})
            text = batch.column(1) if keep_text else pa.nulls(len(batch), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), text, pa.array(out, _FOUND_TYPE)], ["row", "text", "found"])

    return rows.mapInArrow(run, f"row {kind}, text string, found struct<{_FOUND}>")


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH, at_once: int = AT_ONCE, keep_text: bool = True) -> DataFrame:
    """``row`` (the other columns of ``docs``), text and ``found``: n_words, hits (numbers of the words
    that are hit), items (ids as strings) and spans (bytes of the text from the first hit word of a
    run to the end of its last).

    The items' windows are counted and go to every task ``at_once`` at most; more than that in parts,
    and what is found so far is written between them.
    """
    small_batches(docs.sparkSession)
    windows = written(item_windows(items.select(F.col(item).cast("string").alias("id"), F.col(item_text).alias("text")).where("text is not null"), width))
    parts = -(-windows.count() // at_once) or 1
    others = [F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(True).alias("there")]
    rows = docs.select(F.struct(*others).alias("row"), F.col(f"`{text}`").alias("text"), F.lit(None).cast(f"struct<{_FOUND}>").alias("found"))
    for k in range(parts):
        last = k == parts - 1
        mine = windows if parts == 1 else windows.where(F.pmod(F.xxhash64("words", "id"), F.lit(parts)) == k)
        rows = _lookup(rows, mine.collect(), keep_text or not last)
        if not last:
            rows = written(rows)
    return rows


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the bytes of the spans."""
    raw = text.cast("binary")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["stop"]))
    stops = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.octet_length(text).cast("long")))
    pieces = F.transform(F.arrays_zip(starts.alias("a"), stops.alias("b")), lambda p: F.hex(F.substring(raw, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int"))))
    return F.when(F.size(spans) == 0, text).otherwise(F.unhex(F.array_join(pieces, "")).cast("string"))


def without_passages(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", share: float = 0.5, width: int = WIDTH) -> DataFrame:
    """``docs`` in their columns, with hit passages cut out of the texts; documents of which more than
    ``share`` of the words are hit go (0: all documents with a hit)."""
    found = contamination(docs, items, text, item, width=width)
    kept = found.where(F.size("found.hits") <= F.col("found.n_words") * share)
    return unpacked(kept, docs.columns, {text: without_spans(F.col("text"), F.col("found.spans"))})


def benchmark_hits(docs: DataFrame, items: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, the digest of the items' ids, and contaminated, of every row."""
    found = contamination(docs, items, at_once=at_once, keep_text=False)
    n_hit = F.size("found.hits").cast("long")
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("found.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
