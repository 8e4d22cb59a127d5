"""Packing documents into sequences with a grouping genetic algorithm.

Documents are cut into pieces of at most a sequence; pieces go to shards, and a shard's packing is
evolved on several islands. Crossover injects whole well-filled sequences of one parent into the
other, drops the sequences that hold the same pieces, and puts the displaced pieces back by best fit.
Between rounds each island's best packing migrates to the next island. Badly filled sequences of all
shards are pooled at the end and packed once more.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from archivist.llm.common import small_batches, written

#: Where the tokenizer's own rules on white space or case could differ from str.split and str.lower.
_ODD = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_KEPT = 150_000


# The rules of the tokenizer whose texts can be cut at white space.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class WordTokenizer:
    """Token ids of whole texts, as little-endian 32-bit numbers.

    Words between white space are independent of each other for this tokenizer, so each distinct
    word is tokenized once by a worker (as long as its table of ``_KEPT`` words has room).
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        rules = [part and json.loads(part.__getstate__()) for part in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)]
        self.by_word = rules == [_NORMALIZER, _PRE_TOKENIZER]  # for any other rules texts are encoded whole
        self.split = regex.compile(_SPLIT).findall
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        rest = iter(range(256, 512))
        self.byte = {b: chr(b) if b in shown else chr(next(rest)) for b in range(256)}
        outer = self

        class Table(dict):
            def __init__(self, make) -> None:
                self.make = make

            def __missing__(self, key: str) -> bytes:
                value = self.make(key)
                if len(self) < _KEPT:
                    self[key] = value
                return value

        self.parts = Table(outer._part)
        self.words = Table(outer._word)

    def _full(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        if not (part.isascii() and part.isprintable()):
            part = part.encode().decode("latin-1").translate(self.byte)
        return np.array([t.id for t in self.model.tokenize(part)], "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if "<|" in word or not (word.isascii() or max(word) < "\u0130"):
            return self._full(word)
        found = self.split(word.lower())
        if len(found) == 1:
            return self.parts[found[0]]
        return b"".join([self.parts[x] for x in found])

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word or _ODD.search(text):
            return self._full(text)
        return b"".join(map(self.words.__getitem__, text.split()))


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pieces(path: str | None, size: int, end: int):
    """doc_id, piece, start, length and ids_crc32 of all pieces of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = path or tokenizer_path()
        if where not in _LOADED:
            _LOADED[where] = WordTokenizer(where)
        cut, tail = _LOADED[where], np.array([end], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = cut.ids(text) + tail
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


class Packing:
    """Bin of each item and fill of each bin."""

    def __init__(self, bins: np.ndarray, fill: np.ndarray) -> None:
        self.bins, self.fill = bins, fill

    def worth(self, size: int) -> tuple[int, float]:
        """Less is better: bins, then how evenly they are filled."""
        return len(self.fill), -float(((self.fill / size) ** 2).sum())


def best_fit(lengths: np.ndarray, size: int, order: np.ndarray, bins: np.ndarray, fill: np.ndarray) -> Packing:
    """Put the items of ``order`` one by one into the fullest bin that holds them, else a new one."""
    room: list[list[int]] = [[] for _ in range(size + 1)]
    full, mask, fills = bins.copy(), 0, fill.tolist()
    for b, f in enumerate(fills):
        if f < size:
            room[size - f].append(b)
            mask |= 1 << (size - f)
    for item, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = mask >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                mask &= ~(1 << left)
            fills[b] += n
        else:
            b, left = len(fills), size
            fills.append(n)
        left -= n
        if left:
            room[left].append(b)
            mask |= 1 << left
        full[item] = b
    return Packing(full, np.array(fills, np.int64))


def _crossover(a: Packing, b: Packing, lengths: np.ndarray, size: int, rng: np.random.Generator) -> Packing:
    """Whole well-filled bins of ``b`` come into ``a``; what they displace is put back by best fit."""
    good = np.flatnonzero(b.fill >= np.quantile(b.fill, 0.25))  # the best filled three quarters
    taken = np.zeros(len(b.fill), bool)
    taken[rng.choice(good, max(1, int(len(good) * rng.uniform(0.05, 0.3))), replace=False)] = True
    injected = taken[b.bins]
    hit = np.zeros(len(a.fill), bool)
    hit[a.bins[injected]] = True
    worst = np.argsort(a.fill, kind="stable")[: 2 + int(len(a.fill) * rng.uniform(0.02, 0.3))]
    hit[worst] = True  # mutation: the emptiest bins go too
    new_a, new_b = np.cumsum(~hit) - 1, np.cumsum(taken) - 1 + int((~hit).sum())
    bins = np.where(injected, new_b[b.bins], np.where(hit[a.bins], -1, new_a[a.bins]))
    loose = np.flatnonzero(bins < 0)
    key = lengths[loose] * rng.uniform(0.97, 1.03, len(loose)) if rng.random() < 0.5 else lengths[loose]
    return best_fit(lengths, size, loose[np.argsort(-key, kind="stable")], bins, np.concatenate([a.fill[~hit], b.fill[taken]]))


def least_bins(lengths: np.ndarray, size: int) -> int:
    return max(-(-int(lengths.sum()) // size), int((2 * lengths > size).sum()))


def evolve(lengths: np.ndarray, size: int, seed: int, guests: list[Packing], population: int = 4, generations: int = 16, greedy: bool = True) -> Packing:
    """The best packing after ``generations``; earlier, if no packing can have fewer bins. The first
    packings put the items in order of length (``greedy``) or in random order; where the first of these
    has more bins than the bound, crossovers make them better."""
    rng, least = np.random.default_rng(seed), least_bins(lengths, size)
    none, empty = np.full(len(lengths), -1), np.zeros(0, np.int64)
    people = list(guests)
    if people and len(min(people, key=lambda p: len(p.fill)).fill) <= least:
        return min(people, key=lambda p: p.worth(size))
    if greedy and not people:
        people.append(best_fit(lengths, size, np.argsort(-lengths, kind="stable"), none, empty))
    while len(people) < population and len(people[0].fill if people else lengths) > least:
        people.append(best_fit(lengths, size, rng.permutation(len(lengths)), none, empty))
    for _ in range(generations):
        people.sort(key=lambda p: p.worth(size))
        if len(people[0].fill) <= least:
            break
        for x, y in ((0, 1 + rng.integers(population - 1)), tuple(rng.choice(population, 2, replace=False))):
            people.append(_crossover(people[x], people[y], lengths, size, rng))
            if len(people[-1].fill) <= least:
                return people[-1]
        people = sorted(people, key=lambda p: p.worth(size))[:population]
    return people[0]


_STATE = "shard long, island int, uid long, length long, bin int"


def _as_packing(rows: pd.DataFrame) -> Packing:
    bins = pd.factorize(rows["bin"])[0]
    return Packing(bins, np.bincount(bins, weights=rows["length"]).astype(np.int64))


def _island(size: int, turn: int):
    """One round of one island: its own best packing and the one that came, if any."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shard, island = int(key[0]), int(key[1])
        rows = rows.sort_values(["guest", "uid"], ignore_index=True)
        guests = [_as_packing(g) for _, g in rows[rows["bin"] >= 0].groupby("guest")]
        mine = rows[rows["guest"] == 0]
        best = evolve(mine["length"].to_numpy(), size, (shard * 31 + island) * 31 + turn, guests)
        return pd.DataFrame({"shard": shard, "island": island, "uid": mine["uid"].to_numpy(), "length": mine["length"].to_numpy(), "bin": best.bins.astype(np.int32)})

    return run


def _packed(items: DataFrame, size: int, islands: int, rounds: int) -> DataFrame:
    """(shard, uid, length, bin) of items (shard, uid, length): each shard's best packing."""
    one = F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))
    state = items.select("shard", one.alias("island"), "uid", "length", F.lit(-1).alias("bin"))
    for turn in range(rounds):
        here = state.withColumn("guest", F.lit(0))
        if turn and islands > 1:
            here = here.unionByName(state.toDF(*state.columns).withColumns({"island": F.pmod(F.col("island") + 1, F.lit(islands)), "guest": F.lit(1)}))
        state = written(here.groupBy("shard", "island").applyInPandas(_island(size, turn), _STATE))
    best = state.groupBy("shard", "island").agg(F.max("bin").alias("last")).groupBy("shard").agg(F.min_by("island", F.struct("last", "island")).alias("island"))
    return state.join(best, ["shard", "island"]).select("shard", "uid", "length", "bin")


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 2048, end: int = 0, tokenizer: str | None = None, shard: int = 4000, islands: int = 2, rounds: int = 2, loose: float = 0.98) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece.

    A document is its token ids and then ``end``; a null or empty text is ``end`` alone. Repeated
    rows are documents of their own. Documents longer than ``size`` are cut into pieces of ``size``;
    the last may be shorter. Pieces of full size are sequences as they are. All others go, by a hash,
    to shards of about ``shard`` pieces, which bounds a task whatever the corpus holds. Sequences
    filled below ``loose`` are packed again over all shards and replaced where that saves any.
    ``tokenizer`` is the path of the tokenizer's file on every machine. An empty table gives an empty
    result; texts of any length are cut whole; other columns are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    cut = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_pieces(tokenizer, size, end), "doc_id long, piece int, start long, length long, ids_crc32 long")
    pieces = written(cut.withColumn("uid", F.monotonically_increasing_id()))
    parts = pieces.where(F.col("length") < size).select("uid", "length")
    shards = max(1, -(-parts.count() // shard))
    items = parts.select(F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("long").alias("shard"), "uid", "length")
    first = written(_packed(items, size, islands, rounds))
    bins = first.groupBy("shard", "bin").agg(F.sum("length").alias("fill")).where(F.col("fill") < loose * size)
    pool = written(first.join(bins, ["shard", "bin"]).select("uid", "length", "shard", "bin"))
    pools = max(1, -(-pool.count() // shard))
    # a badly filled sequence stays together, so that a pool that saves nothing can be left as it was
    pooled = pool.withColumn("pool", F.pmod(F.xxhash64("shard", "bin"), F.lit(pools)).cast("long"))
    second = written(_packed(pooled.select(F.col("pool").alias("shard"), "uid", "length"), size, islands, rounds))
    before = pooled.select("pool", "shard", "bin").distinct().groupBy("pool").agg(F.count(F.lit(1)).alias("had"))
    after = second.groupBy(F.col("shard").alias("pool")).agg((F.max("bin") + 1).alias("has"))
    saving = before.join(after, "pool").where("has < had").select("pool")
    moved = second.withColumnRenamed("shard", "pool").join(saving, "pool").select("uid", (F.col("pool") + shards).alias("shard2"), F.col("bin").alias("bin2"))
    placed = first.join(moved, "uid", "left").select("uid", (F.coalesce("shard2", "shard") * (1 << 20) + F.coalesce("bin2", "bin")).alias("sequence_id"))
    full = pieces.where(F.col("length") >= size).select("uid", (-F.col("uid") - 1).alias("sequence_id"))
    out = pieces.join(placed.unionByName(full), "uid")
    order = W.partitionBy("sequence_id").orderBy("uid")
    return out.withColumn("offset", F.sum("length").over(order) - F.col("length")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
