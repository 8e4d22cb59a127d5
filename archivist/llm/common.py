"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as the contracts of several operators define it: no space, no control white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, which ``spark.checkpoint.dir`` names.

    Only a session on one machine (tests) may name none: it gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="archivist-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, **options: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet (with ``options``) to the shared folder and read it back. The files are
    removed when the driver ends, as results are read only after the operator has returned."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/archivist-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of keys that are sent to every task at most (about 12 MB of two numbers each).
FEW = 500_000


def rows_with(df: DataFrame, keys: DataFrame, on: list[str], null_safe: bool = False) -> DataFrame:
    """The rows of ``df`` whose key is in ``keys``. Few keys, which are counted first, go to every
    task, so that ``df`` isn't shuffled; more keys and ``df`` meet by a shuffle."""
    keys = written(keys.distinct())
    sent = F.broadcast(keys) if keys.count() <= FEW else keys
    if not null_safe:
        return df.join(sent, on, "left_semi")
    sent = sent.toDF(*[f"key{k}" for k in range(len(on))])
    return df.join(sent, reduce(Column.__and__, [df[c].eqNullSafe(sent[f"key{k}"]) for k, c in enumerate(on)]), "left_semi")


def packed(df: DataFrame) -> DataFrame:
    """One column ``row`` with all columns of ``df``, so that no name clashes with names used beside it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unpacked(df: DataFrame, columns: Sequence[str], new: dict[str, Column] | None = None) -> DataFrame:
    """The columns of ``row`` again, with ``new`` values for those that are there."""
    new = new or {}
    return df.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in columns])


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "2m") -> None:
    """Bound what a Python worker holds of whole texts: the rows and bytes of one Arrow batch."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def unit_hash(*cols: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the values only."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


# --- words of a text as numbers -------------------------------------------------------------

_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_CHUNK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    have = 1
    while have < n:
        step = np.uint64(pow(base, have, 1 << 64))
        take = min(have, n - have)
        out[have : have + take] = out[:take] * step
        have += take
    return out


_POW: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts of an Arrow column, and where each text starts (and the last
    ends); a null is an empty text."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[at[0] : at[-1]], at - at[0]


class Words:
    """Cuts UTF-8 texts into words with whole-array operations and hashes each word to 64 bits.

    ``is_word`` holds for each byte value whether it belongs to a word; A-Z are lowered first.
    """

    def __init__(self, is_word: np.ndarray) -> None:
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.is_word = is_word.astype(bool)[self.lower]

    def bounds(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each word starts and ends; a word never spans two texts."""
        inside = self.is_word[data]
        before = np.empty_like(inside)
        before[:1], before[1:] = False, inside[:-1]
        before[at[:-1][at[:-1] < len(data)]] = False
        start = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1:], after[:-1] = False, inside[1:]
        last = at[1:][at[1:] > 0] - 1
        after[last] = False
        return start, np.flatnonzero(inside & ~after) + 1

    def hashes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each span; equal words have equal hashes."""
        if not _POW:
            _POW["up"], _POW["down"] = _powers(_MULT, _CHUNK), _powers(_INV, _CHUNK)
        out = np.empty(len(start), np.uint64)
        lo = 0
        while lo < len(start):
            base = int(start[lo])
            hi = max(int(np.searchsorted(end, base + _CHUNK, "right")), lo + 1)
            piece = self.lower[data[base : end[hi - 1]]].astype(np.uint64) + np.uint64(1)
            if len(piece) > _CHUNK:  # one word longer than a chunk
                out[lo] = self._long(piece)
            else:
                total = np.empty(len(piece) + 1, np.uint64)
                total[0] = 0
                np.cumsum(piece * _POW["up"][: len(piece)], out=total[1:])
                s, e = start[lo:hi] - base, end[lo:hi] - base
                out[lo:hi] = (total[e] - total[s]) * _POW["down"][s] + (e - s).astype(np.uint64)
            lo = hi
        return mix64(out)

    def _long(self, piece: np.ndarray) -> np.uint64:
        total, scale = 0, 1
        for k in range(0, len(piece), _CHUNK):
            part = piece[k : k + _CHUNK]
            total += scale * int(np.sum(part * _POW["up"][: len(part)], dtype=np.uint64))
            scale = scale * pow(_MULT, len(part), 1 << 64) % (1 << 64)
        return np.uint64((total + len(piece)) % (1 << 64))

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of all texts, and for each text the number of its first (and of the
        first after the last)."""
        data, at = text_bytes(column)
        start, end = self.bounds(data, at)
        return self.hashes(data, start, end), np.searchsorted(start, at)


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles of ``width`` words, sorted; with fewer words the whole
    sequence is one; none without words."""
    step = np.uint64(0xD6E8FEB86659FD93)
    n = len(words) - width + 1
    full = np.zeros(max(n, 0), np.uint64)
    for k in range(width):
        full = full * step + words[k : k + len(full)]
    full = mix64(full)
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= width:
            yield np.unique(full[lo : hi - width + 1])
        elif hi > lo:
            total = np.zeros(1, np.uint64)
            for word in words[lo:hi]:
                total = total * step + word
            yield mix64(total + np.uint64(hi - lo))
        else:
            yield words[:0]


def space_words() -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+``."""
    keep = np.ones(256, bool)
    keep[[32, 9, 10, 11, 12, 13]] = False
    return Words(keep)


def alnum_words() -> Words:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of lowered text."""
    keep = np.zeros(256, bool)
    keep[48:58] = keep[97:123] = keep[128:] = True
    return Words(keep)
