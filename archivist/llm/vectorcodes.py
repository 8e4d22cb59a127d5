"""Vectors compressed to one byte a part: product quantisation in whole numbers.

A vector's components become integers, and its parts are assigned to the nearest entry of their
position's codebook. For a batch of vectors each dimension gets a dictionary of the distinct integers
in it; the squared differences of these to all entries are tabulated once, and the distances of a part
are gathered from its dimensions' tables by dictionary code and added. All sums are of integers, so
results don't depend on how rows are dealt to tasks.

Rows whose vector is null or holds a null or non-finite component are dropped. The codebooks are for
vectors of the most frequent length (of equally frequent ones the shortest) with components below
16,384; rows with other vectors stay, with null as code and error. Rows of equal id are ordered by
their components, rows without id come last. Fewer than 256 vectors make shorter codebooks. Columns
other than id, vector and label play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivist.llm.common import FEW, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components are at most this, so that no sum of squares passes 64 bits (up to 8,192 dimensions).
LARGEST = 1 << 24
#: Vectors whose distances to all entries are held at once.
ROWS = 1024


@dataclass(frozen=True)
class Codebooks:
    """For each part of a vector its entries, as integers (entries x width of the part)."""

    books: tuple[np.ndarray, ...]

    @property
    def dim(self) -> int:
        return sum(b.shape[1] for b in self.books)

    @property
    def sha256(self) -> str:
        """Of all components in order of part, entry and position."""
        return hashlib.sha256(",".join(str(x) for b in self.books for x in b.ravel().tolist()).encode()).hexdigest()


def _parts(d: int) -> list[slice]:
    ends = np.linspace(0, d, PARTS + 1).astype(int)
    return [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]


# --- whole numbers ----------------------------------------------------------------------------


def _whole(vectors: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Which vectors are kept, and all as little-endian 32-bit integers (null where out of range)."""
    vectors = vectors.cast(pa.list_(pa.float64()))
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(vectors.flatten(), float("nan")).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(vectors)), lengths)
    has = lambda flags: np.bincount(row[flags], minlength=len(vectors)) > 0
    keep = vectors.is_valid().to_numpy(zero_copy_only=False) & ~has(~np.isfinite(flat))
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(flat * SCALE)
        small = np.abs(scaled) <= LARGEST
    ends = np.zeros(len(vectors) + 1, np.int32)
    ends[1:] = np.cumsum(lengths * 4)
    values = np.where(small, scaled, 0).astype("<i4")
    raw = pa.Array.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(ends), pa.py_buffer(values)])
    return keep, pc.if_else(pa.array(~has(~small)), raw, pa.scalar(None, pa.binary()))


def whole(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """vec_id, label and values (the integers as bytes) of the rows that are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, values = _whole(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), values], ["vec_id", "label", "values"]).filter(pa.array(keep))

    picked = rows.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    kinds = dict(picked.dtypes)
    return picked.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, values binary")


# --- distances --------------------------------------------------------------------------------


def _dictionary(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct integers of a column in order, and for each row the number of its own."""
    low, high = int(column.min()), int(column.max())
    if high - low > 8 * len(column) + 65_536:
        return np.unique(column, return_inverse=True)
    there = np.zeros(high - low + 1, bool)
    there[column - low] = True
    return np.flatnonzero(there) + low, (np.cumsum(there) - 1)[column - low]


def nearest(values: np.ndarray, books: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For each row of integers the number of the nearest entry in each part (the smallest of equally
    near ones), and the sum of their squared distances."""
    codes, errors = np.zeros((len(values), len(books)), np.int64), np.zeros(len(values), np.int64)
    if not len(values):
        return codes, errors
    for p, (part, book) in enumerate(zip(_parts(values.shape[1]), books, strict=True)):
        most = (int(np.abs(values).max(initial=0)) + int(np.abs(book).max(initial=0))) ** 2 * max(book.shape[1], 1)
        kind = np.int32 if most < 1 << 31 else np.int64
        tables = []
        for j in range(book.shape[1]):
            distinct, code = _dictionary(values[:, part.start + j].astype(np.int64))
            tables.append((((distinct[:, None] - book[:, j]) ** 2).astype(kind), code))
        for at in range(0, len(values), ROWS):
            here = slice(at, at + ROWS)
            total = np.zeros((len(values[here]), len(book)), kind)
            for table, code in tables:
                total += table[code[here]]
            best = total.argmin(axis=1)
            codes[here, p] = best
            errors[here] += total[np.arange(len(best)), best]
    return codes, errors


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """The rows of a column of ``d`` integers each."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), d)


# --- codebooks --------------------------------------------------------------------------------


def _sums(rows: DataFrame, books: tuple[np.ndarray, ...], d: int) -> dict[tuple[int, int, int], int]:
    """For each (part, entry, position) the sum over the parts assigned to it, at position -1 their
    number. A task sends one row for each of these that it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        for batch in batches:
            values = _matrix(batch.column(0), d)
            codes, _ = nearest(values, books)
            for p, part in enumerate(_parts(d)):
                total[p][:, 0] += np.bincount(codes[:, p], minlength=len(books[p]))
                for j in range(part.start, part.stop):  # below 2^53, so exact
                    total[p][:, j - part.start + 1] += np.bincount(codes[:, p], values[:, j], len(books[p])).astype(np.int64)
        for p, t in enumerate(total):
            entry, column = np.nonzero(np.broadcast_to(t[:, :1] > 0, t.shape))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(entry), p)), pa.array(entry), pa.array(column - 1), pa.array(t[entry, column])], ["part", "entry", "position", "total"])

    found = rows.select("values").mapInArrow(run, "part long, entry long, position long, total long")
    found = found.groupBy("part", "entry", "position").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    return {(r.part, r.entry, r.position): int(r.total) for r in found.collect()}  # at most 256 x (dimensions + parts)


def _ours(rows: DataFrame, d: int) -> DataFrame:
    return rows.where(F.octet_length("values") == 4 * d)


def train(rows: DataFrame, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of `whole` rows: they start as the parts of the first 256 vectors; each round assigns
    all parts and replaces each entry by the floor of its parts' mean. Unused entries stay."""
    dims = rows.where("values is not null").groupBy(F.octet_length("values").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    common = dims.orderBy(F.desc("n"), "size").first()
    d = common.size // 4 if common else 0
    first = _ours(rows, d).orderBy(F.col("vec_id").asc_nulls_last(), "values").limit(ENTRIES).select("values").collect()
    start = np.array([np.frombuffer(r.values, "<i4") for r in first], np.int64).reshape(len(first), d)
    books = tuple(start[:, p] for p in _parts(d))
    for _ in range(rounds if len(start) else 0):
        sums, after = _sums(_ours(rows, d), books, d), [b.copy() for b in books]
        for (p, entry, j), total in sums.items():
            if j >= 0:
                after[p][entry, j] = total // sums[p, entry, -1]
        books = tuple(after)
    return Codebooks(books)


def encode(rows: DataFrame, codebooks: Codebooks) -> DataFrame:
    """vec_id, label, code (a byte a part, in hex) and error (squared distances summed over parts) of
    `whole` rows; code and error are null for vectors that the codebooks aren't for."""
    books, d = codebooks.books, codebooks.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = pc.fill_null(pc.equal(pc.binary_length(batch.column(2)), 4 * d), False).to_numpy(zero_copy_only=False) & bool(len(books[0]))
            codes, errors = nearest(_matrix(batch.column(2).filter(pa.array(mine)), d), books)
            code, error = np.full(len(mine), None, object), np.zeros(len(mine), np.int64)
            code[mine], error[mine] = [bytes(c).hex() for c in codes.astype(np.uint8)], errors
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, mask=~mine)], ["vec_id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decode(coded: DataFrame, codebooks: Codebooks, code: str = "code") -> DataFrame:
    """``coded`` and the column decoded: the vector that a code stands for; null for a null code."""
    books = codebooks.books

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if c is None else (np.concatenate([b[n] for b, n in zip(books, bytes.fromhex(c), strict=True)]) / SCALE).tolist() for c in batch.to_pylist()], pa.list_(pa.float64()))

    return coded.withColumn("decoded", F.arrow_udf(run, "array<double>")(F.col(code)))


def vector_codes(rows: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (errors summed over equal labels, nulls together) and the
    digest of the codebooks, of all rows that are kept."""
    values = written(whole(rows))
    codebooks = train(values)
    coded = written(encode(values, codebooks))
    totals = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint").alias("label_error")).withColumnRenamed("label", "of")
    sent = F.broadcast(totals) if coded.select("label").distinct().limit(FEW + 1).count() <= FEW else totals
    found = coded.join(sent, F.col("label").eqNullSafe(F.col("of")), "left")
    return found.select("vec_id", "code", "error", "label_error", F.lit(codebooks.sha256).alias("codebooks_sha256"))
