"""Vectors in cells around centroids, so that a search can leave out cells by their distance.

Directions are compared by angle, which obeys the triangle inequality: a cell whose centroid is at
angle a and whose vectors are all within angle r of it holds nothing nearer than a - r.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivist.sources.shared import shared_path

#: Vectors of a block: two blocks are compared in one task.
BLOCK = 2048
#: Cells at most; the tables of cells and of their pairs that go to every task and to the driver are bounded by it.
CELLS = 1024
#: Vectors at most that centroids are fitted on.
SAMPLE = 16_384
#: Vectors that are compared with all cells at once, and rows of queries put out at once.
SLICE = 1024
#: What angles may be off by.
SLACK = 1e-6
#: The cell of vectors that have no direction (zero or not finite) or a length that no centroid has.
ANY = 0


def unit(vectors: pd.Series | np.ndarray) -> np.ndarray:
    """The vectors, of equal lengths, to unit length; zeros stay."""
    x = vectors if isinstance(vectors, np.ndarray) else np.array([np.asarray(v, np.float64) for v in vectors])
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


@dataclass(frozen=True)
class Cells:
    """Centroids by vector length; ``first`` numbers the first cell of each length (from 1)."""

    centroids: dict[int, np.ndarray] = field(default_factory=dict)
    first: dict[int, int] = field(default_factory=dict)

    @staticmethod
    def of(centroids: dict[int, np.ndarray]) -> Cells:
        first, at = {}, 1
        for d in sorted(centroids):
            first[d] = at
            at += len(centroids[d])
        return Cells({d: centroids[d] for d in sorted(centroids)}, first)

    @property
    def count(self) -> int:
        """Cells, with the one for any vector."""
        return 1 + sum(map(len, self.centroids.values()))

    def angles(self, vectors: pd.Series, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Angles of vectors of length ``d`` to the centroids of that length, and which have a direction."""
        x = unit(vectors)
        good = np.isfinite(x).all(axis=1) & (np.abs(x).max(axis=1, initial=0) > 0)
        return angle(np.where(good[:, None], x, 0) @ self.centroids[d].T), good

    def place(self, vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector, and its angle to the centroid."""
        cell, off = np.full(len(vectors), ANY), np.full(len(vectors), math.pi)
        sizes = vectors.map(len).to_numpy()
        for d in np.unique(sizes):
            if int(d) in self.centroids:
                at = np.flatnonzero(sizes == d)
                angles, good = self.angles(vectors.iloc[at], int(d))
                best = angles.argmin(axis=1)
                cell[at[good]] = best[good] + self.first[int(d)]
                off[at[good]] = angles[good, best[good]]
        return cell, off

    def between(self) -> np.ndarray:
        """Angles of all pairs of cells: 0 with the one for any vector, pi between those of different lengths."""
        out = np.full((self.count, self.count), math.pi)
        out[ANY, :] = out[:, ANY] = 0
        for d, c in self.centroids.items():
            at = slice(self.first[d], self.first[d] + len(c))
            out[at, at] = angle(c @ c.T)
        return out


def _clustered(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """``k`` directions that the rows of ``x`` lie around (or as many as there are different rows)."""
    start = np.unique(x, axis=0)
    c = start[np.random.default_rng(5).permutation(len(start))[:k]]
    for _ in range(rounds):
        nearest = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, nearest, x)
        n = np.sqrt((total * total).sum(axis=1, keepdims=True))
        c = np.where(n > 1e-9, total / np.maximum(n, 1e-9), c)
    return c


def fitted(vectors: DataFrame, cells: int) -> Cells:
    """Centroids for about ``cells`` cells from at most ``SAMPLE`` of the vectors (id, v), chosen by hash."""
    if cells <= 1:
        return Cells()
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()["v"]
    sizes = rows.map(len)
    found = {}
    for d in sorted(set(sizes) - {0}):
        x = unit(rows[sizes == d])
        x = x[np.isfinite(x).all(axis=1) & (np.abs(x).max(axis=1) > 0)]
        if len(x):
            found[int(d)] = _clustered(x, max(1, min(CELLS, round(cells * len(x) / len(rows)))))
    return Cells.of(found)


def sliced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The batches in parts of ``SLICE`` rows, so that a table of rows and cells stays small."""
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            yield batch.iloc[at : at + SLICE]


def placed(vectors: DataFrame, cells: Cells) -> DataFrame:
    """``vectors`` (id, v, d) with cell and off, the angle to its centroid."""
    if not cells.centroids:
        return vectors.withColumns({"cell": F.lit(ANY), "off": F.lit(math.pi)})
    sent = vectors.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in sliced(batches):
            cell, off = sent.value.place(batch["v"])
            yield batch.assign(cell=cell.astype("int32"), off=off)

    kinds = dict(vectors.dtypes)
    return vectors.mapInPandas(run, f"id {kinds['id']}, v {kinds['v']}, d int, cell int, off double")


def kept(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to the shared folder and read from there."""
    path = shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@dataclass(frozen=True)
class Placed:
    """Vectors in cells: ``rows`` (id, v, d, cell, off, block), where a block is a part of a cell, and of
    each cell its radius and its blocks (``first`` to ``first`` + ``parts`` - 1)."""

    rows: DataFrame
    cells: Cells
    radius: np.ndarray
    first: np.ndarray
    parts: np.ndarray

    @property
    def blocks(self) -> DataFrame:
        """(cell, of_cell) of every block, at most a row for ``BLOCK`` vectors and one a cell."""
        table = [(int(c), int(self.first[c]), int(self.parts[c])) for c in np.flatnonzero(self.parts)]
        return self.rows.sparkSession.createDataFrame(table, "cell int, first int, parts int")


def in_cells(vectors: DataFrame, per_cell: int = BLOCK, block: int = BLOCK) -> Placed:
    """Vectors (id, v, d) in cells of about ``per_cell``, of which the larger are split into blocks. The
    vectors are written once, however they are made, and again with their cells."""
    vectors = kept(vectors, "vectors")
    cells = fitted(vectors, min(CELLS, math.ceil(vectors.count() / per_cell)))
    rows = kept(placed(vectors, cells), "placed") if cells.centroids else placed(vectors, cells)
    sums = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("off").alias("radius")).collect()  # a row a cell
    n, radius = np.zeros(cells.count, np.int64), np.zeros(cells.count)
    for r in sums:
        n[r.cell], radius[r.cell] = r.n, r.radius
    parts = -(-n // block)
    first = np.cumsum(parts) - parts
    out = Placed(rows, cells, radius, first, parts)
    table = F.broadcast(out.blocks)  # a row a cell
    rows = rows.join(table, "cell").withColumn("block", F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    return Placed(rows.drop("first", "parts"), cells, radius, first, parts)


def cell_pairs(rows: Placed, least: float) -> list[tuple[int, int]]:
    """The pairs of cells, in both orders, that can hold two vectors with a cosine of ``least`` or more."""
    apart = rows.cells.between() - rows.radius[:, None] - rows.radius
    there = rows.parts > 0
    near = (apart <= math.acos(max(-1.0, min(1.0, least))) + SLACK) & there[:, None] & there
    if least > 1:
        near[:] = False
    return [(int(a), int(b)) for a, b in np.argwhere(near)]


def block_pairs(rows: Placed, least: float, together: int = 1) -> DataFrame:
    """Each of ``rows`` once for each block that its own can hold such a pair with: with own, other, and
    the two in order as a and b. ``together`` blocks that follow each other count as one."""
    pairs = [(a, b, int(rows.first[b]), int(rows.parts[b])) for a, b in cell_pairs(rows, least)]
    met = rows.rows.sparkSession.createDataFrame(pairs, "cell int, with int, start int, n int")  # at most CELLS x CELLS
    place = lambda block: F.floor(block / together).cast("int")
    to = met.select("cell", F.explode(F.sequence(place(F.col("start")), place(F.col("start") + F.col("n") - 1))).alias("other"))
    to = to.groupBy("cell").agg(F.collect_set("other").alias("others"))  # a row a cell
    out = rows.rows.join(F.broadcast(to), "cell").withColumn("other", F.explode("others"))
    own = place(F.col("block"))
    return out.select("id", "v", "d", own.alias("own"), F.least(own, "other").alias("a"), F.greatest(own, "other").alias("b"))
