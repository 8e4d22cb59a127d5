"""Near-duplicate vectors by a subspace pigeonhole join, and exact top-k search with KD-trees."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from archivist.llm.common import written
from archivist.llm.components import components


def finite(vector: Column | str) -> Column:
    """Whether a vector is not null and holds no null, NaN or infinite component."""
    v = F.col(vector) if isinstance(vector, str) else vector
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(ok, F.lit(False))


# --- pigeonhole join ---------------------------------------------------------------------------

BLOCKS = 4
#: Vectors of a cell, or visitors to it, that are compared in one task; more of them are split into parts.
PART = 2048
#: The coordinates that a grid can have; each one more is taken when the largest label outgrows the grid.
AXES = ("x", "y", "z", "u")
_ROTATION: dict[int, np.ndarray] = {}


def rotation(d: int) -> np.ndarray:
    """The same random orthogonal matrix everywhere."""
    if d not in _ROTATION:
        _ROTATION[d] = np.linalg.qr(np.random.default_rng(7).standard_normal((d, d)))[0]
    return _ROTATION[d]


def _unit(vectors: list) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _blocks(d: int) -> list[slice]:
    ends = np.linspace(0, d, min(BLOCKS, d) + 1).astype(int)
    return [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _budgets(d: int, threshold: float) -> list[float]:
    """Of the largest squared distance, each block's share by its dimensions."""
    return [(2 - 2 * threshold) * (b.stop - b.start) / d + 1e-9 for b in _blocks(d)]


def _axes(largest: int) -> int:
    """Coordinates of the grid for labels of up to so many vectors: 2 for 16 parts, 3 for 256, then 4."""
    return 2 + (largest > 16 * PART) + (largest > 256 * PART)


def _ahead(axes: int) -> list[tuple[int, ...]]:
    """A cell and its neighbours that come after it: so every pair of touching cells is met once."""
    steps = [s for s in itertools.product((-1, 0, 1), repeat=axes) if s >= (0,) * axes]
    return [s + (0,) * (len(AXES) - axes) for s in steps]


def _cells(threshold: float, axes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, rows in batch.groupby(batch["vector"].map(len)):
                turned = _unit(list(rows["vector"])) @ rotation(d)
                out = []
                for b, (part, budget) in enumerate(zip(_blocks(d), _budgets(d, threshold), strict=True)):
                    grid = np.floor(turned[:, part][:, :axes] / (budget**0.5 * 1.0001)).astype(np.int64)
                    grid = np.pad(grid, ((0, 0), (0, len(AXES) - grid.shape[1])))
                    out.append(pd.DataFrame({"id": rows["id"], "block": b} | dict(zip(AXES, grid.T, strict=True))))
                yield pd.concat(out)

    return run


def _join(threshold: float):
    """In two parts of a cell, or a part of it and one of the vectors that visit from cells ahead:
    the vectors' links and as many pairs as connect them. Parts of vectors at home meet when
    ``visit`` is 0. A pair belongs to the first block whose budget it keeps."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        d, block, left, right, visit = key[1], key[2], *key[-3:]
        rows = rows.sort_values(["home", "id"], ascending=[False, True], ignore_index=True)
        ids, copies, home, side = (rows[c].to_numpy() for c in ("id", "copies", "home", "side"))
        unit = _unit(list(rows["vector"]))
        turned = unit @ rotation(d)
        parts, budgets = _blocks(d), _budgets(d, threshold)
        mine = turned[:, parts[block]]
        square = (mine * mine).sum(axis=1)
        links, root, edges = np.zeros(len(ids), np.int64), np.arange(len(ids)), []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for lo in range(0, int(home.sum()), 256):
            hi = min(lo + 256, int(home.sum()))
            apart = square[lo:hi, None] + square - 2 * mine[lo:hi] @ mine.T
            near = (apart <= budgets[block] + 1e-6) & (np.arange(len(ids)) > np.arange(lo, hi)[:, None])
            if visit:
                near &= ~home
            elif left != right:
                near &= side[lo:hi, None] != side
            i, j = np.nonzero(near)
            i += lo
            for k in range(0, len(i), 65536):
                a, b = i[k : k + 65536], j[k : k + 65536]
                for n in range(block + 1):
                    gap = turned[a][:, parts[n]] - turned[b][:, parts[n]]
                    keeps = (gap * gap).sum(axis=1) <= budgets[n]
                    keeps = keeps if n == block else ~keeps
                    a, b = a[keeps], b[keeps]
                linked = (unit[a] * unit[b]).sum(axis=1) >= threshold
                a, b = a[linked], b[linked]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    if (p := find(x)) != (q := find(y)):
                        root[max(p, q)] = min(p, q)
                        edges.append((ids[x], ids[y]))
        some = np.flatnonzero(links)
        counts = pd.DataFrame({"a": ids[some], "b": pd.array([None] * len(some), "Int64"), "n": links[some]})
        return pd.concat([counts, pd.DataFrame({"a": [x for x, _ in edges], "b": pd.array([y for _, y in edges], "Int64"), "n": 0})]).astype({"a": "int64", "n": "int64"})

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors``.

    Compared are vectors of equal label (not null) and equal length. Vectors that are null, empty or
    zero or hold a null or non-finite component, and those without label, link with nothing. Equal
    vectors of a label are compared once and counted as often as they occur. Rows with the same id are
    one in components, and each has its own number of links. An empty table gives an empty result;
    other columns are ignored, whatever their names.

    The rotated unit vectors are split into blocks; two vectors within the squared distance 2 - 2 *
    threshold are within a block's share of it in one block at least. Each block is range-joined on
    a grid of its first coordinates, cells as wide as the block's radius, on more coordinates the
    more vectors a label has. The vectors of a cell and those that visit it from cells ahead are
    dealt to parts; a task holds two parts, at home both or one of them visiting.
    """
    v = F.col(vector)
    ok = finite(v) & F.col(label).isNotNull() & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("vector"), F.col(label).alias("label"), F.coalesce(ok, F.lit(False)).alias("ok"))
    nodes = written(rows.where("ok").groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")))
    largest = nodes.groupBy("label", F.size("vector")).count().agg(F.max("count")).first()[0] or 0
    axes = _axes(largest)
    cells = nodes.select("id", "vector").mapInPandas(_cells(threshold, axes), f"id long, block int, {', '.join(f'{c} long' for c in AXES)}")
    cells = written(cells.join(nodes.select("id", "label", F.size("vector").alias("d")), "id"))
    own = ["label", "d", "block", *AXES]
    ahead = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(AXES, s, strict=True)]) for s in _ahead(axes)])
    sent = cells.withColumn("to", F.explode(ahead)).withColumn("home", F.forall(F.array(*[F.col(f"to.{c}") for c in AXES]), lambda v: v == 0))
    sent = sent.select("id", "label", "d", "block", *[(F.col(c) - F.col(f"to.{c}")).alias(c) for c in AXES], "home")
    sizes = sent.groupBy(*own).agg(F.count_if("home").alias("n"), F.count_if(~F.col("home")).alias("m")).where("n > 0")  # a cell without vectors of its own needs no visitors
    sizes = sizes.select(*own, F.ceil(F.col("n") / PART).cast("int").alias("parts"), F.greatest(F.ceil(F.col("m") / PART).cast("int"), F.lit(1)).alias("visits"))
    sent = sent.join(sizes, own)
    sent = sent.withColumn("side", F.pmod(F.xxhash64("id"), F.when(F.col("home"), F.col("parts")).otherwise(F.col("visits"))).cast("int"))
    # a vector at home goes to all pairs that have its part, and alone to each part of the visitors;
    # a visitor goes with its part to each part at home. The visitors' first part comes where a part
    # at home meets itself.
    place = lambda left, right, visit: F.struct(left.alias("left"), right.alias("right"), visit.alias("visit"))
    side, zero, other = F.col("side"), F.lit(0), F.sequence(F.lit(0), F.col("parts") - 1)
    pairs = F.transform(other, lambda o: place(F.least(side, o), F.greatest(side, o), zero))
    more = F.transform(F.slice(F.sequence(F.lit(0), F.col("visits") - 1), F.lit(2), F.col("visits")), lambda o: place(side, side, o))
    sent = sent.withColumn("at", F.explode(F.when(F.col("home"), F.concat(pairs, more)).otherwise(F.transform(other, lambda o: place(o, o, side)))))
    full = sent.select("id", "home", "side", *own, "at.*").join(nodes.select("id", "vector", "copies"), "id").select("id", "copies", "vector", "home", "side", *own, "left", "right", "visit")
    found = written(full.groupBy(*own, "left", "right", "visit").applyInPandas(_join(threshold), "a long, b long, n long"))
    links = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    comps = components(found.where("b is not null").select("a", "b"))
    known = nodes.join(links, "id", "left").join(comps, "id", "left")
    known = known.select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component_id", "id").alias("component_id"))
    good = rows.where("ok").join(known, ["label", "vector"]).select("vec_id", F.col("links").alias("n_links"), "component_id")
    bad = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


# --- exact top-k with KD-trees -------------------------------------------------------------------

SHARD, LEAF = 4096, 128


class KDTree:
    """Median splits of the widest dimension down to leaves of about ``LEAF`` points, and tight
    bounding boxes of all nodes; level n has 2^n nodes."""

    def __init__(self, ids: np.ndarray, points: np.ndarray) -> None:
        order, self.levels = np.arange(len(ids)), max(0, int(np.ceil(np.log2(max(len(ids), 1) / LEAF))))
        ends = [np.array([0, len(ids)])]
        for _ in range(self.levels):
            now = [0]
            for lo, hi in zip(ends[-1][:-1], ends[-1][1:], strict=True):
                mid, some = (lo + hi) // 2, points[order[lo:hi]]
                if hi - lo > 1 and points.shape[1]:
                    widest = int((some.max(axis=0) - some.min(axis=0)).argmax())
                    order[lo:hi] = order[lo:hi][np.argpartition(some[:, widest], mid - lo)]
                now += [mid, hi]
            ends.append(np.array(now))
        self.ids, self.points, self.ends = ids[order], points[order], ends
        self.low, self.high = [], []
        for e in ends:
            lows, highs = np.full((len(e) - 1, points.shape[1]), np.inf), np.full((len(e) - 1, points.shape[1]), -np.inf)
            for k, (lo, hi) in enumerate(zip(e[:-1], e[1:], strict=True)):
                if hi > lo:
                    lows[k], highs[k] = self.points[lo:hi].min(axis=0), self.points[lo:hi].max(axis=0)
            self.low.append(lows)
            self.high.append(highs)

    def bounds(self, level: int, up: np.ndarray, down: np.ndarray) -> np.ndarray:
        """The greatest inner product that any point of a box can have with each query."""
        full = np.diff(self.ends[level]) > 0
        out = np.full((len(up), len(full)), -np.inf)
        out[:, full] = up @ self.high[level][full].T + down @ self.low[level][full].T
        return out


def search(tree: KDTree, queries: np.ndarray, own: np.ndarray, k: int, kth: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the (ids, scores) of its best k in the tree whose score is ``kth`` or more.

    Boxes below the kth score so far are left out level by level; the leaves that remain are visited
    best first, until a leaf's bound is below the kth score. Whole numbers, exact in 64-bit floats.
    """
    kth, up, down = kth.copy(), np.maximum(queries, 0), np.minimum(queries, 0)
    live = np.ones((len(queries), 1), bool)
    for level in range(tree.levels + 1):
        bound = np.where(live, tree.bounds(level, up, down), -np.inf)
        live = np.repeat(bound >= kth[:, None], 2, axis=1)
    turn = np.argsort(-bound, axis=1, kind="stable")
    best = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
    ends, every = tree.ends[-1], np.arange(len(queries))
    for t in range(turn.shape[1]):
        leaf = turn[:, t]
        go = bound[every, leaf] >= np.maximum(kth, -1e300)
        if not go.any():
            break
        for at in np.unique(leaf[go]):
            who = np.flatnonzero(go & (leaf == at))
            ids = tree.ids[ends[at] : ends[at + 1]]
            scores = queries[who] @ tree.points[ends[at] : ends[at + 1]].T
            row, col = np.nonzero((scores >= kth[who, None]) & (ids != own[who, None]))
            cut = np.searchsorted(row, np.arange(len(who) + 1))
            for n, q in enumerate(who.tolist()):
                some = col[cut[n] : cut[n + 1]]
                if len(some) == 0:
                    continue
                i, s = np.concatenate([best[q][0], ids[some]]), np.concatenate([best[q][1], scores[n, some]])
                keep = np.lexsort((i, -s))[:k]
                best[q] = i[keep], s[keep]
                if len(keep) == k:
                    kth[q] = max(kth[q], best[q][1][-1])
    return best


def _whole(vectors: list, scale: float) -> np.ndarray:
    return np.floor(scale * np.array([np.asarray(v, np.float64) for v in vectors]).reshape(len(vectors), -1))


def _found(own: np.ndarray, best: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    n = [len(i) for i, _ in best]
    return pd.DataFrame({"query_id": np.repeat(own, n), "vec_id": np.concatenate([i for i, _ in best] or [np.zeros(0)]).astype(np.int64), "score": np.concatenate([s for _, s in best] or [np.zeros(0)]).astype(np.int64)})


def _first(k: int, scale: float):
    """A shard's tree searched by its own queries, whose kth scores then hold everywhere."""

    def run(shard: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(asked):
            return _found(np.zeros(0, np.int64), [])
        own = asked["vec_id"].to_numpy()
        tree = KDTree(shard["vec_id"].to_numpy(), _whole(list(shard["vector"]), scale))
        return _found(own, search(tree, _whole(list(asked["vector"]), scale), own, k, np.full(len(own), -np.inf)))

    return run


def _others(k: int, scale: float):
    """A shard's tree searched by the queries of other shards, block by block."""

    def run(shard: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(asked):
            return _found(np.zeros(0, np.int64), [])
        tree = KDTree(shard["vec_id"].to_numpy(), _whole(list(shard["vector"]), scale))
        own, out = asked["vec_id"].to_numpy(), []
        points, kth = _whole(list(asked["vector"]), scale), asked["kth"].fillna(-np.inf).to_numpy()
        for at in range(0, len(own), 512):
            part = slice(at, at + 512)
            out.append(_found(own[part], search(tree, points[part], own[part], k, kth[part])))
        return pd.concat(out)

    return run


def top_k(vectors: DataFrame, asks: Column, k: int = 20, scale: float = 64.0, key: str = "vec_id", vector: str = "embedding", shard: int = SHARD, block: int = 2048) -> DataFrame:
    """query_id, rank, vec_id and score: for each row where ``asks`` its ``k`` greatest inner
    products with all other rows, ties to the smaller id.

    Each component x counts as floor(scale * x). Vectors that are null or hold null or non-finite
    components, or have no id, take no part; vectors meet those of equal length. Rows with the query's id are its own
    and no candidates. A repeated id asks once, with the shortest and then least of its vectors, and
    every row of it is a candidate. An empty table gives an empty result; other columns are ignored.
    Scores are exact below 2^53 (with 64 dimensions and the scale 64, for components up to 185,000).
    Rows go to shards of about ``shard`` by a hash of the id; each shard has a
    KD-tree. Every query first searches the shard it lies in; its kth score there goes with it to
    the other shards, where it drops whatever boxes cannot reach it. Queries go to each shard in
    blocks of about ``block``; a task holds one shard and one block.
    """
    rows = vectors.where(finite(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"), F.coalesce(asks, F.lit(False)).alias("asks"), F.size(vector).alias("d"))
    shards = max(1, -(-rows.count() // shard))
    rows = written(rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")))
    asked = rows.where("asks").groupBy("vec_id", "shard").agg(F.min(F.struct("d", "vector")).alias("q"))
    asked = written(asked.select("vec_id", "shard", "q.d", "q.vector"))
    rows = rows.drop("asks")
    blocks = max(1, -(-asked.count() // block))
    schema = "query_id long, vec_id long, score long"
    home = written(rows.groupBy("shard", "d").cogroup(asked.groupBy("shard", "d")).applyInPandas(_first(k, scale), schema))
    limits = home.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), F.col("kth").cast("double").alias("kth"))
    queries = asked.join(limits, "vec_id", "left").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
    to = F.explode(F.array_remove(F.sequence(F.lit(0), F.lit(shards - 1)), F.col("shard")))
    queries = queries.withColumn("to", to).select(F.col("to").alias("shard"), "block", "d", "vec_id", "vector", "kth")
    trees = rows.toDF(*rows.columns).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("shard", "block", "d", "vec_id", "vector")
    on = ["shard", "block", "d"]
    away = trees.groupBy(*on).cogroup(queries.groupBy(*on)).applyInPandas(_others(k, scale), schema)
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = home.unionByName(away).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
