"""Similarity and keyword search."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from archivist.functions import text as T
from archivist.functions import vectors as V
from archivist.operators import cells
from archivist.operators.cells import unit
from archivist.sources import partitioned
from archivist.sources.shared import shared_path


#: Rows of a block of a join at most, and of two pieces of blocks that are compared at once.
JOINED, PIECE = 65_536, 1024


def _literal(query: list[float]) -> Column:
    return F.lit([float(x) for x in query])


def top_k(frames: DataFrame, query: list[float], k: int = 5, key: str = "vec_id", vector: str = "embedding", threshold: float | None = None) -> DataFrame:
    """The k best rows by cosine, ties by key, with rank from 1; each task keeps its k best.

    With ``threshold`` only rows of the query's dimension with that score or more.
    """
    if not query:
        raise ValueError("an empty query has no neighbours")
    rows = frames.withColumn("score", V.cosine(F.col(vector), _literal(query)))
    if threshold is not None:
        rows = rows.where(V.same_dim(F.col(vector), len(query)) & (F.col("score") >= threshold))
    best = rows.orderBy(F.col("score").desc(), key).limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.col("score").desc(), key)))  # over k rows


def threshold_search(frames: DataFrame, query: list[float], limit: int = 10, threshold: float = 0.7, filters: Mapping[str, object] | None = None, filter_mode: str = "pre", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows above the threshold, best first. ``filters`` on the column metadata hold before the limit,
    or after it with ``filter_mode='post'``. Limits or thresholds of 0 or less mean the default."""
    limit, threshold = limit if limit > 0 else 10, threshold if threshold > 0 else 0.7
    if filters and filter_mode == "pre":
        frames = frames.where(T.metadata_matches(F.col("metadata"), filters))
    found = top_k(frames, query, limit, key, vector, threshold)
    return found.where(T.metadata_matches(F.col("metadata"), filters)) if filters and filter_mode == "post" else found


def similar(frames: DataFrame, value: object, limit: int = 5, threshold: float = 0.5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The rows most like the one whose key is ``value``, without itself."""
    one = frames.where(F.col(key) == value).select(F.col(vector).alias("_q")).limit(1)
    rows = frames.where(F.col(key) != value).join(F.broadcast(one))  # one row
    rows = rows.where(F.size(vector) == F.size("_q")).withColumn("score", V.cosine(F.col(vector), F.col("_q"))).drop("_q")
    best = rows.where(F.col("score") >= threshold).orderBy(F.col("score").desc(), key).limit(limit)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.col("score").desc(), key)))


def _vectors(frames: DataFrame, key: str, vector: str) -> DataFrame:
    return frames.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v"), F.size(vector).alias("d"))


def _first(scores: np.ndarray, k: int) -> np.ndarray:
    """The places of each row's k highest scores, highest first, ties by place; a few rows at a time."""
    out = np.empty((len(scores), min(k, scores.shape[1])), np.int64)
    for at in range(0, len(scores), 128):
        out[at : at + 128] = np.argsort(-np.round(scores[at : at + 128], 12), axis=1, kind="stable")[:, :k]
    return out


def _best(k: int | None):
    """Of two blocks, of rows and of queries, each query's k best rows (or all of them)."""

    def run(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({"query_id": [], "key": [], "score": []}).astype({"query_id": "int64", "key": "int64", "score": "float64"})
        x = x.sort_values("id")
        scores = unit(q["q"]) @ unit(x["v"]).T
        if k is None:
            return pd.DataFrame({"query_id": np.repeat(q["qid"].to_numpy(), len(x)), "key": np.tile(x["id"].to_numpy(), len(q)), "score": scores.ravel()})
        order = _first(scores, k)
        return pd.DataFrame({"query_id": np.repeat(q["qid"].to_numpy(), order.shape[1]), "key": x["id"].to_numpy()[order].ravel(), "score": np.take_along_axis(scores, order, axis=1).ravel()})

    return run


_HIT = "query_id long, key long, score double"


def _met(rows: DataFrame, asked: DataFrame, k: int | None, turns: int) -> DataFrame:
    """Hits of queries (qid, q, d, block) in blocks of rows (id, v, d, block); queries are dealt to ``turns`` parts."""
    left = rows.select("id", "v", "d", "block").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    right = asked.select("qid", "q", "d", "block").withColumn("turn", F.pmod(F.xxhash64("qid"), F.lit(turns)).cast("int"))
    return left.groupBy("block", "turn", "d").cogroup(right.groupBy("block", "turn", "d")).applyInPandas(_best(k), _HIT)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "key")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _to_blocks(asked: DataFrame, rows: cells.Placed) -> tuple[DataFrame, DataFrame]:
    """Queries (with cell) once for each block of that cell, and the rows of cells that are asked."""
    table = F.broadcast(rows.blocks)  # a row a cell
    asked = asked.join(table, "cell").withColumn("block", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)))
    wanted = asked.select("cell").distinct()
    return asked, rows.rows.join(F.broadcast(wanted), "cell", "left_semi")  # at most cells.CELLS


def batch_top_k(frames: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", block: int = cells.BLOCK) -> DataFrame:
    """query_id, rank, key and score: the k best rows for each of many queries, by matrix products.

    Rows lie in cells, which are split into blocks, and a query first meets the blocks of its own cell.
    With its kth score it goes to those other cells only that can hold a better one by the triangle
    inequality; so neither side has to fit one task. Vectors meet those of equal length.
    """
    rows = cells.in_cells(_vectors(frames, key, vector), block, block)
    asked = cells.kept(_vectors(queries, query_key, vector).select(F.col("id").alias("qid"), F.col("v").alias("q"), "d"), "queries")
    turns = math.ceil(asked.count() / block) or 1
    if rows.cells.count == 1:
        found = _met(*reversed(_to_blocks(asked.withColumn("cell", F.lit(cells.ANY)), rows)), k, turns)
    else:
        near = cells.placed(asked.toDF("id", "v", "d"), rows.cells).select(F.col("id").alias("qid"), F.col("v").alias("q"), "d", F.col("cell"))
        first = cells.kept(_ranked(_met(*reversed(_to_blocks(near, rows)), k, turns), k).drop("rank"), "nearest")
        kth = first.groupBy(F.col("query_id").alias("qid")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
        rest = _cells_left(near.join(kth, "qid", "left"), rows)
        found = first.unionByName(_met(*reversed(_to_blocks(rest, rows)), k, turns))
    return _ranked(found, k).select("query_id", "rank", F.col("key").alias(key), "score")


def _cells_left(asked: DataFrame, rows: cells.Placed) -> DataFrame:
    """Queries (qid, q, d, cell, kth) once for each other cell that can hold one of their k best."""
    place, radius, there = rows.cells, rows.radius, rows.parts > 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in cells.sliced(batches):
            for d, some in batch.groupby("d"):
                least = np.full((len(some), place.count), 0.0)  # of the angle to a cell's vectors
                if d in place.centroids:
                    at = slice(place.first[d], place.first[d] + len(place.centroids[d]))
                    angles, good = place.angles(some["q"], d)
                    least[:, at] = np.where(good[:, None], np.maximum(angles - radius[at] - cells.SLACK, 0), 0)
                kth = some["kth"].fillna(-2.0).to_numpy()[:, None]
                go = (np.cos(least) + 1e-9 >= kth) & there & (np.arange(place.count) != some["cell"].to_numpy()[:, None])
                row, cell = np.nonzero(go)
                for at in range(0, len(row), cells.SLICE):  # a query has as many rows as there are cells
                    r, c = row[at : at + cells.SLICE], cell[at : at + cells.SLICE]
                    yield pd.DataFrame({"qid": some["qid"].to_numpy()[r], "q": some["q"].to_numpy()[r], "d": d, "cell": c.astype("int32")})

    kinds = dict(asked.dtypes)
    return asked.mapInPandas(run, f"qid {kinds['qid']}, q {kinds['q']}, d int, cell int")


def _near(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and scores of the pairs of unit vectors with a cosine of ``threshold`` or more. Products in
    single precision, off by less than the slack, leave out most; the others are decided in double."""
    slack = (x.shape[1] + 16) * 2.0**-22
    a, b = np.nonzero(~(x.astype(np.float32) @ y.astype(np.float32).T < threshold - slack))
    if len(a) * 4 > len(x) * len(y):
        scores = (x @ y.T)[a, b]
    else:
        scores = np.concatenate([np.einsum("ij,ij->i", x[a[k : k + 1 << 14]], y[b[k : k + 1 << 14]]) for k in range(0, len(a), 1 << 14)] or [np.zeros(0)])
    good = np.round(scores, 9) >= threshold
    return a[good], b[good], scores[good]


def _pairs_in(threshold: float, out: Callable[[np.ndarray, Iterator], Iterator[pa.RecordBatch]]):
    """All pairs of a group of rows (id, v, own, a, b) that are of two blocks, or of one, a piece at a time."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).select(["id", "v", "own"]).sort_by("id").combine_chunks()
        ids, own, d = rows["id"].to_numpy(), rows["own"].to_numpy(), key[2].as_py()
        x = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), d)
        del rows
        x = unit(x)
        first, second = (np.flatnonzero(own == key[k].as_py()) for k in (0, 1))

        def pieces() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for at in range(0, len(first), PIECE):
                mine = first[at : at + PIECE]
                for to in range(0, len(second), PIECE):
                    others = second[to : to + PIECE]
                    if key[0] != key[1] or others[-1] > mine[0]:
                        i, j, s = _near(x[mine], x[others], threshold)
                        i, j = mine[i], others[j]
                        if key[0] == key[1]:
                            i, j, s = i[i < j], j[i < j], s[i < j]
                        yield np.minimum(i, j), np.maximum(i, j), s

        yield from out(ids, pieces())

    return run


def _joined(frames: DataFrame, threshold: float, key: str, vector: str, block: int | None, out: Callable, schema: str) -> DataFrame:
    """Blocks are a sixteenth of the rows, from ``BLOCK`` to ``JOINED``: each row goes to as many tasks as there are blocks."""
    rows = cells.in_cells(_vectors(frames, key, vector), block or cells.BLOCK, block or cells.BLOCK)
    together = 1 if block else max(1, min(JOINED // cells.BLOCK, math.ceil(int(rows.parts.sum()) / 16)))
    return cells.block_pairs(rows, threshold - 1e-9, together).groupBy("a", "b", "d").applyInArrow(_pairs_in(threshold, out), schema)


def similarity_join(frames: DataFrame, threshold: float, key: str = "vec_id", vector: str = "embedding", block: int | None = None) -> DataFrame:
    """All pairs (left_id, right_id, score) with left_id < right_id and score >= threshold: exact, by
    matrix products of the pairs of blocks that can hold one."""

    def out(ids: np.ndarray, pieces: Iterator) -> Iterator[pa.RecordBatch]:
        for i, j, s in pieces:
            yield pa.RecordBatch.from_arrays([pa.array(ids[i], pa.int64()), pa.array(ids[j], pa.int64()), pa.array(s, pa.float64())], ["left_id", "right_id", "score"])

    return _joined(frames, threshold, key, vector, block, out, "left_id long, right_id long, score double")


def neighbour_counts(frames: DataFrame, threshold: float, key: str = "vec_id", vector: str = "embedding", block: int | None = None) -> DataFrame:
    """(key, neighbours) of every row: how many others score the threshold; pairs aren't expanded."""

    def out(ids: np.ndarray, pieces: Iterator) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(ids), np.int64)
        for i, j, _ in pieces:
            n += np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n)], ["id", "n"])

    found = _joined(frames, threshold, key, vector, block, out, "id long, n long")
    every = _vectors(frames, key, vector).select("id", F.lit(0).cast("long").alias("n"))  # also of cells that meet none
    return found.unionByName(every).groupBy(F.col("id").alias(key)).agg(F.sum("n").alias("neighbours"))


# --- inverted file ------------------------------------------------------------------------------


def ann_save(frames: DataFrame, path: str, n_cells: int | None = None, key: str = "vec_id", vector: str = "embedding") -> None:
    """An inverted file below ``path``: vectors partitioned by cell, and the cells' centroids.

    Centroids are fitted on at most ``cells.SAMPLE`` vectors; all are stored. By default there are
    twice as many cells as the square root of the rows, up to ``cells.CELLS``.
    """
    vectors = cells.kept(_vectors(frames, key, vector), "vectors")
    made = cells.fitted(vectors, n_cells or max(2, min(cells.CELLS, round(2 * math.sqrt(vectors.count())))))
    partitioned.save(cells.placed(vectors, made), f"{path}/vectors", "cell", "id")
    table = [(k, d, [float(x) for x in c]) for k, (d, c) in enumerate((d, c) for d, cs in made.centroids.items() for c in cs)]
    frames.sparkSession.createDataFrame(table, "place int, d int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


class AnnIndex:
    """An inverted file that `ann_save` has written."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.rows = partitioned.load(spark, f"{path}/vectors")
        found: dict[int, list] = {}
        for r in spark.read.parquet(f"{path}/cells").orderBy("place").collect():  # at most cells.CELLS or so
            found.setdefault(r.d, []).append(r.centroid)
        self.cells = cells.Cells.of({d: np.array(c) for d, c in found.items()})

    def probed(self, queries: DataFrame, probes: int, query_key: str = "query_id", vector: str = "embedding") -> DataFrame:
        """Queries (qid, q, d) once for each of the ``probes`` nearest cells, and for the cell of any vector."""
        place = self.cells

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in cells.sliced(batches):
                for d, some in batch.groupby("d"):
                    near = np.full((len(some), 1), cells.ANY)
                    if d in place.centroids:
                        near = np.hstack([near, place.angles(some["q"], d)[0].argsort(axis=1, kind="stable")[:, :probes] + place.first[d]])
                    n = near.shape[1]
                    yield pd.DataFrame({"qid": np.repeat(some["qid"].to_numpy(), n), "q": some["q"].to_numpy()[np.repeat(np.arange(len(some)), n)], "d": d, "cell": near.ravel().astype("int32")})

        asked = _vectors(queries, query_key, vector).select(F.col("id").alias("qid"), F.col("v").alias("q"), "d")
        kinds = dict(asked.dtypes)
        return asked.mapInPandas(run, f"qid {kinds['qid']}, q {kinds['q']}, d int, cell int")

    def read(self, wanted: list[int]) -> DataFrame:
        """The rows of these cells; no others are read."""
        return self.rows.where(F.col("cell").isin(wanted))

    def search(self, queries: DataFrame, k: int = 6, probes: int = 8, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", block: int = cells.BLOCK) -> DataFrame:
        """query_id, key, score and rank of the k best rows among those in the cells nearest to a query."""
        asked = cells.kept(self.probed(queries, probes, query_key, vector), "probes")
        wanted = sorted(r.cell for r in asked.select("cell").distinct().collect())  # cells
        rows = self.read(wanted)
        sizes = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
        sizes = F.broadcast(cells.kept(sizes, "sizes"))  # a row a cell
        part = lambda n: F.struct("cell", n.cast("int").alias("part"))
        rows = rows.join(sizes, "cell").withColumn("block", part(F.pmod(F.xxhash64("id"), F.col("parts"))))
        asked = asked.join(sizes, "cell").withColumn("n", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("block", part(F.col("n")))
        turns = math.ceil(queries.count() / block) or 1
        return _ranked(_met(rows, asked, k, turns), k).select("query_id", F.col("key").alias(key), "score", "rank")

    def probes_for(self, recall: float = 0.95, k: int = 6, queries: int = 64) -> int:
        """The fewest probes by which ``queries`` stored vectors, chosen by hash, find this share of their
        k nearest; these are found exactly, and no more than ``queries`` x k rows come to the driver."""
        some = cells.kept(self.rows.where(F.col("cell") != cells.ANY).orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(queries).select(F.col("id").alias("query_id"), "v", "d"), "sample")
        true = batch_top_k(self.rows.select("id", "v"), some, k + 1, "id", "v").where("query_id <> id").join(self.rows.select("id", F.col("cell").alias("of")), "id")
        asked = {r.query_id: (r.v, r.d) for r in some.collect()}
        places = []
        for r in true.collect():
            v, d = asked[r.query_id]
            order = self.cells.angles(pd.Series([v]), d)[0][0].argsort(kind="stable") + self.cells.first[d]
            places.append(0 if r.of == cells.ANY else int(np.flatnonzero(order == r.of)[0]) + 1)
        return max(1, int(np.quantile(places, recall, method="higher"))) if places else 1


def ann_search(frames: DataFrame, queries: DataFrame, k: int = 6, recall: float = 0.95, n_cells: int | None = None, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id") -> DataFrame:
    """Approximate neighbours from an inverted file made for it, with as many cells read a query as
    ``recall`` asks for, scored exactly."""
    path = shared_path(frames.sparkSession, "cells")
    ann_save(frames, path, n_cells, key, vector)
    index = AnnIndex(frames.sparkSession, path)
    return index.search(queries, k, index.probes_for(recall, k), key, vector, query_key)


def rank_hits(hits: DataFrame, query: str = "query_id", key: str = "vec_id") -> DataFrame:
    """Adds rank, from 1 for each query."""
    return hits.withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy(F.col("score").desc(), key)))


def score_all(frames: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", block: int = cells.BLOCK // 2) -> DataFrame:
    """Every query's score with every row of its length, block by block; a task's scores are a block's square."""
    rows = cells.kept(_vectors(frames, key, vector), "vectors")
    asked = cells.kept(_vectors(queries, query_key, vector).select(F.col("id").alias("qid"), F.col("v").alias("q"), "d"), "queries")
    n, turns = (math.ceil(x.count() / block) or 1 for x in (rows, asked))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return _met(rows, asked, None, turns).toDF(query_key, key, "score")


# --- keywords ---------------------------------------------------------------------------------


def keyword_rank(docs: DataFrame, query: str, limit: int = 20, text: str = "text", key: str = "doc_id", scan_limit: int | None = None) -> DataFrame:
    """Documents that contain the query, most relevant first. ``scan_limit`` stops at so many matches
    in key order before ranking."""
    if not query:
        raise ValueError("an empty query matches everything")
    found = docs.where(T.contains_ci(F.col(text), query))
    if scan_limit is not None:
        found = found.orderBy(key).limit(scan_limit)
    found = found.withColumns({"occurrences": T.occurrences(F.col(text), query), "words": T.word_count(F.col(text)), "relevance": T.relevance(F.col(text), query)})
    return found.orderBy(F.col("relevance").desc_nulls_last(), key).limit(limit)


def keyword_snippets(docs: DataFrame, query: str, limit: int = 10, width: int = 200, text: str = "text", key: str = "doc_id", memory: str | None = None, memory_column: str = "source") -> DataFrame:
    """keyword_rank of one memory or all, with snippet and match_start."""
    rows = docs if memory is None else docs.where(F.col(memory_column) == memory)
    found = keyword_rank(rows, query, limit, text, key)
    return found.withColumns({"match_start": T.match_start(F.col(text), query), "snippet": T.snippet(F.col(text), query, width)})


def page(rows: DataFrame, limit: int = 20, offset: int = 0, newest: str = "created_at", key: str = "id") -> DataFrame:
    """Newest first, then by key; a limit of 0 or less means all."""
    out = rows.orderBy(F.col(newest).desc(), key).offset(offset)
    return out.limit(limit) if limit > 0 else out


# --- lookups ----------------------------------------------------------------------------------


def in_request_order(frames: DataFrame, numbers: list[int], number: str = "frame_number", strict: bool = False) -> DataFrame:
    """The frames asked for, in that order, with ``pos`` and ``found``; with ``strict`` a frame that
    isn't there is an error."""
    asked = frames.sparkSession.createDataFrame(list(enumerate(numbers)), f"pos int, {number} long")
    out = F.broadcast(asked).join(frames.withColumn("found", F.lit(True)), number, "left").withColumn("found", F.coalesce("found", F.lit(False)))
    if strict and not out.where(~F.col("found")).isEmpty():
        raise KeyError("some frames are not there")
    return out.orderBy("pos")


def hits_with_content(hits: DataFrame, chunks: DataFrame, on: list[str]) -> DataFrame:
    return hits.join(chunks, on)


# --- embedding --------------------------------------------------------------------------------


def embed(docs: DataFrame, embedder, text: str = "text", width: int | None = None) -> DataFrame:
    """Adds embedding by ``embedder``: an object with ``dim`` and ``embed(list of texts)`` that gives a
    vector or None for each. It gets whole texts, or their first ``width`` characters where its model takes
    no more. Rows that fail have null, for the caller to leave out."""
    given = F.col(text) if width is None else T.embed_truncate(F.col(text), width)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            parts = (embedder.embed(list(batch.iloc[at : at + cells.SLICE])) for at in range(0, len(batch), cells.SLICE))
            yield pd.Series([None if v is None else [float(x) for x in v] for part in parts for v in part], dtype=object)

    # not deterministic as far as Spark knows: else a filter on the embedding runs the embedder a second time, beside the first
    return docs.withColumn("embedding", F.pandas_udf(run, "array<float>").asNondeterministic()(given))


def hash_embed(docs: DataFrame, dim: int = 64, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, embedding): words counted in ``dim`` hash buckets, to unit length. Without words: zeros."""
    words = docs.select(key, F.explode_outer(F.split(F.lower(text), r"\s+")).alias("w")).where("w <> ''")
    bucket = F.pmod(F.conv(F.substring(F.md5(F.col("w").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")
    counts = words.groupBy(key, bucket.alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"))
    rows = docs.select(key).join(rows, key, "left")
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0.0)))
    rows = rows.select(key, dense.alias("v")).withColumn("_n", V.norm(F.col("v")))
    return rows.select(key, V.scaled(F.col("v"), F.col("_n")).alias("embedding"))


def build_index(chunks: DataFrame, embedding: Callable[[DataFrame], DataFrame], memory: str = "memory_id", text: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(frames, index_meta) of text chunks (memory_id, source_file, chunk_index, frame_number,
    payload). ``embedding`` adds the column embedding. Frames are written once, so that it isn't
    computed again for the second table."""
    rows = embedding(chunks)
    frames = rows.select(memory, "frame_number", "chunk_index", "source_file", F.sha2(text, 256).alias("content_hash"), F.length(text).alias("content_len"), "embedding", T.preview(F.col(text)).alias("preview"))
    frames = cells.kept(frames, "frames")
    meta = frames.groupBy(memory).agg(F.count(F.lit(1)).alias("total_frames"), F.max(F.size("embedding")).alias("vector_dim"))
    return frames, meta
