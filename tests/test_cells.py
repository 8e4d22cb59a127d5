import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from archivist.operators import cells, search

SCHEMA = "vec_id long, embedding array<float>"


def _clusters(seed=1, n=1200, centres=12, d=8, spread=0.05):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((centres, d))
    x = middle[rng.integers(0, centres, n)] + spread * rng.standard_normal((n, d))
    return x.astype(np.float32)


def _odd(x):
    """Rows of vectors, some zero, null, equal, opposite, or of another length."""
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    n = len(rows)
    return rows + [(n, [0.0] * x.shape[1]), (n + 1, None), (n + 2, rows[0][1]), (n + 3, rows[0][1]), (n + 4, [-c for c in rows[0][1]]), (n + 5, [1.0, 2.0]), (n + 6, [2.0, 4.0]), (n + 7, [0.0, 0.0]), (n + 8, [1.0] * 3)]


def _cosines(rows):
    out = {}
    for d in {len(v) for _, v in rows if v is not None}:
        ids = [k for k, v in rows if v is not None and len(v) == d]
        x = cells.unit([v for _, v in rows if v is not None and len(v) == d])
        s = x @ x.T
        out |= {(a, b): s[i, j] for i, a in enumerate(ids) for j, b in enumerate(ids)}
    return out


@pytest.fixture(scope="module")
def odd():
    return _odd(_clusters())


@pytest.mark.parametrize("threshold", [0.98, 0.6, 0.0, -0.5])
def test_pruned_join_is_exact(spark, odd, threshold):
    frame, want = spark.createDataFrame(odd, SCHEMA).repartition(4), _cosines(odd)
    pairs = {(a, b) for (a, b), s in want.items() if a < b and round(s, 9) >= threshold}
    counts = search.neighbour_counts(frame, threshold, block=64).collect()
    n = {k: 0 for k, v in odd if v is not None}
    for a, b in pairs:
        n[a], n[b] = n[a] + 1, n[b] + 1
    assert {r.vec_id: r.neighbours for r in counts} == n
    if threshold > 0.9:
        found = search.similarity_join(frame, threshold, block=64).collect()
        assert {(r.left_id, r.right_id) for r in found} == pairs and len(found) == len(pairs)


def test_few_block_pairs_of_clustered_vectors_are_compared(spark):
    frame = spark.createDataFrame(_odd(_clusters())[:1200], SCHEMA)
    rows = cells.in_cells(search._vectors(frame, "vec_id", "embedding"), 64, 64)
    blocks = int(rows.parts.sum())
    met = cells.block_pairs(rows, 0.95).select("a", "b").distinct().count()
    assert blocks >= 19 and met <= 0.3 * blocks * (blocks + 1) / 2, (met, blocks)
    largest = rows.rows.groupBy("block").count().agg(F.max("count")).first()[0]
    assert largest <= 2 * 64  # a cell that is larger is split


def test_a_cell_with_most_rows_is_split(spark):
    same = [(k, [1.0, 2.0, 3.0]) for k in range(700)] + [(700 + k, [float(k % 7), 1.0, -2.0]) for k in range(300)]
    frame = spark.createDataFrame(same, SCHEMA)
    rows = cells.in_cells(search._vectors(frame, "vec_id", "embedding"), 100, 100)
    assert rows.rows.groupBy("block").count().agg(F.max("count")).first()[0] <= 200
    found = search.batch_top_k(frame, frame.where("vec_id in (5, 900)").withColumnRenamed("vec_id", "query_id"), 3, block=100).collect()
    assert {(r.query_id, r.rank, r.vec_id) for r in found if r.query_id == 5} == {(5, 1, 0), (5, 2, 1), (5, 3, 2)}


@pytest.mark.parametrize("k", [1, 7, 2000])
def test_pruned_top_k_is_exact(spark, odd, k):
    frame, want = spark.createDataFrame(odd, SCHEMA).repartition(3), _cosines(odd)
    asked = [r for r in odd if r[0] % 97 == 0 or r[0] >= 1200]
    queries = spark.createDataFrame([(q + 10_000, v) for q, v in asked], "query_id long, embedding array<float>")
    found = {}
    for r in search.batch_top_k(frame, queries, k, block=64).collect():
        found.setdefault(r.query_id - 10_000, []).append((r.rank, r.vec_id))
    for q, v in asked:
        near = sorted((b for a, b in want if a == q), key=lambda b: (-round(want[q, b], 12), b))[:k]
        assert sorted(found.get(q, [])) == [(n + 1, b) for n, b in enumerate(near)], q


def test_a_query_goes_only_to_cells_that_can_hold_better(spark):
    frame = spark.createDataFrame(_odd(_clusters())[:1200], SCHEMA)
    rows = cells.in_cells(search._vectors(frame, "vec_id", "embedding"), 64, 64)
    asked = rows.rows.where("id % 10 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"), "d", "cell", F.lit(0.98).alias("kth"))
    there = int((rows.parts > 0).sum())
    assert search._cells_left(asked, rows).count() < 0.2 * asked.count() * there
    every = search._cells_left(asked.withColumn("kth", F.lit(None).cast("double")), rows).count()
    assert every == asked.count() * (there - 1)  # without a kth score all others


def test_bounds_hold(spark):
    rng = np.random.default_rng(4)
    place = cells.Cells.of({6: cells._clustered(cells.unit(list(rng.standard_normal((300, 6)))), 9)})
    import pandas as pd

    vectors = pd.Series(list(rng.standard_normal((400, 6))))
    cell, off = place.place(vectors)
    radius = np.array([off[cell == c].max(initial=0) for c in range(place.count)])
    apart, x = place.between(), cells.unit(vectors)
    real = cells.angle(x @ x.T)
    assert (real >= np.maximum(apart[cell][:, cell] - radius[cell][:, None] - radius[cell], 0) - 1e-6).all()
    assert cell.min() >= 1 and off.max() < math.pi


def test_only_probed_cells_are_read(spark, tmp_path):
    frame = spark.createDataFrame(_odd(_clusters()), SCHEMA)
    search.ann_save(frame, str(tmp_path / "i"), 12)
    index = search.AnnIndex(spark, str(tmp_path / "i"))
    plan = index.read([1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters")[1].split("]")[0]
    queries = frame.where("vec_id % 50 = 0 and vec_id < 1200").withColumnRenamed("vec_id", "query_id")
    best = {(r.query_id, r.vec_id) for r in search.batch_top_k(frame, queries, 5).collect()}
    probes = index.probes_for(0.95, 5)
    assert probes <= 4  # of about 12
    found = {(r.query_id, r.vec_id) for r in index.search(queries, 5, probes).collect()}
    assert len(best & found) >= 0.9 * len(best)
    everything = index.search(queries, 5, 1000).collect()
    assert {(r.query_id, r.vec_id) for r in everything} == best


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert search.neighbour_counts(none, 0.5).collect() == []
    assert search.batch_top_k(none, none.withColumnRenamed("vec_id", "query_id"), 3).collect() == []
    assert search.ann_search(none, none.withColumnRenamed("vec_id", "query_id"), 3).collect() == []


@pytest.mark.parametrize("threshold", [0.98, 0.0])
def test_blocks_of_a_join_grow_with_the_rows(spark, odd, threshold, monkeypatch):
    """However many blocks there are, a row goes to at most some sixteen tasks, and all pairs are found."""
    monkeypatch.setattr(cells, "BLOCK", 24)
    rows = cells.in_cells(search._vectors(spark.createDataFrame(odd, SCHEMA), "vec_id", "embedding"), 24, 24)
    assert int(rows.parts.sum()) > 48
    together = -(-int(rows.parts.sum()) // 16)
    assert cells.block_pairs(rows, -1.0, together).groupBy("id").count().agg(F.max("count")).first()[0] <= 17
    pairs = {(a, b) for (a, b), s in _cosines(odd).items() if a < b and round(s, 9) >= threshold}
    found = search.similarity_join(spark.createDataFrame(odd, SCHEMA), threshold).collect()
    assert {(r.left_id, r.right_id) for r in found} == pairs and len(found) == len(pairs)


def test_a_query_for_many_cells_goes_out_in_parts(spark, monkeypatch):
    """No batch holds the rows of all queries for all cells."""
    import pandas as pd

    monkeypatch.setattr(cells, "SLICE", 50)
    place = cells.Cells.of({6: cells._clustered(cells.unit(np.random.default_rng(4).standard_normal((300, 6))), 90)})
    taken = cells.Placed(None, place, np.full(place.count, 3.0), np.arange(place.count), np.ones(place.count, int))
    asked = pd.DataFrame({"qid": range(120), "q": list(np.random.default_rng(5).standard_normal((120, 6))), "d": 6, "cell": 1, "kth": 0.5})

    class Frame:
        dtypes = [("qid", "bigint"), ("q", "array<double>")]

        def mapInPandas(self, run, schema):  # noqa: N802
            return [len(b) for b in run(iter([asked]))]

    sizes = search._cells_left(Frame(), taken)
    assert max(sizes) <= 50 and sum(sizes) == 120 * (place.count - 1)
    assert [len(b) for b in cells.sliced(iter([asked]))] == [50, 50, 20]
