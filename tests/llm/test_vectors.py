import numpy as np
import pytest
from pyspark.sql import functions as F

from archivist.llm import vectors

KIND = "vec_id long, embedding array<float>, label int"


def _table(spark, n=700, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 16)) / 4
    x[n // 2 :] = x[: n - n // 2] + rng.standard_normal((n - n // 2, 16)) * 0.04  # near copies
    x[5:60] = x[5]  # one very common vector
    x[60:70] = 2 * x[5]
    rows = [(k, x[k].tolist(), int(k % 3 > 0)) for k in range(n)]
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [None] * 16, 1), (n + 4, x[5].tolist(), None), (n + 5, [1.0, 2.0], 1), (n + 6, [], 1), (n + 7, [2.0, 4.0], 1)]
    return spark.createDataFrame(rows, KIND).withColumns({"links": F.lit(1), "d": F.lit("x")}), rows


def _good(v):
    return v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v)


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PART", 40)  # so that cells are split
    frame, rows = _table(spark)
    root, links = {k: k for k, *_ in rows}, {k: 0 for k, *_ in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    unit = {k: np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) for k, v, _ in rows if _good(v)}
    label = {k: c for k, _, c in rows}
    keys = [k for k in unit if label[k] is not None]
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if label[a] == label[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93:
                links[a] += 1
                links[b] += 1
                p, q = sorted((find(a), find(b)))
                root[q] = p
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(frame).collect()}
    assert found == {k: (links[k], find(k), find(k) == k) for k in root}
    assert max(links.values()) > 30


def _guarded(join, most):
    def make(threshold):
        run = join(threshold)

        def guarded(key, rows):
            assert len(rows) <= most, f"{len(rows)} vectors in one task"
            return run(key, rows)

        return guarded

    return make


def test_visitors_of_a_cell_are_split(spark, monkeypatch):
    frame, _ = _table(spark)
    found = {}
    for axes, part in ((2, 40), (4, 40), (2, 2048)):
        with monkeypatch.context() as m:
            m.setattr(vectors, "PART", part)
            m.setattr(vectors, "_axes", lambda largest, axes=axes: axes, raising=False)
            m.setattr(vectors, "_join", _guarded(vectors._join, 2 * part + 40))
            found[axes, part] = sorted(map(tuple, vectors.near_vectors(frame).collect()))
    assert len({str(rows) for rows in found.values()}) == 1


@pytest.mark.parametrize("operator", [vectors.near_vectors, lambda df: vectors.top_k(df, F.col("vec_id") % 20 == 0)])
def test_empty(operator, spark):
    assert operator(spark.createDataFrame([], KIND)).count() == 0


def test_top_k(spark):
    frame, rows = _table(spark, 900)
    whole = {k: np.floor(64 * np.array(v, np.float32).astype(float)) for k, v, _ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)}
    found = {}
    for r in vectors.top_k(frame, F.col("vec_id") % 20 == 0, shard=200, block=20).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in whole:
        if q % 20 == 0:
            best = sorted((-int(whole[q] @ v), k) for k, v in whole.items() if k != q and len(v) == len(whole[q]))[:20]
            assert sorted(found.pop(q)) == [(n + 1, k, -s) for n, (s, k) in enumerate(best)]
    assert not found


def test_top_k_of_repeated_ids(spark):
    rng = np.random.default_rng(3)
    rows = [(k % 150, (rng.standard_normal(8) / 4).tolist(), 1) for k in range(300)]
    rows += [rows[20], (20, [0.5] * 3, 1), (40, [0.5] * 3, 1), (None, [0.5] * 8, 1)]
    whole = [(k, np.floor(64 * np.array(v, np.float32).astype(float))) for k, v, _ in rows if k is not None]
    vectors_of = {}
    for k, v, _ in rows:
        vectors_of.setdefault(k, []).append((len(v), [float(x) for x in np.array(v, np.float32)]))
    found = {}
    for r in vectors.top_k(spark.createDataFrame(rows, KIND), F.col("vec_id") % 20 == 0, k=7, shard=60, block=3).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in range(0, 150, 20):
        asks = np.floor(64 * np.array(min(vectors_of[q])[1]))
        best = sorted((-int(asks @ v), k) for k, v in whole if k != q and len(v) == len(asks))[:7]
        assert sorted(found.pop(q)) == [(n + 1, k, -s) for n, (s, k) in enumerate(best)]
    assert not found
