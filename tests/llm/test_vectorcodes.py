import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from archivist.llm import vectorcodes

SCHEMA = "vec_id long, embedding array<double>, label string"


def _brute(rows, rounds=4):
    """{(vec_id, label): [(code, error)]} and the codebooks, by plain Python."""
    kept = sorted(([math.floor(1024 * x) for x in v], k, g) for k, v, g in rows)
    kept.sort(key=lambda r: r[1])
    d = len(kept[0][0])
    cuts = [d * p // 4 for p in range(5)]
    part = lambda v, p: v[cuts[p] : cuts[p + 1]]
    books = [[part(v, p) for v, _, _ in kept[:256]] for p in range(4)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(part(v, p), e, strict=True)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(4):
            mine = {}
            for v, _, _ in kept:
                mine.setdefault(near(v, p)[1], []).append(part(v, p))
            new.append([[sum(x) // len(mine[k]) for x in zip(*mine[k], strict=True)] if k in mine else e for k, e in enumerate(books[p])])
        books = new
    found = [(k, g, bytes(near(v, p)[1] for p in range(4)).hex(), sum(near(v, p)[0] for p in range(4))) for v, k, g in kept]
    return found, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize(("n", "spread"), [(40, 1.0), (300, 0.02), (300, 9000.0)])
def test_against_plain_python(spark, n, spread):
    """Few vectors, many ties, and components so far apart that dictionaries are sorted."""
    rng = np.random.default_rng(n)
    rows = [(int(k) - 5, [float(x) for x in np.round(rng.standard_normal(10).clip(-1.5, 1.5) * spread, 3)], None if k % 3 == 0 else f"g{k % 4}") for k in rng.permutation(n)]
    found = vectorcodes.vector_codes(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want, digest = _brute(rows)
    assert sorted((r.vec_id, r.code, r.error) for r in found) == sorted((k, c, e) for k, _, c, e in want)
    sums = {}
    for _, g, _, e in want:
        sums[g] = sums.get(g, 0) + e
    labels = {k: g for k, _, g in rows}
    assert all(r.label_error == sums[labels[r.vec_id]] and r.codebooks_sha256 == digest for r in found)


def test_odd_rows(spark):
    """Null vectors and components go; other lengths and out-of-range components stay without a code;
    repeated ids and ids that are null stay; names may clash."""
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.5, -0.5, 0.25, 1.0], "a"), (1, [0.5, -0.5, 0.25, 1.0], "a"), (None, [0.0, 0.0, 0.0, 0.0], None), (2, None, "a"), (3, [1.0, None, 0.0, 0.0], "a"), (4, [inf, 0.0, 0.0, 0.0], "a"), (5, [nan] * 4, "a")]
    rows += [(6, [1.0, 2.0], "b"), (7, [1e9, 0.0, 0.0, 0.0], "b"), (8, [], None), (9, [1e308, 1.0, 1.0, 1.0], "b")]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("code", "values", "of", "part")})
    found = sorted(((r.vec_id, r.code, r.error, r.label_error) for r in vectorcodes.vector_codes(frame).collect()), key=str)
    assert found == [(1, "00000000", 0, 0), (1, "00000000", 0, 0), (6, None, None, None), (7, None, None, None), (8, None, None, 0), (9, None, None, None), (None, "02020202", 0, 0)]
    assert vectorcodes.vector_codes(frame.limit(0)).collect() == []
    assert [r.code for r in vectorcodes.vector_codes(frame.where("vec_id = 8")).collect()] == ["00000000"]


def test_decoded_vectors_have_the_error(spark, data):
    rows = vectorcodes.whole(spark.read.parquet(f"{data}/embeddings.parquet"))
    codebooks = vectorcodes.train(rows, 1)
    coded = vectorcodes.decode(vectorcodes.encode(rows, codebooks), codebooks).join(rows.select("vec_id", "values"), "vec_id")
    for r in coded.limit(50).collect():
        assert int(((np.frombuffer(bytes(r["values"]), "<i4") - np.array(r.decoded) * 1024) ** 2).sum()) == r.error
