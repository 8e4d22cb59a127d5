import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from archivist.operators import chunking, ordered, versions
from archivist.operators.documents import admit, rate_limit


def _largest_range(spark, monkeypatch, run):
    """The result, and the largest range's share of the rows; small ranges aren't joined as they are else."""
    seen = []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    original = ordered.in_ranges

    def watched(rows, *order):
        out = original(rows, *order)
        sizes = [r["count"] for r in out.groupBy("pid").count().collect()]
        seen.append(max(sizes, default=0) / max(sum(sizes), 1))
        return out

    monkeypatch.setattr(ordered, "in_ranges", watched)
    try:
        return run(), max(seen)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_as_of_against_plain_python(spark, monkeypatch):
    rng = random.Random(1)
    log = [(rng.choice([1, 1, 1, 2, 3]), rng.randrange(200), f"f{k}") for k in range(400)] + [(4, None, "x"), (None, 3, "y"), (5, 10, None)]
    asked = [(rng.choice([1, 2, 3, 6]), rng.randrange(-5, 220)) for _ in range(300)] + [(4, 9), (None, 3), (5, 11), (1, None), (1, 50), (1, 50)]
    found, _ = _largest_range(spark, monkeypatch, lambda: versions.as_of(spark.createDataFrame(log, "memory_id int, version int, file string").repartition(5), spark.createDataFrame(asked, "memory_id int, as_of int").repartition(3)))
    want = set()
    for memory, at in set(asked):
        before = [(v, f or "") for m, v, f in log if m == memory and m is not None and v is not None and at is not None and v <= at]
        version, file = max(before, default=(None, None))
        want.add((memory, at, version, file or None))
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_as_of_of_one_memory_with_many_versions(spark, monkeypatch):
    """100,000 versions and requests of one memory: spread over tasks, and nothing joins them all."""
    log = spark.range(100_000).select(F.lit(1).alias("memory_id"), (F.col("id") * 2).alias("version"), F.col("id").cast("string").alias("file"))
    asked = spark.range(100_000).select(F.lit(1).alias("memory_id"), (F.col("id") * 2 + 1).alias("as_of"))
    found, share = _largest_range(spark, monkeypatch, lambda: versions.as_of(log, asked))
    assert found.where("version = as_of - 1 and file = cast(version / 2 as bigint)").count() == 100_000
    assert share < 0.5  # of four
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_frame_numbers_of_one_archive_with_many_files(spark, monkeypatch):
    files = spark.range(30_000).select(F.lit("a").alias("archive_id"), F.format_string("%06d", "id").alias("source_file"), (F.col("id") % 3 + 1).cast("int").alias("chunk_total"))
    chunks = files.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.col("chunk_total") - 1))).repartition(7)
    found, share = _largest_range(spark, monkeypatch, lambda: chunking.frame_numbers(chunks).select("source_file", "chunk_index", "frame_number").collect())
    assert share < 0.5
    assert [r.frame_number for r in sorted(found)] == list(range(60_000))


def test_frame_numbers_of_empty_files_and_several_archives(spark):
    rows = [("a", "x", 2, 0), ("a", "x", 2, 1), ("a", "y", 0, None), ("a", "z", 1, 0), ("b", "x", 1, 0), (None, "q", 2, 0), (None, "q", 2, 1)]
    chunks = spark.createDataFrame(rows, "archive_id string, source_file string, chunk_total int, chunk_index int")
    found = {(r.archive_id, r.source_file, r.chunk_index): r.frame_number for r in chunking.frame_numbers(chunks).collect()}
    assert {k: v for k, v in found.items() if k[0]} == {("a", "x", 0): 0, ("a", "x", 1): 1, ("a", "y", None): None, ("a", "z", 0): 2, ("b", "x", 0): 0}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_limits_in_segments_are_those_in_one_go(spark, monkeypatch, seed):
    """Bursts and gaps around the window's length, ties, and clients over several ranges."""
    rng, rows, start = random.Random(seed), [], datetime(2024, 1, 1)
    for client in [1] * 6 + [2, 3, None]:
        at = 0.0
        for _ in range(rng.randrange(50, 200)):
            at += rng.choice([0, 0.5, 3, 9, 10, 11, 30])
            rows.append((client, len(rows), start + timedelta(seconds=at)))
    frame = spark.createDataFrame(rows, "client long, event_id long, ts timestamp").repartition(5)
    want, by_client = {}, defaultdict(list)
    for client, event, ts in rows:
        by_client[client].append((ts, event))
    for own in by_client.values():
        own.sort()
        ok, _ = admit([int((t - start).total_seconds() * 1e6) for t, _ in own], [], 4, 10_000_000)
        want |= {e: o for (_, e), o in zip(own, ok, strict=True)}
    found, _ = _largest_range(spark, monkeypatch, lambda: rate_limit(frame, 4, 10).collect())
    assert {r.event_id: r.admitted for r in found} == want and len(found) == len(rows)


def test_a_client_with_gaps_is_spread_over_tasks(spark, monkeypatch):
    """One client makes all requests, in bursts of 20 an hour apart."""
    rows = spark.range(40_000).select(F.lit(1).cast("long").alias("client"), F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") % 20 + F.floor(F.col("id") / 20) * 3600).alias("ts"))
    marked, share = _largest_range(spark, monkeypatch, lambda: ordered.in_segments(rows.withColumn("_at", F.unix_micros("ts")), "client", "_at", "event_id", 60_000_000))
    assert share < 0.5
    sizes = marked.groupBy("segment").count().agg(F.count(F.lit(1)), F.max("count"), F.min("count")).first()
    assert tuple(sizes) == (2000, 20, 20)
    assert rate_limit(rows, 15, 60).where("admitted").count() == 2000 * 15


def test_a_segment_over_many_ranges_is_one(spark, monkeypatch):
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, 1).otherwise(2).alias("client"), F.col("id").alias("event_id"), F.col("id").alias("_at"))
    found, share = _largest_range(spark, monkeypatch, lambda: ordered.in_segments(rows, "client", "_at", "event_id", 10).select("client", "segment").distinct().count())
    assert found == 2 and share < 0.5


# --- histories and digests ----------------------------------------------------------------------


def _long_history(spark, upto=57):
    rng = random.Random(5)
    base = [(m, f, f"h{m}.{f}", f"p{m}.{f}") for m in range(3) for f in range(6)]
    ops = [(m, f, v, rng.choice(["replace", "replace", "delete", "insert"]), f"h{m}.{f}.{v}", f"p{m}.{f}.{v}") for v in range(1, upto + 1) for m in range(3) for f in range(8) if rng.random() < 0.2]
    return spark.createDataFrame(base, "memory_id int, frame int, hash string, payload string"), spark.createDataFrame(ops, "memory_id int, frame int, version int, type string, new_hash string, payload string")


def _state(rows):
    return sorted((r.memory_id, r.frame, r.hash, r.payload) for r in rows.collect())


def test_history_is_that_of_all_operations(spark, tmp_path):
    base, ops = _long_history(spark)
    path = str(tmp_path / "h")
    versions.history_save(base, ops.where("version <= 23"), path, 10)
    for low, high in ((23, 29), (29, 31), (31, 57)):  # ends before, at and after a snapshot
        versions.history_append(spark, path, ops.where(f"version > {low} and version <= {high}"))
    for version in (0, 1, 9, 10, 11, 20, 23, 29, 30, 31, 45, 50, 57, 99):
        assert _state(versions.history_at(spark, path, version)) == _state(versions.reconstruct(base, ops, version)), version


def test_only_a_snapshot_and_the_operations_since_are_read(spark, tmp_path):
    base, ops = _long_history(spark)
    versions.history_save(base, ops, str(tmp_path / "h"), 10)
    plan = versions.history_at(spark, str(tmp_path / "h"), 34)._jdf.queryExecution().executedPlan().toString()
    filters = [x.split("]")[0] for x in plan.split("PartitionFilters: [")[1:]]
    assert len(filters) == 2 and all("span" in x and "= 3" in x for x in filters)


def test_history_without_frames(spark, tmp_path):
    base, ops = _long_history(spark)
    versions.history_save(base.limit(0), ops.limit(0), str(tmp_path / "h"), 10)
    assert _state(versions.history_at(spark, str(tmp_path / "h"), 5)) == []
    versions.history_append(spark, str(tmp_path / "h"), ops)
    assert _state(versions.history_at(spark, str(tmp_path / "h"), 44)) == _state(versions.reconstruct(base.limit(0), ops, 44))


def test_only_changed_buckets_are_read(spark, tmp_path):
    base, _ = _long_history(spark)
    base = base.unionByName(spark.range(3000).selectExpr("9 AS memory_id", "cast(id AS int) AS frame", "concat('h', id) AS hash", "concat('p', id) AS payload"))
    new = base.where("not (memory_id = 9 and frame = 5)").withColumn("hash", F.when(F.expr("memory_id = 9 and frame = 77"), "other").otherwise(F.col("hash")))
    new = new.unionByName(spark.createDataFrame([(10, 0, "h", "p"), (10, 1, None, None)], base.schema))
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    versions.snapshot_save(base, a)
    versions.snapshot_save(new.repartition(7), b)
    found = versions.stored_diff(spark, a, b)
    plain = lambda rows: sorted(map(str, rows.collect()))
    assert plain(found) == plain(versions.snapshot_diff(base, new)) and found.count() == 3
    assert len(versions.changed_buckets(spark, a, b)) <= 4
    filters = [x.split("]")[0] for x in found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1:]]
    assert filters and all("bucket" in x and x.count(",") <= 4 for x in filters)
    assert versions.stored_diff(spark, a, a).count() == 0
    versions.snapshot_save(base, a, 16)
    with pytest.raises(ValueError):
        versions.stored_diff(spark, a, b)
