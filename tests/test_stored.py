import hashlib
import pickle
import random
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from archivist.operators import documents
from archivist.operators.chunking import chunk
from archivist.sources import files

CHUNKS = "archive_id string, source_file string, file_hash string, chunk_index int, chunk_total int, payload binary"


def test_a_large_file_is_written_chunk_by_chunk(spark, tmp_path, monkeypatch):
    """Files of many chunks, shuffled and with copies; a batch holds two chunks."""
    rng = random.Random(2)
    contents = {("a", "big.bin"): rng.randbytes(200_003), ("a", "dir/small.txt"): b"x", ("b", "big.bin"): rng.randbytes(5000), (None, "plain"): b"abc" * 500}
    frame = spark.createDataFrame([(a, n, bytearray(c)) for (a, n), c in contents.items()], "archive_id string, source_file string, content binary")
    chunks = chunk(frame, "content", 700)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        bad = files.write_files(chunks.unionByName(chunks.where("chunk_index % 3 = 0")).orderBy(F.rand(1)), str(tmp_path / "out"))
        assert bad.count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert found == {(f"{a}/{n}" if a else n): c for (a, n), c in contents.items()}
    assert not (tmp_path / "out" / files.STAGING).exists()


def test_incomplete_files_and_second_contents_are_returned(spark, tmp_path):
    rows = [("a", "x", "h", 0, 2, b"1"), ("a", "y", "h1", 0, 1, b"first"), ("a", "y", "h2", 0, 1, b"second"), ("a", "z", "h", 1, 3, b"3"), ("a", "x", "h", 1, 2, b"2")]
    bad = files.write_files(spark.createDataFrame(rows, CHUNKS), str(tmp_path / "o"))
    assert sorted((r.source_file, r.file_hash, r.present, r.first_missing) for r in bad.collect()) == [("y", "h2", 1, None), ("z", "h", 1, 0)]
    assert {p.name: p.read_bytes() for p in (tmp_path / "o" / "a").iterdir()} == {"x": b"12", "y": b"first"}


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    rows = [("a", "fine", "h", 0, 1, b"1"), ("a", "../../evil", "h", 0, 1, b"2")]
    with pytest.raises(Exception, match="no file can be named"):
        files.write_files(spark.createDataFrame(rows, CHUNKS).coalesce(1), str(tmp_path / "o"))
    assert [p for p in tmp_path.rglob("*") if p.is_file() and p.name in ("fine", "evil")] == []
    for name in ("..", "", None, "a/../../b", files.STAGING):
        with pytest.raises(ValueError):
            files.relative(None, name)
    assert files.relative("a", "./b//c") == "a/b/c"


def test_many_small_files_are_read_by_few_tasks(spark, tmp_path):
    contents = {("a", f"{n % 7}/f{n}"): b"%d" % n for n in range(300)} | {("_b", ".hidden"): b"h" * 3_000_000, ("_b", "empty dir/x"): b"x"}
    rows = [(a, n, "h", k, max(1, -(-len(c) // 1_000_000)), bytearray(c[k * 1_000_000 : (k + 1) * 1_000_000])) for (a, n), c in contents.items() for k in range(max(1, -(-len(c) // 1_000_000)))]
    files.write_files(spark.createDataFrame(rows, CHUNKS), str(tmp_path / "o"))
    found = files.digests(spark, str(tmp_path / "o"))
    assert found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert {(r.name, r.length, r.content_hash) for r in found.collect()} == {(f"{a}/{n}", len(c), hashlib.sha256(c).hexdigest()) for (a, n), c in contents.items()}
    assert files.digests(spark, str(tmp_path / "o" / "a")).count() == 300


def test_the_driver_hears_of_tasks_and_not_of_files(tmp_path):
    schema = pa.schema([("archive_id", pa.string()), ("source_file", pa.string()), ("chunk_index", pa.int32()), ("chunk_total", pa.int32()), ("payload", pa.binary())])
    rows = [{"archive_id": "a", "source_file": f"f{k}", "chunk_index": 0, "chunk_total": 1, "payload": b"x"} for k in range(500)]
    writer = files.ChunkWriter({"path": str(tmp_path), "job": "j"})
    assert len(pickle.dumps(writer.write(iter([pa.RecordBatch.from_pylist(rows, schema)])))) < 1000


def test_a_move_that_is_tried_again_ends_well(spark, tmp_path):
    task = tmp_path / files.STAGING / "j" / "t"
    task.mkdir(parents=True)
    (task / "1").write_text("second")
    (task / files.NAMES).write_text('"a/first"\n"a/second"\n')
    (task.parent / files.NAMES).write_text("t\n")
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "first").write_text("first")  # as the first try has left it
    files._move(spark, str(tmp_path), f"{files.STAGING}/j")
    assert {p.name: p.read_text() for p in (tmp_path / "a").iterdir()} == {"first": "first", "second": "second"}


def test_upserts_touch_only_their_buckets(spark, tmp_path):
    path = str(tmp_path / "docs")
    schema = "id string, updated_at int, text string"
    stored = spark.createDataFrame([(f"d{k}", 1, f"old {k}") for k in range(500)], schema)
    documents.documents_save(stored, path, 16)
    names = lambda: {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    before = names()
    rows = spark.createDataFrame([("d3", 2, "new"), ("d3", 3, "newer"), ("d4", 0, "too old"), ("fresh", 1, "here"), (None, 5, "nothing"), ("", 5, "nothing")], schema)
    bad = documents.stored_upsert(rows, path)
    assert bad.count() == 2
    touched = {r[0] for r in rows.where("id is not null").select(documents._bucket("id", 16)).distinct().collect()}
    same = {p for p, t in names().items() if before.get(p) == t}
    assert {int(p.parent.name.split("=")[1]) for p in before if p not in same} == touched
    found = {r.id: r.text for r in documents.documents_load(spark, path).collect()}
    assert len(found) == 501 and found["d3"] == "newer" and found["d4"] == "old 4" and found["fresh"] == "here"
    want, _ = documents.upsert(stored, rows)
    assert found == {r.id: r.text for r in want.collect()}


def test_upsert_into_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "id string, updated_at int, text string")
    documents.documents_save(none, str(tmp_path / "d"), 4)
    documents.stored_upsert(none, str(tmp_path / "d"))
    documents.stored_upsert(spark.createDataFrame([("a", 1, "x")], none.schema), str(tmp_path / "d"))
    assert [tuple(r) for r in documents.documents_load(spark, str(tmp_path / "d")).collect()] == [("a", 1, "x")]


def test_micro_batches_of_many_rows_lie_in_many_files(spark):
    """Three micro-batches, as before, of as many files as a share of the rows' partitions."""
    from archivist.plans.stored import _stream

    stream = _stream(spark.range(0, 1200, 1, 12).toDF("doc_id"), "streamed")
    sizes = []
    stream.writeStream.foreachBatch(lambda batch, _: sizes.append((batch.count(), batch.select(F.input_file_name()).distinct().count()))).trigger(availableNow=True).start().awaitTermination()
    assert len(sizes) == 3 and sum(n for n, _ in sizes) == 1200 and all(files == 4 for _, files in sizes)


def test_an_index_embeds_once(spark):
    from archivist.operators import search

    rows = spark.createDataFrame([("m", "f", 0, k, f"text {k}") for k in range(10)], "memory_id string, source_file string, chunk_index int, frame_number long, payload string")
    seen = spark.sparkContext.accumulator(0)

    def embedding(df):
        return df.withColumn("embedding", F.udf(lambda t: [seen.add(1) or float(len(t))], "array<float>")("payload"))

    frames, meta = search.build_index(rows, embedding)
    assert frames.count() == 10 and [(r.total_frames, r.vector_dim) for r in meta.collect()] == [(10, 1)]
    assert sorted(r.embedding for r in frames.collect()) == [[6.0]] * 10 and seen.value == 10
