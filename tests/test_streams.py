from datetime import datetime, timedelta

from pyspark.sql import functions as F

from archivist.operators.chunking import chunk
from archivist.operators.documents import latest_status, rate_limit
from archivist.streaming import streams


def _stream(spark, frame, path, files=3):
    frame.repartition(files).write.parquet(path)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.sql(f"SELECT * FROM {name}")


def test_reassembly_of_shuffled_copies(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").select(F.col("doc_id").cast("string").alias("source_file"), F.col("text").cast("binary").alias("content")).limit(40)
    chunks = chunk(docs, "content", 700).select("source_file", "chunk_index", "chunk_total", "payload")
    found = _run(streams.stream_reassemble(_stream(spark, chunks.unionByName(chunks), str(tmp_path / "c"))), "files")
    assert {(r.source_file, bytes(r.content)) for r in found.collect()} == {(r.source_file, bytes(r.content)) for r in docs.collect()}
    assert found.count() == 40


class Turns:
    """A stateful stream that is stopped and goes on from its state with each turn's rows."""

    def __init__(self, spark, path, schema, made, mode="append"):
        self.spark, self.path, self.schema, self.made, self.mode, self.rows = spark, path, schema, made, mode, []

    def turn(self, rows):
        """The rows put out by this turn, and what the operator reports at its end."""
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.path}/in")
        before = len(self.rows)
        stream = self.made(self.spark.readStream.schema(self.schema).parquet(f"{self.path}/in"))
        query = stream.writeStream.foreachBatch(lambda batch, _: self.rows.extend(batch.collect())).outputMode(self.mode).option("checkpointLocation", f"{self.path}/log").trigger(availableNow=True).start()
        assert query.awaitTermination(120), "the query doesn't end"
        return self.rows[before:], query.lastProgress.stateOperators[0]


def _at(minutes):
    return datetime(2024, 1, 1) + timedelta(minutes=minutes)


def test_files_that_stay_incomplete_are_given_up(spark, tmp_path):
    turns = Turns(spark, str(tmp_path), "source_file string, chunk_index int, chunk_total int, payload binary, at timestamp", lambda c: streams.stream_reassemble(c, minutes=60, delay="5 minutes"))
    found, _ = turns.turn([("a", 1, 2, b"y", _at(0)), ("b", 0, 2, b"p", _at(1)), ("c", 0, 1, b"q", _at(2)), ("c", 0, 1, b"q", _at(2))])
    assert [(r.source_file, r.status, bytes(r.content)) for r in found] == [("c", "complete", b"q")]
    found, state = turns.turn([("a", 0, 2, b"x", _at(50)), ("a", 1, 2, b"other", _at(50))])  # the first copy counts
    assert [(r.source_file, r.status, bytes(r.content)) for r in found] == [("a", "complete", b"xy")]
    found, _ = turns.turn([("d", 0, 2, b"z", _at(100))])  # b's last chunk is 99 minutes old
    assert [(r.source_file, r.status, r.present, r.chunk_total, r.content) for r in found] == [("b", "missing", 1, 2, None)]
    found, _ = turns.turn([("b", 1, 2, b"s", _at(99)), ("e", 0, 1, b"", _at(101)), ("a", 0, 2, b"x", _at(10))])  # b anew; a too late
    assert [(r.source_file, r.status) for r in found] == [("e", "complete")]
    found, last = turns.turn([("f", 0, 1, b"f", _at(500))])
    assert sorted((r.source_file, r.status) for r in found) == [("b", "missing"), ("d", "missing"), ("f", "complete")]
    assert last.numRowsTotal < state.numRowsTotal + 3  # only f is still known


def test_idle_clients_are_forgotten(spark, tmp_path):
    turns = Turns(spark, str(tmp_path), "client long, event_id long, ts timestamp", lambda r: streams.stream_rate_limit(r, 2, 60))
    found, state = turns.turn([(k, 10 * k + n, _at(k / 100)) for k in range(100) for n in range(3)])
    assert {r.event_id for r in found if r.admitted} == {10 * k + n for k in range(100) for n in range(2)}
    many = state.numRowsTotal
    found, _ = turns.turn([(99, 2000, _at(1.5)), (99, 2001, _at(2.1))])  # 0.99 + 1 minute is when both no longer count
    assert [(r.event_id, r.admitted) for r in sorted(found)] == [(2000, False), (2001, True)]
    found, state = turns.turn([(7, 3000, _at(500)), (8, 3001, _at(0))])  # the second is late
    assert [(r.event_id, r.admitted) for r in found] == [(3000, True)]
    assert state.numRowsTotal <= many / 20


def test_jobs_start_anew_after_their_time(spark, tmp_path):
    turns = Turns(spark, str(tmp_path), "job_id long, status string, ts timestamp", lambda e: streams.stream_job_status(e, 10, delay="1 minute"), "update")
    plain = lambda rows: sorted((r.job_id, r.started, r.status, r.updated, r.closed) for r in rows)
    found, _ = turns.turn([(1, "starting", _at(0)), (1, "working", _at(3)), (2, "starting", _at(4))])
    assert plain(found) == [(1, _at(0), "working", _at(3), False), (2, _at(4), "starting", _at(4), False)]
    found, _ = turns.turn([(1, "completed", _at(9)), (1, "starting", _at(10)), (2, "older", _at(3.5))])
    assert plain(found) == [(1, _at(0), "completed", _at(9), True), (1, _at(10), "starting", _at(10), False), (2, _at(4), "starting", _at(4), False)]
    found, state = turns.turn([(3, "starting", _at(90))])
    assert plain(found) == [(3, _at(90), "starting", _at(90), False)] and state.numRowsTotal <= 6


def test_rate_limit_is_that_of_batch(spark, data, tmp_path):
    rows = spark.read.parquet(f"{data}/events.parquet").select(F.col("user_id").alias("client"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    want = rate_limit(rows, 3, 86_400)
    path = str(tmp_path / "r")
    for k, part in enumerate(("ts < '2024-01-15'", "ts >= '2024-01-15'")):
        rows.where(part).coalesce(1).write.parquet(f"{path}/{k}")
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(path)
    found = _run(streams.stream_rate_limit(stream, 3, 86_400), "limited")
    assert {(r.event_id, r.admitted) for r in found.collect()} == {(r.event_id, r.admitted) for r in want.collect()}


def test_job_status(spark, data, tmp_path):
    rows = spark.read.parquet(f"{data}/events.parquet").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("ts"))
    found = _run(streams.stream_job_status(_stream(spark, rows, str(tmp_path / "j")), delay="60 days"), "jobs", "update")
    last = found.groupBy("job_id").agg(F.max_by("status", "updated").alias("status"))
    assert {tuple(r) for r in last.collect()} == {(r.job_id, r.status) for r in latest_status(rows).collect()}


def test_files_are_chunked_and_indexed_as_they_come(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / f"in/{k}.txt").write_text(f"{k}" * 500)
    chunks = streams.with_progress(streams.stream_chunks(streams.stream_files(spark, str(tmp_path / "in")), 400))
    assert _run(chunks, "chunks").count() == 9
    seen = []
    listener = streams.ProgressListener(lambda *a: seen.append(a), total=10)

    class Event:
        class progress:  # noqa: N801
            observedMetrics = {"progress": {"rows": 2, "bytes": 5}}  # noqa: N815

    listener.onQueryProgress(Event)
    assert seen == [("progress", 2, 5, 0.5)]
    ingest = lambda batch: (batch.where("length > 1"), batch.where("length <= 1"))
    writer = streams.stream_index(streams.stream_files(spark, str(tmp_path / "in")), ingest, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp"))
    writer.trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "good")).count() == 3


def test_a_file_that_comes_whole_needs_no_chunk_in_the_state():
    """Chunks of one micro-batch are put together there; those of an unfinished file are stored once each."""
    import pandas as pd

    asked = []

    class State:
        def __init__(self, name):
            self.name, self.kept = name, {}

        def __getattr__(self, method):
            def call(*a):
                asked.append(f"{self.name}.{method}")
                if method == "get":
                    return self.kept.get(0)
                if method == "update":
                    self.kept[0] = a[0]
                elif method == "updateValue":
                    self.kept[a[0]] = a[1]
                elif method == "containsKey":
                    return a[0] in self.kept
                elif method == "iterator":
                    return list(self.kept.items())
                elif method == "clear":
                    self.kept.clear()

            return call

    class Handle:
        getMapState = getValueState = lambda self, name, *_: State(name)  # noqa: E731, N815
        listTimers = lambda self: asked.append("listTimers") or []  # noqa: E731, N815
        registerTimer = lambda self, due: asked.append("registerTimer")  # noqa: E731, N815

    def come(r, *chunks):
        asked.clear()
        frame = pd.DataFrame([(i, 3, p, pd.Timestamp(2024, 1, 1)) for i, p in chunks], columns=["chunk_index", "chunk_total", "payload", "at"])
        return [bytes(f["content"][0]) for f in r.handleInputRows(("f",), iter([frame]), None)]

    r = streams._Reassembler("at", 1000)
    r.init(Handle())
    assert come(r, (2, b"c"), (0, b"a"), (0, b"x"), (1, b"b")) == [b"abc"]
    assert asked == ["known.get", "known.update", "registerTimer"]
    r.init(Handle())
    assert come(r, (2, b"c"), (0, b"a")) == [] and asked.count("parts.updateValue") == 2
    assert come(r, (0, b"x"), (1, b"b")) == [b"abc"] and not r.parts.kept
    assert come(r, (1, b"late")) == [] and not r.parts.kept
