"""Incremental forms of chunking, reassembly, request limits, job status and indexing."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from archivist.operators.chunking import chunk
from archivist.operators.documents import admit

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    """New files below ``path`` as they come."""
    return spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", True).load(path)


def stream_chunks(files: DataFrame, chunk_size: int = 2800) -> DataFrame:
    """Chunks of files as they come, by the same expressions as in batch."""
    return chunk(files.withColumnRenamed("path", "source_file"), "content", chunk_size)


def with_progress(rows: DataFrame, name: str = "progress", size: str = "payload") -> DataFrame:
    """``rows`` with the observed metrics rows and bytes for each micro-batch."""
    return rows.observe(name, F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(size)).alias("bytes"))


class ProgressListener(StreamingQueryListener):
    """Calls ``report(name, rows so far, bytes so far, share of ``total`` bytes or None)`` for each
    micro-batch, however many there are; `wait` returns when a query has ended and all were counted."""

    def __init__(self, report: Callable[[str, int, int, float | None], None], name: str = "progress", total: int | None = None) -> None:
        self.report, self.name, self.total, self.rows, self.bytes, self.ended = report, name, total, 0, 0, threading.Event()

    def wait(self, seconds: float = 60) -> None:
        if not self.ended.wait(seconds):
            raise TimeoutError("the query's end wasn't reported")

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        seen = event.progress.observedMetrics.get(self.name)
        if seen is not None:
            self.rows += seen["rows"] or 0
            self.bytes += seen["bytes"] or 0
            self.report(self.name, self.rows, self.bytes, self.bytes / self.total if self.total else None)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.set()  # events come in order


# --- state by key, on event time ----------------------------------------------------------------

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _timed(rows: DataFrame, at: str, delay: str) -> DataFrame:
    """``rows`` with a watermark ``delay`` behind the latest time in column ``at``; rows without such a
    column count as of when they come. Rows later than the watermark are dropped, as Spark's stateful
    operators do. The session's state store is set to RocksDB, which processors with timers need and
    which writes only the entries that change."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    if at not in rows.columns:
        rows = rows.withColumn(at, F.current_timestamp())
    return rows.withWatermark(at, delay)


def _millis(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[us]").astype("int64") // 1000


#: Bytes of a file's chunks that wait outside the state for the rest of their micro-batch.
HELD = 8 << 20


class _Expiring(StatefulProcessor):
    """A processor whose keys have one timer each, ``span`` milliseconds after a time it says."""

    def __init__(self, at: str, span: int) -> None:
        self.at, self.span = at, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def expire_after(self, millis: int, new: bool = False) -> None:
        """The key's timer, if it is earlier, moves to ``span`` after ``millis``. A ``new`` key has none,
        and is not asked for it: each question is a message to the state store."""
        due = millis + self.span
        have = [] if new else list(self.handle.listTimers())
        if have and max(have) >= due:
            return
        for timer in have:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(due)

    def close(self) -> None:
        pass


class _Reassembler(_Expiring):
    """State of a file: each chunk an entry of its own, and how many there are of how many."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.parts = handle.getMapState("parts", "chunk_index int", "payload binary")
        self.known = handle.getValueState("known", "total int, have int, done boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        known = self.known.get()
        total, have, done = known or (0, 0, False)
        stored, here, latest = have, {}, 0  # chunks in the state, and of this micro-batch
        for batch in rows:
            latest = max(latest, int(_millis(batch[self.at]).max()))
            for index, n, payload in zip(batch["chunk_index"], batch["chunk_total"], batch["payload"], strict=True):
                total, index = int(n), int(index)
                if not done and index not in here and not (stored and self.parts.containsKey((index,))):
                    here[index] = bytes(payload)
                    have += 1
            if not done and have < total and sum(map(len, here.values())) > HELD:
                for index, payload in here.items():  # a large file's chunks don't wait for its last
                    self.parts.updateValue((index,), (payload,))
                stored, here = have, {}
        if not done and 0 < total == have:
            if stored:
                here |= {k[0]: bytes(v[0]) for k, v in self.parts.iterator()}
                self.parts.clear()
            parts, here, done = sorted(here.items()), {}, True
            yield pd.DataFrame({"source_file": [key[0]], "status": ["complete"], "present": pd.Series([have], dtype="int32"), "chunk_total": pd.Series([total], dtype="int32"), "content": [b"".join(p for _, p in parts)]})
        for index, payload in here.items():
            self.parts.updateValue((index,), (payload,))
        if (total, have, done) != known:
            self.known.update((total, have, done))
        self.expire_after(latest, known is None)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        total, have, done = self.known.get() or (0, 0, True)
        self.parts.clear()
        self.known.clear()
        if not done:
            yield pd.DataFrame({"source_file": [key[0]], "status": ["missing"], "present": pd.Series([have], dtype="int32"), "chunk_total": pd.Series([total], dtype="int32"), "content": [None]})


def stream_reassemble(chunks: DataFrame, minutes: int = 60, at: str = "at", delay: str = "10 minutes") -> DataFrame:
    """source_file, status, present, chunk_total and content of each file, once all of its chunks
    (source_file, chunk_index, chunk_total, payload as binary) have come; copies don't count.

    A file that gets no chunk for ``minutes`` is given up, with status ``missing`` and without content;
    chunks that come after that begin anew. Until then of a complete file only that it is so is kept.
    A chunk is written to the state once, when it comes, unless its file is complete with the same
    micro-batch; no batch writes the file again.
    """
    rows = _timed(chunks, at, delay).select("source_file", "chunk_index", "chunk_total", "payload", at)
    return rows.groupBy("source_file").transformWithStateInPandas(_Reassembler(at, minutes * 60_000), "source_file string, status string, present int, chunk_total int, content binary", "Append", "EventTime")


class _Limiter(_Expiring):
    """State of a client: the times of its admitted requests that still count, ``limit`` at most."""

    def __init__(self, at: str, span: int, limit: int) -> None:
        super().__init__(at, span)
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.times = handle.getListState("times", "time long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        admitted = before = [t[0] for t in self.times.get()]
        batch = pd.concat([b[["event_id", self.at]] for b in rows]).sort_values([self.at, "event_id"])  # of one micro-batch
        ok, admitted = admit(batch[self.at].astype("datetime64[us]").astype("int64").tolist(), admitted, self.limit, self.span * 1000)
        yield pd.DataFrame({"client": key[0], "event_id": batch["event_id"], "ts": batch[self.at], "admitted": ok})
        if admitted != before:
            self.times.put([(t,) for t in admitted])
            if admitted:
                self.expire_after(admitted[-1] // 1000 + 1)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.times.clear()  # the last admitted request no longer counts
        yield from ()


def stream_rate_limit(requests: DataFrame, limit: int = 60, seconds: int = 60, delay: str = "0 seconds") -> DataFrame:
    """client, event_id, ts and admitted of requests (client long, event_id long, ts timestamp), judged
    when they come, those of a batch in order of time; only admitted ones count.

    A request that comes after later ones were judged meets these too. One later than ``delay`` behind
    the latest of the batch before is dropped. A client whose last admitted request no longer counts
    is forgotten.
    """
    rows = _timed(requests, "ts", delay).select("client", "event_id", "ts")
    return rows.groupBy("client").transformWithStateInPandas(_Limiter("ts", seconds * 1000, limit), "client long, event_id long, ts timestamp, admitted boolean", "Append", "EventTime")


class _JobStatus(_Expiring):
    """State of a job: when it started, and its last status with its time."""

    def __init__(self, at: str, span: int, terminal: tuple[str, ...]) -> None:
        super().__init__(at, span)
        self.terminal = terminal

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.entry = handle.getValueState("entry", "started long, updated long, status string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        before = entry = self.entry.get()
        news = {}
        rows = pd.concat([b[[self.at, "status"]] for b in rows]).sort_values([self.at, "status"])
        for at, status in zip(rows[self.at].astype("datetime64[us]").astype("int64"), rows["status"], strict=True):
            if entry is None or at >= entry[0] + self.span * 1000:
                entry = (int(at), int(at), status)
            elif (at, status) >= (entry[1], entry[2]):
                entry = (entry[0], int(at), status)
            news[entry[0]] = entry
        self.entry.update(entry)
        if before is None or entry[0] != before[0]:
            self.expire_after(entry[0] // 1000 + 1, before is None)
        found = list(news.values())
        stamp = lambda k: pd.to_datetime([e[k] for e in found], unit="us")
        yield pd.DataFrame({"job_id": key[0], "started": stamp(0), "status": [e[2] for e in found], "updated": stamp(1), "closed": [e[2] in self.terminal for e in found]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        entry = self.entry.get()
        if entry is not None and entry[0] // 1000 + 1 + self.span <= expiredTimerInfo.getExpiryTimeInMs():
            self.entry.clear()
        yield from ()


def stream_job_status(events: DataFrame, minutes: int = 10, terminal: tuple[str, ...] = ("completed", "failed"), delay: str = "0 seconds") -> DataFrame:
    """job_id, started, status, updated and closed, again for each micro-batch that brings news of a job
    (job_id long, status string, ts timestamp). A job is forgotten ``minutes`` after its start: an
    event from then on starts it anew. Events later than ``delay`` behind the latest are dropped."""
    rows = _timed(events, "ts", delay).select("job_id", "status", "ts")
    return rows.groupBy("job_id").transformWithStateInPandas(_JobStatus("ts", minutes * 60_000, terminal), "job_id long, started timestamp, status string, updated timestamp, closed boolean", "Update", "EventTime")


def stream_index(files: DataFrame, ingest: Callable[[DataFrame], tuple[DataFrame, DataFrame]], good: str, bad: str, checkpoint: str):
    """Each micro-batch of files ingested and appended to ``good``; failures to ``bad``. A batch that
    is repeated after a failure replaces its own folder, so nothing comes twice."""

    def each(batch: DataFrame, number: int) -> None:
        docs, errors = ingest(batch)
        docs.write.mode("overwrite").parquet(f"{good}/batch={number}")
        errors.write.mode("overwrite").parquet(f"{bad}/batch={number}")

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
