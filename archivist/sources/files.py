"""Files written from their chunks, however large or many: a data source whose tasks append the payloads
of a file one by one to one output; when all have ended well, tasks move the outputs to their places.
Folders are listed and files read in tasks as well, so no list of files is on the driver."""

from __future__ import annotations

import functools
import hashlib
import io
import json
import math
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from archivist.operators.cells import kept
from archivist.operators.integrity import FILE, completeness, ordered_chunks

#: Where outputs lie until all are written.
STAGING = "_staging"
#: A file with the names of a task's outputs, a line each; also with the names of a job's tasks.
NAMES = "names"
#: Files, and bytes, that a task reads.
FILES, BYTES = 5_000, 128 << 20


def _opened(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{posixpath.abspath(path)}")


def relative(archive: str | None, name: str | None) -> str:
    """The path of a file below the output folder; one that would leave it is an error."""
    parts = [p for p in f"{archive or ''}/{name or ''}".split("/") if p not in ("", ".")]
    if not parts or ".." in parts or not name or parts[0] == STAGING:
        raise ValueError(f"no file can be named {name!r}")
    return "/".join(parts)


@dataclass
class Written(WriterCommitMessage):
    """The folder of a task's outputs; which file is which is told by its ``NAMES``."""

    task: str


class ChunkWriter(DataSourceArrowWriter):
    """Rows are archive_id, source_file, chunk_index, chunk_total and payload, each file's in order.
    Outputs are staged only; `write_files` moves them."""

    def __init__(self, options: dict) -> None:
        self.path, self.job = options["path"], f"{STAGING}/{options['job']}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _opened(self.path)
        done, out, now, at, total, n = Written(uuid.uuid4().hex), None, None, 0, 0, 0
        task = f"{root}/{self.job}/{done.task}"
        store.create_dir(task, recursive=True)

        def finished() -> None:
            if out is not None:
                out.close()
                if at != total:
                    raise ValueError(f"{now} has {at} of {total} chunks")

        try:
            with store.open_output_stream(f"{task}/{NAMES}") as names:
                for batch in iterator:
                    for archive, name, index, of, payload in zip(*(batch.column(c).to_pylist() for c in ("archive_id", "source_file", "chunk_index", "chunk_total", "payload")), strict=True):
                        if (archive, name) != now:
                            finished()
                            names.write(f"{json.dumps(relative(archive, name))}\n".encode())
                            out = store.open_output_stream(f"{task}/{n}")
                            now, at, total, n = (archive, name), 0, of, n + 1
                        if index != at:
                            raise ValueError(f"{now} lacks chunk {at}")
                        out.write(payload.encode() if isinstance(payload, str) else payload)
                        at += 1
                finished()
        finally:
            if out is not None and not out.closed:
                out.close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        """Says which tasks' outputs count; what a lost try of a task has left does not."""
        store, root = _opened(self.path)
        store.create_dir(f"{root}/{self.job}", recursive=True)
        with store.open_output_stream(f"{root}/{self.job}/{NAMES}") as out:
            out.write("".join(f"{m.task}\n" for m in messages if m).encode())

    def abort(self, messages: list[Written | None]) -> None:
        _clean(self.path, self.job)


def _clean(path: str, job: str) -> None:
    store, root = _opened(path)
    if store.get_file_info(f"{root}/{job}").type != FileType.NotFound:
        store.delete_dir(f"{root}/{job}")
    if store.get_file_info(f"{root}/{STAGING}").type == FileType.Directory and not store.get_file_info(FileSelector(f"{root}/{STAGING}")):
        store.delete_dir(f"{root}/{STAGING}")


def _move(spark: SparkSession, path: str, job: str) -> None:
    """Moves the outputs of the job's tasks to their places, in as many tasks."""
    store, root = _opened(path)
    with store.open_input_stream(f"{root}/{job}/{NAMES}") as f:
        tasks = f.read().decode().split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _opened(path)
        made = set()
        for batch in batches:
            for task in batch.column("task").to_pylist():
                with store.open_input_stream(f"{root}/{job}/{task}/{NAMES}") as f:
                    for k, line in enumerate(io.BufferedReader(f)):
                        staged, final = f"{root}/{job}/{task}/{k}", f"{root}/{json.loads(line)}"
                        if (folder := posixpath.dirname(final)) not in made:
                            store.create_dir(folder, recursive=True)
                            made.add(folder)
                        try:
                            store.move(staged, final)
                        except OSError:  # the task's first try may have moved it
                            if FileType.NotFound == store.get_file_info(final).type or store.get_file_info(staged).type != FileType.NotFound:
                                raise
            yield batch.slice(0, 0)

    if tasks:
        rows = spark.createDataFrame([(t,) for t in tasks], "task string").repartition(len(tasks))
        rows.mapInArrow(run, "task string").write.format("noop").mode("overwrite").save()


class ChunkSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive_files"

    def writer(self, schema, overwrite: bool) -> ChunkWriter:
        return ChunkWriter(self.options)


def write_files(chunks: DataFrame, path: str) -> DataFrame:
    """Writes each complete file of ``chunks`` below ``path`` (a folder that driver and tasks share), as
    archive_id/source_file, and returns the incomplete ones with chunk_total, present and first_missing.

    A task holds one chunk at a time; nothing appears under its name before all of the job's files are
    written, and then tasks move them. Text is written as UTF-8. Of several complete contents of one name that with the smallest
    hash is written and the others are returned. Names that would leave the folder are an error.
    """
    spark: SparkSession = chunks.sparkSession
    spark.dataSource.register(ChunkSink)
    found, job = kept(completeness(chunks), "found"), uuid.uuid4().hex
    good = found.where("status = 'complete' and chunk_total > 0").groupBy("archive_id", "source_file").agg(F.min("file_hash").alias("file_hash"))
    good = good.toDF(*[f"_{c}" for c in FILE])
    same = functools.reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in FILE])
    rows = ordered_chunks(chunks.join(good, same, "left_semi")).select("archive_id", "source_file", "chunk_index", "chunk_total", "payload")
    rows.write.format("archive_files").mode("append").option("job", job).save(path)
    _move(spark, path, f"{STAGING}/{job}")
    _clean(path, f"{STAGING}/{job}")
    return found.join(good, same, "left_anti").drop("status")


def files_below(spark: SparkSession, path: str) -> DataFrame:
    """name (below ``path``) and length of every file, folder by folder in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _opened(path)
        for batch in batches:
            for folder in batch.column("name").to_pylist():
                found = store.get_file_info(FileSelector(posixpath.join(root, folder)))
                for k in range(0, len(found), 10_000):
                    rows = [(posixpath.join(folder, x.base_name), None if x.type == FileType.Directory else x.size) for x in found[k : k + 10_000]]
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.string(), pa.int64()))], ["name", "length"])

    levels, folders = [], spark.createDataFrame([("",)], "name string")
    while not levels or not folders.isEmpty():
        levels.append(kept(folders.mapInArrow(run, "name string, length long"), "listed"))
        folders = levels[-1].where(F.col("length").isNull() & (F.col("name") != STAGING)).select("name")
        folders = folders.repartition(math.ceil(folders.count() / 16) or 1)
    return functools.reduce(DataFrame.unionAll, levels).where("length is not null")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """name (below ``path``), length and content_hash of every file, read a piece at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _opened(path)
        for batch in batches:
            hashes = []
            for name in batch.column("name").to_pylist():
                own = hashlib.sha256()
                with store.open_input_stream(posixpath.join(root, name)) as f:
                    while piece := f.read(1 << 20):
                        own.update(piece)
                hashes.append(own.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes, pa.string())], ["name", "length", "content_hash"])

    files = files_below(spark, path)
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    files = files.repartition(max(spark.sparkContext.defaultParallelism, math.ceil(n / FILES), math.ceil(size / BYTES)))
    return files.mapInArrow(run, "name string, length long, content_hash string")
