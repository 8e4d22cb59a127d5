"""Putting files together from chunks, and checking them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

FILE = ("archive_id", "source_file", "file_hash")


def dedup_chunks(chunks: DataFrame, file: Sequence[str] = FILE) -> DataFrame:
    """One row for each file and index; of different payloads the first by order stays."""
    return chunks.groupBy(*file, "chunk_index").agg(F.min_by(F.struct("payload", "chunk_total"), F.struct("payload", "chunk_total")).alias("_c")).select(*file, "chunk_index", "_c.payload", "_c.chunk_total")


def completeness(chunks: DataFrame, file: Sequence[str] = FILE) -> DataFrame:
    """For each file chunk_total, the number of different indices, the first missing one and a status."""
    rows = chunks.groupBy(*file).agg(F.max("chunk_total").alias("chunk_total"), F.array_sort(F.collect_set("chunk_index")).alias("_have"))
    want = F.when(F.col("chunk_total") > 0, F.sequence(F.lit(0), F.col("chunk_total") - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("first_missing", F.array_min(F.array_except(want, F.col("_have"))))
    status = F.when(F.col("first_missing").isNull(), "complete").otherwise("missing")
    return rows.select(*file, "chunk_total", F.size("_have").alias("present"), "first_missing", status.alias("status"))


def missing_indices(chunks: DataFrame, file: Sequence[str] = FILE) -> DataFrame:
    """(file, chunk_index) of all chunks that should be there and aren't."""
    want = chunks.groupBy(*file).agg(F.max("chunk_total").alias("n")).where("n > 0")
    want = want.select(*file, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("chunk_index"))
    return want.join(chunks.select(*file, "chunk_index").distinct(), [*file, "chunk_index"], "left_anti")


def reassemble(chunks: DataFrame, file: Sequence[str] = FILE) -> DataFrame:
    """Each file's content from its chunks (each index once), as text or as bytes: one row a file, so
    for files that a row can hold; `ordered_chunks` is for others."""
    parts = chunks.groupBy(*file).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "payload"))).alias("_p"))
    payloads = F.transform("_p", lambda x: x["payload"])
    if dict(chunks.dtypes)["payload"] == "binary":
        content = F.unhex(F.array_join(F.transform(payloads, lambda x: F.hex(x)), ""))  # joined in one go
    else:
        content = F.array_join(payloads, "")
    return parts.select(*file, content.alias("content"))


def ordered_chunks(chunks: DataFrame, file: Sequence[str] = FILE) -> DataFrame:
    """Chunks without copies, each file's in order within one partition, so that a writer can append
    them one by one however large the file is. Payloads are shuffled and sorted once."""
    rows = chunks.select(*file, "chunk_index", "payload", "chunk_total").repartition(*file)
    copy = F.row_number().over(W.partitionBy(*file, "chunk_index").orderBy("payload", "chunk_total"))
    return rows.withColumn("_copy", copy).where("_copy = 1").drop("_copy").sortWithinPartitions(*file, "chunk_index")


def verify(chunks: DataFrame, archive: str = "archive_id", failures: int = 5) -> DataFrame:
    """For each archive frames that match their stored ``chunk_hash`` and those that don't, the
    first failures by frame number, the success rate and a status."""
    ok = F.coalesce(F.sha2("payload", 256) == F.col("chunk_hash"), F.lit(False))
    rows = chunks.select(archive, "frame_number", ok.alias("ok"))
    # each task keeps the first failures of an archive only; no archive's list is gathered whole
    worst = rows.where("not ok").withColumn("_r", F.row_number().over(W.partitionBy(archive).orderBy("frame_number"))).where(F.col("_r") <= failures)
    worst = worst.groupBy(archive).agg(F.array_sort(F.collect_list("frame_number")).alias("first_failures"))
    sums = rows.groupBy(archive).agg(F.count_if("ok").alias("ok_frames"), F.count_if(~F.col("ok")).alias("failed_frames"))
    out = sums.join(worst, archive, "left").withColumn("first_failures", F.coalesce("first_failures", F.array().cast("array<bigint>")))
    rate = F.round(100.0 * F.col("ok_frames") / (F.col("ok_frames") + F.col("failed_frames")), 4)
    return out.withColumns({"success": rate, "status": F.when(F.col("failed_frames") == 0, "GOOD").otherwise("DEGRADED")})


def frame_count(chunks: DataFrame, archive: str = "archive_id") -> DataFrame:
    return chunks.groupBy(archive).agg(F.count(F.lit(1)).alias("frames"))


def running_success(checked: DataFrame, archive: str = "archive_id", every: int = 10) -> DataFrame:
    """Success rate so far after every tenth frame and at the end of each archive.

    ``checked``: archive, frame_number (from 1), ok. Frames are summed in runs of ``every`` before
    the running sum, so the window has a tenth of the rows.
    """
    run = F.floor((F.col("frame_number") - 1) / every)
    sums = checked.groupBy(archive, run.alias("_run")).agg(F.count_if("ok").alias("_ok"), F.count(F.lit(1)).alias("_n"), F.max("frame_number").alias("frame_number"))
    so_far = W.partitionBy(archive).orderBy("_run")
    return sums.select(archive, "frame_number", F.round(100.0 * F.sum("_ok").over(so_far) / F.sum("_n").over(so_far), 4).alias("success"))


def same_content(files: DataFrame, key: str, digest: str = "file_hash") -> DataFrame:
    """For each content the number of files and the first of them."""
    return files.groupBy(digest).agg(F.count(F.lit(1)).alias("files"), F.min(key).alias("first_file"))
