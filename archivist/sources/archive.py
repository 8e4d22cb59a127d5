"""Archives of files as Parquet tables: scanning, writing, reading, listing and export."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivist.functions.text import human_size
from archivist.plans.pipelines import extract


def corpus_scan(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """A row a file below ``path``: path, modificationTime, length and content."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def prefix_list(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """path, length and modificationTime below ``path`` of names that start with ``prefix``; contents
    aren't read."""
    pattern = re.sub(r"([\\*?\[\]{}^])", r"\\\1", prefix) + "*"  # while files are listed, others are left out
    return corpus_scan(spark, path, pattern if prefix else None).drop("content")


def archive_write(chunks: DataFrame, contents: DataFrame, path: str) -> None:
    """chunks, contents and archives, partitioned by archive_id."""
    chunks.write.mode("overwrite").partitionBy("archive_id").parquet(f"{path}/chunks")
    contents.write.mode("overwrite").partitionBy("archive_id").parquet(f"{path}/contents")
    archive_stats(contents).write.mode("overwrite").parquet(f"{path}/archives")


def archive_read(spark: SparkSession, path: str, archive: str | None = None) -> DataFrame:
    """The chunk rows of all archives, or of one (only its partition is read); damaged rows are left
    out, and no rows at all are an error."""
    rows = _checked(spark, path, archive).where("valid").drop("valid")
    if rows.isEmpty():
        raise ValueError("the archive holds no valid chunk")
    return rows


def _checked(spark: SparkSession, path: str, archive: str | None) -> DataFrame:
    """All chunk rows with ``valid``: file, index and payload are there and, where the archive has
    the payloads' hashes, agree with them."""
    rows = spark.read.parquet(f"{path}/chunks")
    rows = rows if archive is None else rows.where(F.col("archive_id") == archive)
    valid = F.col("source_file").isNotNull() & F.col("chunk_index").isNotNull() & F.col("payload").isNotNull()
    if "chunk_hash" in rows.columns:
        valid &= F.coalesce(F.sha2("payload", 256) == F.col("chunk_hash"), F.col("chunk_hash").isNull())
    return rows.withColumn("valid", valid)


def archive_damage(spark: SparkSession, path: str, archive: str | None = None) -> DataFrame:
    """For each archive the chunk rows that `archive_read` returns and those that it leaves out."""
    rows = _checked(spark, path, archive)
    return rows.groupBy("archive_id").agg(F.count_if("valid").alias("good"), F.count_if(~F.col("valid")).alias("damaged"))


def archive_list(files: DataFrame, size: str = "size_bytes", time: str = "mtime") -> DataFrame:
    """For each archive its size, as text too, and its latest time."""
    rows = files.groupBy("archive_id").agg(F.sum(size).alias("size_bytes"), F.max(time).alias("mtime"))
    return rows.withColumn("size", human_size(F.col("size_bytes")))


def contents_list(spark: SparkSession, path: str, archive: str) -> DataFrame:
    """The files of an archive; chunks aren't read."""
    return spark.read.parquet(f"{path}/contents").where(F.col("archive_id") == archive)


def archive_stats(contents: DataFrame, total: str = "total") -> DataFrame:
    """For each archive total_chunks and the number and bytes of its files."""
    return contents.groupBy("archive_id").agg(F.sum(total).alias("total_chunks"), F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("size_bytes"))


def index_save(frames: DataFrame, path: str) -> None:
    frames.write.mode("overwrite").partitionBy("memory_id").parquet(path)


def index_load(spark: SparkSession, path: str, memory: str) -> DataFrame:
    rows = spark.read.parquet(path).where(F.col("memory_id") == memory)
    if rows.isEmpty():
        raise FileNotFoundError(f"no index of {memory}")
    return rows


def versions_save(versions: DataFrame, path: str, form: str = "parquet") -> None:
    versions.write.mode("overwrite").format(form).save(path)


def versions_load(spark: SparkSession, path: str, form: str = "parquet", schema: str | None = None) -> DataFrame:
    reader = spark.read.format(form)
    return (reader.schema(schema) if schema else reader).load(path)


def dated_export(rows: DataFrame, path: str, time: str, days: bool = True) -> None:
    """Below ``path`` by year, month and (files) day."""
    at = F.col(time)
    parts = {"y": F.date_format(at, "yyyy"), "m": F.date_format(at, "MM")} | ({"d": F.date_format(at, "dd")} if days else {})
    rows.withColumns(parts).write.mode("overwrite").partitionBy(*parts).parquet(path)


def extract_sink(chunks: DataFrame, path: str, contents: DataFrame | None = None) -> DataFrame:
    """One row a complete source file below ``path``, partitioned by archive, from chunks in any
    order and with copies; the files that can't be written, with their status, are returned."""
    files = extract(chunks, contents)
    files.where("status = 'complete'").drop("status").write.mode("overwrite").partitionBy("archive_id").parquet(path)
    return files.where("status <> 'complete'").drop("content")


def info_report(archives: DataFrame, frames: DataFrame, index_meta: DataFrame | None = None, version_stats: DataFrame | None = None) -> DataFrame:
    """archives with frame counts and, where there are any, index and version statistics."""
    rows = archives.join(frames, "archive_id", "left").withColumn("frames", F.coalesce("frames", F.lit(0).cast("long")))
    for more in (index_meta, version_stats):
        if more is not None:
            rows = rows.join(more, "archive_id", "left")
    return rows
