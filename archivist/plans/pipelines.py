"""Entry points composed of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivist.functions.text import file_digest, with_mime
from archivist.operators.cells import kept
from archivist.operators.chunking import chunk, decrypt, encrypt, frame_numbers, payload_size
from archivist.operators.integrity import FILE, completeness, dedup_chunks, reassemble


def convert(files: DataFrame, chunk_size: int = 2800, password: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, contents) of files (archive_id, source_file, content): binary, or text as characters.

    With a password contents are encrypted before hashing, as binary, and written once: they would be
    sealed in another way each time that they are read.
    """
    size = payload_size(chunk_size)
    rows = kept(encrypt(files, "content", password), "sealed") if password else files
    rows = with_mime(rows, "source_file").withColumn("encrypted", F.lit(password is not None))
    contents = rows.select("archive_id", F.col("source_file").alias("name"), "mime_type", F.octet_length("content").cast("long").alias("size_bytes"), file_digest(F.col("content")).alias("hash"), F.ceil(F.length("content") / size).cast("int").alias("total"))
    chunks = chunk(rows, "content", chunk_size).withColumn("chunk_hash", F.sha2("payload", 256))
    return frame_numbers(chunks), contents


def extract(chunks: DataFrame, contents: DataFrame | None = None, password: str | None = None) -> DataFrame:
    """archive_id, source_file, file_hash, status, content: files from chunks in any order, with
    copies. Files with missing chunks have no content; empty files come from ``contents``."""
    one = dedup_chunks(chunks)
    state = completeness(one)
    rows = state.join(reassemble(one), list(FILE)).withColumn("content", F.when(F.col("status") == "complete", F.col("content")))
    rows = rows.select(*FILE, "status", "content")
    if contents is not None:
        kind = dict(rows.dtypes)["content"]
        empty = contents.where("total = 0").select("archive_id", F.col("name").alias("source_file"), F.col("hash").alias("file_hash"), F.lit("complete").alias("status"), F.lit("").cast(kind).alias("content"))
        rows = rows.unionByName(empty)
    if password:
        rows = decrypt(rows, "content", password)
    return rows
