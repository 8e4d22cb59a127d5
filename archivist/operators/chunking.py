"""Cutting files into chunks, and what is done to single payloads."""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from archivist.functions.text import file_digest, human_size, with_mime
from archivist.operators.ordered import running_total

#: Bytes of a chunk that are kept free for its record.
OVERHEAD = 200


def payload_size(chunk_size: int) -> int:
    if not 1 <= chunk_size <= 4000:
        raise ValueError(f"chunk size must be 1 to 4000, not {chunk_size}")
    if chunk_size <= OVERHEAD:
        raise ValueError(f"a chunk of {chunk_size} leaves no room for a payload")
    return chunk_size - OVERHEAD


def chunk(files: DataFrame, content: str = "content", chunk_size: int = 2800) -> DataFrame:
    """Fixed-size slices of ``content``: characters of text or bytes of binary.

    Adds chunk_id, file_hash, chunk_index (from 0), chunk_total and payload to the other columns.
    Empty files have no chunks (their contents row says so). One narrow step: nothing is shuffled.
    """
    size = payload_size(chunk_size)
    total = F.ceil(F.length(content) / size).cast("int")
    rows = files.withColumns({"file_hash": file_digest(F.col(content)), "chunk_total": total}).where(F.col("chunk_total") > 0)
    rows = rows.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.col("chunk_total") - 1)))
    payload = F.substring(F.col(content), F.col("chunk_index") * size + 1, F.lit(size))
    chunk_id = F.concat_ws("_", F.substring("file_hash", 1, 8), F.col("chunk_index").cast("string"))
    return rows.withColumns({"payload": payload, "chunk_id": chunk_id}).drop(content)


def frame_numbers(chunks: DataFrame, archive: str = "archive_id", file: str = "source_file") -> DataFrame:
    """Adds frame_number: consecutive over the chunks of an archive, from 0.

    The number of a file's first frame is the number of chunks in the files before it, summed within
    ranges of files and over the ranges before; neither an archive's chunks nor its files need meet in
    one task.
    """
    files = chunks.groupBy(archive, file).agg(F.max("chunk_total").cast("long").alias("_n"))
    files = running_total(files, archive, file, "_n", "_before")
    return chunks.join(files, [archive, file]).withColumn("frame_number", (F.col("_before") + F.col("chunk_index")).cast("long")).drop("_before")


def with_total(chunks: DataFrame, *file: str) -> DataFrame:
    """chunk_total as the number of chunks that a file has."""
    return chunks.withColumn("chunk_total", F.count(F.lit(1)).over(W.partitionBy(*file)).cast("int"))


def to_json(chunks: DataFrame) -> DataFrame:
    """One JSON record a row."""
    return chunks.select(F.to_json(F.struct("*")).alias("record"))


def from_json(records: DataFrame, schema: str, column: str = "record") -> DataFrame:
    """Rows of the records that can be read; others are left out."""
    marked = records.select(F.from_json(F.col(column), schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return marked.where("r is not null and r._bad is null").select("r.*").drop("_bad")


def content_items(files: DataFrame, content: str = "content", name: str = "name") -> DataFrame:
    """A row a file: name, mime_type, size_bytes, size, hash and is_text."""
    rows = with_mime(files, name).withColumn("size_bytes", F.octet_length(content).cast("long"))
    return rows.withColumns({"size": human_size(F.col("size_bytes")), "hash": file_digest(F.col(content))}).drop(content)


def route_by_size(files: DataFrame, limit: int = 100 << 20, size: str = "length") -> tuple[DataFrame, DataFrame]:
    """Files up to the limit, and larger ones."""
    return files.where(F.col(size) <= limit), files.where(F.col(size) > limit)


# --- encryption: salt(32) | nonce(12) | AES-256-GCM ciphertext and tag ----------------------------

SALT, ROUNDS = 32, 100_000


def _key(df: DataFrame, password: str, salt: bytes) -> DataFrame:
    """One row with the key, as data: a literal would be shown in plans and logs."""
    key = hashlib.pbkdf2_hmac("sha256", password.encode(), salt, ROUNDS, 32)
    return F.broadcast(df.sparkSession.createDataFrame([(bytearray(salt), bytearray(key))], "_salt binary, _key binary"))


def encrypt(df: DataFrame, column: str, password: str, salt: bytes | None = None) -> DataFrame:
    """``column`` encrypted, as binary; one salt and key for the job."""
    key = _key(df, password, salt or os.urandom(SALT))
    sealed = F.concat(F.col("_salt"), F.aes_encrypt(F.col(column).cast("binary"), F.col("_key"), F.lit("GCM")))
    return df.join(key).withColumn(column, sealed).drop("_salt", "_key")


#: Salts that one call derives keys for; a job writes one.
SALTS = 1000


def decrypt(df: DataFrame, column: str, password: str, sealed: Column | None = None) -> DataFrame:
    """``column`` as it was, and ``decrypted``; values that the password doesn't open stay.

    ``sealed`` says which rows are encrypted, by default the column ``encrypted`` if there is one;
    values too short for a salt, nonce and tag aren't. Keys are derived once for each salt, in tasks;
    more than ``SALTS`` salts are an error, as values that aren't encrypted look like salts.
    """
    if sealed is None:
        sealed = F.col("encrypted") if "encrypted" in df.columns else F.lit(True)
    mine = sealed & (F.octet_length(column) >= SALT + 12 + 16)
    salts = df.where(mine).select(F.substring(F.col(column), 1, SALT).cast("binary").alias("_salt")).distinct().limit(SALTS + 1)
    found = [(bytearray(r[0]),) for r in salts.collect()]
    if len(found) > SALTS:
        raise ValueError(f"more than {SALTS} salts: say which rows are encrypted")

    def derive(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda s: hashlib.pbkdf2_hmac("sha256", password.encode(), bytes(s), ROUNDS, 32))

    table = df.sparkSession.createDataFrame(found, "_salt binary").withColumn("_key", F.pandas_udf(derive, "binary")("_salt"))
    plain = F.try_aes_decrypt(F.substring(F.col(column), SALT + 1, F.length(column)), F.col("_key"), F.lit("GCM"))
    on = mine & (F.substring(F.col(column), 1, SALT).cast("binary") == F.col("_salt"))
    out = df.join(F.broadcast(table), on, "left").withColumn("_plain", plain)  # at most SALTS rows
    out = out.withColumns({"decrypted": F.col("_plain").isNotNull(), column: F.coalesce("_plain", column)})
    return out.drop("_salt", "_key", "_plain")


def inflate_tagged(value: Column) -> Column:
    """``GZ:`` and base64 of gzip becomes its text; whatever can't be read stays as it is."""

    def one(text: str) -> str:
        try:
            return gzip.decompress(base64.b64decode(text[3:], validate=True)).decode()
        except Exception:
            return text

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(one, na_action="ignore")

    tagged = F.startswith(value, F.lit("GZ:"))
    return F.when(tagged, F.pandas_udf(run, "string")(F.when(tagged, value))).otherwise(value)
