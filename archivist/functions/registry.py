"""What users plug in: embedders, text extractors and search as an SQL function."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archivist.functions.text import TEXT_EXTENSIONS, extension


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> list[list[float] | None]: ...


class TextExtractors:
    """Extractors by extension; plain text is built in and needs no Python."""

    def __init__(self) -> None:
        self.own: dict[str, Callable[[bytes], str]] = {}

    def register(self, ext: str, extract: Callable[[bytes], str]) -> None:
        self.own[ext.lower()] = extract

    def supported(self) -> list[str]:
        return sorted({*TEXT_EXTENSIONS, *self.own})

    def text(self, name: str, content: str) -> Column:
        """The text of a file; null if its type is unknown or it can't be read."""
        own = dict(self.own)
        ext = extension(F.col(name))

        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for exts, data in batches:
                out = []
                for e, d in zip(exts, data, strict=True):
                    try:
                        out.append(own[e](bytes(d)) if d is not None else None)
                    except Exception:
                        out.append(None)
                yield pd.Series(out, dtype=object)

        found = F.lit(None).cast("string")
        if own:
            mine = ext.isin(*own)
            found = F.when(mine, F.pandas_udf(run, "string")(ext, F.when(mine, F.col(content))))
        plain = ext.isin(*[e for e in TEXT_EXTENSIONS if e not in own])
        return F.when(plain & F.is_valid_utf8(F.col(content).cast("string")), F.col(content).cast("string")).otherwise(found)


def register_search(spark: SparkSession, frames: DataFrame, name: str = "archive_frames") -> str:
    """A view of frames (vec_id, embedding) for SQL: with archive_cosine(a, b), and as the table function
    archive_search(query, k), which has rank, vec_id and score of the k best frames."""
    frames.createOrReplaceTempView(name)
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION archive_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN
        CASE WHEN size(a) = size(b) AND aggregate(a, 0D, (s, x) -> s + x * x) > 0 AND aggregate(b, 0D, (s, x) -> s + x * x) > 0
        THEN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)
             / sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) / sqrt(aggregate(b, 0D, (s, x) -> s + x * x)) ELSE 0D END"""
    )
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION archive_search(query ARRAY<DOUBLE>, k INT) RETURNS TABLE (rank INT, vec_id BIGINT, score DOUBLE) RETURN
        SELECT rank, vec_id, score FROM (SELECT row_number() OVER (ORDER BY score DESC, vec_id) AS rank, vec_id, score
        FROM (SELECT vec_id, archive_cosine(CAST(embedding AS ARRAY<DOUBLE>), query) AS score FROM {name})) WHERE rank <= k"""
    )
    return name
