"""Parquet tables partitioned by one column, which can be read when they have no rows, too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files that a folder's rows are dealt to at most, so that a large folder isn't written by one task.
FILES = 16


def save(rows: DataFrame, path: str, folder: str, by: str | Column, *order: str, mode: str = "overwrite") -> None:
    """``rows`` below ``path``, a folder for each value of ``folder``, dealt by ``by`` within it and sorted."""
    rows.limit(0).write.mode("overwrite").parquet(f"{path}-schema")
    dealt = rows.repartition(folder, F.pmod(F.xxhash64(by), F.lit(FILES)))
    dealt.sortWithinPartitions(folder, *order).write.mode(mode).partitionBy(folder).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The rows that `save` has written; filters on the folder's column decide which folders are read."""
    return spark.read.schema(spark.read.parquet(f"{path}-schema").schema).parquet(path)
