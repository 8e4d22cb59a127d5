"""A corpus pipeline: language identification, line deduplication, near-duplicate removal, mixing
and packing. Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``; all but the last return docs' columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivist.llm import langid, linededup, minhash, mixing, packing
from archivist.llm.common import packed, unpacked, written

#: Documents whose shingles have this similarity (in percent) or more are near-duplicates.
ALIKE = 80
#: A document is rejected if it has no letters or no language scores this much.
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in a language that the classifier knows; null texts go."""
    found = packed(docs).withColumn("found", langid.identify(docs, langid.train(docs), "row.text"))
    return unpacked(found.where((F.col("found.lang_pred") != langid.UNDETERMINED) & (F.col("found.score") >= LEAST_SCORE)), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that repeat an earlier line, and documents of which nothing is left."""
    return linededup.without_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the smallest id, of each group of near-duplicates."""
    return minhash.without_duplicates(docs, percent=ALIKE)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target asks for, up to twice."""
    own = {c: f"column{k}" for k, c in enumerate(docs.columns)}  # names that don't clash with those of results
    mixed = mixing.mix(docs.toDF(*own.values()), own["text"], own["doc_id"], own["source"]).where("copies > 0")
    mixed = mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return mixed.select(*[F.col(new).alias(c) for c, new in own.items()])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts documents into pieces and packs these into sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mix),
    ("packing", pack),
]

#: The classifier, the tokenizer and the genetic algorithm have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
