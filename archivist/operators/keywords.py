"""Substring search from stored posting lists of character grams.

A text that contains a query contains each of the query's trigrams; so the documents that a few of its
rarest trigrams have in common are looked at, and no others. A query of one or two characters is a
gram of its own.

Below the index's path lie ``documents`` (all columns, by hash of the key), ``postings`` (the keys of
the documents with a gram, at most about ``BLOCK`` a row), ``counts`` (documents a gram) and ``made``
(into how many folders these are dealt, and the names of key and text).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from archivist.functions import text as T
from archivist.operators import search
from archivist.operators.cells import kept
from archivist.sources import partitioned

#: Characters of a gram at most.
GRAM = 3
#: Grams of a query whose postings are read.
RAREST = 6
#: Documents of a posting row, about.
BLOCK = 10_000
#: Characters of a block's texts, about, and of those whose grams are sorted at once.
CHARACTERS, PIECE = 1 << 23, 1 << 20
#: Grams that are sent to every task at most.
FEW = 100_000
#: Folders of documents at most, and of grams; each has about ``BLOCK`` documents, up to that many folders.
PARTS, BUCKETS = 1024, 64


def grams_of(text: Column) -> Column:
    """The distinct grams of a text, of one to ``GRAM`` characters."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([[] if t is None else sorted({t[k : k + n] for n in range(1, GRAM + 1) for k in range(len(t) - n + 1)}) for t in batch.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(text)


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def _codes(place: np.ndarray, row: np.ndarray, n: int, letters: int) -> tuple[np.ndarray, np.ndarray]:
    """Each gram of ``n`` characters (numbers below ``letters``) as one number, and where it starts."""
    at = np.flatnonzero(row[n - 1 :] == row[: len(row) - n + 1])  # within a text
    code = place[at]
    for k in range(1, n):
        code = code * letters + place[at + k]
    return code, at


def _postings(schema: pa.Schema):
    """(gram, block, ids) of a block's texts (id, low, block): for each gram the sorted keys that have it.

    Characters are numbered, so that a gram with a document is one whole number, and the postings are
    these numbers in order: first of ``PIECE`` characters at a time, then of the block.
    """

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).sort_by("id").combine_chunks()
        ids = pc.unique(rows["id"].combine_chunks() if rows.num_rows else rows["id"])
        texts = rows["low"].to_pylist()
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        there = np.flatnonzero(np.bincount(points))
        place = np.searchsorted(there, np.arange(int(there[-1]) + 1 if len(there) else 0))[points] if len(points) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
        doc, chars, docs = pc.index_in(rows["id"], ids).to_numpy()[row].astype(np.int64), [chr(c) for c in there], len(ids)
        for n in range(1, GRAM + 1):
            pieces = range(0, len(place) - n + 1, PIECE)
            cut = lambda x, at: x[at : at + PIECE + n - 1]  # noqa: B023, E731
            known = None
            if len(there) ** n * docs >= 1 << 62:  # with so many characters grams are numbered first
                known = np.unique(np.concatenate([np.unique(_codes(cut(place, at), cut(row, at), n, len(there))[0]) for at in pieces]))
            found = [np.zeros(0, np.int64)]
            for at in pieces:
                code, start = _codes(cut(place, at), cut(row, at), n, len(there))
                found.append(np.unique((code if known is None else np.searchsorted(known, code)) * docs + doc[at + start]))
            code, of = np.divmod(np.unique(np.concatenate(found)), max(docs, 1))
            starts = np.flatnonzero(np.diff(code, prepend=-1))
            code = code[starts] if known is None else known[code[starts]]
            grams = [""] * len(code)
            for _ in range(n):
                code, last = np.divmod(code, max(len(there), 1))
                grams = [chars[c] + g for c, g in zip(last, grams, strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(of)), pa.int32()), ids.take(pa.array(of)))
            columns = [pa.array(grams, pa.string()), pa.array([key[0].as_py()] * len(grams), pa.int64()), lists]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def keyword_save(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", mode: str = "overwrite") -> None:
    """The index of ``docs`` below ``path``; with mode ``append`` of these beside those that are there.

    Rows with a null text are stored and never found. A key's repeated rows are candidates together,
    and each is found only if it contains the query itself.
    """
    spark, (rows, size) = docs.sparkSession, docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
    blocks = max(math.ceil(rows / BLOCK), math.ceil(size / CHARACTERS), 1)
    if mode == "append":
        made = spark.read.parquet(f"{path}/made").first()
        parts, buckets, key, text = made.parts, made.buckets, made.key, made.text
    else:
        parts, buckets = min(PARTS, blocks), min(BUCKETS, blocks)
        spark.createDataFrame([(parts, buckets, key, text)], "parts int, buckets int, key string, text string").coalesce(1).write.mode("overwrite").parquet(f"{path}/made")

    partitioned.save(docs.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")), f"{path}/documents", "_part", key, key, mode=mode)
    rows = docs.select(F.col(key).alias("id"), F.lower(text).alias("low"), F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block")).where("id is not null and low <> ''")
    schema = to_arrow_schema(rows.select(F.lit("").alias("gram"), "block", F.array("id").alias("ids")).schema)
    postings = rows.groupBy("block").applyInArrow(_postings(schema), f"gram string, block long, ids array<{dict(rows.dtypes)['id']}>")
    postings = kept(postings.withColumn("bucket", _bucket(F.col("gram"), buckets)), "postings")
    counts = postings.groupBy("bucket", "gram").agg(F.sum(F.size("ids")).alias("n"))
    for rows, name in ((postings, "postings"), (counts, "counts")):
        partitioned.save(rows, f"{path}/{name}", "bucket", "gram", "gram", mode=mode)


class KeywordIndex:
    """An index that `keyword_save` has written."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        made = spark.read.parquet(f"{path}/made").first()
        self.spark, self.parts, self.buckets, self.key, self.text = spark, made.parts, made.buckets, made.key, made.text
        self.documents, self.postings, self.counts = (partitioned.load(spark, f"{path}/{name}") for name in ("documents", "postings", "counts"))

    def _lowered(self, query: str) -> str:
        return self.spark.range(1).select(F.lower(F.lit(query))).first()[0]  # by the same rules as texts

    def _with(self, rows: DataFrame, grams: list[str]) -> DataFrame:
        """The rows of these grams; other buckets are not read."""
        buckets = self.spark.createDataFrame([(g,) for g in grams], "gram string").select(_bucket(F.col("gram"), self.buckets)).distinct().collect()
        return rows.where(F.col("bucket").isin([r[0] for r in buckets]) & F.col("gram").isin(grams))

    def candidates(self, query: str) -> DataFrame:
        """The keys that all of the query's rarest grams have."""
        low = self._lowered(query)
        grams = sorted({low[k : k + GRAM] for k in range(max(len(low) - GRAM, 0) + 1)})
        counts = self._with(self.counts, grams).groupBy("gram").agg(F.sum("n").alias("n")).collect()  # a row a gram of the query
        n = {r.gram: r.n for r in counts}
        if len(n) < len(grams):
            return self.documents.select(self.key).limit(0)
        rarest = sorted(grams, key=lambda g: (n[g], g))[:RAREST]
        ids = self._with(self.postings, rarest).select("gram", F.explode("ids").alias(self.key))
        return ids.groupBy(self.key).agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(rarest)).select(self.key)

    def _of(self, keys: DataFrame) -> DataFrame:
        """The documents of these keys; folders without any are not read."""
        part = F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")
        wanted = [r[0] for r in keys.select(part.alias("p")).distinct().collect()]  # PARTS at most
        return self.documents.where(F.col("_part").isin(wanted)).join(keys, self.key, "left_semi")

    def find(self, query: str) -> DataFrame:
        """The documents that contain the query, whatever its case."""
        if not query:
            raise ValueError("an empty query matches everything")
        rows = self._of(kept(self.candidates(query), "candidates"))
        return rows.where(T.contains_ci(F.col(self.text), query)).drop("_part")

    def rank(self, query: str, limit: int = 20) -> DataFrame:
        """As `search.keyword_rank`."""
        return search.keyword_rank(self.find(query), query, limit, self.text, self.key)

    def snippets(self, query: str, limit: int = 10, width: int = 200, memory: str | None = None, memory_column: str = "source") -> DataFrame:
        """As `search.keyword_snippets`."""
        return search.keyword_snippets(self.find(query), query, limit, width, self.text, self.key, memory, memory_column)

    def find_all(self, queries: DataFrame, query_key: str = "query_id", query: str = "query") -> DataFrame:
        """(query_key, key) of every document that contains a query, for many queries at once.

        Each query meets the postings of its rarest grams; candidates are compared with the text. Null
        and empty queries find nothing.
        """
        asked = queries.select(F.col(query_key).alias("qid"), F.lower(query).alias("low")).where("low <> ''")
        size = F.least(F.length("low"), F.lit(GRAM))
        grams = asked.select("qid", "low", F.explode(F.filter(grams_of(F.col("low")), lambda g: F.length(g) == size)).alias("gram"))
        counts = self.counts.join(F.broadcast(grams.select("gram").distinct()) if grams.count() <= FEW else grams.select("gram").distinct(), "gram", "left_semi")
        grams = grams.join(counts.groupBy("gram").agg(F.sum("n").alias("n")), "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        own = W.partitionBy("qid", "low")
        rarest = grams.withColumn("place", F.row_number().over(own.orderBy("n", "gram"))).where(F.col("place") <= RAREST)
        rarest = rarest.withColumn("of", F.count(F.lit(1)).over(own))
        # grams of one text are in one block, so lists meet block by block, and none is dealt out key by key
        lists = rarest.join(self.postings.select("gram", "block", "ids"), "gram").groupBy("qid", "low", "of", "block", "gram").agg(F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids"))
        met = lists.groupBy("qid", "low", "of", "block").agg(F.collect_list("ids").alias("lists")).where(F.size("lists") == F.col("of"))
        common = F.aggregate(F.slice("lists", 2, RAREST), F.element_at("lists", 1), F.array_intersect)
        found = met.select("qid", "low", F.explode(F.array_distinct(common)).alias(self.key))
        hits = found.join(self.documents.select(self.key, F.lower(self.text).alias("body")), self.key).where(F.contains("body", "low"))
        return hits.select("qid", self.key).distinct().withColumnRenamed("qid", query_key)
