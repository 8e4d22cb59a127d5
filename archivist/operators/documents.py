"""Collections of documents: ingestion, upserts, deletion and request limits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from archivist.functions import text as T
from archivist.operators.cells import kept
from archivist.operators.ordered import in_segments
from archivist.sources import partitioned


def append(log: DataFrame, rows: DataFrame) -> DataFrame:
    return log.unionByName(rows, allowMissingColumns=True)


def upsert(docs: DataFrame, rows: DataFrame, key: str = "id", newest: str = "updated_at") -> tuple[DataFrame, DataFrame]:
    """(documents, rejects): of each id the last row stays; rows without id or embedding are rejected."""
    every = docs.unionByName(rows, allowMissingColumns=True)
    bad = F.col(key).isNull() | (F.col(key).cast("string") == "")
    if "embedding" in every.columns:
        bad |= F.coalesce(F.size("embedding") <= 0, F.lit(True))
    if "created_at" in every.columns:
        every = every.withColumn("created_at", F.coalesce("created_at", newest))
    # the whole row as the tie break makes reruns agree; a partial aggregate meets each key's rows
    row = F.struct(newest, *[c for c in every.columns if c not in (newest, "metadata")])
    good = every.where(~bad).groupBy(key).agg(F.max_by(F.struct("*"), row).alias("r")).select("r.*")
    return good, every.where(bad)


def documents_save(docs: DataFrame, path: str, buckets: int = 64, key: str = "id", newest: str = "updated_at") -> DataFrame:
    """Stores ``docs`` in buckets by key, of each id the last row, and returns the rejects of `upsert`."""
    good, bad = upsert(docs.limit(0), docs, key, newest)
    partitioned.save(good.withColumn("_bucket", _bucket(key, buckets)), path, "_bucket", key, key)
    docs.sparkSession.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}-made")
    return bad


def documents_load(spark: SparkSession, path: str) -> DataFrame:
    return partitioned.load(spark, path).drop("_bucket")


def stored_upsert(rows: DataFrame, path: str, key: str = "id", newest: str = "updated_at") -> DataFrame:
    """`upsert` of ``rows`` into stored documents, and their rejects: only buckets that have one of the
    rows' ids are read, and written anew; the other files stay as they are."""
    spark = rows.sparkSession
    buckets = spark.read.parquet(f"{path}-made").first().buckets
    rows = kept(rows, "rows")
    touched = [r[0] for r in rows.where(F.col(key).isNotNull()).select(_bucket(key, buckets)).distinct().collect()]  # at most all buckets
    good, _ = upsert(partitioned.load(spark, path).where(F.col("_bucket").isin(touched)).drop("_bucket"), rows, key, newest)
    good = kept(good.withColumn("_bucket", _bucket(key, buckets)), "good")  # before what it is read from goes
    dealt = good.repartition("_bucket", F.pmod(F.xxhash64(key), F.lit(partitioned.FILES))).sortWithinPartitions("_bucket", key)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)
    return upsert(rows.limit(0), rows, key, newest)[1]


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def delete(docs: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """``docs`` without those ids; an id that isn't there is an error."""
    missing = ids.join(docs.select(key), key, "left_anti")
    if not missing.isEmpty():
        raise KeyError("some ids are not there")
    return docs.join(ids, key, "left_anti")


def by_ids(docs: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The documents whose key is in ``ids``; ids that aren't there find nothing."""
    return docs.join(ids.select(key).distinct(), key, "left_semi")


def by_memory(docs: DataFrame, memory: object, column: str = "memory_id") -> DataFrame:
    """The documents of one memory."""
    return docs.where(F.col(column) == memory)


def extract_text(files: DataFrame, name: str = "name", content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(texts, errors): supported types as UTF-8 text; other types and bad bytes are errors."""
    ok = T.type_supported(F.col(name))
    valid = F.is_valid_utf8(F.col(content).cast("string"))
    error = F.when(~ok, "unsupported type").when(~F.coalesce(valid, F.lit(False)), "not UTF-8")
    rows = files.withColumn("error", error)
    good = rows.where("error is null").withColumn("text", F.col(content).cast("string")).drop("error", content)
    return good, rows.where("error is not null").drop(content)


def ingest(files: DataFrame, embedding: Callable[[DataFrame], DataFrame], model: str, name: str = "name", content: str = "content", blank: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, errors) from files (name, content): text, cleaned, embedded and described. Files without
    text are errors; with ``blank`` they are documents like others."""
    texts, errors = extract_text(files, name, content)
    clean = texts.withColumn("text", T.clean_text(F.col("text")))
    if not blank:
        empty = clean.where("text = ''").drop("text").withColumn("error", F.lit("no text"))
        errors, clean = errors.unionByName(empty, allowMissingColumns=True), clean.where("text <> ''")
    rows = embedding(clean)
    failed = rows.where("embedding is null").drop("text", "embedding").withColumn("error", F.lit("not embedded"))
    meta = T.enrich_metadata(F.create_map().cast("map<string,string>"), filename=F.col(name), content_length=F.length("text"), embedding_model=F.lit(model))
    good = rows.where("embedding is not null").withColumns({"id": T.content_id(F.col("text")), "metadata": meta})
    return good, errors.unionByName(failed, allowMissingColumns=True)


def request_window(requests: DataFrame, seconds: int = 60, client: str = "client", ts: str = "ts") -> DataFrame:
    """Adds in_window: the client's requests in the last ``seconds``, this one included."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = W.partitionBy(client).orderBy("_at").rangeBetween(-seconds * 1_000_000, 0)
    return requests.withColumn("_at", at).withColumn("in_window", F.count(F.lit(1)).over(w)).drop("_at")


def admit(times: list[int], admitted: list[int], limit: int, span: int) -> tuple[list[bool], list[int]]:
    """For times in order whether fewer than ``limit`` admitted ones are less than ``span`` old; and
    the admitted times that still count at the end."""
    out = []
    for t in times:
        while admitted and t - admitted[0] >= span:
            admitted = admitted[1:]
        out.append(len(admitted) < limit)
        if out[-1]:
            admitted = [*admitted, t]
    return out, admitted


def rate_limit(requests: DataFrame, limit: int = 60, seconds: int = 60, client: str = "client", ts: str = "ts", key: str = "event_id") -> DataFrame:
    """client, key, ts and admitted. Only admitted requests count, so each depends on those before it,
    but no longer once a client has made none for ``seconds``: between such gaps its requests are
    segments, which are worked on apart. Segments of no more than ``limit`` are admitted whole; a larger
    one is read in order, a few requests at a time, and only the times that still count are kept."""
    rows = requests.select(F.col(client).alias("client"), F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"))
    rows = in_segments(rows.withColumn("_at", F.unix_micros("ts")), "client", "_at", "key", seconds * 1_000_000)
    large = rows.groupBy("client", "segment").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    large = kept(large.select(F.col("client").alias("_client"), F.col("segment").alias("_segment")), "segments")
    same = F.col("client").eqNullSafe(F.col("_client")) & (F.col("segment") == F.col("_segment"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, admitted = None, []
        for batch in batches:
            who = batch["client"].astype(object).where(batch["client"].notna(), None)
            names = list(zip(who.tolist(), batch["range"].tolist(), batch["number"].tolist(), strict=True))
            times, flags, at = batch["_at"].tolist(), [], 0
            while at < len(names):
                end = at + 1
                while end < len(names) and names[end] == names[at]:
                    end += 1
                if names[at] != now:
                    now, admitted = names[at], []
                ok, admitted = admit(times[at:end], admitted, limit, seconds * 1_000_000)
                flags += ok
                at = end
            yield batch[["client", "key", "ts"]].assign(admitted=flags)

    busy = rows.join(large, same, "left_semi").select("client", "key", "ts", "_at", "segment.range", "segment.number")
    dealt = busy.repartition("client", "range", "number").sortWithinPartitions("client", "range", "number", "_at", "key")
    judged = dealt.mapInPandas(run, "client long, key long, ts timestamp, admitted boolean")
    free = rows.join(large, same, "left_anti").select("client", "key", "ts", F.lit(True).alias("admitted"))
    return judged.unionByName(free).select(F.col("client").alias(client), F.col("key").alias(key), F.col("ts").alias(ts), "admitted")


def latest_status(events: DataFrame, job: str = "job_id", terminal: tuple[str, ...] = ("completed", "failed"), minutes: int = 10) -> DataFrame:
    """For each job its last status, whether that ends it, and when it expires (after its start)."""
    rows = events.groupBy(job).agg(F.max_by("status", F.struct("ts", "status")).alias("status"), F.min("ts").alias("started"), F.max("ts").alias("updated"))
    return rows.withColumns({"closed": F.col("status").isin(*terminal), "expires": F.col("started") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))})


def priced(prompts: DataFrame, prices: DataFrame, default: float = 1.00, model: str = "model") -> DataFrame:
    """Adds cost_per_million by model, the default for others."""
    return prompts.join(prices, model, "left").withColumn("cost_per_million", F.coalesce("cost_per_million", F.lit(default)))

