"""Version history of memories: diffs of snapshots, logs, branches and reconstruction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from archivist.operators.cells import kept
from archivist.operators.ordered import last_value
from archivist.operators.search import batch_top_k
from archivist.sources import partitioned

FRAME = ("memory_id", "frame")


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """type (insert, delete, replace), old_hash, new_hash and payload of every frame that differs
    between two snapshots (memory_id, frame, hash, payload)."""
    a = old.select(*FRAME, F.col("hash").alias("old_hash"))
    b = new.select(*FRAME, F.col("hash").alias("new_hash"), "payload")
    both = a.join(b, list(FRAME), "full_outer").where(~F.col("old_hash").eqNullSafe(F.col("new_hash")))
    kind = F.when(F.col("old_hash").isNull(), "insert").when(F.col("new_hash").isNull(), "delete").otherwise("replace")
    return both.select(*FRAME, kind.alias("type"), "old_hash", "new_hash", "payload")


def version_chain(events: DataFrame, memory: str = "memory_id", order: str = "ts") -> DataFrame:
    """Adds version (from 1) and parent_version (null for the first) in the order of the log."""
    w = W.partitionBy(memory).orderBy(order)
    rows = events.withColumn("version", F.row_number().over(w))
    return rows.withColumn("parent_version", F.lag("version").over(w))


def version_stats(versions: DataFrame, memory: str = "memory_id") -> DataFrame:
    """For each memory the number of versions, the latest and its message."""
    latest = F.max_by(F.struct("version", "message"), "version")
    return versions.groupBy(memory).agg(F.count(F.lit(1)).alias("versions"), latest.alias("l")).select(memory, "versions", F.col("l.version").alias("latest"), F.col("l.message").alias("latest_message"))


def as_of(versions: DataFrame, requests: DataFrame, bases: DataFrame | None = None, memory: str = "memory_id") -> DataFrame:
    """For each different request (memory, as_of) the file of the greatest version up to it, else the
    base's. Versions and requests are merged in order; no request meets all versions of its memory."""
    rows = versions.select(memory, F.col("version").alias("as_of"), F.struct("version", "file").alias("found"))
    out = last_value(rows, requests, memory, "as_of", "found").select(memory, "as_of", F.col("found.version").alias("version"), F.col("found.file").alias("file"))
    if bases is None:
        return out
    return out.join(bases.select(memory, "base_file"), memory, "left").withColumn("file", F.coalesce("file", "base_file")).drop("base_file")


def version_range(ops: DataFrame, after: int, upto: int) -> DataFrame:
    """Operations of the versions in (after, upto], in order."""
    return ops.where((F.col("version") > after) & (F.col("version") <= upto)).orderBy(*[c for c in ("memory_id", "version", "frame") if c in ops.columns])


def create_version(versions: DataFrame, old: DataFrame, new: DataFrame, message: str = "Version update", author: str = "archivist") -> tuple[DataFrame, DataFrame]:
    """(versions, ops) with one version more for each memory that differs; the head is the greatest."""
    diff = snapshot_diff(old, new)
    heads = versions.groupBy("memory_id").agg(F.max("version").alias("head"))
    counts = new.groupBy("memory_id").agg(F.count(F.lit(1)).alias("frame_count"))
    made = diff.groupBy("memory_id").agg(F.count(F.lit(1)).alias("n_ops")).join(heads, "memory_id", "left").join(counts, "memory_id", "left")
    row = made.select("memory_id", (F.coalesce("head", F.lit(0)) + 1).cast("int").alias("version"), F.col("head").cast("int").alias("parent_version"), F.lit(message).alias("message"), F.lit(author).alias("author"), F.coalesce("frame_count", F.lit(0)).alias("frame_count"), "n_ops")
    ops = diff.join(row.select("memory_id", "version"), "memory_id")
    return versions.unionByName(row, allowMissingColumns=True), ops


def list_versions(versions: DataFrame, memory: object) -> DataFrame:
    return versions.where(F.col("memory_id") == memory).orderBy("version")


def create_branch(branches: DataFrame, versions: DataFrame, memory: object, name: str, version: int) -> DataFrame:
    """``branches`` (memory_id, branch, version) and a new one. Its version must be there, its name
    must not."""
    if not branches.where((F.col("memory_id") == memory) & (F.col("branch") == name)).isEmpty():
        raise ValueError(f"branch {name} is there already")
    at = versions.where((F.col("memory_id") == memory) & (F.col("version") == version))
    if at.isEmpty():
        raise ValueError(f"there is no version {version}")
    return branches.unionByName(at.select("memory_id", F.lit(name).alias("branch"), F.col("version").cast("int").alias("version")).limit(1))


def list_branches(memories: DataFrame) -> DataFrame:
    """(memory_id, branch, version) of a map column branches."""
    return memories.select("memory_id", F.explode("branches").alias("branch", "version"))


def reconstruct(base: DataFrame, ops: DataFrame, version: int) -> DataFrame:
    """The frames of every memory at a version: of each frame its last operation up to it, or the
    base's frame if there is none; deleted frames are left out."""
    last = ops.where(F.col("version") <= version).groupBy(*FRAME).agg(F.max_by(F.struct("type", "new_hash", "payload"), "version").alias("o"))
    rows = base.select(*FRAME, "hash", "payload").join(last, list(FRAME), "full_outer")
    rows = rows.where(F.col("o").isNull() | (F.col("o.type") != "delete"))
    pick = lambda new, old: F.when(F.col("o").isNull(), F.col(old)).otherwise(F.col(f"o.{new}"))
    return rows.select(*FRAME, pick("new_hash", "hash").alias("hash"), pick("payload", "payload").alias("payload"))


def history_save(base: DataFrame, ops: DataFrame, path: str, every: int = 100) -> None:
    """Snapshots of every ``every``-th version, and the operations since each, partitioned by ``span``.
    Versions count from 1; the base is version 0."""
    _history(_as_ops(base, 0), kept(ops, "ops"), ops.limit(0), path, every, 0, "overwrite")


def history_append(spark: SparkSession, path: str, ops: DataFrame) -> None:
    """Adds operations of later versions; snapshots that these complete come from the last one."""
    every, last = _made(spark, path)
    since = partitioned.load(spark, f"{path}/ops").where(F.col("span") == last).select(*ops.columns)
    _history(_as_ops(_snapshot(spark, path, last), last * every), kept(ops, "ops"), kept(since, "since"), path, every, last + 1, "append")


def _as_ops(frames: DataFrame, version: int) -> DataFrame:
    return frames.select(*FRAME, F.lit(version).alias("version"), F.lit("insert").alias("type"), F.col("hash").alias("new_hash"), "payload")


def _history(first: DataFrame, ops: DataFrame, since: DataFrame, path: str, every: int, begin: int, mode: str) -> None:
    """Writes ``ops``, and the snapshots from number ``begin`` on, of ``first`` and all operations after it.

    All snapshots come from one pass: what an operation makes of a frame holds until the frame's next
    operation, and is in the snapshots between.
    """
    spans = ops.withColumn("span", F.floor((F.col("version") - 1) / every).cast("int"))
    partitioned.save(spans, f"{path}/ops", "span", "frame", "version", mode=mode)
    latest = max((ops.agg(F.max("version")).first()[0] or 0) // every, begin if mode == "overwrite" else begin - 1)
    rows = first.unionByName(since.unionByName(ops).select(*first.columns))
    until = F.lead("version").over(W.partitionBy(*FRAME).orderBy("version"))
    rows = rows.withColumn("from", F.greatest(F.ceil(F.col("version") / every), F.lit(begin)).cast("int"))
    rows = rows.withColumn("upto", F.coalesce(F.ceil(until / every) - 1, F.lit(latest)).cast("int")).where("type <> 'delete' and from <= upto")
    rows = rows.select(*FRAME, F.col("new_hash").alias("hash"), "payload", F.explode(F.sequence("from", "upto")).alias("span"))
    partitioned.save(rows, f"{path}/snapshots", "span", "frame", mode=mode)
    first.sparkSession.createDataFrame([(every, latest)], "every int, latest int").coalesce(1).write.mode(mode).parquet(f"{path}/made")


def _made(spark: SparkSession, path: str) -> tuple[int, int]:
    """Versions a span, and the number of the last snapshot."""
    return tuple(spark.read.parquet(f"{path}/made").agg(F.max("every"), F.max("latest")).first())


def _snapshot(spark: SparkSession, path: str, span: int) -> DataFrame:
    return partitioned.load(spark, f"{path}/snapshots").where(F.col("span") == span).drop("span")


def history_at(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The frames of every memory at a version, from the snapshot before it and the operations since:
    other partitions aren't read."""
    every, latest = _made(spark, path)
    span = min(version // every, latest)
    since = partitioned.load(spark, f"{path}/ops").where((F.col("span") == span) & (F.col("version") > span * every)).drop("span")
    return reconstruct(_snapshot(spark, path, span), since, version)


def time_travel_search(base: DataFrame, ops: DataFrame, version: int, queries: DataFrame, embedding: Callable[[DataFrame], DataFrame], k: int = 5, query_key: str = "query_id") -> DataFrame:
    """`frame_search` of the frames that every memory has at ``version``."""
    return frame_search(reconstruct(base, ops, version), queries, embedding, k, query_key)


def frame_search(frames: DataFrame, queries: DataFrame, embedding: Callable[[DataFrame], DataFrame], k: int = 5, query_key: str = "query_id", key: Column | None = None) -> DataFrame:
    """query_id, rank, memory_id, frame and score: the k frames nearest to each query (query_key, embedding).

    ``embedding`` gets the frames (key, memory_id, frame, payload) and returns key and embedding, or
    null or nothing for frames that aren't to be found. Ties go to the smaller key, by default a hash of
    the frame.
    """
    frames = frames.withColumn("key", F.xxhash64(*FRAME) if key is None else key)
    found = batch_top_k(embedding(frames).select("key", "embedding"), queries, k, "key", "embedding", query_key)
    return found.join(frames.select("key", *FRAME), "key").select(query_key, "rank", *FRAME, "score")


# --- snapshots with digests ---------------------------------------------------------------------


def snapshot_save(snapshot: DataFrame, path: str, buckets: int = 256) -> None:
    """``snapshot`` (memory_id, frame, hash, payload) partitioned by bucket, and of each bucket the number
    of its rows and two sums of hashes of them, which don't depend on their order."""
    rows = kept(snapshot.withColumn("bucket", F.pmod(F.xxhash64(*FRAME), F.lit(buckets)).cast("int")), "snapshot")
    partitioned.save(rows, f"{path}/rows", "bucket", "frame")
    one = lambda seed: F.sum(F.xxhash64(F.lit(seed), *FRAME, "hash").cast("decimal(38,0)"))
    sums = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), one(1).alias("one"), one(2).alias("two"))
    sums.withColumn("buckets", F.lit(buckets)).coalesce(1).write.mode("overwrite").parquet(f"{path}/digests")


def changed_buckets(spark: SparkSession, old: str, new: str) -> list[int]:
    """The buckets in which two stored snapshots differ."""
    a, b = (spark.read.parquet(f"{path}/digests") for path in (old, new))
    if a.select("buckets").unionByName(b.select("buckets")).distinct().count() > 1:
        raise ValueError("the snapshots are stored in different numbers of buckets")
    row = F.struct("n", "one", "two")
    both = a.select("bucket", row.alias("a")).join(b.select("bucket", row.alias("b")), "bucket", "full_outer")
    return sorted(r.bucket for r in both.where(~F.col("a").eqNullSafe(F.col("b"))).select("bucket").collect())  # at most all buckets


def stored_diff(spark: SparkSession, old: str, new: str) -> DataFrame:
    """`snapshot_diff` of two snapshots that `snapshot_save` has written; buckets with equal digests
    aren't read."""
    wanted = changed_buckets(spark, old, new)

    rows = lambda path: partitioned.load(spark, f"{path}/rows").where(F.col("bucket").isin(wanted)).drop("bucket")
    return snapshot_diff(rows(old), rows(new))


def diff_report(ops: DataFrame) -> DataFrame:
    return ops.select(*FRAME, "type", F.left("old_hash", F.lit(16)).alias("old"), F.left("new_hash", F.lit(16)).alias("new"))


def delta_savings(old: DataFrame, new: DataFrame) -> DataFrame:
    """For each memory the bytes of changed payloads, of the whole new snapshot, and what is saved."""
    delta = snapshot_diff(old, new).groupBy("memory_id").agg(F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).alias("delta_bytes"))
    whole = new.groupBy("memory_id").agg(F.sum(F.octet_length("payload")).alias("snapshot_bytes"))
    rows = whole.join(delta, "memory_id", "left").withColumn("delta_bytes", F.coalesce("delta_bytes", F.lit(0)))
    saved = F.when(F.col("snapshot_bytes") > 0, F.round(1 - F.col("delta_bytes") / F.col("snapshot_bytes"), 6))
    return rows.withColumn("saved", saved)
