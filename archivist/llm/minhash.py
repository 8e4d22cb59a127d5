"""Near-duplicate documents by min-max hashing.

A document is its set of word shingles. Under each permutation both the least and the greatest
value are kept, so 60 permutations give a signature of 120; bands of 5 make the buckets in which
candidates meet. Documents with equal sets are one node. In a bucket, pairs are compared by parity
sketches, whose Hamming distance never exceeds the size of the symmetric difference: so no pair at
the threshold is passed over, and nearly all others are. Links are confirmed on the full sets.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from archivist.llm.common import mix64, packed, rows_with, shingles, small_batches, space_words, unpacked, written
from archivist.llm.components import components

PERMUTATIONS, BAND = 60, 5
BANDS = 2 * PERMUTATIONS // BAND
SKETCH = 2048
#: Members of a bucket that are compared in one task; a larger bucket is split into blocks.
BLOCK = 1024
#: Rows of buckets that are compared in one call.
GROUP = 2048

_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64)


def min_max(found: np.ndarray) -> np.ndarray:
    """Least values under all permutations, then the greatest ones."""
    low, high = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for k in range(0, len(found), 2048):
        values = np.multiply.outer(_A, found[k : k + 2048])
        values += _B[:, None]
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    return np.concatenate([low, high])


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit bucket for each row and band; buckets of different bands differ."""
    parts = signatures.reshape(len(signatures), BANDS, BAND)
    total = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F) + np.zeros((len(signatures), 1), np.uint64)
    for k in range(BAND):
        total = mix64(total * np.uint64(0xE7037ED1A0B428DB) + parts[:, :, k])
    return total.view(np.int64)


def parity_sketch(found: np.ndarray) -> bytes:
    """Bit h is set if an odd number of shingles hash to h."""
    bits = np.bincount((found >> np.uint64(53)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


_SIGNED = "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, keys array<long>, sketch binary"


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = space_words()
        for batch in batches:
            words, first = cut.of(batch.column(1))
            n, h1, h2, signed, sketches = [], [], [], [], []
            for found in shingles(words, first, width):
                n.append(len(found))
                h1.append(np.sum(mix64(found), dtype=np.uint64))
                h2.append(np.bitwise_xor.reduce(mix64(found + np.uint64(77))) if len(found) else np.uint64(0))
                signed.append(min_max(found))
                sketches.append(parity_sketch(found))
            keys = band_keys(np.stack(signed)) if signed else np.zeros((0, BANDS), np.int64)
            offsets = pa.array(np.arange(0, len(n) * BANDS + 1, BANDS, dtype=np.int32))
            as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), as_long(h1), as_long(h2), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())), pa.array(sketches, pa.binary())],
                names=["doc_id", "text_hash", "n_shingles", "h1", "h2", "keys", "sketch"],
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = space_words()
        for batch in batches:
            words, first = cut.of(batch.column(1))
            found = list(shingles(words, first, width))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            flat = np.concatenate([*found, words[:0]]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "items"])

    return run


def _compare(threshold: float, forest: bool):
    """Pairs of the same bucket block (rows of equal key, left and right) whose sketches allow the
    threshold and that neither meet in an earlier band nor are in one component: with ``forest``
    only as many as connect what they connect."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "left", "right", "id"], ignore_index=True)
        ids, n, comp, side, key = (rows[c].to_numpy() for c in ("id", "n", "comp", "side", "key"))
        split = (rows["left"] != rows["right"]).to_numpy()
        keys = np.stack(rows["keys"].to_numpy())
        band = (keys == key[:, None]).argmax(axis=1)
        sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint64).reshape(len(rows), -1)
        same = (rows[["key", "left", "right"]] == rows[["key", "left", "right"]].shift()).all(axis=1).to_numpy()
        block = np.cumsum(~same) - 1
        size = np.bincount(block)[block]
        found = []

        def keep(i: np.ndarray, j: np.ndarray) -> None:
            low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            ok = (comp[i] != comp[j]) & (low >= threshold * high - 1e-6) & ~(split[i] & (side[i] == side[j]))
            i, j = i[ok], j[ok]
            for at in range(0, len(i), 8192):
                x, y = i[at : at + 8192], j[at : at + 8192]
                apart = np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1, dtype=np.int64)
                ok = apart <= (1 - threshold) / (1 + threshold) * (n[x] + n[y]) + 1e-6
                x, y, apart = x[ok], y[ok], apart[ok]
                ok = ~((keys[x] == keys[y]) & (np.arange(BANDS) < band[x, None])).any(axis=1)
                found.append((x[ok], y[ok], apart[ok]))

        few = size <= 64
        for step in range(1, int(size[few].max(initial=1))):
            i = np.flatnonzero(few[:-step] & (block[:-step] == block[step:]))
            keep(i, i + step)
        for lo in np.flatnonzero(~same & ~few).tolist():
            hi = lo + int(size[lo])
            for i in range(lo, hi - 1):
                keep(np.full(hi - i - 1, i), np.arange(i + 1, hi))
        x, y, apart = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in range(3))
        if forest:
            nodes, at = np.unique(comp, return_inverse=True)
            root, chosen = list(range(len(nodes))), []

            def find(p: int) -> int:
                while root[p] != p:
                    root[p] = root[root[p]]
                    p = root[p]
                return p

            order = np.argsort(apart, kind="stable")
            for k, p, q in zip(order.tolist(), at[x[order]].tolist(), at[y[order]].tolist(), strict=True):
                if (p := find(p)) != (q := find(q)):
                    root[max(p, q)] = min(p, q)
                    chosen.append(k)
            x, y = x[chosen], y[chosen]
        return pd.DataFrame({"a": ids[x], "b": ids[y]})

    return run


def _met(nodes: DataFrame) -> DataFrame:
    """nodes with only those buckets, and their sizes, that hold two or more."""
    slim = nodes.select("id", F.explode("keys").alias("key"))
    sizes = slim.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = slim.join(sizes, "key").groupBy("id").agg(F.collect_list(F.struct("key", "size")).alias("buckets"))  # one a band at most
    return nodes.join(met, "id")


def _candidates(met: DataFrame, comps: DataFrame | None, threshold: float, forest: bool, groups: int) -> DataFrame:
    if comps is None:
        rows = met.withColumn("comp", F.col("id"))
    else:
        rows = met.join(comps.withColumnRenamed("component_id", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    rows = rows.select("id", "n", "comp", "keys", "sketch", F.explode("buckets").alias("b"))
    if comps is not None:  # buckets with one component are done
        open_ = rows.groupBy(F.col("b.key").alias("key")).agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
        rows = rows.join(open_, F.col("b.key") == F.col("key")).drop("key")
    parts = F.ceil(F.col("b.size") / BLOCK).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("side", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("id", "n", "comp", "keys", "sketch", "side", F.col("b.key").alias("key"), F.least("side", "other").alias("left"), F.greatest("side", "other").alias("right"))
    together = F.pmod(F.xxhash64("key", "left", "right"), F.lit(groups))  # many small buckets make one group
    return rows.groupBy(together).applyInPandas(_compare(threshold, forest), "a long, b long").distinct()


def _stars(met: DataFrame) -> DataFrame:
    """(a, b): for each row of a bucket of more than ``BLOCK`` the bucket's first row; of several such
    the one that it meets most often. So a large group of copies is linked by as many pairs as rows."""
    rows = met.select("id", F.explode("buckets").alias("b")).where(F.col("b.size") > BLOCK).select("id", F.col("b.key").alias("key"))
    first = rows.groupBy("key").agg(F.min("id").alias("a"))
    times = rows.join(first, "key").where("a <> id").groupBy("id", "a").agg(F.count(F.lit(1)).alias("n"))
    return times.groupBy(F.col("id").alias("b")).agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b")


#: Numbers of nodes that are a document's second set, or a later one, begin here; ids of documents are below.
SECOND = 1 << 62
_SET = ["n_shingles", "h1", "h2"]


def _nodes(signed: DataFrame) -> DataFrame:
    """A row for each different set: id, own and text_hash (of the first document that has it), keys and
    sketch. The id is that document's, or a number of its own where that has several such sets."""
    own = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))).alias("own")
    nodes = signed.where("n_shingles > 0").groupBy(*_SET).agg(own, F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    nodes = nodes.where("own is not null").select(*_SET, F.col("own.doc_id").alias("own"), "own.text_hash", "keys", "sketch")
    nodes = written(nodes.withColumn("id", F.col("own")))
    several = nodes.groupBy("own").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("own")
    if several.isEmpty():
        return nodes
    mine = rows_with(nodes, several, ["own"])
    place = F.row_number().over(W.partitionBy("own").orderBy(*_SET))  # sets of one document
    number = F.when(place == 1, F.col("own")).otherwise(F.lit(SECOND) + F.pmod(F.xxhash64(*_SET), F.lit(1 << 61)))
    return written(nodes.join(several, "own", "left_anti").unionByName(mine.withColumn("id", number)))


def _same_document(signed: DataFrame, nodes: DataFrame, repeated: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of documents that have several rows."""
    rows = rows_with(signed.where("n_shingles > 0").select("doc_id", *_SET), repeated, ["doc_id"])
    met = written(rows.distinct().join(nodes.select(*_SET, "id"), _SET).select("doc_id", "id"))
    return met.join(met.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").where("id <> a").select("a", F.col("id").alias("b")).distinct()


def _confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union, on full sets."""
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = written(nodes.join(wanted, "id", "left_semi").select("id", F.col("own").alias("doc_id"), "text_hash"))
    rows = rows_with(docs, texts.select("doc_id", "text_hash"), ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    rows = rows.join(texts, ["doc_id", "text_hash"])
    sets = written(rows.select("id", "text").mapInArrow(_sets(width), "id long, items array<long>"))
    first, second = sets.select(F.col("id").alias("a"), F.col("items").alias("x")), sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    both = pairs.join(first, "a").join(second, "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def labelled(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, percent: int = 85) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), n_shingles, component_id and kept of every row of ``docs``.

    Texts that are null or without words have no shingles and link with nothing. Rows with equal
    sets are always linked. Rows with the same key are one document, which is linked by any of its
    texts; in whatever order rows come, results are the same. A row without key belongs to the component
    of documents with the same set and isn't kept if there are any. An empty table gives an empty result,
    very long texts are taken whole, other columns are ignored.

    The chance that a pair at similarity s shares no band is (1 - s^5)^24, below 8e-7 at 0.85.
    In large buckets every row is first compared with one other. Then all pairs of a bucket that lie
    between different components are compared, in blocks: first so many candidates are confirmed as
    connect each block, then all that still lie between different components.
    """
    small_batches(docs.sparkSession)
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    signed = written(plain.select("doc_id", "text", "text_hash").mapInArrow(_sign(width), _SIGNED))
    nodes = _nodes(signed)
    repeated = written(signed.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    again = not repeated.isEmpty()
    met = written(_met(nodes.select("id", F.col("n_shingles").alias("n"), "keys", "sketch")))
    threshold = percent / 100
    groups = max(1, -(-(met.agg(F.sum(F.size("buckets"))).first()[0] or 0) // GROUP))
    links = [written(_same_document(signed, nodes, repeated))] if again else []
    star = written(_stars(met))
    if not star.isEmpty():
        links.append(written(_confirmed(star, plain, nodes, width, percent)))
    comps = components(functools.reduce(DataFrame.unionByName, links)) if links else None
    links.append(written(_confirmed(written(_candidates(met, comps, threshold, True, groups)), plain, nodes, width, percent)))
    comps = components(functools.reduce(DataFrame.unionByName, links))
    more = written(_confirmed(written(_candidates(met, comps, threshold, False, groups)), plain, nodes, width, percent))
    if not more.isEmpty():
        comps = components(functools.reduce(DataFrame.unionByName, [*links, more]))
    labels = nodes.join(comps, "id", "left").select(*_SET, F.coalesce("component_id", "id").alias("component_id"))
    rows = signed.select("doc_id", "text_hash", *_SET).join(labels, _SET, "left")
    component = F.coalesce("component_id", "doc_id")
    if again:  # a document's texts without words go with its others
        rows = written(rows)
        least = rows_with(rows, repeated, ["doc_id"]).groupBy("doc_id").agg(F.min("component_id").alias("least"))
        rows = rows.join(least, "doc_id", "left")
        component = F.coalesce("least", "component_id", "doc_id")
    return rows.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``; see `labelled`."""
    return labelled(docs, text, key, width, percent).drop("text_hash")


def without_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` that are kept, of rows with the same key and text one. Columns of any name
    are left as they are."""
    names = ["row_key", "row_hash"]
    found = labelled(docs, text, key, width, percent).where("kept").groupBy(F.col("doc_id").alias("row_key"), F.col("text_hash").alias("row_hash")).count()
    found = written(found)
    rows = packed(docs)
    on = F.col(f"row.`{key}`").cast("long").eqNullSafe(F.col("row_key")) & (F.xxhash64(f"row.`{text}`") == F.col("row_hash"))
    kept = rows.join(found, on).select("row", "count", *names)
    again = kept.where("count > 1").dropDuplicates(names)  # only rows that are repeated are shuffled for this
    return unpacked(kept.where("count = 1").select("row").unionByName(again.select("row")), docs.columns)
