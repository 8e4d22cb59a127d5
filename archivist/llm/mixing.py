"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words. A document's expected number of copies is its source's
target over the source's size; the expected copies are summed along the documents of the source,
a random offset is added once, and a document is taken once for every whole number crossed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from archivist.llm.common import WORD, packed, written


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash30(*cols: Column | str) -> Column:
    """30 bits of md5 of the columns' text, which other engines compute alike."""
    text = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("~")) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long").bitwiseAND((1 << 30) - 1)


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds target to rows of (source, source_size), one row a source.

    Sources in code-point order, null last, weigh ``weights``, repeating, and share ``share`` times
    all sizes. A target stops at ``most`` times the source's size; what is over goes to the other
    sources by weight until none is above: the water level is where the sources that fill first,
    taken in order of cap / weight, leave a level that the next one can hold.
    The windows run over one row a source, not over documents.
    """
    k = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (k % len(weights) + 1).cast("int"))
    one = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_fill = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = W.partitionBy()
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    one = one.withColumns(
        {
            "total": F.sum("source_size").over(every) * F.lit(float(share)),
            "left": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
            "full": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        }
    )
    level = (F.col("total") - F.col("full")) / F.col("left")
    fits = level <= F.col("cap") / F.col("weight")
    first = by_fill.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    one = one.withColumn("level", F.first(F.when(fits, level), ignorenulls=True).over(first))
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return one.withColumn("target", target)


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2, buckets: int = 16) -> DataFrame:
    """All rows of ``docs`` with size, source_size, target, copies and taken (= copies * size).

    The documents of a source are put in order of size class (leading bits of the size), a hash
    bucket, and the hash and key inside it, so that long and short ones are taken alike. A bucket's
    offset comes from the counts of (source, class, bucket), so no task sees a whole source.
    ``buckets`` splits a size class; a bucket holds its source's rows over classes and buckets.
    Null texts have size 0 and are taken 0 words; null sources are one source, the last; repeated
    keys are documents of their own, in order of a hash of their texts; an empty table gives an empty
    result; very long texts are counted whole; columns of ``docs`` with the names of results are
    replaced, all others stay as they are.
    """
    results = ("size", "source_size", "target", "copies", "taken")
    stay = [c for c in docs.columns if c not in results]
    key, source, text = (F.col(f"row.`{c}`") for c in (key, source, text))
    rows = packed(docs).withColumn("size", n_words(text))
    bits = F.bin("size")
    rows = rows.withColumns(
        {
            # null as a value of its own, so that counts and rows meet by equality
            "_src": F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("z")),
            "_len": F.length(bits),
            "_top": F.substring(bits, 1, 6),
            "_h": hash30(key),
        }
    ).withColumn("_b", F.col("_h") % buckets)
    group = ["_src", "_len", "_top", "_b"]
    counts = written(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_words"), F.first(source).alias("source")))
    sizes = counts.groupBy("_src", "source").agg(F.sum("_words").alias("source_size"))
    targets = source_targets(sizes, weights, share, float(most))
    order = W.partitionBy("_src").orderBy("_len", "_top", "_b")
    offsets = counts.select(*group, (F.sum("_n").over(order) - F.col("_n")).alias("_before"))
    offsets = offsets.join(targets.select("_src", "source_size", "target"), "_src")
    ranked = rows.withColumn("_k", F.row_number().over(W.partitionBy(*group).orderBy("_h", key, F.xxhash64(text))))
    full = ranked.join(offsets, group)
    each = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    start = hash30(source, F.lit("offset")) / F.lit(float(1 << 30))
    at = F.col("_before") + F.col("_k")
    copies = F.floor(start + each * at) - F.floor(start + each * (at - 1))
    full = full.withColumn("copies", F.greatest(F.lit(0), F.least(copies, F.lit(most))).cast("long"))
    full = full.withColumn("taken", F.col("copies") * F.col("size"))
    return full.select(*[F.col(f"row.`{c}`").alias(c) for c in stay], *results)


def mixing(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    return mix(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")
