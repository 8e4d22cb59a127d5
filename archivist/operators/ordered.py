"""What depends on order along a key, however many rows a key has: rows are dealt to ranges of the
whole order, each range is worked on by itself, and what goes on from one range to the next is a table
with a row a range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from archivist.operators.cells import kept


def in_ranges(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``pid``, the number of their range in the order of these columns; written, so that
    ranges stay as they are. Rows that are equal in all of them are in one range."""
    return kept(rows.repartitionByRange(*order).withColumn("pid", F.spark_partition_id()), "ranges")


def last_value(rows: DataFrame, asked: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``asked`` (key, at), each once, with the value of the last of ``rows`` (key, at, value) of its key
    up to that place, of equal places the greatest value; null if there is none."""
    events = rows.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, at, F.lit(0).alias("kind"), F.struct(value).alias("v"))
    wanted = asked.select(key, at).distinct()
    events = in_ranges(events.unionByName(wanted.withColumn("kind", F.lit(1)), allowMissingColumns=True), key, at, "kind", "v")
    here = W.partitionBy("pid", key).orderBy(at, "kind", "v").rowsBetween(W.unboundedPreceding, 0)
    events = events.withColumn("found", F.last("v", ignorenulls=True).over(here))
    ends = events.groupBy("pid").agg(F.max(F.when(F.col("kind") == 0, F.struct(F.col(key).alias("key"), F.col(at).alias("at"), "v"))).alias("end"))
    before = W.orderBy("pid").rowsBetween(W.unboundedPreceding, -1)  # over a row a range
    carried = ends.select("pid", F.last("end", ignorenulls=True).over(before).alias("end"))
    out = events.where("kind = 1").join(F.broadcast(carried), "pid")
    found = F.coalesce("found", F.when(F.col("end.key") == F.col(key), F.col("end.v")))
    return out.select(key, at, found[value].alias(value))


def running_total(rows: DataFrame, key: str, order: str, number: str, name: str) -> DataFrame:
    """(key, order, name): the sum of ``number`` over the rows of the key that come before."""
    rows = in_ranges(rows.select(key, order, number), key, order)
    here = W.partitionBy("pid", key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_here", F.coalesce(F.sum(number).over(here), F.lit(0)))
    totals = rows.groupBy(key, "pid").agg(F.sum(number).alias("_n"))  # ranges that a key is in
    earlier = F.coalesce(F.sum("_n").over(W.partitionBy(key).orderBy("pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(F.col(key).alias("_key"), F.col("pid").alias("_pid"), earlier.alias("_before"))
    out = rows.join(totals, F.col(key).eqNullSafe(F.col("_key")) & (F.col("pid") == F.col("_pid")))
    return out.select(key, order, (F.col("_before") + F.col("_here")).alias(name))


def in_segments(rows: DataFrame, key: str, at: str, tie: str, gap: int) -> DataFrame:
    """``rows`` with ``segment`` (range, number): a key's rows between gaps of ``gap`` or more along ``at``.

    A segment that goes on over ranges has the name that it began with; which do is resolved from the
    first and last rows of the ranges, on the driver.
    """
    rows = in_ranges(rows, key, at, tie)
    here = W.partitionBy("pid", key).orderBy(at, tie)
    cut = F.coalesce(F.col(at) - F.lag(at).over(here) >= gap, F.lit(True))
    rows = kept(rows.withColumn("_cut", cut).withColumn("_number", F.sum(F.col("_cut").cast("int")).over(here.rowsBetween(W.unboundedPreceding, 0))), "cuts")
    place = F.struct(F.col(key).alias("key"), F.col(at).alias("at"), F.col("_number").alias("number"))
    ends = rows.groupBy("pid").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count_if("_cut").alias("cuts")).orderBy("pid").collect()  # a row a range
    names, before, name = [], None, None
    for r in ends:
        goes_on = before is not None and r.first.key == before.key and r.first.at - before.at < gap
        if goes_on:
            names.append((r.pid, *name))
        if not (goes_on and r.cuts == 1):
            name = (r.pid, r.last.number)
        before = r.last
    linked = rows.sparkSession.createDataFrame(names, "pid int, _range int, _begun long")
    firsts = rows.sparkSession.createDataFrame([(r.pid, r.first.key) for r in ends], f"pid int, _first {dict(rows.dtypes)[key]}")
    out = rows.join(F.broadcast(firsts.join(linked, "pid")), "pid", "left")
    mine = (F.col("_number") == 1) & F.col("_first").eqNullSafe(F.col(key)) & F.col("_range").isNotNull()
    segment = F.struct(F.when(mine, F.col("_range")).otherwise(F.col("pid")).alias("range"), F.when(mine, F.col("_begun")).otherwise(F.col("_number")).alias("number"))
    return out.withColumn("segment", segment).drop("pid", "_cut", "_number", "_first", "_range", "_begun")
