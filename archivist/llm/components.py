"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivist.llm.common import written


def _least(pairs: DataFrame) -> DataFrame:
    """For each a the least of a and its bs."""
    return pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """(id, component_id) of every node of ``links`` (a, b): the least id reachable.

    Large-star and small-star steps in turn until nothing changes, about log(nodes) rounds of two
    joins; each round's links are written to the shared folder. No node's neighbours are gathered.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_least(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = _least(large)
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())
