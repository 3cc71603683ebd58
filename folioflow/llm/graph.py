"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.store import stored


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long -> (node, component): each node that has an edge and the smallest node it reaches.

    Every round joins each node's neighbours to the smallest of them, first the
    larger ones, then the smaller ones, until all edges are stars. A round is a
    written table; nothing is gathered on the driver but two sums. A star of any
    size stays rows of a join, never one row.

    No edges: no rows. Nulls, self-loops and repeated edges: ignored.
    """
    e = stored(_clean(edges.select(F.col("a").cast("long"), F.col("b").cast("long"))), "edges")
    before = _sums(e)
    while before[0]:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(_clean(large), "large")
        # large holds each edge from its larger end: its groups are the smaller neighbours
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = stored(_clean(small.unionAll(least.select("a", F.col("m").alias("b")))), "small")
        if (now := _sums(e)) == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(e.select(F.col("b"), F.col("b")).distinct())


def _clean(e: DataFrame) -> DataFrame:
    """Each edge once, from its larger end."""
    return e.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _sums(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
