"""Connected components of an edge table by alternating large and small stars; nothing leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node of the component. ``edges``: a, b (any order, any orderable type).

    Each round joins every node with the least of its neighbours, so a node with many neighbours is
    only ever aggregated (with partial sums) and joined, never collected. Every round is written out.
    """
    now = materialize(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = materialize(both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("a"), F.col("b"), "m")
        hooked = small.select(F.col("a"), F.col("m").alias("b")).unionByName(small.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")))
        now = materialize(hooked.where(F.col("a") != F.col("b")).distinct())
        mark, before = _mark(now), mark
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]
