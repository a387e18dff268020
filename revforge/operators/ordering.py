"""Exact, distributed row positions.

A ``row_number()`` over an un-partitioned window pulls every row into one task. Instead we
range-partition on the ordering, number rows locally, and add per-partition offsets. The offsets
table has one row per partition, so it is bounded by the partition count and safe to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .joins import checked_broadcast

MAX_BROADCAST_GROUPS = 100_000
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row index in the low 33 bits


def ordered_index(df: DataFrame, order: list[Column | str], name: str = "pos",
                  num_partitions: int | None = None) -> DataFrame:
    """Add ``name``: the 1-based position of each row under ``order`` (which must be a total order).

    Runs as: range shuffle on the order -> local sort -> positional id -> checkpoint (the ids are
    positional, so the numbered table is written once as Parquet and reused) -> broadcast join of the
    per-partition offsets.
    """
    # Without an explicit count the range shuffle uses the session default and AQE may merge
    # adjacent (small) ranges; merged ranges stay contiguous, so the order is kept.
    ranged = df.repartitionByRange(num_partitions, *order) if num_partitions else df.repartitionByRange(*order)
    numbered = materialize(
        ranged
        .sortWithinPartitions(*order)
        .withColumn("_mono", F.monotonically_increasing_id())
    )
    part = F.shiftright(F.col("_mono"), _LOCAL_BITS)
    local = F.col("_mono").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    counts = numbered.groupBy(part.alias("_pid")).agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    return (
        numbered.join(F.broadcast(offsets), part == F.col("_pid"))
        .withColumn(name, (F.col("_off") + local + F.lit(1)).cast("long"))
        .drop("_mono", "_pid", "_off")
    )


def rank_within(df: DataFrame, groups: list[str], order: list[Column | str], name: str = "rank",
                num_partitions: int | None = None) -> DataFrame:
    """1-based row number inside each group under ``order``, without a per-group single task.

    A hot group is spread over many range partitions; its first global position is the group's
    offset, found by one small aggregation (one row per group) and broadcast behind a check of its size, so
    that the rows of a hot group are not hashed into one task.
    """
    ranked = ordered_index(df, [F.col(g) for g in groups] + list(order), name="_gpos",
                           num_partitions=num_partitions)
    starts = ranked.groupBy(*groups).agg(F.min("_gpos").alias("_gstart"))
    starts = starts.select([F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)] + ["_gstart"])
    # by name: a table that had to be written for the size check is another relation than ``starts``
    cond = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)]
    return (
        ranked.join(checked_broadcast(starts, MAX_BROADCAST_GROUPS), cond)
        .withColumn(name, (F.col("_gpos") - F.col("_gstart") + F.lit(1)).cast("long"))
        .drop("_gpos", "_gstart", *[f"_g{i}" for i in range(len(groups))])
    )
