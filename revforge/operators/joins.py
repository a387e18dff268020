"""Join helpers: broadcast only behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# Plans whose optimizer size estimate is at most this many bytes are broadcast without counting.
# Kept below Spark's own 10 MB default: estimates of exploded (token) tables can undercount.
BROADCAST_BYTES = 8 * 1024 * 1024
# Bytes of Parquet files of a written table that is broadcast (some four times that in memory).
WRITTEN_BYTES = 32 * 1024 * 1024
# Keys whose rows are joined by broadcast beside a shuffle join, and counters of the sketch that finds them.
HEAVY_KEYS, TRACKED_KEYS = 500, 10_000


def plan_bytes(plan) -> int:
    """``sizeInBytes`` of a logical plan's statistics (py4j hands a BigInt over as int or object)."""
    v = plan.stats().sizeInBytes()
    return v if isinstance(v, int) else int(v.toString())


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of ``df`` (an upper bound for scans of written tables and
    local data; the same statistic Spark uses for its own broadcast threshold)."""
    try:
        return plan_bytes(df._jdf.queryExecution().optimizedPlan())
    except Exception:  # noqa: BLE001 - no estimate: treat as large
        return 1 << 62


def is_plain_scan(df: DataFrame) -> bool:
    """True when ``df`` is a file scan under projections / filters only (a written table): counting
    it reads Parquet footers and column chunks of one table, with no joins or aggregates to redo."""
    try:
        node = df._jdf.queryExecution().optimizedPlan()
        while node.nodeName() in ("Project", "Filter"):
            node = node.child()
        return node.nodeName() in ("Relation", "LogicalRelation")
    except Exception:  # noqa: BLE001
        return False


def small_enough(df: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> tuple[bool, DataFrame]:
    """Whether ``df`` may be broadcast, and the table to join (written, if it had to be).

    First the optimizer's byte estimate (free). If that is not conclusive (estimates above joins and
    aggregates multiply or keep their inputs' sizes), ``df`` is written once under the checkpoint folder, and
    both its row count (Parquet footers) and the bytes of its files are held against the bounds; the join
    then reads the written table, so the side is computed once, not once for the check and again for the join.
    """
    if estimated_bytes(df) <= max_bytes:
        return True, df
    written = df if is_plain_scan(df) else materialize(df)
    return estimated_bytes(written) <= WRITTEN_BYTES and written.count() <= max_rows, written


def checked_broadcast(df: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only when its size is known to be small, else leave the choice to the planner."""
    small, table = small_enough(df, max_rows, max_bytes)
    return F.broadcast(table) if small else table


def heavy_keys(df: DataFrame, key: str, k: int = HEAVY_KEYS, tracked: int = TRACKED_KEYS) -> DataFrame:
    """The (about) ``k`` commonest values of ``key`` by a mergeable frequent-items sketch: a written table of at most
    ``k`` rows. Each map task sends one sketch of ``tracked`` counters."""
    top = df.agg(F.expr(f"approx_top_k({key}, {k}, {tracked})").alias("top"))
    return materialize(top.select(F.explode("top").alias("t")).select(F.col("t.item").alias(key)).where(F.col(key).isNotNull()))


def term_join(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", max_rows: int = 2_000_000,
              max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` joined to ``table`` (one row per ``key``), where a few keys hold most of ``rows``.

    A table of checked small size is broadcast whole. Beyond that the rows of the heaviest keys (``heavy_keys``, at most
    ``HEAVY_KEYS`` rows of ``table``) meet a broadcast of just these keys, and only the light rest is shuffled by key,
    so no commonest word is ever one task's key. ``rows`` is read once for the sketch and once for each part."""
    small, table = small_enough(table, max_rows, max_bytes)
    if small:
        return rows.join(F.broadcast(table), key, how)
    hot = F.broadcast(heavy_keys(rows, key))
    heavy = rows.join(hot, key, "left_semi").join(F.broadcast(table.join(hot, key, "left_semi")), key, how)
    light = rows.join(hot, key, "left_anti").join(table.join(hot, key, "left_anti"), key, how)
    return heavy.unionByName(light)
