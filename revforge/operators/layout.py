"""Row layout before heavy per-row work: spread coarse inputs over the cluster.

A scan yields one task per file split (row group). A table stored as a few large row groups (the
test tables are one row group each) would run all tokenizing in a handful of tasks. When the
optimizer's size estimate says the input is smaller than one split per core, the rows are
hash-partitioned by their key over the cluster's parallelism; a big input (many splits) is left as
it is, so no shuffle is added at scale. Hashing on the key also lets a later aggregation keyed by
it (term frequencies per text) reuse the partitioning instead of shuffling again.

Why the threshold is "fewer splits than cores": the regex tokenizer runs at about 1 MB/s per core,
while a shuffle moves tens of MB/s per core, so moving the text costs a few percent of tokenizing
it; whenever the scan would leave cores idle, spreading pays for itself. Keys are text ids (one row
each), so the hash layout has no hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .joins import plan_bytes

# Bytes of input files in one partition of ``by_key``: a few times that in token rows of one task.
KEYED_BYTES = 8 << 20
NO_ESTIMATE = 1 << 50


def largest_input_bytes(df: DataFrame) -> int:
    """Size estimate of the largest relation ``df`` scans (a leaf of its optimized plan).

    Unlike the estimate of the whole plan (which multiplies the sides of a join), a leaf's size is
    the bytes of its files, which is what decides how many splits its scan has."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [plan_bytes(leaves.apply(i)) for i in range(leaves.size())]
        return max(sizes) if sizes else 0
    except Exception:  # noqa: BLE001 - no estimate: treat as large (leave the layout alone)
        return 1 << 62


def split_bytes(df: DataFrame) -> int:
    raw = df.sparkSession.conf.get("spark.sql.files.maxPartitionBytes", "134217728")
    raw = str(raw).strip().lower()
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    for suffix in ("kb", "mb", "gb", "k", "m", "g", "b"):
        if raw.endswith(suffix):
            num = raw[: -len(suffix)]
            return int(float(num) * units.get(suffix[0], 1))
    return int(raw)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` hash-partitioned by ``key`` over the cluster's cores when its input is too coarse to
    keep them busy; otherwise ``df`` unchanged (decided at plan time, no job is run)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if largest_input_bytes(df) >= cores * split_bytes(df):
        return df
    return df.repartition(cores, key)


def input_bytes(df: DataFrame) -> int:
    """Size estimate of all relations that ``df`` scans."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        return sum(plan_bytes(leaves.apply(i)) for i in range(leaves.size()))
    except Exception:  # noqa: BLE001 - no estimate
        return 1 << 62


def parts_of(df: DataFrame, each: int) -> int:
    """How many parts of about ``each`` bytes of input files ``df`` has, at least one a core."""
    cores, size = df.sparkSession.sparkContext.defaultParallelism, input_bytes(df)
    return cores if size >= NO_ESTIMATE else max(cores, -(-size // each))


def by_key(df: DataFrame, key: str) -> DataFrame:
    """``df`` hash-partitioned by ``key`` in parts of about ``KEYED_BYTES`` of input, whatever the input's size: what an
    aggregate by ``key`` and more holds in one task does not grow, and it moves the texts once instead of their terms."""
    return df.repartition(parts_of(df, KEYED_BYTES), key)
