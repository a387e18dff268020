"""Training-log operators.

A log is ``run, ts, seq, kind ('train' | 'eval'), loss``. The carry "each eval entry gets the
latest training loss of its run" is a segmented scan. A plain ``Window.partitionBy(run)`` would put
a hot run in one task, so the scan is done in blocks:

1. number all entries in (run, ts, seq) order with range partitions (``ordered_index``);
2. cut the order into blocks of ``block_rows`` positions; a window per (run, block) carries inside
   the block (each window group holds at most ``block_rows`` rows);
3. per (run, block) keep the block's last training loss (a partial/final aggregate), carry it
   across the blocks of a run with a window over that block table (``rows / block_rows`` rows);
4. an entry takes its in-block value, else the carried value of the earlier blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import ordered_index, rank_within

BLOCK_ROWS = 100_000


def carry_last(log: DataFrame, run: list[str], order: list[str], value: str, when_col, out: str,
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``out``: the last ``value`` among earlier-or-same rows of the run where ``when_col`` holds."""
    keyed = log.withColumn("_take", when_col)
    pos = ordered_index(keyed, [F.col(c) for c in run + order], name="_pos")
    pos = pos.withColumn("_blk", F.expr(f"(_pos - 1) div {block_rows}"))
    cand = F.when(F.col("_take"), F.struct(F.col("_pos").alias("p"), F.col(value).alias("v")))
    inner = Window.partitionBy(*run, "_blk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    pos = pos.withColumn("_in", F.max(cand).over(inner))
    blocks = pos.groupBy(*run, "_blk").agg(F.max(cand).alias("_last"))
    across = Window.partitionBy(*run).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*run, "_blk", F.max("_last").over(across).alias("_prev"))
    cond = [pos[c].eqNullSafe(blocks[c]) for c in run] + [pos["_blk"] == blocks["_blk"]]
    j = pos.join(blocks, cond, "left").select(pos["*"], blocks["_prev"])
    return j.withColumn(out, F.coalesce(F.col("_in.v"), F.col("_prev.v"))).drop(
        "_take", "_pos", "_blk", "_in", "_prev")


def loss_carry(log: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Eval entries with the latest training loss of the same run (null when none)."""
    is_train = (F.col("kind") == "train") & F.col("loss").isNotNull()
    carried = carry_last(log, ["run"], ["ts", "seq"], "loss", is_train, "training_loss", block_rows)
    return carried.filter(F.col("kind") == "eval").select(
        "run", "ts", "seq", "training_loss", F.col("loss").alias("validation_loss"))


def loss_log_snapshots(log: DataFrame, folds: int, fold_col: str = "fold",
                       block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The cumulative log as written after each fold.

    One log spans all folds (ordered by fold, then time), so the carry crosses fold boundaries.
    Snapshot k holds the eval entries of folds <= k except fold k's last one (the extra evaluation
    logged after the save). Each entry is emitted once per snapshot that holds it (an explode).
    """
    one = log.withColumn("_all", F.lit(0))
    is_train = (F.col("kind") == "train") & F.col("loss").isNotNull()
    carried = carry_last(one, ["_all"], [fold_col, "ts", "seq"], "loss", is_train, "training_loss", block_rows)
    evals = carried.filter(F.col("kind") == "eval")
    last = evals.groupBy(fold_col).agg(F.max(F.struct("ts", "seq")).alias("_last"))
    evals = evals.join(last, fold_col).withColumn(
        "_is_last", (F.col("ts") == F.col("_last.ts")) & (F.col("seq") == F.col("_last.seq")))
    snaps = evals.withColumn("snapshot", F.explode(F.sequence(F.col(fold_col), F.lit(folds - 1))))
    snaps = snaps.filter(~(F.col("_is_last") & (F.col("snapshot") == F.col(fold_col))))
    return snaps.select("snapshot", fold_col, "run", "ts", "seq", "training_loss",
                        F.col("loss").alias("validation_loss"))


def best_epoch(history: DataFrame, run: str, order: list[str], metric: str) -> DataFrame:
    """Per run, the first iteration with a strictly greater metric (start 0; none if all <= 0).

    Iterations are numbered per run with range partitions; the pick is a grouped min of
    (-metric, iteration), i.e. a partial + final aggregate.
    """
    it = rank_within(history, [run], [F.col(c) for c in order], name="iteration")
    good = it.filter(F.col(metric) > 0)
    best = good.groupBy(run).agg(F.min(F.struct((-F.col(metric)).alias("neg"), F.col("iteration"))).alias("b"))
    return best.select(run, F.col("b.iteration").alias("best_iteration"), (-F.col("b.neg")).alias("best_metric"))
