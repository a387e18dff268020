"""Deterministic holdout splits and k-folds.

Rows are ordered by ``md5('<seed>:<id>')`` (ties by id), which every SQL engine computes alike, so
membership is reproducible and checkable. The order is found by hash cells: the first digits of the hash cut every
class into ``16 ** CELL_DIGITS`` cells of even size. Counts per (class, cell), a small table, say where each cell
starts in its class, so

* a holdout split needs no numbering at all: only the cell that holds the cut is ranked, and a row is on the train
  side if its key is not behind the cut's (a comparison in the scan);
* a fold, which needs the rank itself, is the cell's start plus the rank within the cell, one shuffle by (class, cell).

Nothing is range-sorted or written, and a class with a third of all rows is spread over its cells.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import SEED, TEST_SHARE
from ..functions.hashing import hash_key
from ..session import materialize
from .joins import checked_broadcast

MAX_ALLOCATION_ROWS = 1_000_000
CELL_DIGITS = 3
MAX_CELL_ROWS = 1_000_000


def _share(share: float) -> tuple[int, int]:
    f = Fraction(share).limit_denominator(1_000_000)
    return f.numerator, f.denominator


def class_allocation(df: DataFrame, label: str, test_share: float = TEST_SHARE,
                     groups: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """``[groups..], label, n_class, n_train_class``: train rows per class, shares kept exactly.

    n_test = ceil(n * share); per class floor(n_c * n_train / n), the left-over rows going to the
    largest remainders (ties by label). Integer arithmetic only; the table has one row per
    (group, class), so its windows are small. ``weight``: a column of row counts, where ``df`` has counted already.
    """
    groups = groups or []
    num, den = _share(test_share)
    cls = df.groupBy(*groups, label).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n_class"))
    everything = Window.partitionBy(*groups)
    cls = cls.withColumn("_n", F.sum("n_class").over(everything))
    cls = cls.withColumn("_ntrain", F.col("_n") - F.expr(f"(_n * {num} + {den - 1}) div {den}"))
    cls = cls.withColumn("_fl", F.expr("(n_class * _ntrain) div _n")).withColumn(
        "_rem", F.expr("(n_class * _ntrain) % _n"))
    cls = cls.withColumn("_left", F.col("_ntrain") - F.sum("_fl").over(everything))
    cls = cls.withColumn("_rr", F.row_number().over(
        Window.partitionBy(*groups).orderBy(F.col("_rem").desc(), F.col(label))))
    return cls.select(
        *groups, label, "n_class",
        (F.col("_fl") + F.when(F.col("_rr") <= F.col("_left"), 1).otherwise(0)).cast("long").alias("n_train_class"))


def cell_counts(keyed: DataFrame, groups: list[str]) -> DataFrame:
    """``[groups..], _cell, _in``: one pass over the rows; a written table of groups x cells rows."""
    return materialize(keyed.groupBy(*groups, "_cell").agg(F.count(F.lit(1)).alias("_in")))


def cell_starts(counts: DataFrame, groups: list[str]) -> DataFrame:
    """Add ``_before``: rows of the group in earlier cells."""
    before = Window.partitionBy(*groups).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0)))


def with_hash(df: DataFrame, key: str, seed: int) -> DataFrame:
    hashed = df.withColumn("_h", hash_key(seed, key))
    return hashed.withColumn("_cell", F.substring(F.coalesce("_h", F.lit("0" * 32)), 1, CELL_DIGITS))


def renamed(df: DataFrame, keys: list[str], *others: str) -> tuple[DataFrame, list[Column]]:
    """A small table with its keys renamed, and the null-safe join conditions with the rows."""
    return (df.select(*[F.col(k).alias(f"_a{i}") for i, k in enumerate(keys)], *others),
            [F.col(k).eqNullSafe(F.col(f"_a{i}")) for i, k in enumerate(keys)])


def cell_rank(keyed: DataFrame, counts: DataFrame, groups: list[str], key: str, name: str = "_r") -> DataFrame:
    """Add ``name``: the 1-based position in hash order within the group."""
    keys = [*groups, "_cell"]
    starts, cond = renamed(cell_starts(counts, groups), keys, "_before")
    local = F.row_number().over(Window.partitionBy(*keys).orderBy("_h", key))
    return (keyed.withColumn("_l", local).join(checked_broadcast(starts, MAX_CELL_ROWS), cond)
            .withColumn(name, (F.col("_before") + F.col("_l")).cast("long"))
            .drop("_h", "_cell", "_l", "_before", *[f"_a{i}" for i in range(len(keys))]))


def train_cut(keyed: DataFrame, counts: DataFrame, groups: list[str], key: str, wanted: DataFrame) -> DataFrame:
    """``[groups..], _cut``: the (hash, key) of the last train row of each group. ``wanted``: groups, n_train_class.

    The cell with the cut follows from the cell counts; of the rows only that cell's are ranked."""
    wanted, cond = renamed(wanted, groups, "n_train_class")
    at = cell_starts(counts, groups).join(checked_broadcast(wanted, MAX_ALLOCATION_ROWS), cond or F.lit(True)).filter(
        (F.col("_before") < F.col("n_train_class")) & (F.col("_before") + F.col("_in") >= F.col("n_train_class")))
    keys = [*groups, "_cell"]
    at, cond = renamed(at.select(*keys, (F.col("n_train_class") - F.col("_before")).alias("_rest")), keys, "_rest")
    inside = keyed.select(*keys, "_h", key).join(checked_broadcast(at, MAX_ALLOCATION_ROWS), cond)
    ranked = inside.withColumn("_l", F.row_number().over(Window.partitionBy(*keys).orderBy("_h", key)))
    return ranked.filter(F.col("_l") == F.col("_rest")).select(*groups, F.struct("_h", F.col(key).alias("_k")).alias("_cut"))


def split_stratified(df: DataFrame, label: str = "label", key: str = "row_id", test_share: float = TEST_SHARE,
                     seed: int = SEED, groups: list[str] | None = None) -> DataFrame:
    """Add ``split`` = train/test with class shares kept (per group when ``groups`` is given)."""
    groups = groups or []
    keys = groups + [label]
    keyed = with_hash(df, key, seed)
    narrow = keyed.select(*dict.fromkeys([*keys, "_cell", "_h", key]))
    counts = cell_counts(narrow, keys)
    alloc = class_allocation(counts, label, test_share, groups, "_in")
    cuts, cond = renamed(train_cut(narrow, counts, keys, key, alloc), keys, "_cut")
    # one row per (group, class): broadcast behind a size check
    j = keyed.join(checked_broadcast(cuts, MAX_ALLOCATION_ROWS), cond, "left")
    return _by_cut(j, key).drop("_h", "_cell", "_cut", *[f"_a{i}" for i in range(len(keys))])


def _by_cut(j: DataFrame, key: str) -> DataFrame:
    train = F.struct("_h", F.col(key).alias("_k")) <= F.col("_cut")
    return j.withColumn("split", F.when(F.coalesce(train, F.lit(False)), F.lit("train")).otherwise(F.lit("test")))


def train_rows(n: Column, test_share: float) -> Column:
    """Rows of the train part of n: the test part is rounded up."""
    num, den = _share(test_share)
    return n - F.floor((n * num + (den - 1)) / den).cast("long")


def split_random(df: DataFrame, key: str = "row_id", test_share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Add ``split``; the first n_train rows in hash order are train."""
    keyed = with_hash(df, key, seed)
    narrow = keyed.select("_cell", "_h", key)
    counts = cell_counts(narrow, [])
    wanted = counts.agg(train_rows(F.coalesce(F.sum("_in"), F.lit(0)), test_share).alias("n_train_class"))
    cut = train_cut(narrow, counts, [], key, wanted)  # one row, or none
    return _by_cut(keyed.join(F.broadcast(cut), F.lit(True), "left"), key).drop("_h", "_cell", "_cut")


def folds_stratified(df: DataFrame, k: int, label: str = "label", key: str = "row_id", seed: int = SEED,
                     groups: list[str] | None = None) -> DataFrame:
    """``fold`` = (position in ([groups], label, hash) order - 1) mod k: every class spread evenly."""
    keys = (groups or []) + [label]
    keyed = with_hash(df, key, seed)
    counts = cell_counts(keyed, keys)
    offsets, cond = _group_offsets(counts, keys)
    j = cell_rank(keyed, counts, keys, key).join(checked_broadcast(offsets, MAX_ALLOCATION_ROWS), cond)
    return j.withColumn("fold", F.pmod(F.col("_off") + F.col("_r") - 1, F.lit(k)).cast("int")).drop(
        "_r", "_off", *[f"_a{i}" for i in range(len(keys))])


def _group_offsets(counts: DataFrame, keys: list[str]) -> tuple[DataFrame, list[Column]]:
    """Rows of earlier groups, by group, and the join conditions."""
    sizes = counts.groupBy(*keys).agg(F.sum("_in").alias("_n"))
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)  # one row a group
    return renamed(sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))), keys, "_off")


def folds_random(df: DataFrame, k: int, key: str = "row_id", seed: int = SEED,
                 groups: list[str] | None = None) -> DataFrame:
    """Shuffled folds of sizes within one of each other."""
    keyed = with_hash(df, key, seed)
    counts = cell_counts(keyed, groups or [])
    if groups:
        offsets, cond = _group_offsets(counts, groups)
        j = cell_rank(keyed, counts, groups, key).join(checked_broadcast(offsets, MAX_ALLOCATION_ROWS), cond)
    else:
        j = cell_rank(keyed, counts, [], key).withColumn("_off", F.lit(0))
    return j.withColumn("fold", F.pmod(F.col("_off") + F.col("_r") - 1, F.lit(k)).cast("int")).drop(
        "_r", "_off", *[f"_a{i}" for i in range(len(groups or []))])


def fold_train_val(df: DataFrame, k: int, fold: str = "fold") -> DataFrame:
    """The k (train, validation) pairs as rows: each row once per round, role val when its fold
    is the round. An array explode, not a join."""
    rounds = df.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return rounds.withColumn("role", F.when(F.col(fold) == F.col("round"), F.lit("val")).otherwise(F.lit("train")))


def split_with_folds(df: DataFrame, k: int, label: str = "label", key: str = "row_id",
                     test_share: float = TEST_SHARE, seed: int = SEED,
                     groups: list[str] | None = None) -> DataFrame:
    """X1 + X3 in one numbering: ``split`` and, for train rows, the stratified ``fold``.

    The train rows of a class are exactly its ranks 1..t_c in hash order, so a train row's position
    in ([groups], label, hash) order over the train part is (train rows of earlier classes) + rank.
    That offset comes from the allocation table (one row per class), so no second distributed
    numbering is needed. Equal to ``folds_stratified`` run on the train part of ``split_stratified``.
    """
    groups = groups or []
    keys = groups + [label]
    keyed = with_hash(df, key, seed)
    counts = cell_counts(keyed, keys)
    alloc = class_allocation(counts, label, test_share, groups, "_in")
    before = Window.orderBy(*[F.col(c) for c in keys]).rowsBetween(Window.unboundedPreceding, -1)
    alloc = alloc.withColumn("_off", F.coalesce(F.sum("n_train_class").over(before), F.lit(0)))
    alloc, cond = renamed(alloc, keys, "n_train_class", "_off")
    j = cell_rank(keyed, counts, keys, key).join(checked_broadcast(alloc, MAX_ALLOCATION_ROWS), cond)
    train = F.col("_r") <= F.col("n_train_class")
    return (j.withColumn("split", F.when(train, F.lit("train")).otherwise(F.lit("test")))
            .withColumn("fold", F.when(train, F.pmod(F.col("_off") + F.col("_r") - 1, F.lit(k))).cast("int"))
            .drop("_r", "n_train_class", "_off", *[f"_a{i}" for i in range(len(keys))]))


def split_with_random_folds(df: DataFrame, k: int, key: str = "row_id", test_share: float = TEST_SHARE,
                            seed: int = SEED) -> DataFrame:
    """X2 + X4 in one numbering: train rows are hash positions 1..n_train, fold = (position - 1) mod k."""
    keyed = with_hash(df, key, seed)
    counts = cell_counts(keyed, [])
    total = counts.agg(train_rows(F.coalesce(F.sum("_in"), F.lit(0)), test_share).alias("_t"))  # one row
    j = cell_rank(keyed, counts, [], key, "_p").join(F.broadcast(total), F.lit(True))
    train = F.col("_p") <= F.col("_t")
    return (j.withColumn("split", F.when(train, F.lit("train")).otherwise(F.lit("test")))
            .withColumn("fold", F.when(train, F.pmod(F.col("_p") - 1, F.lit(k))).cast("int"))
            .drop("_p", "_t"))
