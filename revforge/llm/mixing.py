"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words (weights, capped at ``cap`` times its own size, the excess
shared out again by weight). Inside a source a document of word octave ``o`` (its size has o binary
digits) has ``e = min(cap, lambda / (TEMPER + o))`` expected copies, with lambda solved so that the
expected words equal the target: ``floor(e)`` whole copies are certain, the rest ``p = e - floor(e)`` is
its inclusion probability. Pareto order sampling ranks documents by random odds over inclusion odds,
``(u / (1 - u)) / (p / (1 - p))``, and takes them in that order until the source's remaining words are
reached; a second pass over the documents left, no longer than a quarter of what is missing, fills the gap.

No source is ever sorted in one task: words are summed over ``CELLS`` cells of the rank (two levels), the
running sum over cells finds the cell where the budget ends, and only that cell's rows are ordered.

Defined results: null text has size 0 and takes 0 words; a null source is a source of its own (last);
an empty string is another one; repeated rows are drawn alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, hash_unit, key_of, materialize, text_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
TEMPER = 4
CELLS = 2048
SEED = 9


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size in words, tie) of every row; the only pass over the texts, written once."""
    return materialize(docs.select(
        "doc_id", "source",
        F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"),
        F.md5(text_of().cast("binary")).alias("_tie")))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
                   cap: float = CAP) -> DataFrame:
    """(_src, source, source_size, target): one row per source.

    The windows run over the table of sources (one row each), never over documents.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    w = totals.withColumn("_w", F.get(cycle, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))))
    filled = Window.orderBy(F.col("source_size") / F.col("_w"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    after = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()).cast("double") * F.lit(share)
    level = (total - F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("_w").over(after)
    w = w.withColumn("_level", level)
    w = w.withColumn("_full", F.col("_level") * F.col("_w") >= F.lit(cap) * F.col("source_size"))
    # the first source that is not full fixes the level of all that follow
    first = F.min(F.when(~F.col("_full"), F.struct(F.col("source_size") / F.col("_w"), F.col("source").isNull(),
                                                   F.col("source"), F.col("_level")))).over(Window.partitionBy())
    target = F.when(F.col("_full"), F.lit(cap) * F.col("source_size")).otherwise(first["_level"] * F.col("_w"))
    return w.select(key_of("source").alias("_src"), "source", "source_size", target.cast("double").alias("target"))


def octave(size: Column) -> Column:
    return F.length(F.bin(size))


def expected_copies(sizes: DataFrame, targets: DataFrame, cap: float = CAP, temper: int = TEMPER) -> DataFrame:
    """(_src, _oct, _e): expected copies per source and size octave (at most 64 rows per source)."""
    hist = (sizes.groupBy(key_of("source").alias("_src"), octave(F.col("size")).alias("_oct"))
            .agg(F.sum("size").cast("double").alias("_words"))
            .join(targets.select("_src", "target"), "_src")
            .withColumn("_w", F.lit(1.0) / (F.lit(temper) + F.col("_oct"))))
    up = Window.partitionBy("_src").orderBy("_oct")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    after = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    full_words = F.coalesce(F.sum("_words").over(before), F.lit(0.0))
    rate = (F.col("target") - F.lit(cap) * full_words) / F.sum(F.col("_words") * F.col("_w")).over(after)
    hist = hist.withColumn("_rate", F.when(F.sum(F.col("_words") * F.col("_w")).over(after) > 0, rate).otherwise(0.0))
    hist = hist.withColumn("_full", F.col("_rate") * F.col("_w") >= F.lit(cap))
    first = F.min(F.when(~F.col("_full"), F.struct("_oct", "_rate"))).over(Window.partitionBy("_src"))
    e = F.when(F.col("_full"), F.lit(cap)).otherwise(F.least(F.lit(cap), F.greatest(F.lit(0.0), first["_rate"] * F.col("_w"))))
    return hist.select("_src", "_oct", e.alias("_e"))


def _cells(rows: DataFrame, cell: str, keys: list[str]) -> DataFrame:
    """Words per cell with the words of the cells before it (window over at most CELLS rows a source)."""
    sums = rows.groupBy("_src", *keys, cell).agg(F.sum("size").alias("_words"))
    before = Window.partitionBy("_src").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0)))


def _edge(cells: DataFrame, budgets: DataFrame, cell: str, name: str) -> DataFrame:
    """Per source: the cell in which the budget ends, and the budget left when it begins."""
    j = cells.join(budgets, "_src").where(F.col("_before") < F.col("_budget"))
    return j.groupBy("_src").agg(F.max(F.struct(cell, (F.col("_budget") - F.col("_before")).alias("left"))).alias(name))


def take_in_order(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Rows of each source in ascending ``_v`` (ties: doc_id, size, _tie) as long as half of the row still
    fits what is left of ``_budget``. ``rows``: doc_id, _src, size, _v in [0, 1), _tie; ``budgets``: _src, _budget."""
    cut = rows.withColumn("_c1", F.floor(F.col("_v") * CELLS))
    cut = cut.withColumn("_c2", F.floor((F.col("_v") * CELLS - F.col("_c1")) * CELLS))
    e1 = materialize(_edge(_cells(cut, "_c1", []), budgets, "_c1", "_e1"))
    near = cut.join(e1, "_src").where(F.col("_c1") <= F.col("_e1._c1"))
    inside = near.where(F.col("_c1") == F.col("_e1._c1"))
    left1 = e1.select("_src", F.col("_e1.left").alias("_budget"))
    e2 = materialize(_edge(_cells(inside, "_c2", []), left1, "_c2", "_e2"))
    sure = near.where(F.col("_c1") < F.col("_e1._c1")).select(rows.columns)
    inside = inside.join(e2, "_src")
    sure2 = inside.where(F.col("_c2") < F.col("_e2._c2")).select(rows.columns)
    order = Window.partitionBy("_src").orderBy("_v", "doc_id", "size", "_tie")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = (inside.where(F.col("_c2") == F.col("_e2._c2")).withColumn("_at", before)
            .where(F.col("_at") + F.col("size") / F.lit(2.0) <= F.col("_e2.left")).select(rows.columns))
    return sure.unionByName(sure2).unionByName(last)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP,
        seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies (0, 1, 2, ...), taken."""
    sizes = sized(docs)
    targets = materialize(source_targets(sizes, weights, share, cap))
    copies = materialize(expected_copies(sizes, targets, cap))
    p = F.col("_e") - F.floor("_e")
    u = hash_unit(seed, "doc_id")
    u = F.when(u <= 0, F.lit(2.0 ** -61)).otherwise(F.coalesce(u, F.lit(0.5)))
    ranked = F.when(p > 0, (u / (F.lit(1.0) - u)) / (p / (F.lit(1.0) - p)))
    rows = materialize(
        sizes.withColumn("_src", key_of("source")).withColumn("_oct", octave(F.col("size")))
        .join(copies, ["_src", "_oct"])
        .select("doc_id", "source", "_src", "size", "_tie", F.floor("_e").cast("long").alias("_sure"),
                (ranked / (F.lit(1.0) + ranked)).alias("_v")))
    rest = (rows.groupBy("_src").agg(F.sum(F.col("size") * F.col("_sure")).alias("_fixed"))
            .join(targets, "_src").select("_src", (F.col("target") - F.col("_fixed")).alias("_budget")))
    drawable = rows.where(F.col("_v").isNotNull() & (F.col("size") > 0)).select("doc_id", "_src", "size", "_tie", "_v")
    first = materialize(take_in_order(drawable, rest))
    used = first.groupBy("_src").agg(F.sum("size").alias("_used"))
    gap = materialize(rest.join(used, "_src", "left").select(
        "_src", (F.col("_budget") - F.coalesce("_used", F.lit(0))).alias("_budget")))
    key = ["doc_id", "_src", "size", "_tie", "_v"]
    taken1 = first.groupBy(*key).agg(F.lit(1).alias("_one"))
    spare = _null_safe_join(drawable, taken1, key, "left_anti").join(gap, "_src")
    spare = spare.where(F.col("size") * 4 <= F.col("_budget")).select(key)
    second = take_in_order(spare, gap)
    # repeated rows are drawn with their number, so that k of n equal rows give k copies
    drawn = materialize(first.unionByName(second).groupBy(*key).agg(F.count(F.lit(1)).alias("_drawn")))
    numbered = rows.withColumn("_no", F.row_number().over(Window.partitionBy("doc_id", "_src", "size", "_tie").orderBy("_v")))
    got = _null_safe_join(numbered, drawn.select("doc_id", "_src", "size", "_tie", "_drawn"),
                          ["doc_id", "_src", "size", "_tie"], "left")
    n = F.col("_sure") + (F.coalesce(F.col("_drawn"), F.lit(0)) >= F.col("_no")).cast("long")
    out = got.withColumn("copies", n).join(targets.select("_src", "source_size", "target"), "_src")
    return out.select("doc_id", "source", "size", "source_size", "target", "copies",
                      (F.col("copies") * F.col("size")).alias("taken"), "_src", "_tie", "_no")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: the rows of ``docs`` (all columns), each as often as the mix takes it."""
    plan = mix(docs).where(F.col("copies") > 0)
    plan = plan.groupBy(F.col("doc_id").alias("_id"), F.col("_src").alias("_s"), F.col("_tie").alias("_t")).agg(
        F.sort_array(F.collect_list(F.struct("_no", "copies"))).alias("_take"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_did"),
                       key_of("source").alias("_ds"), F.md5(text_of().cast("binary")).alias("_dt"))
    on = rows["_did"].eqNullSafe(plan["_id"]) & (rows["_ds"] == plan["_s"]) & (rows["_dt"] == plan["_t"])
    no = F.row_number().over(Window.partitionBy("_id", "_s", "_t").orderBy("_dt"))
    got = rows.join(plan, on).withColumn("_rn", no)
    n = F.filter("_take", lambda x: x["_no"] == F.col("_rn"))
    return got.select("_row", F.explode(F.sequence(F.lit(1), F.get(n, F.lit(0))["copies"])).alias("_c")).select("_row.*")


def _null_safe_join(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    right = b.select([F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in b.columns])
    on = [a[k].eqNullSafe(right[f"_r_{k}"]) for k in keys]
    return a.join(right, on, how).drop(*[f"_r_{k}" for k in keys])
