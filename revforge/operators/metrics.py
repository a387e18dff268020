"""Evaluation metrics as aggregations.

Everything starts from one pass over the predictions: ``groupBy(truth, pred).count()`` (at most
C x C rows, partial + final hash aggregate). Per-class counts, reports and averages are then
computed on that tiny table, so the cost is one scan of the scored rows whatever the report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ratio(num, den):
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def pair_counts(df: DataFrame, truth: str, pred: str, by: list[str] | None = None) -> DataFrame:
    by = by or []
    return df.groupBy(*by, truth, pred).agg(F.count(F.lit(1)).alias("n"))


def confusion_counts(df: DataFrame, truth: str = "truth", pred: str = "pred", by: list[str] | None = None,
                     classes: list[int] | None = None) -> DataFrame:
    """``[by..], class, tp, fp, fn, support`` for every class seen in truth or prediction
    (or listed in ``classes``, so an absent class reports zeros)."""
    by = by or []
    pc = pair_counts(df, truth, pred, by)
    as_truth = pc.select(*by, F.col(truth).alias("class"),
                         F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(0).alias("tp"),
                         F.lit(0).cast("long").alias("fp"),
                         F.when(F.col(truth) != F.col(pred), F.col("n")).otherwise(0).alias("fn"),
                         F.col("n").alias("support"))
    as_pred = pc.filter(F.col(truth) != F.col(pred)).select(
        *by, F.col(pred).alias("class"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("fp"),
        F.lit(0).cast("long").alias("fn"), F.lit(0).cast("long").alias("support"))
    parts = as_truth.unionByName(as_pred)
    if classes is not None:
        # every listed class once per group, as zero rows (an explode, not a join)
        zeros = pc.select(*by).distinct().select(
            *by, F.explode(F.array(*[F.lit(c) for c in classes])).alias("class"),
            *[F.lit(0).cast("long").alias(c) for c in ("tp", "fp", "fn", "support")])
        parts = parts.unionByName(zeros.select(parts.columns))
    return parts.groupBy(*by, "class").agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "support")])


def class_report(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 per class; 0 where a denominator is 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumn("precision", _ratio(tp, tp + fp)) \
        .withColumn("recall", _ratio(tp, tp + fn)) \
        .withColumn("f1", _ratio(2 * tp, 2 * tp + fp + fn))


def report_averages(report: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A8 + A9: macro (plain mean over classes) and weighted (by support) P, R, F1."""
    by = by or []
    aggs = []
    for m in ("precision", "recall", "f1"):
        aggs.append(F.avg(m).alias(f"macro_{m}"))
        aggs.append(_ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}"))
    return report.groupBy(*by).agg(*aggs)


def accuracy(df: DataFrame, truth: str = "truth", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    """A5: share of rows where prediction equals truth."""
    by = by or []
    return df.groupBy(*by).agg(F.avg((F.col(truth) == F.col(pred)).cast("double")).alias("accuracy"),
                               F.count(F.lit(1)).alias("n"))


def flag_counts(df: DataFrame, truth: list[str], pred: list[str], by: list[str] | None = None) -> DataFrame:
    """Per-flag tp / fp / fn / support from paired 0/1 columns (one pass, one row per group)."""
    by = by or []
    aggs = []
    for i, (t, p) in enumerate(zip(truth, pred)):
        aggs += [F.sum(((F.col(t) == 1) & (F.col(p) == 1)).cast("long")).alias(f"tp_{i}"),
                 F.sum(((F.col(t) == 0) & (F.col(p) == 1)).cast("long")).alias(f"fp_{i}"),
                 F.sum(((F.col(t) == 1) & (F.col(p) == 0)).cast("long")).alias(f"fn_{i}"),
                 F.sum(F.col(t).cast("long")).alias(f"support_{i}")]
    wide = df.groupBy(*by).agg(*aggs)
    stack = F.explode(F.array(*[
        F.struct(F.lit(i).alias("class"), F.col(f"tp_{i}").alias("tp"), F.col(f"fp_{i}").alias("fp"),
                 F.col(f"fn_{i}").alias("fn"), F.col(f"support_{i}").alias("support"))
        for i in range(len(truth))])).alias("s")
    return wide.select(*by, stack).select(*by, "s.*")


def micro_prf(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A10: pool tp / fp / fn over all labels, then P, R, F1."""
    by = by or []
    pooled = counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return pooled.select(*by, "tp", "fp", "fn", _ratio(tp, tp + fp).alias("micro_precision"),
                         _ratio(tp, tp + fn).alias("micro_recall"),
                         _ratio(2 * tp, 2 * tp + fp + fn).alias("micro_f1"))


def samples_avg(df: DataFrame, truth: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """Per-row P / R / F1 of flag arrays, averaged over rows (0 for an empty denominator)."""
    by = by or []
    both = F.aggregate(F.zip_with(truth, pred, lambda a, b: a * b), F.lit(0), lambda acc, x: acc + x)
    n_true = F.aggregate(F.col(truth), F.lit(0), lambda acc, x: acc + x)
    n_pred = F.aggregate(F.col(pred), F.lit(0), lambda acc, x: acc + x)
    rows = df.select(*by, both.alias("b"), n_true.alias("t"), n_pred.alias("p"))
    b, t, p = F.col("b"), F.col("t"), F.col("p")
    return rows.groupBy(*by).agg(F.avg(_ratio(b, p)).alias("samples_precision"),
                                 F.avg(_ratio(b, t)).alias("samples_recall"),
                                 F.avg(_ratio(2 * b, t + p)).alias("samples_f1"))


def samples_avg_long(df: DataFrame, row: str, truth: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """A11 on a long table (one row per (row, flag)): per-row sums by a grouped aggregate first."""
    by = by or []
    per_row = df.groupBy(*by, row).agg(F.sum(F.col(truth) * F.col(pred)).alias("b"),
                                       F.sum(truth).alias("t"), F.sum(pred).alias("p"))
    b, t, p = F.col("b"), F.col("t"), F.col("p")
    return per_row.groupBy(*by).agg(F.avg(_ratio(b, p)).alias("samples_precision"),
                                    F.avg(_ratio(b, t)).alias("samples_recall"),
                                    F.avg(_ratio(2 * b, t + p)).alias("samples_f1"))


def pooled_flag_counts(df: DataFrame, truth: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """tp / fp / fn pooled over every (row, flag) pair of a long table."""
    by = by or []
    t, p = F.col(truth), F.col(pred)
    return df.groupBy(*by).agg(F.sum(((t == 1) & (p == 1)).cast("long")).alias("tp"),
                               F.sum(((t == 0) & (p == 1)).cast("long")).alias("fp"),
                               F.sum(((t == 1) & (p == 0)).cast("long")).alias("fn"))


def best_by(scores: DataFrame, metric: str, key: str = "fold") -> DataFrame:
    """The first key with a strictly greater score, starting from 0 (no row if all are 0)."""
    return scores.filter(F.col(metric) > 0).orderBy(F.col(metric).desc(), F.col(key).asc()).limit(1)


def wide_metrics(report: DataFrame, by: str, classes: list[tuple[int, str]]) -> DataFrame:
    """A13 + A14: one row per ``by`` value; P / R / F1 per class as flat ``<class>_<measure>`` names."""
    values = [c for c, _ in classes]
    piv = report.groupBy(by).pivot("class", values).agg(
        F.first("precision").alias("p"), F.first("recall").alias("r"), F.first("f1").alias("f1"))
    ren = []
    for code, name in classes:
        slug = name.replace(" ", "_")
        for m in ("p", "r", "f1"):
            ren.append(F.col(f"{code}_{m}").alias(f"{slug}_{m}"))
    return piv.select(by, *ren)


def collect_scores(scores: DataFrame, metric: str, key: str = "fold") -> DataFrame:
    """The per-fold scores as one ordered list (bounded by the number of folds)."""
    return scores.agg(F.array_sort(F.collect_list(F.struct(key, metric))).alias("scores"))
