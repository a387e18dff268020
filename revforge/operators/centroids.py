"""Classification of dense vectors by exact class means (M5 on given vectors): nearest mean by squared distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

ROUND = 6


def class_means(df: DataFrame, vector: str, label: str) -> DataFrame:
    """``label, mean``: one partial and final aggregate per (class, dimension), so a hot class is summed where it lies."""
    each = df.select(label, F.posexplode(vector).alias("dim", "x")).groupBy(label, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    rows = each.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("dim", "m"))).alias("a"))  # classes x dimensions
    return materialize(rows.select(label, F.transform("a", lambda c: c["m"]).alias("mean")))


def _distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)


def nearest_mean(df: DataFrame, means: DataFrame, vector: str, label: str, out: str = "pred") -> DataFrame:
    """Add ``out``: the class with the nearest mean (distances rounded to ``ROUND`` decimals, ties to the smaller label).

    All means stand in one row (classes x dimensions numbers, whatever the table), which is broadcast."""
    every = means.agg(F.sort_array(F.collect_list(F.struct(F.col(label).alias("label"), "mean"))).alias("_means"))
    v = F.transform(vector, lambda x: x.cast("double"))
    best = F.array_min(F.transform("_means", lambda c: F.struct(F.round(_distance(F.col("_v"), c["mean"]), ROUND).alias("d"), c["label"])))
    return df.withColumn("_v", v).join(F.broadcast(every), F.lit(True)).withColumn(out, best["label"]).drop("_v", "_means")


def mean_scores(df: DataFrame, means: DataFrame, vector: str, label: str, out: str = "scores") -> DataFrame:
    """Add ``out``: minus the rounded distance to each class mean, in the order of the labels."""
    every = means.agg(F.sort_array(F.collect_list(F.struct(F.col(label).alias("label"), "mean"))).alias("_means"))
    v = F.transform(vector, lambda x: x.cast("double"))
    scores = F.transform("_means", lambda c: -F.round(_distance(F.col("_v"), c["mean"]), ROUND))
    return df.withColumn("_v", v).join(F.broadcast(every), F.lit(True)).withColumn(out, scores).drop("_v", "_means")
