"""Label dictionary: fit, encode, decode."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import checked_broadcast

# A classifier head has a handful of classes; beyond this the dictionary is joined without a hint.
MAX_BROADCAST_CLASSES = 100_000


def label_fit(df: DataFrame, label: str = "label") -> DataFrame:
    """M1: sorted distinct labels -> codes 0..n-1 (the window runs over the distinct labels only)."""
    distinct = df.select(label).where(F.col(label).isNotNull()).distinct()
    return distinct.select(
        F.col(label), (F.row_number().over(Window.orderBy(label)) - 1).cast("int").alias("label_code"))


def label_apply(df: DataFrame, dictionary: DataFrame, label: str = "label", out: str = "label_code") -> DataFrame:
    """M2: encode; a label missing from the dictionary fails the job."""
    d = checked_broadcast(dictionary.select(F.col(label).alias("_lab"), F.col("label_code").alias("_code")),
                          MAX_BROADCAST_CLASSES)
    j = df.join(d, F.col(label) == F.col("_lab"), "left")
    code = F.when(F.col("_code").isNull(),
                  F.raise_error(F.concat(F.lit("unseen label: "), F.coalesce(F.col(label), F.lit("null")))))
    return j.withColumn(out, F.coalesce(F.col("_code"), code.cast("int"))).drop("_lab", "_code")


def label_decode(df: DataFrame, dictionary: DataFrame, code: str, out: str) -> DataFrame:
    """M3: code -> name."""
    d = checked_broadcast(dictionary.select(F.col("label_code").alias("_code"), F.col("label").alias(out)),
                          MAX_BROADCAST_CLASSES)
    return df.join(d, F.col(code) == F.col("_code"), "left").drop("_code")
