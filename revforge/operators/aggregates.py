"""Counting and summing aggregations (A1-A4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import COUNT_PRINT_ORDER, LABEL_CODES

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def class_counts(df: DataFrame, label: str = "new_label") -> DataFrame:
    """A1: rows per class code; every known code appears (absent -> 0), with its print position.

    One partial + final hash aggregate; the 4-row code dictionary is the preserved side.
    """
    spark = df.sparkSession
    codes = spark.createDataFrame(
        [(c, COUNT_PRINT_ORDER.index(c)) for c in sorted(LABEL_CODES.values())], f"{label} int, print_pos int")
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return (
        F.broadcast(codes).join(counts, label, "left")
        .select(F.col(label).cast("long").alias(label), F.col("print_pos").cast("long"),
                F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))
    )


def numeric_sums(df: DataFrame) -> DataFrame:
    """A2: sum of every numeric column, nulls skipped, all-null -> 0; one row per column.

    Whole numbers are added as decimals, which a sum of longs could overflow; ``exact`` holds their sum with all its
    digits (null for other columns), ``total`` the nearest double."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, total double, exact string")
    whole = {f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)}
    added = {c: F.col(f"`{c}`").cast("decimal(28,0)") if c in whole else F.col(f"`{c}`") for c in cols}
    wide = df.agg(*[F.sum(added[c]).alias(f"s{i}") for i, c in enumerate(cols)])
    rows = [F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"s{i}").cast("double"), F.lit(0.0)).alias("total"),
                     (F.coalesce(F.col(f"s{i}").cast("string"), F.lit("0")) if c in whole else F.lit(None).cast("string")).alias("exact"))
            for i, c in enumerate(cols)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def row_count(df: DataFrame) -> int:
    """A3."""
    return df.count()


def distinct_classes(df: DataFrame, label: str = "label") -> DataFrame:
    """A4: sorted distinct labels (null excluded); their number sizes a classifier head."""
    return df.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label)
