"""Shared building blocks of the registered queries: bound inputs and output normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.columns import recode_labels, with_label_code
from ..sources.bindings import raw_reviews

# ---- fixed values: quotas of the registered balancing queries (code -> k) -------------------
LONGEST_QUOTA = {0: 50, 1: 50, 2: 200, 3: 50}
SHORTEST_QUOTA = {0: 100, 1: 100, 2: 100, 3: 100}
NESTED_CUTS = [10, 100, 250, 500]
TOP_N = 25
SIGNIFICANT = 6  # decimals kept on every floating output


def coded_reviews(spark: SparkSession, root: str) -> DataFrame:
    """raw reviews -> short codes replaced by names -> integer class code."""
    return with_label_code(recode_labels(raw_reviews(spark, root)))


def normalise(df: DataFrame) -> DataFrame:
    """Integers as bigint, floats rounded to a fixed number of decimals, booleans as 0/1."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
            c = c.cast("long")
        elif isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = F.round(c.cast("double"), SIGNIFICANT)
        out.append(c.alias(f.name))
    return df.select(out)
