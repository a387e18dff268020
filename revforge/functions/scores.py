"""Score-vector expressions: arg max, sigmoid, threshold, unwrap of nested scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .constants import DECISION_THRESHOLD


def argmax(scores: Column) -> Column:
    """0-based index of the largest score; the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - F.lit(1)).cast("int")


def sigmoid(scores: Column) -> Column:
    return F.transform(scores, lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x)))


def threshold(probs: Column, cut: float = DECISION_THRESHOLD) -> Column:
    """1 where the probability is strictly above ``cut``."""
    return F.transform(probs, lambda p: (p > F.lit(cut)).cast("int"))


def unwrap_scores(df: DataFrame, col: str) -> Column:
    """Scores may arrive nested (a tuple whose first item holds the logits); take the first item.

    Decided once from the schema, not per row.
    """
    dtype = df.schema[col].dataType
    c = F.col(col)
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.ArrayType):
        return F.element_at(c, 1)
    return c


def negate(metric: Column) -> Column:
    """a search objective to minimise from a score to maximise."""
    return -metric
