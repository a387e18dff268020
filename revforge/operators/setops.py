"""Set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame


def union_sources(a: DataFrame, b: DataFrame) -> DataFrame:
    """Stack rows by column name; a column missing on one side is null there; duplicates kept."""
    return a.unionByName(b, allowMissingColumns=True)
