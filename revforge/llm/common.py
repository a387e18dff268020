"""Small helpers shared by the training-data operators: table access, word splitting, hash draws."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash_unit
from ..session import materialize

__all__ = ["WORD", "hash_unit", "key_of", "let", "materialize", "table", "text_of", "words_of"]

WORD = r"[^\x20\x09-\x0D]+"
_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the maximal runs of non-blank characters."""
    return F.filter(F.split(text, _GAP), lambda w: w != F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once (a lambda variable, never inlined per use)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def key_of(name: str) -> Column:
    """A non-null grouping key: null and the empty string stay apart."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))
