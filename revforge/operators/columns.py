"""Projections, filters and column operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import LABEL_CODES, OTHER_CODE, SHORT_CODES
from ..functions.text import clean_ascii
from .ordering import ordered_index


def project(df: DataFrame, cols: list[str]) -> DataFrame:
    """Keep columns."""
    return df.select(*cols)


def filter_present(df: DataFrame, col: str = "review") -> DataFrame:
    """Text not null and not empty (pushed to the Parquet scan as IsNotNull / Not(EqualTo))."""
    return df.filter(F.col(col).isNotNull() & (F.col(col) != F.lit("")))


def filter_class(df: DataFrame, code: int, col: str = "new_label") -> DataFrame:
    """Equality predicate."""
    return df.filter(F.col(col) == F.lit(code))


def recode_labels(df: DataFrame, mapping: dict[str, str] = SHORT_CODES) -> DataFrame:
    """Whole-cell replace in every string column."""
    subset = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.replace(mapping, subset=subset) if subset else df


def label_code(label: Column | str) -> Column:
    """P5: bug report 0, feature request 1, rating 2, anything else (null too) 3; case-sensitive."""
    c = F.col(label) if isinstance(label, str) else label
    expr = None
    for name, code in LABEL_CODES.items():
        if code == OTHER_CODE:
            continue
        expr = F.when(c == F.lit(name), F.lit(code)) if expr is None else expr.when(c == F.lit(name), F.lit(code))
    return expr.otherwise(F.lit(OTHER_CODE)).cast("int")


def with_label_code(df: DataFrame, label: str = "label", out: str = "new_label") -> DataFrame:
    return df.withColumn(out, label_code(label))


def rename_contains(df: DataFrame, old: str, new: str) -> DataFrame:
    """Replace a substring in every column name; a name collision is an error."""
    names = [c.replace(old, new) for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError(f"renaming {old!r} -> {new!r} makes duplicate columns: {names}")
    return df.toDF(*names)


def drop_column(df: DataFrame, col: str) -> DataFrame:
    """Delete a column; a missing one is an error (plain ``drop`` would be silent)."""
    if col not in df.columns:
        raise KeyError(f"no column {col!r} in {df.columns}")
    return df.drop(col)


def add_row_ids(df: DataFrame, order: list[Column | str], name: str = "ID") -> DataFrame:
    """``name`` = 1..n in the given order, numbered by range partitions + offsets."""
    return ordered_index(df, order, name=name)


def pack_flags(df: DataFrame, flags: list[str], out: str = "labels") -> DataFrame:
    """Four 0/1 columns to one float label vector."""
    return df.withColumn(out, F.array(*[F.col(c).cast("float") for c in flags]))


def cast_label(df: DataFrame, col: str = "label") -> DataFrame:
    """P10: integer label."""
    return df.withColumn(col, F.col(col).cast("int"))


def clean_column_in_place(df: DataFrame, col: str = "review") -> DataFrame:
    """Overwrite the text with its printable-ASCII form; null stays null, no row is dropped."""
    return df.withColumn(col, clean_ascii(col))
