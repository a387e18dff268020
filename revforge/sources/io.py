"""Scans and sinks for review tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import NA_STRINGS
from . import csv_split

# Explicit schema of a review table; no inference at scale.
REVIEW_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType(), True),
    T.StructField("review", T.StringType(), True),
    T.StructField("label", T.StringType(), True),
    T.StructField("package", T.StringType(), True),
])


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def null_na_strings(df: DataFrame) -> DataFrame:
    """Turn the cells a CSV reader treats as missing into null, string columns only."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.when(c.isin(NA_STRINGS), F.lit(None).cast("string")).otherwise(c).alias(f.name)
        out.append(c)
    return df.select(out)


def scan_csv(spark: SparkSession, path: str, schema: T.StructType = REVIEW_SCHEMA) -> DataFrame:
    """Header CSV with multi-line quoted cells and doubled quotes, large files read by many tasks; NA strings become
    null (S1)."""
    return null_na_strings(csv_split.scan(spark, path, schema))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV without an index column."""
    (df.write.mode("overwrite").option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet sink (S8). With ``partition_by`` only the partitions present in ``df`` are replaced,
    which is how one run's result directory is reset (S9)."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.parquet(path)


def count_named_path(df: DataFrame, prefix: str, suffix: str = "") -> str:
    """Output name carrying the row count."""
    return f"{prefix}_{df.count()}{suffix}"


def preview(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """First ``n`` rows under an explicit order."""
    return df.orderBy(*order).limit(n)


def dataset_catalog(spark: SparkSession, directory: str, glob: str = "*") -> DataFrame:
    """Files of a dataset directory, smallest first.

    Hidden files are skipped by the file source. Only the listing metadata is read: ``binaryFile``
    with the ``content`` column pruned does not open the files.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).load(directory)
        .select("path", "length")
    )
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    pieces = F.split(name, r"\.")
    return files.select(
        name.alias("file_name"),
        F.element_at(pieces, 1).alias("stem"),
        F.when(F.size(pieces) > 1, F.element_at(pieces, 2)).alias("ext"),
        F.col("length").alias("bytes"),
        (F.row_number().over(Window.orderBy("length", "path")) - 1).alias("rank"),
    )


def pick_datasets(catalog: DataFrame, positions: list[int]) -> DataFrame:
    """Choose datasets by their position in size order."""
    return catalog.filter(F.col("rank").isin(positions))


def variant_of(kind: int | str) -> str:
    """1 -> Balanced, anything else -> Unbalanced."""
    return "Balanced" if kind == 1 else "Unbalanced"


def timed(action) -> tuple[object, str]:
    """run an action and return (result, elapsed seconds as text with an ``s`` suffix)."""
    import time

    t0 = time.time()
    out = action()
    return out, f"{time.time() - t0:.2f} s"
