"""Multi-line CSV read by many tasks.

A quoted cell may hold line breaks, so where a record starts depends on all quotes before it, and Spark's own multi-line
reader gives each file to one task. Here the file is read as lines, in splits like any text file, and the state at the
start of a split is found from counts: doubled quotes leave the parity of a line even, so a line starts inside a cell if the quotes
before it in the file are odd in number. One row per split holds its quotes; their running sum gives each split its parity, a running sum within
the split gives each line's. Lines that start outside a cell start a record; the lines up to the next one belong to it,
also across splits, and are joined again and parsed as one record.

A split's lines are numbered as its task reads them (``monotonically_increasing_id`` grows within a task) and its
place in the file is the start of its block, so nothing depends on the order of tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import checked_broadcast
from ..session import materialize

MAX_SPLITS = 1_000_000


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block (start of the split), line (order within the split), value, quotes (of the line)."""
    text = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                       F.monotonically_increasing_id().alias("line"), "value",
                       (F.length("value") - F.length(F.replace("value", F.lit('"')))).cast("long").alias("quotes"))


def split_starts(each: DataFrame) -> DataFrame:
    """file, block, odd (whether the split starts inside a cell): a running sum over one row per split of a file."""
    sums = each.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("file", "block", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).alias("odd"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, block and line (of the record's first line), value: the whole record, its line breaks kept."""
    each = materialize(lines(spark, path))  # numbers given once
    starts = split_starts(each).select(F.col("file").alias("f"), F.col("block").alias("b"), "odd")
    of_split = [F.col("file") == F.col("f"), F.col("block") == F.col("b")]
    known = each.join(checked_broadcast(starts, MAX_SPLITS), of_split).drop("f", "b")
    within = Window.partitionBy("file", "block").orderBy("line")
    upto = within.rowsBetween(Window.unboundedPreceding, -1)
    outside = (F.col("odd") + F.coalesce(F.sum("quotes").over(upto), F.lit(0))) % 2 == 0
    marked = known.withColumn("first", F.when(outside, F.struct("block", "line")))
    marked = materialize(marked.withColumn("own", F.max("first").over(within)).select("file", "block", "line", "value", "own"))
    # a record that an earlier split began: the last start before, from one row per split
    ends = marked.groupBy("file", "block").agg(F.max("own").alias("last"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col("file").alias("f"), F.col("block").alias("b"), F.max("last").over(earlier).alias("open"))
    whole = marked.join(checked_broadcast(ends, MAX_SPLITS), of_split).withColumn("start", F.coalesce("own", "open"))
    parts = F.sort_array(F.collect_list(F.struct("block", "line", "value")))
    joined = whole.groupBy("file", "start").agg(parts.alias("p"))
    return joined.select("file", "start.block", "start.line", F.array_join(F.transform("p", lambda x: x["value"]), "\n").alias("value"))


def cells(record: Column, schema: T.StructType) -> Column:
    options = {"escape": '"', "multiLine": "true", "mode": "FAILFAST"}
    return F.from_csv(F.regexp_replace(record, r"\r\z", ""), schema.simpleString()[7:-1].replace(":", " "), options)


def scan(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The records under the header of every file; a header that names other columns is an error."""
    rows = records(spark, path)
    first = Window.partitionBy("file").orderBy("block", "line")
    heads = rows.where((F.col("block") == 0)).withColumn("n", F.row_number().over(first)).where("n = 1")
    names = ",".join(schema.names)
    plain = F.replace(F.regexp_replace("value", r"\r\z|\A\x{FEFF}", ""), F.lit('"'))
    checked = heads.select(F.col("file").alias("f"), F.col("block").alias("b"), F.col("line").alias("l"), F.when(
        plain == names, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"CSV header is not {names}: "), plain)).cast("boolean")).alias("head"))
    at = [F.col("file") == F.col("f"), F.col("block") == F.col("b"), F.col("line") == F.col("l")]
    # one header a file
    body = rows.join(checked_broadcast(materialize(checked), MAX_SPLITS), at, "left").where(F.col("head").isNull() & (F.trim("value") != ""))
    return body.select(cells(F.col("value"), schema).alias("r")).select("r.*")
