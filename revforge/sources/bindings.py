"""How the driver tables stand in for review tables.

documents      -> reviews (text as review, language as the class, source as package)
conversations  -> a second review source (role as label, extra column turn)
documents+labels -> a multi-label table (four 0/1 flags)
events         -> a training log (user = run, click = train entry, purchase = eval entry)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import read_table

# ---- fixed values: binding of languages to short label codes -------------------------------
LANG_SHORT_CODE = {"en": "PD", "de": "FR", "es": "RT", "fr": "UE"}
# ---- fixed values: the hard 4-class target from (quality, toxic) ----------------------------
PAIR_CLASS = {(0, 0): "bug report", (0, 1): "feature request", (1, 0): "rating", (1, 1): "user experience"}


def _case(col: F.Column, mapping: dict, default: F.Column) -> F.Column:
    expr = None
    for k, v in mapping.items():
        expr = (F.when(col == F.lit(k), F.lit(v)) if expr is None else expr.when(col == F.lit(k), F.lit(v)))
    return expr.otherwise(default)


def raw_reviews(spark: SparkSession, root: str) -> DataFrame:
    """Reviews with short label codes, as the raw source holds them."""
    d = read_table(spark, root, "documents")
    return d.select(
        F.col("doc_id").cast("long").alias("row_id"),
        F.col("text").alias("review"),
        _case(F.col("lang"), LANG_SHORT_CODE, F.col("lang")).alias("label"),
        F.col("source").alias("package"),
    )


def conversation_reviews(spark: SparkSession, root: str) -> DataFrame:
    """Second source for the outer union: role as label, turn as an extra column."""
    c = read_table(spark, root, "conversations")
    return c.select(
        F.col("text").alias("review"),
        F.col("role").alias("label"),
        F.col("turn").cast("long").alias("turn"),
    )


def multilabel_reviews(spark: SparkSession, root: str) -> DataFrame:
    """documents joined to labels; flags in the fixed flag order."""
    d = read_table(spark, root, "documents").select("doc_id", "text", "lang", "n_chars")
    lab = read_table(spark, root, "labels")
    j = d.join(lab, "doc_id")
    return j.select(
        F.col("doc_id").cast("long").alias("row_id"),
        F.col("text").alias("review"),
        F.col("quality").cast("int").alias("bug_report"),
        F.col("toxic").cast("int").alias("user_experience"),
        (F.col("lang") == "en").cast("int").alias("rating"),
        (F.col("n_chars") > 1000).cast("int").alias("feature_request"),
    )


def pair_class_reviews(spark: SparkSession, root: str) -> DataFrame:
    """documents joined to labels with the (quality, toxic) pair as a 4-class label."""
    d = read_table(spark, root, "documents").select("doc_id", "text")
    lab = read_table(spark, root, "labels")
    expr = None
    for (q, t), name in PAIR_CLASS.items():
        cond = (F.col("quality") == q) & (F.col("toxic") == t)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return d.join(lab, "doc_id").select(
        F.col("doc_id").cast("long").alias("row_id"),
        F.col("text").alias("review"),
        expr.alias("label"),
    )


def training_log(spark: SparkSession, root: str) -> DataFrame:
    """Log entries: run, ordering (ts, seq), kind train/eval, loss."""
    return _log_of(read_table(spark, root, "events"))


def training_log_stream(spark: SparkSession, root: str) -> DataFrame:
    """The same entries as a stream over the files of the table."""
    path = f"{root}/events.parquet"
    # as a pattern, since a stream's plain path must be a folder and the table may be a single file
    return _log_of(spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[t]"))


def _log_of(events: DataFrame) -> DataFrame:
    e = events.filter(F.col("event_type").isin("click", "purchase"))
    return e.select(
        F.col("user_id").cast("long").alias("run"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").cast("long").alias("seq"),
        F.when(F.col("event_type") == "click", F.lit("train")).otherwise(F.lit("eval")).alias("kind"),
        F.col("value").alias("loss"),
    )
