"""Registered dataset-preparation queries (sections S, P, A1-A4, W, U of the inventory)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_ascii, text_length
from ..operators import aggregates, balance, columns
from ..operators.setops import union_sources
from ..session import ensure_checkpoint_dir
from ..sources import bindings, io
from .common import (LONGEST_QUOTA, NESTED_CUTS, SHORTEST_QUOTA, TOP_N, coded_reviews, normalise)


def q_balance_longest(spark: SparkSession, root: str) -> DataFrame:
    """Flagship: per class the k longest reviews (generated-data balancing)."""
    b = balance.balance_longest(coded_reviews(spark, root), LONGEST_QUOTA)
    return normalise(b.select("row_id", "new_label", text_length("review").alias("review_len"), "class_rank"))


def q_balance_shortest(spark: SparkSession, root: str) -> DataFrame:
    b = balance.balance_shortest(coded_reviews(spark, root), SHORTEST_QUOTA)
    return normalise(b.select("row_id", "new_label", text_length("review").alias("review_len"), "class_rank"))


def q_class_counts(spark: SparkSession, root: str) -> DataFrame:
    return normalise(aggregates.class_counts(coded_reviews(spark, root)))


def q_filter_present(spark: SparkSession, root: str) -> DataFrame:
    r = columns.filter_present(bindings.raw_reviews(spark, root))
    return normalise(r.select("row_id", "label", text_length("review").alias("review_len")))


def q_filter_class(spark: SparkSession, root: str) -> DataFrame:
    r = columns.filter_class(coded_reviews(spark, root), 2)
    return normalise(r.select("row_id", "new_label", "package"))


def q_project_reviews(spark: SparkSession, root: str) -> DataFrame:
    return normalise(columns.project(coded_reviews(spark, root), ["row_id", "label", "new_label"]))


def q_recode_labels(spark: SparkSession, root: str) -> DataFrame:
    r = columns.recode_labels(bindings.raw_reviews(spark, root))
    return normalise(r.select("row_id", "label", "package"))


def q_label_code(spark: SparkSession, root: str) -> DataFrame:
    r = coded_reviews(spark, root)
    return normalise(r.groupBy("label", "new_label").agg(F.count(F.lit(1)).alias("n")))


def q_clean_text(spark: SparkSession, root: str) -> DataFrame:
    """Filter first, clean second (an emptied review stays)."""
    r = columns.clean_column_in_place(columns.filter_present(bindings.raw_reviews(spark, root)))
    return normalise(r.select(
        "row_id", text_length("review").alias("clean_len"),
        F.md5(F.col("review")).alias("clean_md5")))


def q_text_length_stats(spark: SparkSession, root: str) -> DataFrame:
    r = coded_reviews(spark, root)
    n = text_length("review")
    return normalise(r.groupBy("new_label").agg(
        F.count(F.lit(1)).alias("n"), F.min(n).alias("min_len"), F.max(n).alias("max_len"),
        F.sum(n).alias("sum_len"), F.sum(text_length(clean_ascii("review"))).alias("sum_clean_len")))


def q_rename_cols(spark: SparkSession, root: str) -> DataFrame:
    r = columns.rename_contains(coded_reviews(spark, root), "package", "ID")
    return normalise(r.select("row_id", "ID", "new_label"))


def q_drop_cols(spark: SparkSession, root: str) -> DataFrame:
    r = columns.drop_column(coded_reviews(spark, root), "review")
    return normalise(r)


def q_add_row_ids(spark: SparkSession, root: str) -> DataFrame:
    """Ids 1..n after balancing, in the balanced output order (class, then rank)."""
    b = balance.balance_longest(coded_reviews(spark, root), LONGEST_QUOTA)
    ided = columns.add_row_ids(b.select("row_id", "new_label", "class_rank"),
                               [F.col("new_label"), F.col("class_rank")], name="ID")
    return normalise(ided.select("ID", "row_id", "new_label"))


def q_pack_flags(spark: SparkSession, root: str) -> DataFrame:
    """Flags packed to a float vector, emitted element by element."""
    m = columns.pack_flags(bindings.multilabel_reviews(spark, root),
                           ["bug_report", "user_experience", "rating", "feature_request"])
    return normalise(m.select("row_id", F.posexplode("labels").alias("flag_pos", "flag_value")))


def q_sort_by_length(spark: SparkSession, root: str) -> DataFrame:
    return normalise(balance.sorted_lengths(bindings.raw_reviews(spark, root)).select("row_id", "length_rank", "review_len"))


def q_top_longest(spark: SparkSession, root: str) -> DataFrame:
    t = balance.top_longest(bindings.multilabel_reviews(spark, root), TOP_N)
    return normalise(t.select("row_id", text_length("review").alias("review_len")))


def q_nested_cuts(spark: SparkSession, root: str) -> DataFrame:
    c = balance.nested_cuts(bindings.multilabel_reviews(spark, root), NESTED_CUTS)
    return normalise(c.select("row_id", "length_rank", "cut"))


def q_union_sources(spark: SparkSession, root: str) -> DataFrame:
    u = union_sources(columns.recode_labels(bindings.raw_reviews(spark, root)),
                      bindings.conversation_reviews(spark, root))
    return normalise(u.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count("row_id").alias("n_row_id"), F.count("turn").alias("n_turn"),
        F.sum(text_length("review")).alias("sum_len")))


def q_numeric_sums(spark: SparkSession, root: str) -> DataFrame:
    b = balance.balance_longest(coded_reviews(spark, root), LONGEST_QUOTA)
    b = b.select("row_id", "new_label", "class_rank", F.lit(None).cast("int").alias("empty_flag"))
    return normalise(aggregates.numeric_sums(b))


def q_label_dictionary(spark: SparkSession, root: str) -> DataFrame:
    from ..operators.labels import label_fit
    return normalise(label_fit(columns.recode_labels(bindings.raw_reviews(spark, root))))


def q_preview(spark: SparkSession, root: str) -> DataFrame:
    p = io.preview(coded_reviews(spark, root), ["row_id"], 5)
    return normalise(p.select("row_id", "label", "new_label", "package"))


def q_scan_table(spark: SparkSession, root: str) -> DataFrame:
    """Write the prepared table as Parquet into the checkpoint folder and scan it back."""
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, f"scan_table-{uuid.uuid4().hex}")
    prepared = coded_reviews(spark, root).select("row_id", "label", "new_label", "package")
    io.write_table(prepared, path)
    return normalise(spark.read.parquet(path).select("row_id", "label", "new_label", "package"))


def q_scan_reviews(spark: SparkSession, root: str) -> DataFrame:
    """CSV round trip of the raw review table (multi-line cells, quotes), NA strings to null."""
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, f"scan_reviews-{uuid.uuid4().hex}")
    io.write_csv(bindings.raw_reviews(spark, root), path)
    back = io.scan_csv(spark, path)
    return normalise(back.select("row_id", "label", "package", text_length("review").alias("review_len"),
                                 F.md5("review").alias("review_md5")))


def q_per_dataset_counts(spark: SparkSession, root: str) -> DataFrame:
    from ..operators.matrix import stacked_datasets
    s = stacked_datasets(spark, root)
    return normalise(s.groupBy("dataset", "label").agg(F.count(F.lit(1)).alias("n")))


QUERIES = {
    "balance_longest": q_balance_longest,
    "balance_shortest": q_balance_shortest,
    "class_counts": q_class_counts,
    "filter_present": q_filter_present,
    "filter_class": q_filter_class,
    "project_reviews": q_project_reviews,
    "recode_labels": q_recode_labels,
    "label_code": q_label_code,
    "clean_text": q_clean_text,
    "text_length_stats": q_text_length_stats,
    "rename_cols": q_rename_cols,
    "drop_cols": q_drop_cols,
    "add_row_ids": q_add_row_ids,
    "pack_flags": q_pack_flags,
    "sort_by_length": q_sort_by_length,
    "top_longest": q_top_longest,
    "nested_cuts": q_nested_cuts,
    "union_sources": q_union_sources,
    "numeric_sums": q_numeric_sums,
    "label_dictionary": q_label_dictionary,
    "preview": q_preview,
    "scan_table": q_scan_table,
    "scan_reviews": q_scan_reviews,
    "per_dataset_counts": q_per_dataset_counts,
}
