"""Physical-plan checks: top-k pushed below the shuffle, filters pushed to the scan, no per-row
Python in the registered queries."""

import pytest

from revforge.operators import balance, columns
from revforge.plans.common import LONGEST_QUOTA, coded_reviews
from revforge.sources import bindings

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_balance_has_partial_window_group_limit(spark):
    p = plan(balance.balance_longest(coded_reviews(spark, SF), LONGEST_QUOTA))
    assert "WindowGroupLimit" in p


def test_top_longest_is_take_ordered(spark):
    p = plan(balance.top_longest(bindings.raw_reviews(spark, SF), 5))
    assert "TakeOrderedAndProject" in p


def test_filter_pushed_to_scan(spark):
    df = columns.filter_present(bindings.raw_reviews(spark, SF)).select("row_id")
    p = plan(df)
    assert "PushedFilters: [IsNotNull(text), Not(EqualTo(text,))]" in p


@pytest.mark.parametrize("key", ["balance_longest", "clean_text", "tokenize_words", "lemma_vocab",
                                 "stopword_antijoin", "wide_metrics", "micro_prf", "encode_fixed"])
def test_no_row_python(spark, key):
    import __spark_entry__ as e
    p = plan(e.queries()[key](spark, SF))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_coarse_input_is_spread_and_tf_reuses_it(spark):
    """A one-row-group table is hash-partitioned by the text key before tokenizing, and the
    per-text term aggregation reuses that partitioning (one exchange, no second shuffle)."""
    from pyspark.sql import functions as F

    from revforge.operators import nb, textops
    docs = bindings.raw_reviews(spark, SF).select(F.col("row_id").alias("uid"), "review")
    p = plan(nb.term_frequencies(textops.token_table(docs, key="uid"), key="uid"))
    assert "REPARTITION_BY_NUM" in p
    assert p.count("Exchange hashpartitioning") == 1


def test_large_input_is_left_alone(spark, monkeypatch):
    """When the scanned relation already has a split per core, no shuffle is added."""
    from revforge.operators import layout
    monkeypatch.setattr(layout, "largest_input_bytes", lambda df: 1 << 50)
    docs = bindings.raw_reviews(spark, SF)
    assert "Exchange" not in plan(layout.spread(docs, "row_id"))


def test_broadcast_check_counts_written_tables_directly(spark):
    from revforge.operators.joins import is_plain_scan
    t = spark.read.parquet(f"{SF}/labels.parquet")
    assert is_plain_scan(t.select("doc_id").filter("doc_id > 3"))
    assert not is_plain_scan(t.groupBy("quality").count())
    assert not is_plain_scan(t.join(t, "doc_id"))


def test_balance_has_one_plan_whatever_the_input_size(spark, monkeypatch):
    """The choice by length histogram has no form for small and none for large inputs."""
    import re

    from revforge.operators import layout
    df = coded_reviews(spark, SF)

    def shape():
        return re.findall(r"Exchange \w+|WindowGroupLimit|BroadcastHashJoin|SortMergeJoin", plan(balance.balance_longest(df, LONGEST_QUOTA)))

    small = shape()
    monkeypatch.setattr(layout, "largest_input_bytes", lambda d: 1 << 50)
    assert shape() == small
