"""Sources and sinks (S1-S12) and the small helpers of the inventory."""

import os
import tempfile

import pytest

from pyspark.sql import functions as F

from revforge.functions.scores import negate
from revforge.operators.columns import cast_label
from revforge.sources import io


def test_csv_round_trip_with_na_strings(spark):
    d = tempfile.mkdtemp(prefix="revforge-csv-")
    rows = [(1, 'He said "hi"\nthen left', "PD", "p1"), (2, "NA", "None", "p2"), (3, "", "RT", None)]
    df = spark.createDataFrame(rows, "row_id long, review string, label string, package string")
    io.write_csv(df, os.path.join(d, "out"))
    back = {r.row_id: r for r in io.scan_csv(spark, os.path.join(d, "out")).collect()}
    assert back[1].review == 'He said "hi"\nthen left'
    assert back[2].review is None and back[2].label is None
    assert back[3].review is None and back[3].package is None


def test_partition_overwrite_resets_one_run(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="revforge-pq-"), "runs")
    a = spark.createDataFrame([("nb", "Balanced", 1), ("nb", "Unbalanced", 2)], "model string, variant string, v int")
    io.write_table(a, d, partition_by=["model", "variant"])
    b = spark.createDataFrame([("nb", "Balanced", 9)], "model string, variant string, v int")
    io.write_table(b, d, partition_by=["model", "variant"])
    got = sorted((r.variant, r.v) for r in spark.read.parquet(d).collect())
    assert got == [("Balanced", 9), ("Unbalanced", 2)]


def test_dataset_catalog_and_picks(spark):
    d = tempfile.mkdtemp(prefix="revforge-cat-")
    for name, size in [("small.a.csv", 10), ("big.csv", 300), ("mid.xlsx", 100), (".hidden.csv", 5)]:
        with open(os.path.join(d, name), "w") as f:
            f.write("x" * size)
    cat = io.dataset_catalog(spark, d)
    rows = [(r.file_name, r.stem, r.ext, r.bytes, r.rank) for r in cat.orderBy("rank").collect()]
    assert rows == [("small.a.csv", "small", "a", 10, 0), ("mid.xlsx", "mid", "xlsx", 100, 1),
                    ("big.csv", "big", "csv", 300, 2)]
    assert [r.file_name for r in io.pick_datasets(cat, [1, 2]).orderBy("rank").collect()] == ["mid.xlsx", "big.csv"]


def test_csv_header_is_checked(spark):
    d = tempfile.mkdtemp()
    spark.createDataFrame([("x", 1)], "other string, row_id long").write.option("header", True).csv(os.path.join(d, "csv"))
    with pytest.raises(Exception, match="(?i)header"):
        io.scan_csv(spark, os.path.join(d, "csv")).collect()


def test_partition_overwrite_leaves_the_session_alone(spark):
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    io.write_table(spark.createDataFrame([(1, "a")], "x long, p string"), tempfile.mkdtemp(), partition_by=["p"])
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before


def test_sums_of_large_longs(spark):
    from revforge.operators.aggregates import numeric_sums
    got = numeric_sums(spark.createDataFrame([(2 ** 62,), (2 ** 62,)], "n long")).first()
    assert got.total == float(2 ** 63)
    odd = numeric_sums(spark.createDataFrame([(2 ** 53,), (1,)], "n long")).first()
    assert odd.exact == str(2 ** 53 + 1)


def test_small_helpers(spark):
    df = spark.createDataFrame([("3",)], "label string")
    assert cast_label(df).schema["label"].dataType.typeName() == "integer"
    assert df.select(negate(F.lit(0.7)).alias("o")).first().o == -0.7
    assert io.variant_of(1) == "Balanced" and io.variant_of(2) == "Unbalanced"
    assert io.count_named_path(df, "final_data_unbalanced", ".parquet") == "final_data_unbalanced_1.parquet"
    out, took = io.timed(lambda: df.count())
    assert out == 1 and took.endswith(" s")
    assert [r.row_id for r in io.preview(spark.range(10).withColumnRenamed("id", "row_id"), ["row_id"], 3)
            .collect()] == [0, 1, 2]


def test_balance_with_a_hot_class(spark):
    from revforge.operators.balance import balance_longest
    # class 0 holds most rows; its top-k must be exact whatever the partitioning
    df = spark.range(20000).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 4).cast("int").alias("new_label"),
        F.repeat(F.lit("x"), (F.col("id") * 7919 % 1000).cast("int")).alias("review")).repartition(13)
    got = balance_longest(df, {0: 50, 1: 5, 2: 5, 3: 5})
    top0 = sorted(r.row_id for r in got.filter("new_label = 0").collect())
    ref = sorted(r.row_id for r in df.filter("new_label = 0").orderBy(F.length("review").desc(), "row_id")
                 .limit(50).collect())
    assert top0 == ref and got.count() == 65


def test_one_csv_file_is_read_by_many_tasks(spark):
    """Small splits through quoted line breaks, doubled quotes, separators and empty cells: equal to the whole-file reader."""
    import csv
    import random

    rng = random.Random(8)
    pieces = ["a", 'say ""no""'.replace('""', '"'), "line\nbreak", "\n\n", "x,y", "é", '"', "", "tail "]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) or None, rng.choice(["PD", "NA", None]), "p,1") for i in range(400)]
    path = os.path.join(tempfile.mkdtemp(prefix="revforge-split-"), "one.csv")
    with open(path, "w", newline="") as f:
        w = csv.writer(f, lineterminator="\n")
        w.writerow(io.REVIEW_SCHEMA.names)
        w.writerows([["" if c is None else c for c in r] for r in rows])
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        from revforge.sources import csv_split
        assert csv_split.lines(spark, path).select("block").distinct().count() > 10
        got = sorted(tuple(r) for r in io.scan_csv(spark, path).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    whole = io.null_na_strings(spark.read.schema(io.REVIEW_SCHEMA).option("header", True).option("multiLine", True).option("escape", '"').csv(path))
    assert [str(r) for r in got] == [str(tuple(r)) for r in sorted(whole.collect(), key=lambda r: r.row_id)]
    assert len(got) == 400
