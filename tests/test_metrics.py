"""Hand goldens of FIXTURES.md sections 3.2-3.4 and metric invariants."""

import pytest
from pyspark.sql import functions as F

from revforge.functions.scores import argmax, sigmoid, threshold, unwrap_scores
from revforge.operators import metrics, splits


@pytest.fixture
def mc(spark):
    truth = [0, 0, 0, 1, 1, 2, 2, 2, 3, 3]
    pred = [0, 0, 1, 1, 1, 2, 0, 2, 0, 2]
    return spark.createDataFrame(list(zip(range(10), truth, pred)), "id long, truth int, pred int")


def test_multiclass_report(mc):
    rep = {r["class"]: r for r in metrics.class_report(metrics.confusion_counts(mc, classes=[0, 1, 2, 3])).collect()}
    assert (rep[0].tp, rep[0].fp, rep[0].fn, rep[0].support) == (2, 2, 1, 3)
    assert rep[0].precision == pytest.approx(1 / 2) and rep[0].recall == pytest.approx(2 / 3)
    assert rep[0].f1 == pytest.approx(4 / 7)
    assert rep[1].precision == pytest.approx(2 / 3) and rep[1].recall == 1 and rep[1].f1 == pytest.approx(4 / 5)
    assert (rep[3].precision, rep[3].recall, rep[3].f1) == (0.0, 0.0, 0.0)
    acc = metrics.accuracy(mc).first().accuracy
    assert acc == pytest.approx(0.6)
    avg = metrics.report_averages(metrics.class_report(metrics.confusion_counts(mc))).first()
    assert avg.macro_precision == pytest.approx(11 / 24) and avg.macro_recall == pytest.approx(7 / 12)
    assert avg.macro_f1 == pytest.approx(0.509524, abs=1e-6)
    assert avg.weighted_f1 == pytest.approx(0.531429, abs=1e-6)


def test_single_label_micro_f1_equals_accuracy(mc):
    long = mc.select("id", F.explode(F.array(*[F.struct(
        F.lit(c).alias("c"), (F.col("truth") == c).cast("int").alias("t"), (F.col("pred") == c).cast("int").alias("p"))
        for c in range(4)])).alias("x")).select("id", "x.*")
    micro = metrics.micro_prf(metrics.pooled_flag_counts(long, "t", "p")).first()
    assert micro.micro_f1 == pytest.approx(0.6)


def test_against_mllib_evaluator(mc):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    d = mc.select(F.col("truth").cast("double").alias("label"), F.col("pred").cast("double").alias("prediction"))
    ev = MulticlassClassificationEvaluator()
    avg = metrics.report_averages(metrics.class_report(metrics.confusion_counts(mc))).first()
    assert ev.setMetricName("accuracy").evaluate(d) == pytest.approx(0.6)
    assert ev.setMetricName("f1").evaluate(d) == pytest.approx(avg.weighted_f1)


def test_multilabel_report(spark):
    rows = [([2.0, -1.0, 0.0, 1.0], [1, 0, 0, 1]), ([-2.0, 3.0, -1.0, 0.5], [0, 1, 1, 0]),
            ([-1.0, -1.0, -1.0, -1.0], [0, 0, 0, 1])]
    df = spark.createDataFrame(rows, "scores array<double>, truth array<int>")
    df = df.withColumn("flags", threshold(sigmoid(F.col("scores"))))
    assert [r.flags for r in df.collect()] == [[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0]]
    names = [f"f{i}" for i in range(4)]
    wide = df.select(*[F.col("truth")[i].alias(f"t{i}") for i in range(4)],
                     *[F.col("flags")[i].alias(f"p{i}") for i in range(4)])
    counts = metrics.flag_counts(wide, [f"t{i}" for i in range(4)], [f"p{i}" for i in range(4)])
    m = metrics.micro_prf(counts).first()
    assert (m.tp, m.fp, m.fn) == (3, 1, 2)
    assert m.micro_precision == pytest.approx(3 / 4) and m.micro_recall == pytest.approx(3 / 5)
    assert m.micro_f1 == pytest.approx(2 / 3)
    s = metrics.samples_avg(df, "truth", "flags").first()
    assert s.samples_precision == pytest.approx(0.5) and s.samples_recall == pytest.approx(0.5)
    assert s.samples_f1 == pytest.approx(0.5)
    assert len(names) == 4


def test_argmax_and_unwrap(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, 0.0],)], "s array<double>")
    assert df.select(argmax(F.col("s")).alias("a")).first().a == 1
    nested = spark.createDataFrame([([[0.0, 2.0], [9.0, 9.0]],)], "s array<array<double>>")
    assert nested.select(argmax(unwrap_scores(nested, "s")).alias("a")).first().a == 1


def test_best_fold(spark):
    s = spark.createDataFrame([(0, 0.5), (1, 0.7), (2, 0.7)], "fold int, score double")
    assert metrics.best_by(s, "score").first().fold == 1
    z = spark.createDataFrame([(0, 0.0), (1, 0.0)], "fold int, score double")
    assert metrics.best_by(z, "score").count() == 0


def test_split_and_folds_sizes(spark):
    rows = [(i, lab) for i, lab in enumerate(["a"] * 5 + ["b"] * 3 + ["c"] * 2)]
    df = spark.createDataFrame(rows, "row_id long, label string")
    sp = splits.split_stratified(df)
    per = {}
    for r in sp.collect():
        per.setdefault((r.label, r.split), 0)
        per[(r.label, r.split)] += 1
    assert per[("a", "train")] == 4 and per[("b", "train")] == 2 and per[("c", "train")] == 2
    assert per[("a", "test")] == 1 and per[("b", "test")] == 1 and ("c", "test") not in per
    train = sp.filter(F.col("split") == "train")
    folds = splits.folds_stratified(train, 5)
    per_label = {}
    for r in folds.orderBy("label").collect():
        per_label.setdefault(r.label, []).append(r.fold)
    assert sorted(per_label["a"]) == [0, 1, 2, 3] and sorted(per_label["b"]) == [0, 4]
    assert sorted(per_label["c"]) == [1, 2]
    sizes = sorted(r["count"] for r in folds.groupBy("fold").count().collect())
    assert sizes == [1, 1, 2, 2, 2]
    both = splits.split_with_folds(df, 5).filter(F.col("split") == "train")
    assert sorted((r.row_id, r.fold) for r in both.collect()) == sorted((r.row_id, r.fold) for r in folds.collect())
    rnd = splits.folds_random(train, 5)
    assert sorted(r["count"] for r in rnd.groupBy("fold").count().collect()) == [1, 1, 2, 2, 2]


def test_split_partitions_rows_exactly(spark):
    df = spark.range(997).select(F.col("id").alias("row_id"), (F.col("id") % 7).cast("string").alias("label"))
    sp = splits.split_stratified(df)
    assert sp.count() == 997 and sp.select("row_id").distinct().count() == 997
    assert sp.filter(F.col("split") == "test").count() == (997 + 4) // 5
    rs = splits.split_random(df)
    assert rs.filter(F.col("split") == "test").count() == (997 + 4) // 5
