"""Cross-validation with the folds beside one another against MLlib's own."""

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

from revforge.operators import mlfit


@pytest.fixture(scope="module")
def train(spark):
    tokens = spark.createDataFrame([(i, [f"t{i * k % 7}" for k in range(2, 6)] + [f"c{i % 2}"] * (i % 5 > 0)) for i in range(60)], "row_id long, tokens array<string>")
    rows = spark.createDataFrame([(i, i % 2, i // 2 % 3) for i in range(60)], "row_id long, label_code int, fold int")
    return mlfit.hashed(tokens, rows)


def test_rows_are_joined_to_the_counts(train):
    assert train.columns == ["row_id", "tf", "label_code", "fold"] and train.count() == 60


def test_same_means_and_model_as_the_serial_one(spark, train):
    pipe = mlfit.tfidf_lr()
    lr = pipe.getStages()[-1]
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.1]).addGrid(lr.maxIter, [1, 6]).build()
    ev = MulticlassClassificationEvaluator(labelCol="label_code", predictionCol="prediction", metricName="accuracy")
    want = CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=ev, numFolds=3, foldCol="fold").fit(train)
    got = mlfit.cross_validated_lr(train, [0.1], [1, 6], 3)
    assert got.avgMetrics == pytest.approx(want.avgMetrics, abs=1e-12)
    one, other = ([r.prediction for r in m.bestModel.transform(train).orderBy("row_id").collect()] for m in (got, want))
    assert one == other
    assert not train.storageLevel.useMemory


def test_a_fold_without_rows_is_an_error(train):
    with pytest.raises(ValueError, match="folds 0 to 3"):
        mlfit.cross_validated_lr(train, [0.1], [1], 4)
