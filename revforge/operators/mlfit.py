"""MLlib forms of the classifiers (M5-M8, M10 on ``pyspark.ml``).

The four encoder configurations of the work being rebuilt become four Spark configurations:
naive Bayes on counts (``nb.py``), logistic regression on TF-IDF, logistic regression on given
dense vectors, and one-vs-rest linear SVM. Cross-validation uses the deterministic fold column, so
folds equal the ones of the DataFrame operators; it makes the fits of ``CrossValidator(foldCol=...)``, but those of
all folds beside one another. Weight decay maps to ``regParam``, epochs to ``maxIter``.
"""

from __future__ import annotations

from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# Width of the hashed term counts: every term of every text is counted, whatever the vocabulary's size.
FEATURES = 1 << 18


def hashed(df: DataFrame, rows: DataFrame | None = None, key: str = "row_id") -> DataFrame:
    """``df`` with its ``tokens`` as hashed term counts ``tf``, written: every fit of every fold and setting reads
    these (two numbers a distinct term) and neither hashes nor caches the words again. ``rows`` are joined by ``key`` to
    the counts, so the words themselves are neither moved nor written."""
    counts = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=FEATURES).transform(df).drop("tokens")
    return materialize(counts if rows is None else counts.join(rows, key))


def tfidf_lr(reg: float = 0.1, max_iter: int = 50) -> Pipeline:
    """On the column ``tf`` of ``hashed``."""
    idf = IDF(inputCol="tf", outputCol="features")
    lr = LogisticRegression(featuresCol="features", labelCol="label_code", regParam=reg, maxIter=max_iter)
    return Pipeline(stages=[idf, lr])


@dataclass
class CrossValidated:
    bestModel: PipelineModel  # noqa: N815 - named as in pyspark.ml
    avgMetrics: list[float]  # noqa: N815


def cross_validated_lr(train: DataFrame, regs: list[float], max_iters: list[int], folds: int,
                       parallelism: int = 3) -> CrossValidated:
    """Fit TF-IDF + logistic regression over a (regParam x maxIter) grid with the given fold column.

    ``train`` needs ``tf`` (``hashed``), ``label_code`` (int) and ``fold`` (int). ``train`` is cached once for all folds, a
    fold's idf is fitted once for all settings, and ``parallelism`` fits run beside one another whatever their fold: an
    iteration is mostly waiting (gradients as wide as the hash go to the driver and back), and a fit caches its own rows."""
    grid = [(reg, n) for reg in regs for n in max_iters]
    ev = MulticlassClassificationEvaluator(labelCol="label_code", predictionCol="prediction", metricName="accuracy")
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    pool = ThreadPool(parallelism)
    own_session = inheritable_thread_target(train.sparkSession)
    try:
        sizes = {r["fold"]: r["count"] for r in train.groupBy("fold").count().collect()}  # one row a fold
        if sizes.keys() != set(range(folds)) or folds < 2:
            raise ValueError(f"each of the folds 0 to {folds - 1} needs rows, and no row another fold: {sizes}")
        idfs = pool.map(own_session(lambda k: IDF(inputCol="tf", outputCol="features").fit(train.filter(F.col("fold") != k))), range(folds))

        def accuracy(fit: tuple[int, int]) -> float:
            k, j = fit
            model = tfidf_lr(*grid[j]).getStages()[-1].fit(idfs[k].transform(train.filter(F.col("fold") != k)))
            return ev.evaluate(model.transform(idfs[k].transform(train.filter(F.col("fold") == k))))

        fits = sorted(((k, j) for k in range(folds) for j in range(len(grid))), key=lambda f: -grid[f[1]][1])  # the longest first
        found = dict(zip(fits, pool.map(own_session(accuracy), fits, chunksize=1)))
        means = [float(np.mean([found[k, j] for k in range(folds)])) for j in range(len(grid))]
        return CrossValidated(tfidf_lr(*grid[int(np.argmax(means))]).fit(train), means)
    finally:
        pool.terminate()
        train.unpersist()


def vector_lr(train: DataFrame, vector_col: str, label: str, reg: float = 0.01, max_iter: int = 100):
    """Logistic regression on a given dense array column (a frozen encoder plus a linear head)."""
    feats = train.withColumn("features", array_to_vector(F.col(vector_col)))
    return LogisticRegression(featuresCol="features", labelCol=label, regParam=reg, maxIter=max_iter).fit(feats)


def ovr_svc(train: DataFrame, reg: float = 0.1, max_iter: int = 25):
    """One-vs-rest linear SVM on TF-IDF features."""
    tf = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=FEATURES)
    idf = IDF(inputCol="tf", outputCol="features")
    ovr = OneVsRest(classifier=LinearSVC(regParam=reg, maxIter=max_iter), featuresCol="features",
                    labelCol="label_code")
    return Pipeline(stages=[tf, idf, ovr]).fit(train)


def per_flag_lr(train: DataFrame, flags: list[str], reg: float = 0.1, max_iter: int = 25) -> dict:
    """Multi-label: one logistic regression per flag over shared TF-IDF features."""
    tf = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=FEATURES)
    feats = tf.transform(train)
    idf = IDF(inputCol="tf", outputCol="features").fit(feats)
    feats = idf.transform(feats)
    models = {f: LogisticRegression(featuresCol="features", labelCol=f, regParam=reg, maxIter=max_iter)
              .fit(feats.withColumn(f, F.col(f).cast("double"))) for f in flags}
    return {"vectorizer": tf, "idf": idf, "models": models}


def predict_flags(fitted: dict, df: DataFrame, flags: list[str]) -> DataFrame:
    feats = fitted["idf"].transform(fitted["vectorizer"].transform(df))
    out = feats.select("row_id", "features")
    for f in flags:
        m = fitted["models"][f]
        out = m.setPredictionCol(f"pred_{f}").setProbabilityCol(f"p_{f}").setRawPredictionCol(f"r_{f}") \
            .transform(out).drop(f"p_{f}", f"r_{f}")
    return out.drop("features")
