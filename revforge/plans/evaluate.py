"""Registered split and metric queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import FLAG_ORDER, LABEL_CODES, REPORT_ORDER
from ..functions.scores import argmax, sigmoid, threshold, unwrap_scores
from ..operators import centroids, labels, metrics, nb, splits
from ..operators.columns import filter_present
from ..session import materialize
from ..sources import bindings
from .common import coded_reviews, normalise
from .models import FLAGS, FOLDS, cv_scores, flag_problem, pair_problem

NO_SCORE = -1e9  # of a class that a model never met
REPORT_CLASSES = [(LABEL_CODES[n], n) for n in REPORT_ORDER]


def present(spark: SparkSession, root: str) -> DataFrame:
    return filter_present(coded_reviews(spark, root)).select("row_id", "label", "new_label")


def scored(spark: SparkSession, root: str) -> DataFrame:
    """Every training row of the pair problem as the naive Bayes model that left its fold out predicts it."""
    rows, tf = pair_problem(spark, root)
    return materialize(cv_scores(rows, tf, FOLDS).select(F.col("uid").alias("row_id"), F.col("model").alias("fold"), "truth", "pred"))


def flag_scored(spark: SparkSession, root: str) -> DataFrame:
    """Held-out multi-label rows with the log odds of each flag as logits, and the flags after sigmoid and threshold."""
    rows, tf = flag_problem(spark, root)
    preds = nb.predict(nb.fit(rows, tf, [nb.ALL]), nb.holdout_targets(rows), tf, with_scores=True)

    def score(cls: int) -> Column:
        return F.coalesce(F.get(F.filter("scores", lambda s: s["cls"] == cls), F.lit(0))["score"], F.lit(NO_SCORE))

    odds = preds.join(rows.select("grp", "uid", F.col("class").alias("truth")), ["grp", "uid"]).select("uid", "grp", "truth", (score(1) - score(0)).alias("odds"))
    of = lambda c, j: F.max(F.when(F.col("grp") == f"flag{j}", F.col(c)))
    s = odds.groupBy(F.col("uid").alias("row_id")).agg(*[of("truth", j).alias(c) for j, c in enumerate(FLAGS)],
                                                       F.array(*[of("odds", j) for j in range(len(FLAGS))]).alias("logits"))
    s = s.withColumn("flags", threshold(sigmoid(F.col("logits"))))
    return materialize(s.select("row_id", *FLAGS, "logits", "flags", *[F.col("flags")[j].alias(f"pred_{c}") for j, c in enumerate(FLAGS)]))


def q_split_stratified(spark, root):
    return normalise(splits.split_stratified(present(spark, root)).select("row_id", "label", "split"))


def q_split_random(spark, root):
    return normalise(splits.split_random(present(spark, root)).select("row_id", "split"))


def q_folds_stratified(spark, root):
    both = splits.split_with_folds(present(spark, root), FOLDS)
    return normalise(both.filter(F.col("split") == "train").select("row_id", "label", "fold"))


def q_folds_random(spark, root):
    both = splits.split_with_random_folds(present(spark, root), 2)
    return normalise(both.filter(F.col("split") == "train").select("row_id", "fold"))


def q_fold_train_val(spark, root):
    f = splits.folds_stratified(present(spark, root), FOLDS)
    r = splits.fold_train_val(f, FOLDS)
    return normalise(r.groupBy("round", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("sum_id")))


def q_accuracy(spark, root):
    return normalise(metrics.accuracy(scored(spark, root), by=["fold"]))


def q_confusion_counts(spark, root):
    return normalise(metrics.confusion_counts(scored(spark, root), by=["fold"], classes=[0, 1, 2, 3]))


def q_class_report(spark, root):
    rep = metrics.class_report(metrics.confusion_counts(scored(spark, root), classes=[0, 1, 2, 3]))
    return normalise(rep)


def q_report_averages(spark, root):
    rep = metrics.class_report(metrics.confusion_counts(scored(spark, root), by=["fold"]))
    return normalise(metrics.report_averages(rep, by=["fold"]))


def q_wide_metrics(spark, root):
    s = scored(spark, root)
    rep = metrics.class_report(metrics.confusion_counts(s, by=["fold"], classes=[0, 1, 2, 3]))
    wide = metrics.wide_metrics(rep, "fold", REPORT_CLASSES)
    return normalise(metrics.accuracy(s, by=["fold"]).drop("n").join(wide, "fold"))


def q_best_fold(spark, root):
    return normalise(metrics.best_by(metrics.accuracy(scored(spark, root), by=["fold"]), "accuracy"))


def q_fold_scores(spark, root):
    acc = metrics.accuracy(scored(spark, root), by=["fold"])
    coll = metrics.collect_scores(acc, "accuracy")
    return coll.select(F.array_join(F.transform(
        "scores", lambda x: F.format_string("%d:%.6f", x["fold"], x["accuracy"])), ",").alias("scores"))


def q_label_decode(spark, root):
    s = scored(spark, root)
    d = labels.label_fit(filter_present(bindings.pair_class_reviews(spark, root)))
    return normalise(labels.label_decode(s, d, "pred", "pred_label").select("row_id", "pred", "pred_label"))


def q_label_encode(spark, root):
    p = bindings.pair_class_reviews(spark, root)
    d = labels.label_fit(p)
    return normalise(labels.label_apply(p, d).select("row_id", "label", "label_code"))


def q_argmax_label(spark, root):
    """Nested scores (a tuple whose first item holds the logits): minus the distances of each vector to the class means."""
    e = bindings.read_table(spark, root, "embeddings").select(
        F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("int").alias("label"))
    scores = centroids.mean_scores(e, centroids.class_means(e, "embedding", "label"), "embedding", "label")
    nested = scores.select("vec_id", F.array(F.col("scores"), F.array(F.lit(0.0))).alias("logits"))
    return normalise(nested.select("vec_id", argmax(unwrap_scores(nested, "logits")).alias("pred")))


def q_sigmoid_flags(spark, root):
    s = flag_scored(spark, root)
    return normalise(s.select("row_id", *[f"pred_{c}" for c in FLAGS]))


def q_micro_prf(spark, root):
    s = flag_scored(spark, root)
    counts = metrics.flag_counts(s, FLAGS, [f"pred_{c}" for c in FLAGS])
    return normalise(metrics.micro_prf(counts))


def q_flag_report(spark, root):
    s = flag_scored(spark, root)
    rep = metrics.class_report(metrics.flag_counts(s, FLAGS, [f"pred_{c}" for c in FLAGS]))
    names = F.element_at(F.array(*[F.lit(n) for n in FLAG_ORDER]), F.col("class") + 1)
    return normalise(rep.withColumn("flag", names))


def q_samples_avg(spark, root):
    s = flag_scored(spark, root)
    s = s.withColumn("truth", F.array(*[F.col(c) for c in FLAGS]))
    return normalise(metrics.samples_avg(s, "truth", "flags"))


QUERIES = {
    "split_stratified": q_split_stratified,
    "split_random": q_split_random,
    "folds_stratified": q_folds_stratified,
    "folds_random": q_folds_random,
    "fold_train_val": q_fold_train_val,
    "accuracy": q_accuracy,
    "confusion_counts": q_confusion_counts,
    "class_report": q_class_report,
    "report_averages": q_report_averages,
    "wide_metrics": q_wide_metrics,
    "best_fold": q_best_fold,
    "fold_scores": q_fold_scores,
    "label_decode": q_label_decode,
    "label_encode": q_label_encode,
    "argmax_label": q_argmax_label,
    "sigmoid_flags": q_sigmoid_flags,
    "micro_prf": q_micro_prf,
    "flag_report": q_flag_report,
    "samples_avg": q_samples_avg,
}
