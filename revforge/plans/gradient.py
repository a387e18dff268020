"""Registered queries of the gradient-trained classifier: history, best epochs, search, full reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import LABEL_CODES, REPORT_ORDER
from ..operators import metrics, search, softmax
from ..session import materialize
from .common import normalise
from .models import FLAGS, FOLDS, ML_FOLDS, flag_texts, pair_texts

REPORT_CLASSES = [(LABEL_CODES[n], n) for n in REPORT_ORDER]
# ---- fixed values: settings of the cross-validated runs (rate, decay, epochs, train and evaluation batch) ----
MULTICLASS = softmax.Candidate(3e-5, 0.1, 5, 16, 64)
MULTILABEL = softmax.Candidate(3e-5, 0.1, 5, 16, 64)


def _pairs(spark: SparkSession, root: str) -> DataFrame:
    rows, texts = pair_texts(spark, root)
    return softmax.pack_shards(rows.select("uid", F.array("class").alias("labels"), "fold"), softmax.text_features(texts))


def _flags(spark: SparkSession, root: str) -> DataFrame:
    """One row a text with its four flags: the text's terms are taken once for all flags."""
    rows, texts = flag_texts(spark, root)
    wide = rows.groupBy("uid").agg(F.first("fold", ignorenulls=True).alias("fold"), *[
        F.max(F.when(F.col("grp") == f"flag{j}", F.col("class"))).alias(f"f{j}") for j in range(len(FLAGS))])
    return softmax.pack_shards(wide.select("uid", F.array(*[f"f{j}" for j in range(len(FLAGS))]).alias("labels"), "fold"), softmax.text_features(texts))


def _report(preds: DataFrame, by: str) -> DataFrame:
    """Accuracy, P / R / F1 of every class, macro and weighted averages, one row per ``by``."""
    rep = materialize(metrics.class_report(metrics.confusion_counts(preds, "truth", "pred", by=[by], classes=[c for c, _ in REPORT_CLASSES])))
    return (metrics.accuracy(preds, "truth", "pred", by=[by]).join(metrics.wide_metrics(rep, by, REPORT_CLASSES), by)
            .join(metrics.report_averages(rep, by=[by]), by))


def q_softmax_history(spark: SparkSession, root: str) -> DataFrame:
    """Scores of every fold's model after every epoch (folds from 1)."""
    f = softmax.fit(_pairs(spark, root), softmax.Settings([MULTICLASS], list(range(FOLDS)), len(LABEL_CODES)))
    return normalise(f.history.select((F.col("left_out") + 1).alias("fold"), "epoch", "n", "accuracy", "loss"))


def q_softmax_best_epoch(spark: SparkSession, root: str) -> DataFrame:
    """Each fold's best epoch, on the history of real fits."""
    f = softmax.fit(_pairs(spark, root), softmax.Settings([MULTICLASS], list(range(FOLDS)), len(LABEL_CODES)))
    best = softmax.best_epochs(f.history, ["left_out"])
    return normalise(best.select((F.col("left_out") + 1).alias("fold"), "best_epoch", "accuracy", "loss"))


def q_softmax_report(spark: SparkSession, root: str) -> DataFrame:
    """The full report of each fold's model at its best epoch (folds from 1), and of the best fold's model on the
    held-out part (fold 0)."""
    folds = list(range(FOLDS))
    f = softmax.fit(_pairs(spark, root), softmax.Settings([MULTICLASS], folds, len(LABEL_CODES)))
    best = softmax.best_epochs(f.history, ["left_out"])
    val = softmax.predict(f).select((F.col("left_out") + 1).alias("fold"), "truth", "pred")
    # the best fold's model alone scores the held-out part: a join with a table of one row
    top = best.orderBy(F.desc("accuracy"), "left_out").limit(1).select("left_out")
    test = softmax.predict(f, "test").join(F.broadcast(top), "left_out").select(F.lit(0).cast("long").alias("fold"), "truth", "pred")
    return normalise(_report(materialize(val.unionByName(test)), "fold"))


def q_softmax_multilabel(spark: SparkSession, root: str) -> DataFrame:
    """P / R / F1 of every flag, micro averages and the share of right flags, for each fold's model at its best epoch."""
    f = softmax.fit(_flags(spark, root), softmax.Settings([MULTILABEL], list(range(ML_FOLDS)), 2, len(FLAGS)))
    preds = materialize(softmax.predict(f).select((F.col("left_out") + 1).alias("fold"), "uid", "target", "truth", "pred"))
    hit = lambda t, p: F.sum(((F.col("truth") == t) & (F.col("pred") == p)).cast("long"))
    rep = metrics.class_report(preds.groupBy("fold", F.col("target").alias("class")).agg(
        hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), F.sum("truth").alias("support")))
    micro = metrics.micro_prf(metrics.pooled_flag_counts(preds, "truth", "pred", by=["fold"]), by=["fold"])
    return normalise(metrics.accuracy(preds, "truth", "pred", by=["fold"]).join(
        metrics.wide_metrics(rep, "fold", list(enumerate(FLAGS))), "fold").join(micro, "fold"))


def candidates_of(table: DataFrame) -> list[softmax.Candidate]:
    """The drawn candidates (as many rows as the search budget)."""
    return [softmax.Candidate(r["learning_rate"], r["weight_decay"], r["epochs"], r["train_batch"], r["eval_batch"], r["candidate"])
            for r in table.orderBy("candidate").collect()]


def q_softmax_search(spark: SparkSession, root: str) -> DataFrame:
    """Every candidate trained on the train part and scored on the held-out part at its best epoch, all in one run."""
    table = search.sample_candidates(spark)
    f = softmax.fit(_pairs(spark, root), softmax.Settings(candidates_of(table), [softmax.TEST], len(LABEL_CODES)))
    best = softmax.best_epochs(f.history, ["candidate"])
    return normalise(search.pick_best(table.join(best, "candidate"), "accuracy"))


QUERIES = {
    "softmax_history": q_softmax_history,
    "softmax_best_epoch": q_softmax_best_epoch,
    "softmax_report": q_softmax_report,
    "softmax_multilabel": q_softmax_multilabel,
    "softmax_search": q_softmax_search,
}
