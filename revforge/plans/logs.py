"""Registered training-log queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import trainlog
from ..sources import bindings
from .common import normalise

LOG_FOLDS = 5


def q_loss_carry(spark: SparkSession, root: str) -> DataFrame:
    c = trainlog.loss_carry(bindings.training_log(spark, root))
    return normalise(c.select("run", "seq", "training_loss", "validation_loss"))


def q_loss_log_snapshots(spark: SparkSession, root: str) -> DataFrame:
    log = bindings.training_log(spark, root).withColumn("fold", F.pmod(F.col("run"), F.lit(LOG_FOLDS)))
    s = trainlog.loss_log_snapshots(log, LOG_FOLDS)
    return normalise(s.groupBy("snapshot").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("training_loss").alias("n_with_train"),
        F.sum("training_loss").alias("sum_training_loss"), F.sum("validation_loss").alias("sum_validation_loss"),
        F.sum("seq").alias("sum_seq")))


def q_best_epoch(spark: SparkSession, root: str) -> DataFrame:
    ev = bindings.read_table(spark, root, "events").select(
        F.col("user_id").alias("run"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("metric"))
    return normalise(trainlog.best_epoch(ev, "run", ["ts", "seq"], "metric"))


def q_loss_carry_stream(spark: SparkSession, root: str) -> DataFrame:
    from ..streaming.loss_stream import loss_carry_stream
    c = loss_carry_stream(spark, bindings.training_log_stream(spark, root))
    return normalise(c.select("run", "seq", "training_loss", "validation_loss"))


QUERIES = {
    "loss_carry": q_loss_carry,
    "loss_log_snapshots": q_loss_log_snapshots,
    "best_epoch": q_best_epoch,
    "loss_carry_stream": q_loss_carry_stream,
}
