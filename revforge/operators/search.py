"""Hyper-parameter candidates and search.

Candidates are seeded draws from the search space (``md5`` units, reproducible in any engine):
uniform ``a + u (b - a)``, integer ``a + floor(u (b - a + 1))``, log-uniform integer
``round(exp(ln a + u (ln b - ln a)))``. Random search stands in for a Gaussian-process search.
The whole candidate set is scored in one job: the smoothing of each candidate is one more key of
the naive Bayes scoring (``nb.predict(alphas=...)``).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.constants import SEARCH_CALLS, SEARCH_SPACE, SEED
from ..functions.hashing import hash_unit


def sample_candidates(spark: SparkSession, n: int = SEARCH_CALLS, seed: int = SEED) -> DataFrame:
    """``candidate, <one column per dimension>``: ``n`` seeded draws."""
    df = spark.range(n).withColumnRenamed("id", "candidate")
    cols = [F.col("candidate")]
    for dim, (kind, lo, hi) in SEARCH_SPACE.items():
        u = hash_unit(f"{seed}-{dim}", "candidate")
        if kind == "uniform":
            v = F.round(F.lit(lo) + u * F.lit(hi - lo), 10)
        elif kind == "int":
            v = (F.lit(lo) + F.floor(u * F.lit(hi - lo + 1))).cast("long")
        else:
            v = F.round(F.exp(F.lit(math.log(lo)) + u * F.lit(math.log(hi) - math.log(lo)))).cast("long")
        cols.append(v.alias(dim))
    return df.select(cols)


def smoothing_of(candidates: DataFrame) -> DataFrame:
    """Map a candidate to the naive Bayes smoothing it tunes: ten times its weight decay."""
    return candidates.withColumn("alpha", F.round(F.col("weight_decay") * 10, 6))


def pick_best(scores: DataFrame, metric: str, key: str = "candidate") -> DataFrame:
    """Flag the best candidate: highest metric, lowest key on ties (minimising -metric).

    ``scores`` has one row per candidate (bounded by the search budget)."""
    w = Window.orderBy(F.col(metric).desc(), F.col(key).asc())
    return scores.withColumn("is_best", (F.row_number().over(w) == 1).cast("int"))
