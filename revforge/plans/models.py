"""Registered classifier queries: naive Bayes fit / predict / cross-validation / holdout / search /
run matrix (M1-M13 on Spark)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import REPORT_ORDER, LABEL_CODES
from ..operators import blocks, centroids, labels, metrics, nb, search, splits, textops
from ..operators.columns import filter_present
from ..operators.matrix import matrix_problem
from ..sources import bindings
from ..session import materialize
from .common import normalise

FOLDS = 5
ML_FOLDS = 2
FLAGS = ["bug_report", "user_experience", "rating", "feature_request"]
REPORT_CLASSES = [(LABEL_CODES[n], n) for n in REPORT_ORDER]


def _tf(texts: DataFrame) -> DataFrame:
    """Term frequencies per text, written once (checkpoint) and reused by fit and predict."""
    return materialize(nb.term_frequencies(textops.token_table(texts, key="uid", clean=True, keyed=True), key="uid"))


def pair_texts(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Hard 4-class target: (quality, toxic) pairs; stratified 80/20 split, 5 stratified folds. The rows (written), and uid with its text."""
    p = filter_present(bindings.pair_class_reviews(spark, root))
    p = labels.label_apply(p, labels.label_fit(p))
    rows = splits.split_with_folds(p.select("row_id", "label", "label_code"), FOLDS, label="label").select(
        F.lit("pairs").alias("grp"), F.col("row_id").alias("uid"), F.col("label_code").alias("class"),
        "split", "fold")
    return materialize(rows), p.select(F.col("row_id").alias("uid"), "review")


def pair_problem(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """``pair_texts`` with the texts' term frequencies."""
    rows, texts = pair_texts(spark, root)
    return rows, _tf(texts)


def flag_texts(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Multi-label target: four flags as four binary problems; random split, 2 random folds. The rows (written), and uid with its text."""
    m = filter_present(bindings.multilabel_reviews(spark, root))
    base = splits.split_with_random_folds(m.select("row_id", *FLAGS), ML_FOLDS)
    per_flag = F.explode(F.array(*[F.struct(F.lit(j).alias("flag"), F.col(c).alias("class"))
                                   for j, c in enumerate(FLAGS)])).alias("f")
    rows = base.select(F.col("row_id").alias("uid"), "split", "fold", per_flag).select(
        F.concat(F.lit("flag"), F.col("f.flag").cast("string")).alias("grp"), "uid",
        F.col("f.class").alias("class"), "split", "fold")
    return materialize(rows), m.select(F.col("row_id").alias("uid"), "review")


def flag_problem(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """``flag_texts`` with the texts' term frequencies."""
    rows, texts = flag_texts(spark, root)
    return rows, _tf(texts)


def _truth(rows: DataFrame) -> DataFrame:
    return rows.select("grp", "uid", F.col("class").alias("truth"))


def cv_scores(rows: DataFrame, tf: DataFrame, folds: int, model: nb.NBModel | None = None) -> DataFrame:
    """Validation predictions of every fold's model, joined to the truth."""
    model = model or nb.fit(rows, tf, list(range(folds)))
    preds = nb.predict(model, nb.validation_targets(rows), tf)
    return preds.join(_truth(rows), ["grp", "uid"])


def q_nb_term_counts(spark, root):
    rows, tf = pair_problem(spark, root)
    model = nb.fit(rows, tf, [nb.ALL])
    terms = model.counts().groupBy("class").agg(F.count(F.lit(1)).alias("n_terms"))
    return normalise(model.class_table(spark).join(terms, "class", "left").select(
        "class", "nd", "ntok", "vsize", F.coalesce("n_terms", F.lit(0)).alias("n_terms")))


def q_nb_predict(spark, root):
    rows, tf = pair_problem(spark, root)
    preds = nb.predict(nb.fit(rows, tf, [nb.ALL]), nb.holdout_targets(rows), tf)
    return normalise(preds.join(_truth(rows), ["grp", "uid"]).select(
        F.col("uid").alias("row_id"), "truth", "pred"))


def q_cv_multiclass(spark, root):
    rows, tf = pair_problem(spark, root)
    j = cv_scores(rows, tf, FOLDS)
    acc = metrics.accuracy(j, "truth", "pred", by=["model"])
    avg = metrics.report_averages(metrics.class_report(metrics.confusion_counts(j, "truth", "pred", by=["model"])),
                                  by=["model"])
    return normalise(acc.join(avg.select("model", "macro_f1", "weighted_f1"), "model")
                     .withColumnRenamed("model", "fold"))


def scored_parts(rows: DataFrame, tf: DataFrame, folds: int) -> DataFrame:
    """``grp, uid, model, split, truth, pred``: validation rows by the model that left them out, test rows by every model
    (and the one of all training rows), in one pass; written, as reports read it more than once."""
    models = [nb.ALL, *range(folds)]
    preds = nb.predict(nb.fit(rows, tf, models), nb.all_targets(rows, models), tf, every=True)
    return materialize(preds.join(rows.select("grp", "uid", F.col("class").alias("truth"), "split"), ["grp", "uid"])
                       .select("grp", "uid", "model", "split", "truth", "pred"))


def of_dataset(tf: DataFrame, dataset: str) -> DataFrame:
    """The terms of one dataset's texts, whose ids (``<dataset>:<row id>``) name it."""
    if blocks.are_blocks(tf):
        return tf.filter(F.col("dataset") == dataset)
    return tf.filter(F.substring_index("uid", ":", 1) == dataset)


def scored_datasets(rows: DataFrame, tf: DataFrame, folds: int) -> DataFrame:
    """``scored_parts`` of stacked datasets. Groups of one dataset (its variants) share texts and are scored together; the
    datasets (a few) follow one another, as all their classes and folds at once would be hundreds of columns."""
    datasets = sorted({r["grp"].split("|")[0] for r in rows.select("grp").distinct().collect()})
    out = None
    for d in datasets:
        part = scored_parts(rows.filter(F.col("grp").startswith(f"{d}|")), of_dataset(tf, d), folds)
        out = part if out is None else out.unionByName(part)
    return out


def chosen_model(rows: DataFrame, scores: DataFrame, metric: str) -> DataFrame:
    """The one-row table of the best fold's model (``ALL`` if every score is 0)."""
    best = metrics.best_by(scores, metric, key="model").select("model")
    return best.unionByName(rows.sparkSession.createDataFrame([(nb.ALL,)], "model int")).agg(F.max("model").cast("int").alias("model"))


def held_out(rows: DataFrame, scored: DataFrame, scores: DataFrame, metric: str) -> DataFrame:
    """The test rows as the chosen model scores them."""
    return scored.filter(F.col("split") == "test").join(F.broadcast(chosen_model(rows, scores, metric)), "model")


def _pair_scores(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(problem rows, scored rows, the validation part)."""
    rows, tf = pair_problem(spark, root)
    scored = scored_parts(rows, tf, FOLDS)
    return rows, scored, scored.filter(F.col("split") == "train")


def _flag_scores(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows, tf = flag_problem(spark, root)
    scored = scored_parts(rows, tf, ML_FOLDS)
    return rows, scored, scored.filter(F.col("split") == "train")


def class_table(j: DataFrame, by: str = "model") -> DataFrame:
    """Accuracy, P / R / F1 of every class and the printed averages, one row per ``by``."""
    rep = metrics.class_report(metrics.confusion_counts(j, "truth", "pred", by=[by], classes=[c for c, _ in REPORT_CLASSES]))
    return (metrics.accuracy(j, "truth", "pred", by=[by]).join(metrics.wide_metrics(rep, by, REPORT_CLASSES), by)
            .join(metrics.report_averages(rep, by=[by]), by))


def flag_table(j: DataFrame, by: str = "model") -> DataFrame:
    """Micro P / R / F1, P / R / F1 of every flag and the printed averages, one row per ``by`` (a long table of flags)."""
    hit = lambda t, p: F.sum(((F.col("truth") == t) & (F.col("pred") == p)).cast("long"))
    counts = j.groupBy(by, F.substring("grp", 5, 9).cast("int").alias("class")).agg(
        hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), F.sum("truth").cast("long").alias("support"))
    rep = metrics.class_report(counts)
    return (_micro(j, [by]).join(metrics.wide_metrics(rep, by, list(enumerate(FLAGS))), by)
            .join(metrics.report_averages(rep, by=[by]), by).join(metrics.samples_avg_long(j, "uid", "truth", "pred", by=[by]), by))


def _folds_from_one(df: DataFrame) -> DataFrame:
    return df.withColumn("model", F.col("model") + 1).withColumnRenamed("model", "fold")


def q_cv_multiclass_report(spark, root):
    """The table written per fold: accuracy and P / R / F1 of every class, folds from 1."""
    return normalise(_folds_from_one(class_table(_pair_scores(spark, root)[2])))


def q_holdout_multiclass_report(spark, root):
    """The full report of the best fold's model on the held-out part, averages included."""
    rows, scored, val = _pair_scores(spark, root)
    return normalise(_folds_from_one(class_table(held_out(rows, scored, metrics.accuracy(val, "truth", "pred", by=["model"]), "accuracy"))))


def q_cv_multilabel_report(spark, root):
    return normalise(_folds_from_one(flag_table(_flag_scores(spark, root)[2])))


def q_holdout_multilabel_report(spark, root):
    rows, scored, val = _flag_scores(spark, root)
    return normalise(_folds_from_one(flag_table(held_out(rows, scored, _micro(val, ["model"]), "micro_f1"))))


def q_holdout_multiclass(spark, root):
    rows, scored, val = _pair_scores(spark, root)
    j = held_out(rows, scored, metrics.accuracy(val, "truth", "pred", by=["model"]), "accuracy")
    rep = metrics.class_report(metrics.confusion_counts(j, "truth", "pred", by=["model"], classes=[0, 1, 2, 3]))
    wide = metrics.wide_metrics(rep, "model", REPORT_CLASSES)
    out = metrics.accuracy(j, "truth", "pred", by=["model"]).join(wide, "model")
    return normalise(out.withColumnRenamed("model", "best_fold"))


def q_nb_multilabel(spark, root):
    rows, tf = flag_problem(spark, root)
    preds = nb.predict(nb.fit(rows, tf, [nb.ALL]), nb.holdout_targets(rows), tf)
    return normalise(preds.join(_truth(rows), ["grp", "uid"]).select(
        F.col("uid").alias("row_id"), F.col("grp").alias("flag"), "truth", "pred"))


def _micro(j: DataFrame, by: list[str]) -> DataFrame:
    return metrics.micro_prf(metrics.pooled_flag_counts(j, "truth", "pred", by=by), by=by)


def q_cv_multilabel(spark, root):
    rows, tf = flag_problem(spark, root)
    return normalise(_micro(cv_scores(rows, tf, ML_FOLDS), ["model"]).withColumnRenamed("model", "fold"))


def q_holdout_multilabel(spark, root):
    rows, scored, val = _flag_scores(spark, root)
    j = held_out(rows, scored, _micro(val, ["model"]), "micro_f1")
    out = _micro(j, ["model"]).join(metrics.samples_avg_long(j, "uid", "truth", "pred", by=["model"]), "model")
    return normalise(out.withColumnRenamed("model", "best_fold"))


def q_hp_search(spark, root):
    """Score every candidate's smoothing on the held-out part (as the search being rebuilt does)."""
    rows, tf = pair_problem(spark, root)
    cands = search.smoothing_of(search.sample_candidates(spark))
    alphas = [r["alpha"] for r in cands.select("alpha").collect()]  # bounded by the search budget
    preds = nb.predict(nb.fit(rows, tf, [nb.ALL]), nb.holdout_targets(rows), tf, alphas)
    acc = metrics.accuracy(preds.join(_truth(rows), ["grp", "uid"]), "truth", "pred", by=["alpha"])
    scored = cands.join(acc.select("alpha", "accuracy"), "alpha")
    return normalise(search.pick_best(scored, "accuracy"))


def q_run_matrix(spark, root):
    rows, texts = matrix_problem(spark, root, FOLDS)
    tf = materialize(blocks.term_blocks(texts))
    scored = scored_datasets(rows, tf, FOLDS)
    acc = metrics.accuracy(scored.filter(F.col("split") == "train"), "truth", "pred", by=["grp", "model"])
    best = acc.filter(F.col("accuracy") > 0).groupBy("grp").agg(
        F.min(F.struct((-F.col("accuracy")).alias("neg"), F.col("model").alias("m"))).alias("b")
    ).select("grp", F.col("b.m").alias("best"))
    # one row a group; a group without a score above 0 takes the model of all training rows
    j = scored.filter(F.col("split") == "test").join(F.broadcast(best), "grp", "left").filter(
        F.col("model") == F.coalesce("best", F.lit(nb.ALL)))
    hacc = metrics.accuracy(j, "truth", "pred", by=["grp", "model"])
    avg = metrics.report_averages(metrics.class_report(
        metrics.confusion_counts(j, "truth", "pred", by=["grp", "model"])), by=["grp", "model"])
    out = hacc.join(avg.select("grp", "model", "macro_f1"), ["grp", "model"])
    parts = F.split("grp", r"\|")
    return normalise(out.select(parts[0].alias("dataset"), parts[1].alias("variant"),
                                F.col("model").alias("best_fold"), F.col("n").alias("n_test"),
                                "accuracy", "macro_f1"))


def _lower_tokens(df: DataFrame) -> DataFrame:
    """Lower-cased token arrays, tokenized after spreading a coarse input over the cluster."""
    from ..functions.text import clean_ascii, word_tokens
    from ..operators.layout import spread
    return spread(df, "row_id").withColumn(
        "tokens", F.transform(word_tokens(clean_ascii("review")), lambda t: F.lower(t)))


def _pair_tokens(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Pair target: row_id with token arrays, and the rows with split and folds (the same folds as the naive Bayes path),
    ranked without tokens."""
    p = filter_present(bindings.pair_class_reviews(spark, root))
    p = labels.label_apply(p, labels.label_fit(p))
    folds = splits.split_with_folds(p.select("row_id", "label", "label_code"), FOLDS, label="label")
    return _lower_tokens(p.select("row_id", "review")).select("row_id", "tokens"), folds


def _ml_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Pair target with token arrays, split and folds, written once: fits read it more than once, which would
    otherwise re-run tokenizing and the split numbering."""
    tokens, folds = _pair_tokens(spark, root)
    return materialize(tokens.join(folds, "row_id"))


def q_lr_multiclass(spark, root):
    """TF-IDF + logistic regression, (regParam x maxIter) grid cross-validated on the fold column."""
    from ..operators import mlfit
    d = mlfit.hashed(*_pair_tokens(spark, root))
    cvm = mlfit.cross_validated_lr(d.filter(F.col("split") == "train"), [0.1], [10, 25], FOLDS)
    pred = cvm.bestModel.transform(d.filter(F.col("split") == "test"))
    return normalise(pred.select("row_id", F.col("label_code").alias("truth"), F.col("prediction").alias("pred")))


def q_ovr_svc(spark, root):
    from ..operators import mlfit
    d = _ml_pairs(spark, root)
    pred = mlfit.ovr_svc(d.filter(F.col("split") == "train")).transform(d.filter(F.col("split") == "test"))
    return normalise(pred.select("row_id", F.col("label_code").alias("truth"), F.col("prediction").alias("pred")))


def q_lr_multilabel(spark, root):
    from ..operators import mlfit
    m = _lower_tokens(filter_present(bindings.multilabel_reviews(spark, root)))
    s = materialize(splits.split_random(m.select("row_id", "tokens", *FLAGS)))
    fitted = mlfit.per_flag_lr(s.filter(F.col("split") == "train"), FLAGS)
    return normalise(mlfit.predict_flags(fitted, s.filter(F.col("split") == "test"), FLAGS))


def q_embed_lr(spark, root):
    """Logistic regression on the given dense vectors (frozen encoder + linear head)."""
    from ..operators import mlfit
    e = bindings.read_table(spark, root, "embeddings").select(
        F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("int").alias("label"))
    s = splits.split_stratified(e, label="label", key="vec_id")
    model = mlfit.vector_lr(s.filter(F.col("split") == "train"), "embedding", "label")
    test = s.filter(F.col("split") == "test").withColumn("features", F.col("embedding"))
    from pyspark.ml.functions import array_to_vector
    pred = model.transform(test.withColumn("features", array_to_vector("embedding")))
    return normalise(pred.select("vec_id", F.col("label").alias("truth"), F.col("prediction").alias("pred")))


def q_embed_means(spark, root):
    """Held-out vectors by the nearest class mean of the training vectors."""
    e = bindings.read_table(spark, root, "embeddings").select(
        F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("int").alias("label"))
    s = splits.split_stratified(e, label="label", key="vec_id")
    means = centroids.class_means(s.filter(F.col("split") == "train"), "embedding", "label")
    pred = centroids.nearest_mean(s.filter(F.col("split") == "test"), means, "embedding", "label")
    return normalise(pred.select("vec_id", F.col("label").alias("truth"), "pred"))


def q_dataset_catalog(spark, root):
    """The data directory as a dataset catalog: files by size, with name pieces and rank."""
    from ..sources import io
    return normalise(io.dataset_catalog(spark, root, "*.parquet"))


QUERIES = {
    "lr_multiclass": q_lr_multiclass,
    "ovr_svc": q_ovr_svc,
    "lr_multilabel": q_lr_multilabel,
    "embed_lr": q_embed_lr,
    "embed_means": q_embed_means,
    "dataset_catalog": q_dataset_catalog,
    "nb_term_counts": q_nb_term_counts,
    "nb_predict": q_nb_predict,
    "cv_multiclass": q_cv_multiclass,
    "holdout_multiclass": q_holdout_multiclass,
    "nb_multilabel": q_nb_multilabel,
    "cv_multilabel": q_cv_multilabel,
    "holdout_multilabel": q_holdout_multilabel,
    "cv_multiclass_report": q_cv_multiclass_report,
    "holdout_multiclass_report": q_holdout_multiclass_report,
    "cv_multilabel_report": q_cv_multilabel_report,
    "holdout_multilabel_report": q_holdout_multilabel_report,
    "hp_search": q_hp_search,
    "run_matrix": q_run_matrix,
}
