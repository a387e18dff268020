"""Multinomial naive Bayes written as DataFrame aggregations and joins.

Inputs
  rows: ``grp, uid, class, split ('train'|'test'), fold`` - ``grp`` keys independent problems
        (a dataset/variant of the run matrix, or one flag of a multi-label table);
  tf:   ``uid, term, tf`` - term frequencies per text; or the same as blocks of texts (``blocks.term_blocks``), which
        exchange one row per block and term where the former exchange one per text and term.

A *model* is identified by the fold it leaves out: model ``k`` is fitted on the training rows whose
fold is not ``k``; model ``-1`` (``ALL``) on every training row. All models of all groups are fitted
in one job: a text's classes and folds in all groups are one row, its terms join it once, and one aggregate per term gives
the counts of every (group, class, fold) as columns. A model's counts are the total minus its own fold's.

Scoring uses the sparse form of the log-likelihood, so only (term, class) pairs with a non-zero
count are joined:

  score(d, c) = ln(n_c / n) + L_d * (ln a - ln(N_c + a V)) + sum_{t in d, c_t > 0} tf * ln((c_t + a) / a)

with L_d the number of in-vocabulary tokens of d, N_c the tokens of class c, V the vocabulary size
and a the smoothing. Out-of-vocabulary terms are skipped. The prediction is the arg max of the
score rounded to 6 decimals, lowest class on ties.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from . import blocks
from .joins import checked_broadcast, heavy_keys
from .layout import KEYED_BYTES, parts_of

ALL = -1
UNFOLDED = -2  # fold of a training row without one
MAX_BROADCAST_CLASS_ROWS = 1_000_000
# Bytes in memory of a term table that is broadcast: the key and 8 bytes a column of each term.
MAX_BROADCAST_MODEL_BYTES, KEY_BYTES = 256 << 20, 64
ROUND = 6


@dataclass
class NBModel:
    """``table``: one row per term, written; column ``n<g>_<c>_<f>`` counts it in class c and fold f of group g.
    ``classes``: the cells, (group number, group, class) in order; ``folds``: the folds, null as ``UNFOLDED``."""

    table: DataFrame
    cells: list[tuple[int, str, int]]
    folds: list[int]
    docs: dict[tuple[int, int, int], int]  # rows by (group number, class, fold)
    models: list[int]

    def cells_table(self) -> DataFrame:
        """term, counts: the counts above 0, a few for a rare term whatever the number of columns; each as count times columns plus its column's number."""
        names = self.columns()
        n = F.array(*[F.col(c) * F.lit(len(names)) + F.lit(i) for i, c in enumerate(names)])
        return self.table.select("term", F.filter(n, lambda x: x >= F.lit(len(names))).alias("counts"))

    def columns(self) -> list[str]:
        return [c for c in self.table.columns if c not in ("term", "texts")]

    def count(self, g: int, c: int, model: int) -> Column:
        """Occurrences of the term in the class, in the rows the model is fitted on; null if none."""
        kept = [F.col(f"n{g}_{c}_{f}".replace("-", "m")) for f in self.folds if f != model]
        total = kept[0] if kept else F.lit(0)
        for k in kept[1:]:
            total = total + k
        return F.when(total > 0, total)

    def slots(self) -> list[tuple[tuple[str, int], list[dict]]]:
        """((group, model), its classes with rows, log prior, tokens and vocabulary size), in order: groups x models x classes."""
        by_group: dict[tuple[int, str], list[int]] = {}
        for g, grp, c in self.cells:
            by_group.setdefault((g, grp), []).append(c)
        keys = [(g, grp, m) for g, grp in by_group for m in self.models]
        if not keys:
            return []
        aggs = []
        for j, (g, grp, m) in enumerate(keys):
            each = [self.count(g, c, m) for c in by_group[(g, grp)]]
            aggs.append(F.count(F.coalesce(*each)).alias(f"v{j}"))
            aggs += [F.coalesce(F.sum(n), F.lit(0)).alias(f"t{j}_{c}") for c, n in zip(by_group[(g, grp)], each)]
        sums = self.table.agg(*aggs).first()  # one row
        out = []
        for j, (g, grp, m) in enumerate(keys):
            rows = {c: sum(self.docs.get((g, c, f), 0) for f in self.folds if f != m) for c in by_group[(g, grp)]}
            total = sum(rows.values())
            out.append(((grp, m), [{"class": c, "g": g, "nd": n, "log_prior": math.log(n / total), "ntok": sums[f"t{j}_{c}"], "vsize": sums[f"v{j}"]}
                                   for c, n in sorted(rows.items()) if n]))
        return sorted(out, key=lambda s: s[0])

    def class_table(self, spark: SparkSession) -> DataFrame:
        """grp, model, class, nd, log_prior, ntok, vsize."""
        rows = [(grp, m, c["class"], c["nd"], c["log_prior"], c["ntok"], c["vsize"]) for (grp, m), cs in self.slots() for c in cs]
        return spark.createDataFrame(rows, "grp string, model int, class int, nd long, log_prior double, ntok long, vsize long")

    def counts(self, model: int = ALL) -> DataFrame:
        """grp, class, term, c (> 0) of one model."""
        each = F.array(*[F.struct(F.lit(grp).alias("grp"), F.lit(c).alias("class"), self.count(g, c, model).alias("c")) for g, grp, c in self.cells])
        return self.table.select("term", F.explode(each).alias("x")).select("x.grp", "x.class", "term", "x.c").where(F.col("c").isNotNull())


def term_frequencies(tokens: DataFrame, key: str = "uid") -> DataFrame:
    """``uid, term, tf`` from a token table (terms lower-cased)."""
    return tokens.groupBy(key, F.lower("term").alias("term")).agg(F.count(F.lit(1)).alias("tf"))


def fit(rows: DataFrame, tf: DataFrame, models: list[int]) -> NBModel:
    """Fit every requested model of every group (M5 / M6 / M8 in one job): one join on the text, one aggregate per term."""
    train = rows.filter(F.col("split") == "train").select("grp", "uid", "class", F.coalesce("fold", F.lit(UNFOLDED)).alias("fold"))
    found = train.groupBy("grp", "class", "fold").agg(F.count(F.lit(1)).alias("n")).collect()  # groups x classes x folds
    groups = {g: i for i, g in enumerate(sorted({r["grp"] for r in found}))}
    cells = sorted({(groups[r["grp"]], r["grp"], r["class"]) for r in found})
    folds = sorted({r["fold"] for r in found})
    docs = {(groups[r["grp"]], r["class"], r["fold"]): r["n"] for r in found}
    if blocks.are_blocks(tf):
        at = {(g, c, f): i for i, (g, c, f) in enumerate((g, c, f) for g, _, c in cells for f in folds)}
        numbers = train.sparkSession.createDataFrame([(grp, c, f, at[(g, c, f)]) for g, grp, c in cells for f in folds], "grp string, class int, fold int, cell int")
        own = train.groupBy("grp", "uid").agg(F.max(F.struct("class", "fold")).alias("m")).select("grp", "uid", "m.class", "m.fold")
        own = own.join(F.broadcast(numbers), ["grp", "class", "fold"]).groupBy("uid").agg(F.collect_list("cell").alias("cells"))
        names = [f"n{g}_{c}_{f}".replace("-", "m") for g, c, f in at]
        return NBModel(materialize(blocks.cell_counts(tf, own, names)), cells, folds, docs, models)
    own = [F.max(F.when(F.col("grp") == grp, F.struct("class", "fold"))).alias(f"g{g}") for grp, g in groups.items()]
    labelled = tf.join(train.groupBy("uid").agg(F.count(F.lit(1)).alias("_n"), *own), "uid")
    sums = [F.coalesce(F.sum(F.when((F.col(f"g{g}.class") == c) & (F.col(f"g{g}.fold") == f), F.col("tf"))), F.lit(0)).alias(f"n{g}_{c}_{f}".replace("-", "m"))
            for g, _, c in cells for f in folds]
    table = materialize(labelled.groupBy("term").agg(F.count(F.lit(1)).alias("texts"), *sums))
    return NBModel(table, cells, folds, docs, models)


def term_vectors(model: NBModel, slots: list[tuple[tuple, list]], alphas: list[float]) -> DataFrame:
    """One row per term: a column per (group, model), 1 where the term is in its vocabulary, and a column per (group,
    model, class, smoothing) with ``ln((c + a) / a)``, null where the class never has the term."""
    cols = []
    for j, ((_, m), classes) in enumerate(slots):
        counts = [model.count(c["g"], c["class"], m) for c in classes]
        cols.append(F.when(F.coalesce(*counts).isNotNull(), 1).alias(f"v{j}"))
        cols += [F.log((n + F.lit(float(a))) / F.lit(float(a))).alias(f"w{j}_{i}_{k}") for i, n in enumerate(counts) for k, a in enumerate(alphas)]
    return model.table.select("term", *cols)


def _sums_of_runs(model: NBModel, slots: list[tuple[tuple, list]], alphas: list[float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The sums of ``text_sums`` over rows (uid, tf, counts) sorted by uid, one row per text and batch; 0 where no term has a weight."""
    at = {c: i for i, c in enumerate(model.columns())}
    plan = [(j, [[at[f"n{c['g']}_{c['class']}_{f}".replace("-", "m")] for f in model.folds if f != m] for c in classes])
            for j, ((_, m), classes) in enumerate(slots)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            uid, tf = b.column("uid"), b.column("tf").to_numpy()
            new = pc.fill_null(pc.not_equal(uid.slice(1), uid.slice(0, n - 1)), True)
            starts = np.flatnonzero(np.r_[True, new.to_numpy(zero_copy_only=False)])
            held = np.zeros((len(at), n))
            rows = np.repeat(np.arange(n), pc.list_value_length(b.column("counts")).to_numpy())
            count, col = np.divmod(b.column("counts").flatten().to_numpy(), len(at))
            held[col, rows] = count
            out = {"uid": uid.take(pa.array(starts))}
            for j, classes in plan:
                totals = [held[kept].sum(axis=0) for kept in classes]
                out[f"v{j}"] = pa.array(np.add.reduceat(np.where(np.logical_or.reduce([t > 0 for t in totals]), tf, 0), starts), pa.int64())
                for i, t in enumerate(totals):
                    for k, a in enumerate(alphas):
                        out[f"w{j}_{i}_{k}"] = pa.array(np.add.reduceat(tf * np.log((t + a) / a), starts), pa.float64())
            yield pa.RecordBatch.from_pydict(out)

    return run


def text_sums(needed: DataFrame, model: NBModel, slots: list[tuple[tuple, list]], alphas: list[float]) -> DataFrame:
    """One row per text with a known term: the sums of the weights of its terms, named as in ``term_vectors``.

    A term table that is small in memory is broadcast. Beyond that only the heaviest terms' rows are; the others
    meet their terms by a shuffle and go on to their texts with the term's few counts above 0, so no row of weights
    is ever exchanged for a term of a text. Weights are then taken at the texts. Both exchanges are in parts of bounded size."""
    if blocks.are_blocks(needed):
        at = {c: i for i, c in enumerate(model.columns())}
        plan = [[[at[f"n{c['g']}_{c['class']}_{f}".replace("-", "m")] for f in model.folds if f != m] for c in classes] for (_, m), classes in slots]
        kinds = [x for j, classes in enumerate(plan) for x in [f"v{j} long", *[f"w{j}_{i}_{k} double" for i in range(len(classes)) for k in range(len(alphas))]]]
        return blocks.block_sums(needed, model.cells_table(), len(at), plan, alphas, ", ".join(["uid string", *kinds]))
    vectors = term_vectors(model, slots, alphas)
    names = [c for c in vectors.columns if c != "term"]
    sums = [(F.sum(F.when(F.col(c).isNotNull(), F.col("tf"))) if c.startswith("v") else F.sum(F.col("tf") * F.col(c))).alias(c) for c in names]
    if model.table.count() * (KEY_BYTES + 8 * len(names)) <= MAX_BROADCAST_MODEL_BYTES:
        return needed.join(F.broadcast(vectors), "term").groupBy("uid").agg(*sums)
    hot = F.broadcast(heavy_keys(needed, "term"))
    heavy = needed.join(hot, "term", "left_semi").join(F.broadcast(vectors.join(hot, "term", "left_semi")), "term")
    n = parts_of(needed, KEYED_BYTES)
    cells = model.cells_table().join(hot, "term", "left_anti").repartition(n, "term")
    light = needed.join(hot, "term", "left_anti").repartition(n, "term").join(cells.hint("merge"), "term")
    light = light.select("uid", "tf", "counts").repartition(n, "uid").sortWithinPartitions("uid")
    heavy = heavy.groupBy("uid").agg(*sums)
    both = heavy.unionByName(light.mapInArrow(_sums_of_runs(model, slots, alphas), heavy.schema))
    return both.groupBy("uid").agg(*[F.sum(c).alias(c) for c in names])


def predict(model: NBModel, targets: DataFrame, tf: DataFrame, alphas: list[float] | None = None, with_scores: bool = False,
            every: bool = False) -> DataFrame:
    """``grp, uid, model, alpha, pred`` for each target row ``grp, uid, model`` (M7, M12); ``with_scores`` adds the rounded
    scores of the model's classes, an array of (cls, score). With ``every`` the texts of ``tf`` are all targets, so its
    rows need no exchange to find those that are.

    A term's weights for all groups, models, classes and smoothing values are one row (``term_vectors``), so a text's
    terms are looked up once whatever it is scored for, and one aggregate per text gives all sums; the target rows
    then pick theirs. Priors and totals are numbers of the plan (one per group, model and class)."""
    alphas = alphas or [1.0]
    slots = [s for s in model.slots() if s[1]]
    if not slots:
        return targets.select("grp", "uid", "model", F.lit(None).cast("double").alias("alpha"), F.lit(None).cast("int").alias("pred"),
                              *[F.lit(None).cast("array<struct<cls:int,score:double>>").alias("scores")] * with_scores).limit(0)
    needed = tf if every or blocks.are_blocks(tf) else tf.join(targets.select("uid").distinct(), "uid", "left_semi")
    per_text = text_sums(needed, model, slots, alphas)

    def ranked_classes(j: int, n: int) -> Column:
        """(-score, class) of each class; the least one has the greatest rounded score, the lowest class on ties."""
        a, ranked = alphas[n], []
        for i, c in enumerate(slots[j][1]):
            score = (F.lit(c["log_prior"]) + F.coalesce(F.col(f"v{j}"), F.lit(0)) * F.lit(math.log(a) - math.log(c["ntok"] + a * c["vsize"]))
                     + F.coalesce(F.col(f"w{j}_{i}_{n}"), F.lit(0.0)))
            ranked.append(F.struct((-F.round(score, ROUND)).alias("neg"), F.lit(c["class"]).alias("cls")))
        return F.array(*ranked)

    scored = targets.join(per_text, "uid", "left")
    picked = None
    for j, ((grp, m), _) in enumerate(slots):
        preds = F.array(*[F.struct(F.lit(float(a)).alias("alpha"), ranked_classes(j, n).alias("ranked")) for n, a in enumerate(alphas)])
        own = (F.col("grp") == grp) & (F.col("model") == m)
        picked = F.when(own, preds) if picked is None else picked.when(own, preds)
    out = scored.select("grp", "uid", "model", F.explode(picked).alias("p")).withColumn("pred", F.array_min("p.ranked")["cls"])
    scores = [F.transform("p.ranked", lambda r: F.struct(r["cls"].alias("cls"), (-r["neg"]).alias("score"))).alias("scores")]
    return out.select("grp", "uid", "model", "p.alpha", "pred", *scores * with_scores)


def validation_targets(rows: DataFrame) -> DataFrame:
    """Each training row is scored by the model that left its fold out."""
    return rows.filter(F.col("split") == "train").select("grp", "uid", F.col("fold").alias("model"))


def all_targets(rows: DataFrame, models: list[int]) -> DataFrame:
    """Validation targets, and each test row with every one of ``models``: one pass scores both, the chosen model's rows
    are picked afterwards."""
    test = rows.filter(F.col("split") == "test").select("grp", "uid", F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    return validation_targets(rows).unionByName(test)


def holdout_targets(rows: DataFrame, model_of_group: DataFrame | None = None) -> DataFrame:
    """Each test row is scored by its group's chosen model (``grp, model``), else by ``ALL``."""
    test = rows.filter(F.col("split") == "test").select("grp", "uid")
    if model_of_group is None:
        return test.withColumn("model", F.lit(ALL))
    chosen = test.join(checked_broadcast(model_of_group, MAX_BROADCAST_CLASS_ROWS), "grp", "left")
    return chosen.withColumn("model", F.coalesce(F.col("model"), F.lit(ALL)))
