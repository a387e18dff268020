"""Naive Bayes operators against a direct numpy computation on a small fixture."""

import math

import numpy as np
from pyspark.sql import functions as F

from revforge.operators import nb


def _brute(train_docs, test_doc, alpha):
    classes = sorted({c for c, _ in train_docs})
    vocab = sorted({t for _, d in train_docs for t in d})
    n = len(train_docs)
    best = None
    for c in classes:
        docs = [d for cc, d in train_docs if cc == c]
        counts = {t: sum(d.count(t) for d in docs) for t in vocab}
        total = sum(counts.values())
        s = math.log(len(docs) / n)
        for t in test_doc:
            if t in counts:
                s += math.log((counts[t] + alpha) / (total + alpha * len(vocab)))
        s = round(s, 6)
        if best is None or s > best[0]:
            best = (s, c)
    return best[1]


def test_predict_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(12)]
    docs = []
    for i in range(60):
        c = int(rng.integers(0, 3))
        bias = words[c * 3:(c + 1) * 3]
        d = list(rng.choice(words, 6)) + list(rng.choice(bias, 4))
        docs.append((i, c, [str(x) for x in d]))
    rows = spark.createDataFrame([("g", i, c, "train" if i < 45 else "test", i % 3 if i < 45 else None)
                                  for i, c, _ in docs], "grp string, uid long, class int, split string, fold int")
    tf = spark.createDataFrame([(i, t, d.count(t)) for i, _, d in docs for t in set(d)], "uid long, term string, tf long")
    model = nb.fit(rows, tf, [nb.ALL, 0, 1, 2])
    for alpha in (1.0, 0.5):
        got = {r.uid: r.pred for r in nb.predict(model, nb.holdout_targets(rows), tf, [alpha]).collect()}
        train = [(c, d) for i, c, d in docs if i < 45]
        for i, c, d in docs[45:]:
            assert got[i] == _brute(train, d, alpha)
    # leave-one-fold-out models equal a fit on the other folds
    val = {(r.uid, r.model): r.pred for r in nb.predict(model, nb.validation_targets(rows), tf).collect()}
    for i, c, d in docs[:45]:
        train = [(cc, dd) for j, cc, dd in docs[:45] if j % 3 != i % 3]
        assert val[(i, i % 3)] == _brute(train, d, 1.0)
    assert F is not None


def test_every_text_a_target_needs_no_exchange_of_terms(spark):
    """Where each text of the terms is a target, the result is the same without the join that finds them."""
    from revforge.plans.models import of_dataset
    rows = spark.createDataFrame([("a|x", f"a:{i}", i % 2, "train" if i < 9 else "test", i % 2 if i < 9 else None) for i in range(12)],
                                 "grp string, uid string, class int, split string, fold int")
    terms = [(f"a:{i}", f"t{k}", 1 + (i * k) % 3) for i in range(12) for k in range(i % 4, 6)] + [("a", "t1", 1), ("ab:1", "t1", 9), ("b", "t2", 1)]
    tf = spark.createDataFrame(terms, "uid string, term string, tf long")
    own = of_dataset(tf, "a")
    assert {r.uid for r in own.collect()} == {"a", *(f"a:{i}" for i in range(12))}  # a text without a row id is named by its dataset alone
    model, targets = nb.fit(rows, own, [nb.ALL, 0, 1]), nb.all_targets(rows, [nb.ALL, 0, 1])
    got = nb.predict(model, targets, own, every=True)
    assert sorted(got.collect(), key=str) == sorted(nb.predict(model, targets, tf).collect(), key=str)
    assert "LeftSemi" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_cross_validation_reads_hashed_counts(spark):
    """The words are hashed once, in front of the folds; no fit has them."""
    from revforge.operators import mlfit
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, [])], "row_id long, tokens array<string>")
    got = mlfit.hashed(df)
    assert got.columns == ["row_id", "tf"] and sorted(sum(r.tf.values) for r in got.collect()) == [0.0, 3.0]
    assert [type(s).__name__ for s in mlfit.tfidf_lr().getStages()] == ["IDF", "LogisticRegression"]
