"""Texts as blocks of term counts: the same tokens, counts, models and features as from rows of terms."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from revforge.functions.text import clean_ascii, word_tokens
from revforge.operators import blocks, nb, softmax, textops

PIECES = ["Don't", "don’t", "IT'S", "we'll've", "n't", "'s", "cannot", "CANNOT", "Gonna", "d'ye", "more'n", "12,500", "1:2x", "a,b", "v3.5", "well-known", "a--b", "...", "....", "x_y", "_", "a/b/",
          "café", "İ", "😀", "字", "\t", "\n", "\x00", "\x7f", " ", "  ", "'", "o'clock's", ".", ",", "(", "word", "Word", "a1b2"]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(9)
    join = lambda n: "".join(rng.choice(PIECES) + rng.choice(["", " ", " "]) for _ in range(n))
    rows = [(f"{d}:{i}", join(rng.randint(0, 40))) for d in ("one", "two") for i in range(150)]
    rows += [("one:3", "again this id"), ("one:3", "this"), ("two:9", None), ("two", "no row id"), ("one:900", ""), ("one:901", " \n")]
    return spark.createDataFrame(rows, "uid string, review string")


def tf_of(texts):
    return nb.term_frequencies(textops.token_table(texts, key="uid", clean=True, keyed=True), key="uid")


def test_tokens_are_those_of_the_column_expression(spark, texts):
    rows = texts.where(F.col("review").isNotNull()).select("review", F.transform(word_tokens(clean_ascii("review")), F.lower).alias("t")).collect()
    for r in rows:
        assert [p.decode() for t in blocks.tokens_of(r.review.encode()) for p in blocks.parts_of_token(t)] == r.t


def test_blocks_hold_the_term_frequencies(spark, texts):
    want = sorted(map(tuple, tf_of(texts).collect()))
    got = []
    for r in blocks.term_blocks(texts).collect():
        b = blocks.Block(r.asDict())
        assert {u.split(":")[0] for u in b.uids} == {r.dataset} and len(set(b.terms)) == len(b.terms)
        got += [(b.uids[t], b.terms[i], int(n)) for t, i, n in zip(b.texts(), b.ids, b.tfs)]
    assert sorted(got) == want


def test_models_and_predictions_from_blocks(spark, texts):
    rng = random.Random(10)
    ids = sorted({r.uid for r in texts.collect()}) + ["one:none"]
    rows = [(g, u, rng.randrange(3), *rng.choice([("train", 0), ("train", 1), ("train", None), ("test", None)])) for g in ("one|a", "one|b") for u in ids if rng.random() < 0.8]
    rows += rows[:5]
    rows = spark.createDataFrame(rows, "grp string, uid string, class int, split string, fold int")
    packed, plain, models = blocks.term_blocks(texts), tf_of(texts), [nb.ALL, 0, 1]
    a, b = nb.fit(rows, plain, models), nb.fit(rows, packed, models)
    for m in models:
        assert sorted(map(tuple, a.counts(m).collect())) == sorted(map(tuple, b.counts(m).collect()))
    assert a.slots() == b.slots()
    for every in (False, True):
        targets = nb.all_targets(rows, models)
        p, q = (sorted(((r.grp, r.uid, r.model, r.alpha, r.pred, [(s.cls, round(s.score, 5)) for s in r.scores])
                        for r in nb.predict(m, targets, tf, [1.0, 0.1], with_scores=True, every=every).collect()), key=str) for m, tf in ((a, plain), (b, packed)))
        assert len(p) > 300 and p == q


def test_only_rows_of_blocks_and_terms_are_exchanged(spark, texts):
    """The cost that grew with the texts' terms: no exchange of a fit or a prediction has (text, term) rows."""
    packed = blocks.term_blocks(texts)
    cells = texts.select("uid").distinct().withColumn("cells", F.array(F.lit(0)))
    plan = blocks.cell_counts(packed, cells, ["n"])._jdf.queryExecution().executedPlan().toString()
    assert "posexplode(terms" not in plan and "FlatMapCoGroupsInArrow" in plan
    assert blocks.cell_counts(packed, cells, ["n"]).agg(F.sum("n")).first()[0] == tf_of(texts).agg(F.sum("tf")).first()[0]


def test_features_from_blocks(spark, texts):
    a, b = ({r.uid: (list(r.cols), list(r.vals)) for r in f.collect()} for f in (softmax.term_features(tf_of(texts), 64), softmax.block_features(blocks.term_blocks(texts), 64)))
    assert a.keys() == b.keys() and all(a[u][0] == b[u][0] and np.allclose(a[u][1], b[u][1], rtol=1e-12) for u in a)


def test_an_epoch_over_rows_of_single_targets():
    """Rows that have one target of three change that target's columns alone, in the batches of all rows."""
    rng = np.random.default_rng(11)
    n, targets, classes, features = 90, 3, 4, 40
    st = softmax.Settings([softmax.Candidate(1e-5, 0.1, 3, 8, 16)], [0, 1], classes, targets, features)
    labels = np.full((n, targets), -1, np.int32)
    labels[np.arange(n), rng.integers(0, 2, n)] = rng.integers(0, classes, n)
    counts = rng.integers(0, 6, n)

    class Row:
        shard, uids, folds = 5, [str(i) for i in range(n)], rng.integers(-1, 2, n).astype(np.int32).tobytes()
        starts = np.append(0, np.cumsum(counts)).astype(np.int64).tobytes()
        cols = np.concatenate([np.sort(rng.choice(features, c, replace=False)) for c in counts]).astype(np.int32).tobytes()
        vals = rng.random(counts.sum()).tobytes()

    Row.labels = labels.tobytes()
    s, c, start = softmax.Shard(Row, targets, features), st.candidates[0], rng.normal(size=(features + 1, st.width))
    rows = np.random.default_rng([st.seed, 1, s.no]).permutation(np.flatnonzero(s.folds != softmax.TEST))
    steps, w, scale = -(-len(rows) // 8), start.copy(), 1.0
    keep = (s.folds[:, None] != np.array([0, 1])[None, :]).astype(float)
    for k in range(steps):
        batch = rows[k * 8:(k + 1) * 8]
        used, x = s.block(batch)
        p = softmax._softmax((x @ w[used] * scale).reshape(len(batch), 2, targets, classes))
        p -= np.eye(classes)[np.maximum(labels[batch], 0)][:, None]
        kept = keep[batch][:, :, None] * (labels[batch] >= 0)[:, None, :]
        p *= (kept / np.maximum(kept.sum(axis=0), 1.0))[:, :, :, None]
        scale *= 1.0 - c.rate * c.decay * softmax.DECAY_SCALE
        w[used] -= c.rate * softmax.STEP_SCALE * (1.0 - (steps + k) / (3 * steps)) / scale * (x.T @ p.reshape(len(batch), -1))
    got = softmax.run_epoch(s, start, c, st, 1)
    assert np.allclose(got, w * scale, rtol=1e-10, atol=1e-12)
    blank = got.reshape(features + 1, 2, targets, classes)[:, :, 2]
    assert np.allclose(blank, start.reshape(features + 1, 2, targets, classes)[:, :, 2] * scale)
