"""Features straight from the texts, and the shards packed from them, against the term table they stand for."""

import numpy as np

from revforge.operators import nb, softmax, textops

FEATURES = 64
TEXTS = [(1, "One two two three, don't stop; 12,500 times!"), (2, ""), (3, None), (4, "...  -- ??"), (5, "two TWO Two"), (5, "two more"),
         (6, "café über 中"), (7, "中文"), (8, " ".join(f"w{i % 90}" for i in range(700))), (None, "of no one")]


def both(spark):
    texts = spark.createDataFrame(TEXTS, "uid long, review string")
    tf = nb.term_frequencies(textops.token_table(texts, key="uid", clean=True))
    return texts, softmax.text_features(texts, FEATURES), softmax.term_features(tf, FEATURES)


def test_features_of_texts_are_those_of_their_terms(spark):
    _, got, want = both(spark)
    assert got.columns == want.columns
    found, wanted = ({r.uid: r for r in d.collect()} for d in (got, want))
    assert found.keys() == wanted.keys() == {None, 1, 4, 5, 6, 8}
    for k, r in found.items():
        assert r.cols == wanted[k].cols and np.allclose(r.vals, wanted[k].vals, atol=1e-14)


def test_terms_are_not_exchanged(spark):
    """One exchange, of the texts by their key; no row of a term is written or moved."""
    plan = both(spark)[1]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan


def test_a_block_is_its_rows(spark):
    """A batch's dense block has each row's values in the columns used, the bias last; a text without terms has the bias alone."""
    texts, got, _ = both(spark)
    rows = spark.createDataFrame([(1, [0], 0), (2, [1], 0), (5, [1], 1), (8, [0], -1)], "uid long, labels array<int>, fold int")
    packed = softmax.pack_shards(rows, got)
    s = softmax.Shard(packed.first(), 1, FEATURES)
    assert s.uids == ["1", "2", "5", "8"]
    w = np.random.default_rng(1).normal(size=(FEATURES + 1, 3))
    feats = {r.uid: r for r in got.collect()}
    for order in ([0, 1, 2, 3], [3, 1], [1]):
        used, x = s.block(np.array(order))
        assert list(used) == sorted(set(used)) and used[-1] == FEATURES and (x[:, -1] == 1).all()
        for k, r in enumerate(order):
            f = feats.get(int(s.uids[r]))
            want = w[FEATURES] + (np.array(f.vals) @ w[f.cols] if f else 0.0)
            assert np.allclose(x[k] @ w[used], want) and np.allclose(s.logits(w, np.array(order))[k], want)
