"""Naive Bayes scoring with a term table too large to broadcast: the same rows, narrow exchanges."""

from revforge.operators import nb


def _problem(spark):
    rows = spark.createDataFrame([(f"g{g}", i, (i + g) % 3, "train" if i < 30 else "test", i % 2 if i < 30 else None) for g in range(2) for i in range(40)],
                                 "grp string, uid long, class int, split string, fold int")
    terms = [(i, f"t{k}", 1 + (i * k) % 3) for i in range(40) for k in range(i % 5, 30, 1 + i % 4)] + [(35, "new", 2), (3, None, 1), (36, None, 1)]
    return rows, spark.createDataFrame(terms, "uid long, term string, tf long")


def test_large_tables_give_the_same_rows(spark, monkeypatch):
    rows, tf = _problem(spark)
    model = nb.fit(rows, tf, [nb.ALL, 0, 1])
    targets = nb.all_targets(rows, [nb.ALL, 0, 1])
    want = sorted(nb.predict(model, targets, tf, [1.0, 0.5], with_scores=True).collect(), key=str)
    monkeypatch.setattr(nb, "MAX_BROADCAST_MODEL_BYTES", 0)
    monkeypatch.setattr(nb, "heavy_keys", lambda df, key: spark.createDataFrame([("t4",), ("t7",)], "term string"))
    assert want and sorted(nb.predict(model, targets, tf, [1.0, 0.5], with_scores=True).collect(), key=str) == want


def test_broadcast_is_bounded_by_memory_not_by_file_size(spark, monkeypatch):
    """Many small columns write to a small file and are large rows in memory; light terms move without their weights."""
    monkeypatch.setattr(nb, "MAX_BROADCAST_MODEL_BYTES", 4_000)  # 31 terms of 3 models of 2 groups of 3 classes need more
    rows, tf = _problem(spark)
    model = nb.fit(rows, tf, [nb.ALL, 0, 1])
    plan = nb.predict(model, nb.all_targets(rows, [nb.ALL, 0, 1]), tf)._jdf.queryExecution().optimizedPlan().toString()
    moved = [line for line in plan.splitlines() if "RepartitionByExpression [uid" in line]
    assert moved
    below = plan.splitlines()[plan.splitlines().index(moved[0]) + 1]
    assert "counts" in below and "tf" in below and "w0_" not in below
