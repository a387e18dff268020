"""Joins on terms where one term holds most rows, splits by hash cells and choices by length against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from revforge.operators import balance, joins, nb, splits


@pytest.fixture
def no_small_tables(monkeypatch):
    """No table passes the size check."""
    monkeypatch.setattr(joins, "small_enough", lambda df, max_rows, max_bytes=0: (False, df))


def tokens_of(spark):
    rng = random.Random(2)
    rows = [(i, "the") for i in range(3000)] + [(i, rng.choice([f"t{k}" for k in range(400)])) for i in range(3000)] + [(7, None)]
    return spark.createDataFrame(rows, "uid long, term string")


@pytest.mark.parametrize("how", ["inner", "left"])
def test_term_join_equals_a_join(spark, no_small_tables, how):
    tokens = tokens_of(spark)
    table = spark.createDataFrame([("the", 1)] + [(f"t{k}", k) for k in range(0, 400, 2)], "term string, v long")
    got = sorted(joins.term_join(tokens, table, "term", how).collect(), key=str)
    assert got == sorted(tokens.join(table, "term", how).collect(), key=str)


def test_the_commonest_term_is_never_a_shuffle_key(spark, no_small_tables, monkeypatch):
    """The sketch finds the heavy term; its rows are joined by broadcast, and the shuffled part is without it."""
    monkeypatch.setattr(joins, "HEAVY_KEYS", 3)
    tokens = tokens_of(spark)
    heavy = {r.term for r in joins.heavy_keys(tokens, "term", 3, 1000).collect()}
    assert "the" in heavy and len(heavy) <= 3
    table = spark.createDataFrame([("the", 1)] + [(f"t{k}", k) for k in range(400)], "term string, v long")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = joins.term_join(tokens, table, "term")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Union" in plan and "BroadcastHashJoin" in plan and "SortMergeJoin" in plan
        hot = F.broadcast(spark.createDataFrame([(t,) for t in heavy], "term string"))
        light = tokens.join(hot, "term", "left_anti")
        assert light.where("term = 'the'").count() == 0
        assert df.count() == 6000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_scoring_reads_the_terms_once(spark):
    """Four groups share their texts: one join with the term table, whatever the groups and models."""
    rows = spark.createDataFrame([(f"g{g}", i, (i + g) % 2, "train" if i < 30 else "test", i % 2 if i < 30 else None) for g in range(4) for i in range(40)],
                                 "grp string, uid long, class int, split string, fold int")
    tf = spark.createDataFrame([(i, f"t{k}", 1 + (i * k) % 3) for i in range(40) for k in range(i % 5, 12)], "uid long, term string, tf long")
    model = nb.fit(rows, tf, [nb.ALL, 0, 1])
    preds = nb.predict(model, nb.all_targets(rows, [nb.ALL, 0, 1]), tf)
    plan = preds._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner, (term") + plan.count("Join Inner, (term#") // 2 <= 2
    assert preds.count() == 4 * (30 + 10 * 3)


def hashed(seed, x):
    return hashlib.md5(f"{seed}:{x}".encode()).hexdigest()


def test_splits_by_cells_equal_a_sort(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("aaaaaaaab")) for i in range(5000)] + [(9000, "c"), (9001, None)]
    df = spark.createDataFrame(rows, "row_id long, label string").repartition(5)
    got = {r.row_id: r for r in splits.split_with_folds(df, 5).collect()}
    alone = {r.row_id: r.split for r in splits.split_stratified(df).collect()}
    folds = {r.row_id: r.fold for r in splits.folds_stratified(df, 5).collect()}
    alloc = {r.label: r.n_train_class for r in splits.class_allocation(df, "label").collect()}
    offset, position = 0, 0
    for label in sorted(alloc, key=lambda x: (x is not None, x or "")):
        own = sorted((hashed(42, i), i) for i, x in rows if x == label)
        for rank, (_, i) in enumerate(own, 1):
            train = rank <= alloc[label]
            assert alone[i] == got[i].split == ("train" if train else "test")
            assert got[i].fold == ((offset + rank - 1) % 5 if train else None)
            assert folds[i] == position % 5
            position += 1
        offset += alloc[label]
    order = sorted((hashed(42, i), i) for i, _ in rows)
    random_split = {r.row_id: r.split for r in splits.split_random(df).collect()}
    both = {r.row_id: (r.split, r.fold) for r in splits.split_with_random_folds(df, 2).collect()}
    n_train = len(rows) - -(-len(rows) // 5)
    for p, (_, i) in enumerate(order):
        want = "train" if p < n_train else "test"
        assert random_split[i] == want and both[i] == (want, p % 2 if p < n_train else None)


def test_split_by_cells_of_nothing(spark):
    df = spark.createDataFrame([], "row_id long, label string")
    assert splits.split_with_folds(df, 5).count() == splits.split_stratified(df).count() == splits.split_random(df).count() == 0


def test_a_holdout_split_shuffles_no_wide_row(spark):
    """The rows themselves meet the cuts by broadcast only."""
    df = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("string").alias("label"), F.repeat(F.lit("x"), 10).alias("review"))
    plan = splits.split_stratified(df)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange" in line and "review" in line]


@pytest.mark.parametrize("descending", [True, False])
def test_choice_by_length_equals_a_sort(spark, descending):
    rng = random.Random(6)
    rows = [(i, rng.choice([0, 0, 0, 1, 2]), rng.choice([None, "", "a", "bb", "bb", "bb", "x" * rng.randint(0, 30)])) for i in range(3000)]
    rows += [(9999, 3, "alone")]
    df = spark.createDataFrame(rows, "row_id long, new_label int, review string").repartition(6)
    quota = {0: 700, 1: 5, 2: 10_000, 3: 4}
    got = {r.row_id: (r.new_label, r.class_rank, r.review) for r in balance.balance(df, quota, descending).collect()}
    want = {}
    for c, k in quota.items():
        own = sorted((r for r in rows if r[1] == c), key=lambda r: (r[2] is None, (-len(r[2]) if descending else len(r[2])) if r[2] is not None else 0, r[0]))
        want.update({r[0]: (c, n, r[2]) for n, r in enumerate(own[:k], 1)})
    assert got == want
    if descending:
        every = sorted(rows, key=lambda r: (r[2] is None, -len(r[2] or ""), r[0]))
        assert sorted(r.row_id for r in balance.top_longest(df, 75).collect()) == sorted(r[0] for r in every[:75])
        cuts = {r.row_id: (r.length_rank, r.cut) for r in balance.nested_cuts(df, [3, 50]).collect()}
        assert cuts == {r[0]: (n, 3 if n <= 3 else 50) for n, r in enumerate(every[:50], 1)}
        ranks = {r.row_id: r.length_rank for r in balance.sort_by_length(df).collect()}
        assert ranks == {r[0]: n for n, r in enumerate(every, 1)}


def test_no_text_is_shuffled_before_the_choice(spark):
    df = spark.range(500).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("new_label"), F.repeat(F.lit("x"), 9).alias("review"))
    plan = balance.balance_longest(df, {0: 5, 1: 5, 2: 5})._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line or "SinglePartition" in line]
    assert not [line for line in exchanged if "review" in line]
