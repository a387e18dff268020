"""Distributed row numbering and the blocked carry, against single-partition brute force."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from revforge.operators import trainlog
from revforge.operators.ordering import ordered_index, rank_within


def test_ordered_index_matches_row_number(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 3).alias("g"))
    got = ordered_index(df, [F.col("g"), F.col("k")], name="pos", num_partitions=7)
    ref = df.withColumn("pos", F.row_number().over(Window.orderBy("g", "k")))
    assert sorted(got.select("g", "k", "pos").collect()) == sorted(ref.select("g", "k", "pos").collect())


def test_rank_within_hot_group(spark):
    # one group holds most rows: it is spread over many range partitions
    df = spark.range(3000).select(F.when(F.col("id") < 2500, 0).otherwise(F.col("id") % 5).alias("g"),
                                  F.col("id").alias("k"))
    got = rank_within(df, ["g"], [F.col("k").desc()], name="r", num_partitions=9)
    ref = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.col("k").desc())))
    assert sorted(got.select("g", "k", "r").collect()) == sorted(ref.select("g", "k", "r").collect())


def test_rank_within_many_groups(spark, monkeypatch):
    """Group starts too large to be broadcast unseen are written for the check; a null group is one too."""
    from revforge.operators import joins
    df = spark.range(600).select(F.when(F.col("id") % 7 > 0, F.col("id") % 7).alias("g"), F.col("id").alias("k"))
    ref = sorted(df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("k"))).select("g", "k", "r").collect(), key=str)
    real = joins.estimated_bytes
    monkeypatch.setattr(joins, "estimated_bytes", lambda d: real(d) if joins.is_plain_scan(d) else 1 << 40)
    assert sorted(rank_within(df, ["g"], [F.col("k")], name="r").select("g", "k", "r").collect(), key=str) == ref
    monkeypatch.setattr(joins, "estimated_bytes", lambda d: 1 << 40)  # nor is the written table small
    assert sorted(rank_within(df, ["g"], [F.col("k")], name="r").select("g", "k", "r").collect(), key=str) == ref


def _log(spark, rows):
    base = dt.datetime(2024, 1, 1)
    data = [(run, base + dt.timedelta(seconds=s), seq, kind, loss) for run, s, seq, kind, loss in rows]
    return spark.createDataFrame(data, "run long, ts timestamp, seq long, kind string, loss double")


def test_blocked_carry_equals_window(spark):
    import random
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 2), i, i, rnd.choice(["train", "eval", "eval"]), float(i)) for i in range(400)]
    log = _log(spark, rows)
    got = trainlog.loss_carry(log, block_rows=7)
    w = Window.partitionBy("run").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    ref = (log.withColumn("training_loss", F.last(F.when(F.col("kind") == "train", F.col("loss")), True).over(w))
           .filter(F.col("kind") == "eval").select("run", "seq", "training_loss"))
    assert sorted(got.select("run", "seq", "training_loss").collect()) == sorted(ref.collect())


def test_log_snapshots_golden(spark):
    # FIXTURES.md 3.5: 2 folds x 2 epochs, each fold ends with an extra eval after the save
    seq = [(0, "train", .9), (0, "eval", .8), (0, "train", .7), (0, "eval", .75), (0, "eval", .75),
           (1, "train", .6), (1, "eval", .65), (1, "train", .5), (1, "eval", .55), (1, "eval", .55)]
    rows = [(0, i, i, k, v) for i, (_, k, v) in enumerate(seq)]
    log = _log(spark, rows).withColumn("fold", F.when(F.col("seq") < 5, 0).otherwise(1))
    snaps = trainlog.loss_log_snapshots(log, 2, block_rows=3)
    got = {}
    for r in snaps.orderBy("snapshot", "seq").collect():
        got.setdefault(r.snapshot, []).append((r.training_loss, r.validation_loss))
    assert got[0] == [(.9, .8), (.7, .75)]
    assert got[1] == [(.9, .8), (.7, .75), (.7, .75), (.6, .65), (.5, .55)]


def test_eval_before_train_is_null(spark):
    log = _log(spark, [(0, 0, 0, "eval", 1.0), (0, 1, 1, "train", 2.0), (0, 2, 2, "eval", 3.0)])
    got = sorted((r.seq, r.training_loss) for r in trainlog.loss_carry(log).collect())
    assert got == [(0, None), (2, 2.0)]


def test_stream_equals_batch(spark):
    import random
    from revforge.streaming.loss_stream import loss_carry_stream
    rnd = random.Random(5)
    rows = [(rnd.randint(0, 3), i, i, rnd.choice(["train", "eval"]), float(i % 17)) for i in range(300)]
    log = _log(spark, rows)
    batch = sorted(tuple(r) for r in trainlog.loss_carry(log).select("run", "seq", "training_loss").collect())
    stream = sorted(tuple(r) for r in loss_carry_stream(spark, log).select("run", "seq", "training_loss").collect())
    assert stream == batch


def test_best_epoch(spark):
    h = _log(spark, [(0, 0, 0, "eval", .5), (0, 1, 1, "eval", .7), (0, 2, 2, "eval", .7), (1, 0, 3, "eval", 0.0)])
    got = {r.run: (r.best_iteration, r.best_metric) for r in trainlog.best_epoch(h, "run", ["ts", "seq"], "loss")
           .collect()}
    assert got == {0: (2, .7)}


def test_grouped_top_k_hot_class_brute_force(spark):
    """One- and two-round top-k equal a sort-and-head per class on a skewed table spread over many
    partitions (one class holds ~90% of the rows; lengths tie often, ties broken by id)."""
    from pyspark.sql import functions as F

    from revforge.operators.balance import grouped_top_k, head_rows
    rows = [(i, 0 if i % 10 else 1 + (i // 10) % 3, (i * 37) % 23) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, cls int, n int").repartition(24)
    order = [F.col("n").desc(), F.col("id")]
    for rounds in (1, 2):
        got = {(r.cls, r.rk): r.id for r in grouped_top_k(df, ["cls"], order, 40, "rk", rounds).collect()}
        _check_top_k(rows, got)
    for rounds in (1, 2):
        head = [r.id for r in head_rows(df, order, 75, rounds).collect()]
        assert head == [r[0] for r in sorted(rows, key=lambda r: (-r[2], r[0]))[:75]]


def _check_top_k(rows, got):
    want = {}
    for c in {r[1] for r in rows}:
        ranked = sorted((r for r in rows if r[1] == c), key=lambda r: (-r[2], r[0]))[:40]
        want.update({(c, i + 1): r[0] for i, r in enumerate(ranked)})
    assert got == want


def _entries():
    import random

    rng = random.Random(7)
    t0 = dt.datetime(2024, 1, 1)
    return [(rng.randint(1, 4), t0 + dt.timedelta(seconds=i * 40 + rng.random()), i, rng.choice(["train", "eval"]), rng.choice([None, float(i), i / 2])) for i in range(300)]


def _carried(entries):
    """The carry of a whole log, one entry after the other."""
    last, out = {}, []
    for run, ts, seq, kind, loss in sorted(entries, key=lambda e: (e[1], e[2])):
        if kind == "eval":
            out.append((run, seq, last.get(run), loss))
        elif loss is not None:
            last[run] = loss
    return sorted(out, key=str)


def test_stream_holds_late_and_repeated_entries_and_restarts(spark, tmp_path):
    """Entries arrive shuffled within the delay and repeatedly, over three starts of the query; then the log is closed."""
    import random

    from revforge.streaming import loss_stream as ls
    entries = _entries()
    late = sorted(entries, key=lambda e: e[1].timestamp() + random.Random(e[2]).uniform(0, 2000))  # up to 2,000 s out of order
    source, markers, sink, ckpt = (str(tmp_path / x) for x in ("log", "markers", "sink", "state"))
    spark.createDataFrame([], ls.LOG_SCHEMA).write.parquet(markers)
    spark.createDataFrame([], ls.LOG_SCHEMA).write.parquet(source)
    seen = []
    for k in range(3):
        part = late[k * 100:(k + 1) * 100] + late[max(0, k * 100 - 5):k * 100]  # some once more
        spark.createDataFrame(part, ls.LOG_SCHEMA).repartition(3).write.mode("append").parquet(source)
        log = spark.readStream.schema(ls.LOG_SCHEMA).option("maxFilesPerTrigger", 3).parquet(source)
        ls.run_available(ls.carry(ls.with_markers(log, markers), "1 hour"), sink, ckpt)
        seen.append(spark.read.schema(ls.OUT_SCHEMA).parquet(sink).count())
    assert 0 < seen[0] < seen[1] < seen[2] < sum(e[3] == "eval" for e in entries)  # the last hour waits
    ls.close_log(spark, markers)
    ls.run_available(ls.carry(ls.with_markers(log, markers), "1 hour"), sink, ckpt)
    got = spark.read.schema(ls.OUT_SCHEMA).parquet(sink).collect()
    assert sorted(((r.run, r.seq, r.training_loss, r.validation_loss) for r in got), key=str) == _carried(entries)


def test_settle():
    from revforge.streaming.loss_stream import settle
    waiting = [(3000, 2, "eval", 0.5), (1000, 1, "train", 2.0), (3000, 2, "eval", 0.5), (2000, 5, "train", None), (9000, 6, "eval", None)]
    assert settle(waiting, 3, None) == ([(3000, 2, 2.0, 0.5)], [(9000, 6, "eval", None)], 2.0)
    assert settle(waiting, 0, 1.0) == ([], waiting, 1.0)
