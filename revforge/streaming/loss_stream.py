"""The training-loss carry by event time, as a stateful Structured Streaming query.

The state of a run is the last training loss and the entries that are not yet settled. An entry is settled when the
watermark (the latest time seen, less ``DELAY``) passes it: from then on Spark drops what is older, so no entry can
come before it any more. Entries may arrive in any order within the delay and more than once; they wait in a list
state, an event-time timer at the earliest one wakes the run, and all settled ones are taken in (ts, seq) order, each
(ts, seq) once. Eval entries leave with the training loss carried to them.

A log that ends is closed by a marker: an entry of kind ``close`` far ahead in time, read from a second directory. It
moves the watermark past everything, so what still waits is settled. The query may be stopped and started again at any
point with its checkpoint; ``loss_carry_stream`` itself runs twice, once over the log and once over the marker.

A run's unsettled entries (those of the last ``DELAY``) are held by one task, as are its timers; runs are spread by key.
"""

from __future__ import annotations

import datetime
import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..session import ensure_checkpoint_dir

LOG_SCHEMA = "run long, ts timestamp, seq long, kind string, loss double"
OUT_SCHEMA = "run long, ts timestamp, seq long, training_loss double, validation_loss double"
WAITING = "ts long, seq long, kind string, loss double"
DELAY = "1 hour"
CLOSE = "close"
END_OF_TIME = datetime.datetime(2200, 1, 1)
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def settle(waiting: list[tuple], watermark_ms: int, last: float | None) -> tuple[list[tuple], list[tuple], float | None]:
    """(eval rows with their training loss, entries that still wait, last training loss). Entries: (ts in
    microseconds, seq, kind, loss)."""
    ready = sorted({(t, s): (t, s, k, x) for t, s, k, x in waiting if t <= watermark_ms * 1000}.values(), key=lambda e: e[:2])
    out = []
    for t, s, kind, loss in ready:
        if kind == "eval":
            out.append((t, s, last, loss))
        elif kind == "train" and loss is not None:
            last = loss
    return out, [e for e in waiting if e[0] > watermark_ms * 1000], last


class Carry(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.last = handle.getValueState("last", "loss double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for b in rows:
            b = b[b["kind"] != CLOSE]
            times = b["ts"].astype("datetime64[us]").astype("int64")
            new += [(int(t), int(s), k, None if pd.isna(x) else float(x)) for t, s, k, x in zip(times, b["seq"], b["kind"], b["loss"])]
        if new:
            self.waiting.appendList(new)
            self._wake(min(e[0] for e in new))
        return iter(())

    def _wake(self, ts: int) -> None:
        self.handle.registerTimer(-(-ts // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        held = [tuple(e) for e in self.waiting.get()]
        out, rest, now = settle(held, timerValues.getCurrentWatermarkInMs(), last)
        if len(rest) < len(held):
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
        if rest:
            self._wake(min(e[0] for e in rest))
        if now is not None:
            self.last.update((now,))
        if out:
            yield pd.DataFrame({
                "run": key[0], "ts": pd.to_datetime([e[0] for e in out], unit="us"), "seq": [e[1] for e in out],
                "training_loss": pd.array([e[2] for e in out], "Float64"), "validation_loss": pd.array([e[3] for e in out], "Float64")})

    def close(self) -> None:
        pass


def carry(log: DataFrame, delay: str = DELAY) -> DataFrame:
    """The stream of settled eval entries of a streaming ``log``."""
    return log.withWatermark("ts", delay).groupBy("run").transformWithStateInPandas(
        Carry(), outputStructType=OUT_SCHEMA, outputMode="Append", timeMode="EventTime")


def run_available(stream: DataFrame, sink_dir: str, checkpoint: str) -> None:
    """Process what is there now and stop; the state is in RocksDB under ``checkpoint``."""
    spark = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        q = (stream.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def with_markers(log: DataFrame, marker_dir: str) -> DataFrame:
    """A streaming ``log`` and the markers of ``marker_dir``."""
    markers = log.sparkSession.readStream.schema(LOG_SCHEMA).parquet(marker_dir)
    return log.select("run", "ts", "seq", "kind", "loss").unionByName(markers)


def close_log(spark: SparkSession, marker_dir: str) -> None:
    marker = spark.createDataFrame([(None, END_OF_TIME, None, CLOSE, None)], LOG_SCHEMA)
    marker.write.mode("append").parquet(marker_dir)


def loss_carry_stream(spark: SparkSession, log: DataFrame, delay: str = DELAY) -> DataFrame:
    """Run the carry over a ``log`` that ends, and return the sink as a batch DataFrame. A batch ``log`` is written
    first, in its own partitions, and read as a stream of these files."""
    base = os.path.join(ensure_checkpoint_dir(spark), f"loss-stream-{uuid.uuid4().hex}")
    if not log.isStreaming:
        log.select("run", "ts", "seq", "kind", "loss").write.parquet(os.path.join(base, "log"))
        log = spark.readStream.schema(LOG_SCHEMA).parquet(os.path.join(base, "log"))
    markers, sink, ckpt = (os.path.join(base, p) for p in ("markers", "sink", "state"))
    spark.createDataFrame([], LOG_SCHEMA).write.parquet(markers)
    run_available(carry(with_markers(log, markers), delay), sink, ckpt)
    close_log(spark, markers)
    run_available(carry(with_markers(log, markers), delay), sink, ckpt)
    return spark.read.schema(OUT_SCHEMA).parquet(sink)
