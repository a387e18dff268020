"""Approximate nearest neighbours by inner product: inverted lists scanned with adaptive dimensions.

Largest inner product becomes smallest distance by one more coordinate, ``sqrt(M^2 - |x|^2)`` (0 for queries; M
is the largest norm). All vectors are turned by one random rotation, so that a distance over the first
d of D coordinates estimates the whole one. A list's vectors lie as column blocks of ``BLOCK`` coordinates;
for each query the scan adds block after block and, after each, a hypothesis test drops a candidate
whose partial distance is too large for the current k-th best (rejected wrongly with a probability that
``EPSILON`` bounds). Survivors are scored exactly, in double precision, on the original vectors.

Centroids, rotation and the number of lists to probe are fitted on at most ``SAMPLE`` vectors; the probes are
the fewest that reach ``GOAL`` recall there. Every vector is indexed. Work is dealt by (unit, part of its queries), all of
bounded size: a unit is a run of whole small lists, or a part of a large one, so a list that holds a third of all vectors
spreads. A query goes to a unit once, with the marks of its lists, and brings back its k best of them. Rows are
ranked against centers ``ROWS`` at a time, so a task holds no table of all its batch's rows, lists and vectors.

Defined results: vectors that are null, zero, of another length than most, or with null or non-finite
components, and rows without an id, take no part; equal scores go by vec_id; rows repeating an id are
candidates each, but never of that id's query; with at most k candidates all of them are returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

K = 20
SAMPLE = 20_000
GOAL = 0.95
BLOCK = 16
EPSILON = 2.1
# Vectors of a unit (at least, at most, and units aimed at between these), and queries of a part.
PART_LEAST, PART, UNITS = 512, 16_384, 96
QUERY_PART = 4096
ROWS = 512  # rows ranked against all centers at a time
PAIRS, SCORED = 1 << 19, 1 << 15  # pairs of a vector and a query that are compared, and scored, at a time
SLACK, ROUNDING = 1 + 1e-9, 1e-10


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>, norm2) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where((F.size("v") > 0) & ~bad)
    return rows.withColumn("norm2", norm2).where((F.col("norm2") > 0) & (F.col("norm2") < float("inf")))


class Index:
    """Rotation, centroids and probes: of bounded size, sent to the tasks in their closures."""

    def __init__(self, sample: np.ndarray, dim: int, m2: float, lists: int, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.dim, self.m2 = dim, m2
        self.turn = np.linalg.qr(rng.normal(size=(dim + 1, dim + 1)))[0]
        x = self.rotated(sample)
        self.centers = _kmeans(x, max(1, min(lists, len(x) // 8)), rng)
        self.probes = 1
        self._tune(sample, x, rng)

    def rotated(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        extra = np.zeros(len(v)) if query else np.sqrt(np.maximum(self.m2 - (v * v).sum(axis=1), 0))
        return np.concatenate([v, extra[:, None]], axis=1) @ self.turn

    def near(self, x: np.ndarray) -> np.ndarray:
        """Squared distance to every center."""
        return (x * x).sum(axis=1)[:, None] + (self.centers ** 2).sum(axis=1)[None, :] - 2 * x @ self.centers.T

    def _tune(self, sample: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> None:
        n = len(sample)
        lists = self.near(x).argmin(axis=1)
        q = rng.choice(n, min(300, n), replace=False)
        order = np.argsort(self.near(self.rotated(sample[q], query=True)), axis=1)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :].repeat(len(q), 0), axis=1)
        k = min(K, n - 1)
        need = []
        for row, i in enumerate(q):
            s = sample @ sample[i]
            s[i] = -np.inf
            best = np.argsort(-s)[:k]
            need.append(np.sort(place[row, lists[best]]))
        found = np.concatenate(need) if need else np.zeros(1)
        self.probes = int(np.quantile(found, GOAL)) + 1 if len(found) else 1


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        of = ((c ** 2).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)
        n = np.bincount(of, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, of, x)
        c[n > 0] = s[n > 0] / n[n > 0, None]
        c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c


def _assign(index: Index) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _pieces(batches):
            v = np.stack(b["v"].to_numpy())
            yield pd.DataFrame({"vec_id": b["vec_id"], "v": b["v"], "lst": index.near(index.rotated(v)).argmin(axis=1)})

    return run


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The batches ``ROWS`` rows at a time."""
    for b in batches:
        for at in range(0, len(b), ROWS):
            yield b.iloc[at:at + ROWS]


class Units:
    """What is scanned together: unit ``first[l]`` and the ``parts[l] - 1`` after it hold list ``l`` (one row a list, bounded by the sample)."""

    def __init__(self, sizes: np.ndarray) -> None:
        most = int(np.clip(-(-sizes.sum() // UNITS), PART_LEAST, PART))
        self.parts = np.maximum(-(-sizes // most), 1)
        self.first = np.zeros(len(sizes), np.int64)
        unit, held = 0, 0
        for i, n in enumerate(sizes):
            if held and (held + n > most):
                unit, held = unit + 1, 0
            self.first[i] = unit
            held += n
            if self.parts[i] > 1:
                unit, held = unit + int(self.parts[i]), 0
        self.of = [range(f, f + p) for f, p in zip(self.first, self.parts)]

    def table(self, spark: SparkSession, sizes: np.ndarray) -> DataFrame:
        return spark.createDataFrame([(i, int(f), int(p)) for i, (f, p) in enumerate(zip(self.first, self.parts)) if sizes[i]], "lst int, first int, parts int")


def _probe(index: Index, sizes: np.ndarray, units: Units) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """One row per query: its lists as bits, and the units that hold them."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _pieces(batches):
            q = np.stack(b["v"].to_numpy())
            order = np.argsort(index.near(index.rotated(q, query=True)), axis=1)
            held = np.cumsum(sizes[order], axis=1)
            # the tuned probes, and more where those lists hold hardly enough vectors
            n = np.maximum(index.probes, (held < 4 * K + 1).sum(axis=1) + 1).clip(max=order.shape[1])
            wanted = np.zeros(order.shape, bool)
            np.put_along_axis(wanted, order, np.arange(order.shape[1])[None, :] < n[:, None], axis=1)
            wanted &= sizes[None, :] > 0
            to = [sorted({u for i in np.flatnonzero(w) for u in units.of[i]}) for w in wanted]
            yield pd.DataFrame({"query_id": b["vec_id"], "q": b["v"], "lists": [x.tobytes() for x in np.packbits(wanted, axis=1)], "units": to})

    return run


def scan(x: np.ndarray, vectors: np.ndarray, ids: np.ndarray, xq: np.ndarray, q: np.ndarray, own: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the query, id, score) of the k best of one list part for each of some queries. ``x``: rotated vectors."""
    dims = x.shape[1]
    blocks = [(x[:, at:at + BLOCK], xq[:, at:at + BLOCK]) for at in range(0, dims, BLOCK)]
    # squared distances over each block of coordinates, of all the queries to all rows at once
    over = [(c * c).sum(axis=1)[:, None] + (a * a).sum(axis=1)[None, :] - 2 * c @ a.T for a, c in blocks]
    slack = (ROUNDING * ((x * x).sum(axis=1).max() + (xq * xq).sum(axis=1)))[:, None]  # of such differences
    live = ids[None, :] != own[:, None]
    if len(ids) > k:
        part, whole = np.where(live, over[0], np.inf), np.sum(over, axis=0)
        first = np.argpartition(part, k - 1, axis=1)[:, :k]  # a first guess at the k-th best, on whole vectors
        limit = np.where(np.take_along_axis(live, first, axis=1), np.take_along_axis(whole, first, axis=1), np.inf).max(axis=1)[:, None]
        for n, more in enumerate([*over[1:], None], 1):
            done = n * BLOCK
            test = (1 + EPSILON / np.sqrt(done)) ** 2 * done / dims if done < dims else 1.0
            live &= (part <= limit * test * SLACK + slack) | (live.sum(axis=1) <= k)[:, None]
            if more is not None:
                part += more
        # the k-th least distance bounds the k-th best score: what is within rounding of it is scored
        part = np.where(live, whole, np.inf)
        live &= part <= np.partition(part, k - 1, axis=1)[:, k - 1:k] * SLACK + slack
    at, row = np.nonzero(live)
    score = np.concatenate([np.zeros(0)] + [(vectors[row[i:i + SCORED]] * q[at[i:i + SCORED]]).sum(axis=1) for i in range(0, len(at), SCORED)])
    return best(at, ids[row], score, k)


def best(at: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query (numbered ``at``) by score, then id."""
    order = np.lexsort((ids, -score, at))
    at, ids, score = at[order], ids[order], score[order]
    kept = np.arange(len(at)) - np.searchsorted(at, at, side="left") < k
    return at[kept], ids[kept], score[kept]


def _scanner(index: Index, k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if len(rows) and len(queries):
            rows = rows.sort_values("lst", kind="stable")
            v, vec, lst = np.stack(rows["v"].to_numpy()), rows["vec_id"].to_numpy(), rows["lst"].to_numpy()
            x = index.rotated(v)
            asked, qs = queries["query_id"].to_numpy(), np.stack(queries["q"].to_numpy())
            xq = index.rotated(qs, query=True)
            wanted = np.unpackbits(np.stack([np.frombuffer(b, np.uint8) for b in queries["lists"]]), axis=1)
            more, held = [found], 0
            starts = np.flatnonzero(np.append(True, lst[1:] != lst[:-1]))
            for lo, hi in zip(starts, np.append(starts[1:], len(lst))):
                of = np.flatnonzero(wanted[:, lst[lo]])
                each = max(1, PAIRS // (hi - lo))
                for some in (of[i:i + each] for i in range(0, len(of), each)):
                    at, got, score = scan(x[lo:hi], v[lo:hi], vec[lo:hi], xq[some], qs[some], asked[some], k)
                    more.append((some[at], got, score))
                    held += len(at)
                    if held > PAIRS:  # what many lists bring is merged in between
                        more, held = [best(*(np.concatenate(c) for c in zip(*more)), k)], 0
            found = best(*(np.concatenate(c) for c in zip(*more)), k)
            return pd.DataFrame({"query_id": asked[found[0]], "vec_id": found[1], "score": found[2]})
        return pd.DataFrame({"query_id": found[0], "vec_id": found[1], "score": found[2]})

    return run


def search(vectors: DataFrame, is_query: F.Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found for every usable row for which ``is_query`` holds."""
    rows = materialize(usable(vectors))
    empty = rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    dims = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max("norm2").alias("m2")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not dims:
        return empty
    dim, total, m2 = dims[0]["d"], dims[0]["n"], dims[0]["m2"]
    rows = rows.where(F.size("v") == dim)
    share = 1_100_000 * SAMPLE // total + 1  # about SAMPLE rows by hash, so that no task sends more than its part
    some = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < share)
    sample = some.orderBy("vec_id", "v").limit(SAMPLE).select("v").toPandas()
    if sample.empty:
        sample = rows.orderBy("vec_id", "v").limit(1).select("v").toPandas()
    index = Index(np.stack(sample["v"].to_numpy()), dim, m2, lists=int(np.sqrt(total)))
    listed = materialize(rows.select("vec_id", "v").mapInPandas(_assign(index), "vec_id long, v array<double>, lst int"))
    counts = {r["lst"]: r["n"] for r in listed.groupBy("lst").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = np.array([counts.get(i, 0) for i in range(len(index.centers))])
    units = Units(sizes)
    probes = materialize(listed.where(is_query).select("vec_id", "v").mapInPandas(
        _probe(index, sizes, units), "query_id long, q array<double>, lists binary, units array<int>"))
    to_units = F.explode("units").alias("unit")
    asked = probes.select(to_units).groupBy("unit").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per unit
    if not asked:
        return empty
    spark = vectors.sparkSession
    lists = F.broadcast(units.table(spark, sizes))  # one row per list: bounded by the sample
    qparts = F.broadcast(spark.createDataFrame([(r["unit"], -(-r["n"] // QUERY_PART)) for r in asked], "unit int, qparts int"))
    unit = (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int").alias("unit")
    left = (listed.join(lists, "lst").select(unit, "lst", "vec_id", "v").join(qparts, "unit")
            .withColumn("qpart", F.explode(F.sequence(F.lit(0), F.col("qparts") - 1))))
    right = (probes.select(to_units, "query_id", "q", "lists").join(qparts, "unit")
             .withColumn("qpart", F.pmod(F.xxhash64("query_id"), F.col("qparts")).cast("int")))
    keys = ["unit", "qpart"]
    found = (left.select(*keys, "lst", "vec_id", "v").groupBy(*keys).cogroup(right.select(*keys, "query_id", "q", "lists").groupBy(*keys))
             .applyInPandas(_scanner(index, k), "query_id long, vec_id long, score double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def every_twentieth(vectors: DataFrame) -> DataFrame:
    return search(vectors, F.col("vec_id") % 20 == 0)
