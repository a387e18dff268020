"""Near duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, then verified.

1. Document frequencies of five-word shingles, hashed into ``2 ** DF_BITS`` counters, over all documents: a table
   of fixed size. Weights depend on shares of the documents, so they mean the same at any size.
2. Each distinct text's shingles get the weight tf * idf. Improved consistent weighted sampling draws
   ``BANDS * ROWS`` samples (two texts agree on one with the probability of their weighted Jaccard
   similarity); the random numbers come from tables indexed by a hash of (shingle, sample).
3. Texts that agree on a band share a bucket. Up to ``ALL_PAIRS`` texts: all pairs. Larger buckets are dealt in parts of
   ``PART`` texts; a text is paired with its nearest few by agreeing samples and with the part's hub (the
   text that agrees most with the most frequent samples), and with the hub of all parts; variants of one
   original meet through it.
4. Pairs that agree on too few samples for ``SIMILARITY`` go; the others are verified by their exact weighted Jaccard
   similarity on the whole texts.
5. Large buckets whose texts are not one component by then are searched whole (``crossing_pairs``): a prefix filter
   on the weighted Jaccard similarity, rarest shingles first, meets every pair of two components that can
   reach ``SIMILARITY``; these pairs are verified too. All verified links form classes (connected components).

Exact copies are one text from the start: only the membership table is per document, and no group of
copies is ever collected. Defined results: null or blank text is a class of its own per document;
texts under five words are one shingle; rows repeating an id and text are copies; null doc_id is kept as
such (a class of null ids only has a null class id); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_of, words_of
from .graph import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 4
SAMPLES = BANDS * ROWS
DF_BITS = 18
CHUNK_BITS = 12
DAMP = 0.5  # idf runs from 1 (in every document) to 1 + DAMP (in one)
ALL_PAIRS = 5
PART = 1024
NEAREST = 2
EARLIER = 32
LEAST_AGREE = 25  # of 48 samples: at similarity 0.8 fewer agree with probability below 1e-5
_M = np.uint64(0x9E3779B97F4A7C15)
_TABLE = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (sorted) of one text's word hashes, and their counts."""
    n = len(words) - SHINGLE + 1
    size = SHINGLE if n > 0 else len(words)
    h = np.zeros(max(n, 1), np.uint64)
    for j in range(size):
        h = mix(h + words[j:j + len(h)] + _M)
    return np.unique(h, return_counts=True)


class Sampler:
    """Weights and samples; ``idf`` per counter (1 MB, sent in the closure)."""

    def __init__(self, idf: np.ndarray, seed: int = 2) -> None:
        self.idf = idf.astype(np.float32)
        self.seed = seed

    def ready(self) -> "Sampler":
        rng = np.random.default_rng(self.seed)
        self.r = rng.gamma(2.0, 1.0, _TABLE).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, _TABLE)).astype(np.float32)
        self.shift = rng.random(_TABLE).astype(np.float32)
        self.odd = rng.integers(1, 1 << 62, SAMPLES).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        return self

    def weights(self, h: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return tf * self.idf[h >> np.uint64(64 - DF_BITS)]

    def samples(self, h: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """One 64-bit identity (shingle and quantised weight) per sample."""
        best = np.full(SAMPLES, np.inf, np.float32)
        out = np.zeros(SAMPLES, np.uint64)
        log_w = np.log(weight).astype(np.float32)
        for at in range(0, len(h), 8192):
            part, lw = h[at:at + 8192], log_w[at:at + 8192]
            idx = ((part[None, :] * self.odd[:, None]) >> np.uint64(48)).astype(np.int32)
            r = self.r[idx]
            t = np.floor(lw[None, :] / r + self.shift[idx])
            a = self.log_c[idx] - r * (t - self.shift[idx] + 1)
            k = a.argmin(axis=1)
            rows = np.arange(SAMPLES)
            new = mix(part[k] + (t[rows, k].astype(np.int64).astype(np.uint64) + np.uint64(1)) * _M + rows.astype(np.uint64))
            less = a[rows, k] < best
            best[less], out[less] = a[rows, k][less], new[less]
        return out

    def similarity(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
        """Weighted Jaccard similarity: sum of the smaller over sum of the larger weights."""
        wa, wb = self.weights(*a), self.weights(*b)
        _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
        low = np.minimum(wa[i], wb[j]).sum()
        return float(low / (wa.sum() + wb.sum() - low))


def _word_hashes() -> Column:
    return F.transform(words_of(F.lower(text_of())), lambda w: F.xxhash64(w))


def _rows(batch: pa.RecordBatch, name: str) -> Iterator[np.ndarray]:
    col = batch.column(name)
    flat, at = col.values.to_numpy(zero_copy_only=False).view(np.uint64), col.offsets.to_numpy()
    for i in range(len(col)):
        yield flat[at[i]:at[i + 1]]


def _count_df(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(1 << DF_BITS, np.int64)
    for batch in batches:
        for words in _rows(batch, "w"):
            if len(words):
                h, _ = shingles(words)
                np.add.at(n, np.unique(h >> np.uint64(64 - DF_BITS)), 1)
    parts = n.reshape(-1, 1 << CHUNK_BITS)
    some = np.flatnonzero(parts.any(axis=1))
    yield pa.RecordBatch.from_pydict({"chunk": pa.array(some, pa.int32()), "n": pa.array([parts[i].tobytes() for i in some], pa.binary())})


def _add_counts(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(x, np.int64) for x in rows["n"]], axis=0)
    return pd.DataFrame({"chunk": [rows["chunk"].iloc[0]], "n": [total.tobytes()]})


def inverse_frequencies(words: DataFrame, total: int) -> np.ndarray:
    """1 + DAMP * log(documents / frequency) / log(documents) per counter. Every frequency has its own weight, but the
    rarest weighs no more than 1 + DAMP times the commonest: undamped, what a large group of near copies shares would weigh a
    fraction of the few words in which each differs, and the group would fall apart. Each task sends one table of
    counters; they are added by chunk."""
    parts = words.mapInArrow(_count_df, "chunk int, n binary").groupBy("chunk").applyInPandas(_add_counts, "chunk int, n binary")
    df = np.zeros(1 << DF_BITS, np.int64)
    for r in parts.collect():  # 2 ** (DF_BITS - CHUNK_BITS) rows, 2 MB in all
        df[r["chunk"] << CHUNK_BITS:(r["chunk"] + 1) << CHUNK_BITS] = np.frombuffer(r["n"], np.int64)
    n = max(total, 2)
    return 1.0 + DAMP * np.log(n / np.clip(df, 1, n)) / np.log(n)


def _sign(sampler: Sampler) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sampler.ready()
        for batch in batches:
            bands, signs = [], []
            for words in _rows(batch, "w"):
                h, tf = shingles(words)
                got = s.samples(h, s.weights(h, tf))
                key = np.zeros(BANDS, np.uint64)
                for j in range(ROWS):
                    key = mix(key + got[j::ROWS] + _M)
                bands.append(key.view(np.int64))
                signs.append((got & np.uint64(0xFFFF)).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_pydict({"t": batch.column("t"), "bands": pa.array(bands, pa.list_(pa.int64())), "sign": pa.array(signs, pa.binary())})

    return run


def _agree(signs: np.ndarray, one: np.ndarray) -> np.ndarray:
    return (signs == one).sum(axis=1)


def _hub(signs: np.ndarray) -> int:
    """The row that agrees most with the most frequent value of each sample."""
    score = np.zeros(len(signs), np.int64)
    for j in range(signs.shape[1]):
        values, at, n = np.unique(signs[:, j], return_inverse=True, return_counts=True)
        score += at == n.argmax()
    return int(score.argmax())


def _part_pairs(rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs (a, b, hub) of one part: each text with its nearest and with the hub; the hub's own row has b = a."""
    rows = rows.sort_values("t")
    t = rows["t"].to_numpy()
    signs = np.stack([np.frombuffer(x, np.uint16) for x in rows["sign"]])
    hub = _hub(signs)
    a, b = [t[hub]], [t[hub]]
    if len(t) > 1:
        for i in range(len(t)):
            same = _agree(signs, signs[i])
            same[i] = -1
            near = np.argpartition(-same, min(NEAREST, len(t) - 1) - 1)[:NEAREST]
            for j in {hub, *near.tolist()} - {i}:
                if same[j] >= LEAST_AGREE:
                    a.append(min(t[i], t[j]))
                    b.append(max(t[i], t[j]))
    return pd.DataFrame({"a": a, "b": b, "band": rows["band"].iloc[0], "key": rows["key"].iloc[0]})


def _best_hub(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("t")
    signs = np.stack([np.frombuffer(x, np.uint16) for x in rows["sign"]])
    i = _hub(signs)
    return pd.DataFrame({"band": rows["band"].iloc[:1], "key": rows["key"].iloc[:1], "hub": [rows["t"].iloc[i]], "hub_sign": [rows["sign"].iloc[i]]})


def _agreement(x: str, y: str) -> Column:
    """Number of samples on which two signatures agree."""
    return F.pandas_udf(_agreeing, "int")(x, y)


def _agreeing(x: pd.Series, y: pd.Series) -> pd.Series:
    if not len(x):
        return pd.Series([], dtype="int32")
    a, b = (np.frombuffer(b"".join(s), np.uint16).reshape(len(s), SAMPLES) for s in (x, y))
    return pd.Series((a == b).sum(axis=1).astype("int32"))


def candidate_pairs(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a < b) of texts that may be similar; band, key and t of the large buckets, whose pairs these
    are not all of. ``signed``: t, bands, sign (one row per text)."""
    each = signed.select("t", F.posexplode("bands").alias("band", "key"))
    sizes = each.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    met = materialize(each.join(sizes, ["band", "key"]))
    few = met.where(F.col("n") <= ALL_PAIRS).groupBy("band", "key").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    pair = F.flatten(F.transform("ts", lambda x, i: F.transform(F.slice("ts", i + 2, F.lit(ALL_PAIRS)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    few = few.select(F.explode(pair).alias("p")).select("p.a", "p.b").distinct()
    s1 = signed.select(F.col("t").alias("a"), F.col("sign").alias("sa"))
    s2 = signed.select(F.col("t").alias("b"), F.col("sign").alias("sb"))
    few = few.join(s1, "a").join(s2, "b").where(_agreement("sa", "sb") >= LEAST_AGREE).select("a", "b")

    many = met.where(F.col("n") > ALL_PAIRS).join(signed.select("t", "sign"), "t")
    parts = F.ceil(F.col("n") / PART)
    many = many.select("band", "key", "t", "sign", parts.alias("parts"), F.pmod(F.xxhash64("t"), parts).alias("part"))
    found = materialize(many.groupBy("band", "key", "part").applyInPandas(_part_pairs, "a string, b string, band int, key long"))
    hubs = found.where(F.col("a") == F.col("b")).select("band", "key", F.col("a").alias("t")).distinct()
    large = many.where(F.col("parts") > 1)
    best = (hubs.join(large.select("band", "key", "t", "sign"), ["band", "key", "t"]).groupBy("band", "key")
            .applyInPandas(_best_hub, "band int, key long, hub string, hub_sign binary"))
    across = (large.join(best, ["band", "key"]).where(F.col("t") != F.col("hub"))
              .where(_agreement("sign", "hub_sign") >= LEAST_AGREE)
              .select(F.least("t", "hub").alias("a"), F.greatest("t", "hub").alias("b")))
    pairs = few.unionByName(found.where(F.col("a") != F.col("b")).select("a", "b")).unionByName(across).distinct()
    return pairs, met.where(F.col("n") > ALL_PAIRS).select("band", "key", "t")


def _shingled(sampler: Sampler) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row per shingle of each text, with its weight and the text's."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sampler.ready()
        for batch in batches:
            for i, g, words in zip(batch.column("i").to_pylist(), batch.column("g").to_pylist(), _rows(batch, "w")):
                h, tf = shingles(words)
                w = s.weights(h, tf).astype(np.float64)
                n = len(h)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, i)), pa.array(np.full(n, g)), pa.array(h.view(np.int64)), pa.array(w), pa.array(np.full(n, w.sum()))],
                                                 names=["i", "g", "h", "w", "total"])

    return run


def crossing_pairs(large: DataFrame, found: DataFrame, signed: DataFrame, docs: DataFrame, members: DataFrame, sampler: Sampler, similarity: float) -> DataFrame:
    """Every pair (a < b) of texts of the large buckets that may be similar and that the links ``found`` do not connect.

    A shingle that two components have is shared. Each text's shingles are ordered by (number of texts, hash), the
    others first: a pair of similarity s or more shares one of those with which the text's weight first exceeds
    (1 - s) of the whole. Its overlap is no more than what either text has from the first common shingle on, which drops
    most pairs that have only a template in common before they are made. A pair is made where no earlier
    shingle of both is known (of EARLIER, which saves repeats only; ``distinct`` drops those left).
    """
    texts = large.select("t").distinct()
    inner = found.join(texts.withColumnRenamed("t", "a"), "a", "left_semi").join(texts.withColumnRenamed("t", "b"), "b", "left_semi")
    roots = components(inner.select("a", "b")).select(F.col("node").alias("t"), "root")
    rooted = materialize(large.join(roots, "t", "left").withColumn("root", F.coalesce("root", "t")))
    mixed = rooted.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where(F.col("lo") < F.col("hi"))
    numbered = materialize(rooted.join(mixed, ["band", "key"], "left_semi").select("t", "root").distinct().withColumn("i", F.monotonically_increasing_id()))
    groups = numbered.groupBy("root").agg(F.min("i").alias("g"))
    numbered = materialize(numbered.join(groups, "root").select("t", "i", "g"))

    words = texts_by_key(docs, members, numbered.select("t")).select("t", _word_hashes().alias("w"))
    each = materialize(words.join(numbered, "t").select("i", "g", "w").mapInArrow(_shingled(sampler), "i long, g long, h long, w double, total double"))
    counts = each.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("g").alias("lo"), F.max("g").alias("hi")).where(F.col("lo") < F.col("hi")).select("h", "n")
    text = Window.partitionBy("i")
    earlier = text.orderBy("n", "h").rowsBetween(Window.unboundedPreceding, -1)
    first = text.orderBy("n", "h").rowsBetween(-EARLIER, -1)
    keys = each.join(counts, "h").select("*", (F.sum("w").over(text) - F.coalesce(F.sum("w").over(earlier), F.lit(0.0))).alias("rest"))
    keys = keys.where(F.col("rest") >= F.col("total") * (similarity - 1e-6)).withColumn("prior", F.collect_list("h").over(first))
    keys = materialize(keys.select("h", "g", "i", "rest", "total", "prior"))

    # overlap >= q * (sum of both weights), and at the first common shingle neither text's rest is less than the overlap
    q = similarity / (1 + similarity) - 1e-6
    sides = keys.groupBy("h", "g").agg(F.max(F.col("rest") - q * F.col("total")).alias("room"), F.min("total").alias("low"))
    s1, s2 = (sides.select("h", *[F.col(c).alias(f"{c}{k}") for c in ("g", "room", "low")]) for k in (1, 2))
    meet = (F.col("g1") < F.col("g2")) & (F.col("room1") >= q * F.col("low2")) & (F.col("room2") >= q * F.col("low1"))
    met = s1.join(s2, "h").where(meet).select("h", "g1", "g2")
    k1, k2 = (keys.select("h", *[F.col(c).alias(f"{c}{k}") for c in ("g", "i", "rest", "total", "prior")]) for k in (1, 2))
    enough = (F.least("rest1", "rest2") >= q * (F.col("total1") + F.col("total2"))) & ~F.arrays_overlap("prior1", "prior2")
    pairs = met.join(k1, ["h", "g1"]).join(k2, ["h", "g2"]).where(enough).select("i1", "i2").distinct()
    named = materialize(numbered.join(signed.select("t", "sign"), "t").select("t", "i", "sign"))
    n1, n2 = (named.select(*[F.col(c).alias(f"{c}{k}") for c in ("t", "i", "sign")]) for k in (1, 2))
    pairs = pairs.join(n1, "i1").join(n2, "i2").where(_agreement("sign1", "sign2") >= LEAST_AGREE)
    return pairs.select(F.least("t1", "t2").alias("a"), F.greatest("t1", "t2").alias("b"))


def _verify(sampler: Sampler, similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sampler.ready()
        last, kept = None, None
        for batch in batches:
            a, b, sims = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
            for x, wa, wb in zip(a, _rows(batch, "wa"), _rows(batch, "wb")):
                if x != last:
                    last, kept = x, shingles(wa)
                sims.append(s.similarity(kept, shingles(wb)))
            yes = [i for i, v in enumerate(sims) if v >= similarity - 1e-9]
            yield pa.RecordBatch.from_pydict({"a": pa.array([a[i] for i in yes], pa.string()), "b": pa.array([b[i] for i in yes], pa.string()),
                                              "similarity": pa.array([sims[i] for i in yes], pa.float64())})

    return run


def texts_by_key(docs: DataFrame, members: DataFrame, need: DataFrame) -> DataFrame:
    """t and text of the texts ``need`` (t): of one row per text, so that copies do not meet."""
    rep = members.join(need, "t").groupBy("t").agg(F.min("doc_id").alias("rep")).select(F.col("t").alias("rt"), "rep")
    keyed = docs.select("doc_id", F.md5(text_of().cast("binary")).alias("t"), text_of().alias("text"))
    return keyed.join(rep, keyed["doc_id"].eqNullSafe(rep["rep"]) & (keyed["t"] == rep["rt"])).select("t", "text").dropDuplicates(["t"])


def verified(docs: DataFrame, members: DataFrame, pairs: DataFrame, sampler: Sampler, similarity: float) -> DataFrame:
    """Of ``pairs`` (a, b) those that are similar, with their similarity."""
    need = pairs.select(F.col("a").alias("t")).unionByName(pairs.select(F.col("b").alias("t"))).distinct()
    texts = materialize(texts_by_key(docs, members, need))
    ta = texts.select(F.col("t").alias("a"), F.col("text").alias("xa"))
    tb = texts.select(F.col("t").alias("b"), F.col("text").alias("xb"))
    both = pairs.join(ta, "a").join(tb, "b")
    hashes = lambda c: F.transform(words_of(F.lower(F.col(c))), lambda w: F.xxhash64(w))
    both = both.select("a", "b", hashes("xa").alias("wa"), hashes("xb").alias("wb"))
    return materialize(both.mapInArrow(_verify(sampler, similarity), "a string, b string, similarity double"))


def links(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(members, links): doc_id and text key t of every row; verified links (a, b, similarity) between distinct texts."""
    key = F.md5(text_of().cast("binary")).alias("t")
    members = materialize(docs.select("doc_id", key, (~text_of().rlike(r"[^\x20\x09-\x0D]")).alias("blank")))
    total = members.count()
    words = docs.select(key, _word_hashes().alias("w"))
    sampler = Sampler(inverse_frequencies(words.select("w"), total))
    full = F.size("w") > 0
    signed = words.where(full).mapInArrow(_sign(sampler), "t string, bands array<long>, sign binary")
    signed = materialize(signed)
    one = materialize(signed.groupBy("t").agg(F.first("bands").alias("bands"), F.first("sign").alias("sign")))  # copies sign alike
    pairs, large = candidate_pairs(one)
    found = verified(docs, members, materialize(pairs), sampler, similarity)
    if large.limit(1).count():
        rest = materialize(crossing_pairs(large, found, one, docs, members, sampler, similarity))
        found = found.unionByName(verified(docs, members, rest, sampler, similarity))
    return members, found


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, t, class_id (least doc_id of the class), n_links (verified links of the text) of every row."""
    members, found = links(docs, similarity)
    roots = components(found.select("a", "b"))
    ends = found.select(F.col("a").alias("t")).unionByName(found.select(F.col("b").alias("t")))
    degree = ends.groupBy("t").agg(F.count(F.lit(1)).alias("n_links"))
    texts = members.where(~F.col("blank")).groupBy("t").agg(F.min("doc_id").alias("least"))
    texts = texts.join(roots.select(F.col("node").alias("t"), "root"), "t", "left").withColumn("root", F.coalesce("root", "t"))
    least = texts.groupBy("root").agg(F.min("least").alias("class_id"))
    texts = texts.join(least, "root").join(degree, "t", "left").select("t", "class_id", "n_links")
    out = members.join(materialize(texts), "t", "left")
    return out.select("doc_id", "t", F.when(F.col("blank"), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` (all columns) whose id is its class's least; one of rows that repeat id and text."""
    stay = classes(docs, similarity).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("_keep"), F.col("t").alias("_t")).distinct()
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("doc_id").alias("_id"), F.md5(text_of().cast("binary")).alias("_key"))
    got = rows.join(stay, rows["_id"].eqNullSafe(stay["_keep"]) & (rows["_key"] == stay["_t"]))
    return got.dropDuplicates(["_keep", "_t"]).select("_row.*")
