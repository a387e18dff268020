"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its subwords: the whole word and its character n-grams with word
borders, hashed into ``2 ** BITS`` rows of an embedding table. A text is the mean of its words, a linear softmax
on top gives the two classes, and table and softmax are trained jointly (momentum descent, plain numpy). A misspelling
never seen shares n-grams with words seen, so it gets a nearby vector.

Rare toxic words vanish in the mean of a long text, so a text is cut evenly into windows of up to ``SPAN`` words
(each the mean of its distinct words, of ``LEAST`` at least, through the same softmax); its score is that of its most toxic window, and training passes the
text's label to that window (one forward pass finds it, as in multiple-instance learning).

Training uses a bounded sample: at most ``SAMPLE`` labelled rows of each class, smallest hash first; a text of more than
``SAMPLE_CHARS`` characters gives ``SLICES`` even slices of it. A fifth of it is kept from training and calibrates the logit to the full class shares.
Scoring covers every whole text: the trained model is one number per subword row (2 MB), and a worker
computes each distinct word once.

Defined results: null or empty text scores as a window without words (the bias alone); null doc_id is
never held out and never trained on; an id with several labels has the greatest one, an id with several texts
is trained on the one with the least checksum; without labels of both classes every score is the share of toxic labels (0 if
there are none); other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

BITS = 18
GRAMS = (3, 4, 5)
DIM = 4
SPAN = 50
LEAST = 25
SAMPLE = 2500
SAMPLE_CHARS = 20_000
SLICES = 40
STEPS = 100
KEPT_WORDS = 300_000
THRESHOLD = 0.3
START = 0.02
MIN_WINDOWS = 5
RATES = (1000.0, 0.1, 0.5)
_WORD = re.compile(r"[^\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_in(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def window_starts(n: int) -> list[int]:
    """Starts of the evenly cut windows of n words: as few as possible, none over SPAN words."""
    k = max(1, -(-n // SPAN))
    return [i * n // k for i in range(k)]


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, word index) of all subwords of ``words``: a rolling hash over the code points of ``<word>``."""
    marked = "".join([f"<{w}>" for w in words])
    cp = np.frombuffer(marked.encode("utf-32-le"), np.uint32).astype(np.uint64)
    lens = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    of = np.repeat(np.arange(len(words)), lens)
    ends = np.cumsum(lens)
    rows, owner = [], []
    shift = np.uint64(64 - BITS)
    for n in GRAMS:
        if len(cp) < n:
            continue
        h = np.zeros(len(cp) - n + 1, np.uint64)
        for j in range(n):
            h = (h ^ cp[j:len(cp) - n + 1 + j]) * _MIX
            h ^= h >> np.uint64(29)
        inside = of[:len(h)] == of[n - 1:]
        rows.append(((h[inside] * _MIX) >> shift).astype(np.int64))
        owner.append(of[:len(h)][inside])
    weight = cp * _MIX  # the whole word: position-weighted sum of mixed code points
    place = np.arange(len(cp)) - np.repeat(ends - lens, lens)
    weight = (weight ^ (weight >> np.uint64(31))) * (np.uint64(2) * place.astype(np.uint64) + np.uint64(3))
    whole = np.add.reduceat(weight, ends - lens) if len(words) else weight
    whole = (whole ^ (whole >> np.uint64(32))) * _MIX
    rows.append((whole >> shift).astype(np.int64))
    owner.append(np.arange(len(words)))
    return np.concatenate(rows), np.concatenate(owner)


@dataclass
class Model:
    """``rows``: per subword row its vector's part of the logit; ``bias``; ``share`` where nothing was trained."""

    rows: np.ndarray | None
    bias: float
    share: float = 0.0


class _Sparse:
    """Mean of member rows per group, and its transpose, for a fixed (group, member) list."""

    def __init__(self, group: np.ndarray, member: np.ndarray, groups: int, members: int, least: int | np.ndarray = 1) -> None:
        order = np.argsort(group, kind="stable")
        self.member, g = member[order], group[order]
        counts = np.bincount(g, minlength=groups)
        self.inv = 1.0 / np.maximum(counts, least)
        self.at, self.some = np.flatnonzero(np.diff(g, prepend=-1)), np.unique(g)
        back = np.argsort(self.member, kind="stable")
        self.g_back, m = g[back], self.member[back]
        self.at_back, self.some_back = np.flatnonzero(np.diff(m, prepend=-1)), np.unique(m)
        self.groups, self.members = groups, members

    def mean(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((self.groups, x.shape[1]), np.float32)
        if len(self.at):
            out[self.some] = np.add.reduceat(x[self.member], self.at, axis=0)
        return out * self.inv[:, None].astype(np.float32)

    def back(self, grad: np.ndarray) -> np.ndarray:
        out = np.zeros((self.members, grad.shape[1]), np.float32)
        if len(self.at_back):
            g = grad * self.inv[:, None].astype(np.float32)
            out[self.some_back] = np.add.reduceat(g[self.g_back], self.at_back, axis=0)
        return out


def train(texts: list[str], labels: np.ndarray, share: float, steps: int = STEPS, seed: int = 8) -> Model:
    """Joint training of the subword table and the softmax; ``share``: toxic share of all labelled rows."""
    vocab: dict[str, int] = {}
    win, word, doc = array("i"), array("i"), array("i")
    for d, t in enumerate(texts):
        ws = words_in(t)
        starts = window_starts(len(ws))
        for lo, hi in zip(starts, [*starts[1:], len(ws)]):
            for x in dict.fromkeys(ws[lo:hi]):
                win.append(len(doc))
                word.append(vocab.setdefault(x, len(vocab)))
            doc.append(d)
    if not vocab:
        return Model(None, 0.0, share)
    rows, owner = subwords(list(vocab))
    met = np.bincount(np.frombuffer(word, np.int32), minlength=len(vocab))  # windows that hold the word
    common = np.bincount(rows, weights=met[owner], minlength=1 << BITS)[rows] >= MIN_WINDOWS
    of_word = np.bincount(owner, minlength=len(vocab))  # rows left out count as zero vectors
    used, local = np.unique(rows[common], return_inverse=True)
    to_words = _Sparse(owner[common], local, len(vocab), len(used), of_word)
    to_wins = _Sparse(np.frombuffer(win, np.int32), np.frombuffer(word, np.int32), len(doc), len(vocab), LEAST)
    doc_a = np.frombuffer(doc, np.int32)
    first = np.flatnonzero(np.diff(doc_a, prepend=-1))
    y = labels.astype(np.float32)
    tune = np.arange(len(y)) % 5 == 4  # a fifth of the sample sets the calibration only
    rng = np.random.default_rng(seed)
    weight = np.zeros(len(y), np.float32)
    for c in (0, 1):
        weight[(y == c) & ~tune] = 0.5 / max(((y == c) & ~tune).sum(), 1)
    # softmax over two classes: its two weight vectors enter only by their difference
    p = [rng.normal(0, START, (len(used), DIM)).astype(np.float32), rng.normal(0, 1.0, DIM).astype(np.float32), np.zeros(1, np.float32)]
    speed = [np.zeros_like(x) for x in p]
    rate, least_loss, kept = 1.0, np.inf, [x.copy() for x in p]
    for step in range(steps + 1):
        if step == steps:
            p = kept
        wins = to_wins.mean(to_words.mean(p[0]))
        z = wins @ p[1] + p[2]
        top = np.maximum.reduceat(z, first)
        best = np.flatnonzero(z == np.repeat(top, np.diff(np.append(first, len(z)))))
        best = best[np.unique(doc_a[best], return_index=True)[1]]
        if step == steps:
            break
        loss = float((weight * np.logaddexp(0, np.where(y > 0, -top, top))).sum())
        if not loss < 1.3 * least_loss:  # a step too far: back to the best point with half the rate
            p, speed, rate = [x.copy() for x in kept], [np.zeros_like(x) for x in p], rate / 2
            continue
        if loss < least_loss:
            least_loss, kept = loss, [x.copy() for x in p]
        dz = np.zeros(len(z), np.float32)
        dz[best] = (1 / (1 + np.exp(-np.clip(z[best], -30, 30))) - y) * weight
        grads = (to_words.back(to_wins.back(dz[:, None] * p[1][None, :])), wins.T @ dz, np.array([dz.sum()], np.float32))
        for i, g in enumerate(grads):
            speed[i] = 0.9 * speed[i] + g
            p[i] -= rate * RATES[i] * speed[i]
    slope, offset = calibrated(top[tune], y[tune], share)
    table = np.zeros(1 << BITS, np.float32)
    table[used] = slope * (p[0] @ p[1])
    return Model(table, float(slope * p[2][0] + offset), share)


def calibrated(z: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and offset of a logistic fit of the labels on the logits, the classes weighted to their full shares
    (Newton steps with a weak pull to slope 1)."""
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    if not n1 or not n0 or not 0 < share < 1:
        return 1.0, 0.0
    w = np.where(y > 0, share / n1, (1 - share) / n0) * len(y)
    x = np.stack([z.astype(np.float64), np.ones(len(z))], axis=1)
    a = np.array([1.0, np.log(share / (1 - share))])

    def loss(c: np.ndarray) -> float:
        return float((w * np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ c))).sum() + (c[0] - 1) ** 2 / 2)

    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        g = x.T @ (w * (q - y)) + np.array([a[0] - 1.0, 0.0])
        step = np.linalg.solve((x * (w * q * (1 - q) + 1e-9)[:, None]).T @ x + np.diag([1.0, 1e-3]), g)
        now = loss(a)
        while loss(a - step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        a = a - step
    return (float(a[0]), float(a[1])) if np.all(np.isfinite(a)) and a[0] > 0 else (1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Model:
    """A model from at most ``2 * sample`` labelled, not held-out rows (the only rows that reach the driver)."""
    known = labels.select("doc_id", F.col("toxic").alias("y")).where(F.col("y").isin(0, 1) & (bucket_of("doc_id") != 2)).groupBy(
        "doc_id").agg(F.max("y").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = counts.get(1, 0) / max(sum(counts.values()), 1)
    if len(counts) < 2:
        return Model(None, 0.0, share)
    ids = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        ids = part if ids is None else ids.unionByName(part)
    ids = ids.select(F.col("doc_id").alias("id"), "toxic")
    rows = docs.select(F.col("doc_id").alias("id"), sliced(text_of(), sample_chars).alias("t"), F.md5(text_of().cast("binary")).alias("sum"))
    rows = rows.join(F.broadcast(ids), "id").groupBy("id", "toxic").agg(F.min(F.struct("sum", "t")).alias("m"))  # at most 2 * sample ids
    got = rows.select("id", F.col("m.t").alias("t"), "toxic").toPandas().sort_values("id")
    if got["toxic"].nunique() < 2:
        return Model(None, 0.0, share)
    texts, known = got["t"].tolist(), got["toxic"].to_numpy()
    del got
    return train(texts, known, share)


def sliced(text: F.Column, most: int) -> F.Column:
    """The text, or ``SLICES`` slices of it, evenly spread and ``most`` characters together."""
    size = most // SLICES
    part = F.transform(F.sequence(F.lit(0), F.lit(SLICES - 1)), lambda i: F.substr(
        text, (F.floor(i * (F.length(text) - size) / (SLICES - 1)) + 1).cast("int"), F.lit(size)))
    return F.when(F.length(text) <= most, text).otherwise(F.array_join(part, " "))


def bucket_of(name: str) -> F.Column:
    """crc32 of the id as text, modulo 4; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(4)), F.lit(-1))


def scorer(model: Model) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
    """Pandas function from texts to scores."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, float] = {}
        for texts in batches:
            out = np.empty(len(texts))
            lists = [words_in(t) for t in texts] if model.rows is not None else []
            new: set[str] = set()
            for ws in lists:
                new.update(ws)
            if len(known) > KEPT_WORDS:
                known.clear()
            fresh = [w for w in new if w not in known]
            for at in range(0, len(fresh), 50_000):
                part = fresh[at:at + 50_000]
                rows, owner = subwords(part)
                n = np.bincount(owner, minlength=len(part))
                known.update(zip(part, (np.bincount(owner, model.rows[rows], len(part)) / n).tolist()))
            if model.rows is None:
                out[:] = model.share
            for i, ws in enumerate(lists):
                at = window_starts(len(ws))
                z = 0.0
                for k, (lo, hi) in enumerate(zip(at, [*at[1:], len(ws)])):
                    own = set(ws[lo:hi])
                    mean = math.fsum([known[w] for w in own]) / max(len(own), LEAST)
                    z = mean if k == 0 else max(z, mean)
                out[i] = 1 / (1 + np.exp(-np.clip(z + model.bias, -30, 30)))
            yield pd.Series(out)

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    udf = F.pandas_udf(scorer(model), "double")
    out = docs.select("doc_id", (bucket_of("doc_id") == 2).alias("held_out"), udf(text_of()).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
