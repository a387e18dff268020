"""Language of every text by sparse multinomial logistic regression on TF-IDF character n-grams.

A word (a run of letters, lower-cased, with word borders) gives its character n-grams, hashed into ``2 ** BITS``
columns. A column's value in a text is its share of the text's n-grams times its inverse document frequency; the
document frequencies are counted over all rows one may learn from, each map task adding up one bounded vector.
Training is follow-the-regularised-leader (per-coordinate rates) with an L1 threshold, which keeps most weights at
exactly zero, and an L2 term; a fifth of the sample is kept from it and sets the temperature of the softmax on whole
texts. Values are linear in the words of a text, so a worker scores each distinct word once.

The fit takes a bounded sample of labelled rows: ``sample`` rows over all languages, shared evenly, smallest hash
first, and of each at most ``WINDOWS`` windows of ``SPAN`` words spread over the whole text. At most ``classes``
languages are learned, the commonest ones. Frequencies, calibration and predictions read whole texts.

Defined results: null text or a text without a letter is ``und`` with score 0; letters never seen score by the
languages' biases; without any row to learn from every text is ``und``; a null doc_id is not held out but never learned
from; repeated rows and rows with one id are rows of their own; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BITS = 17
GRAMS = (1, 2, 3, 4)
SAMPLE = 4800
CLASSES = 176
WINDOWS = 3
SPAN = 40
EPOCHS = 2
SCALE = 10.0
ALPHA, BETA = 0.3, 0.1
L1, L2 = 0.05, 0.01
KEPT_WORDS = 200_000
UNKNOWN = "und"
_RUN = regex.compile(r"\p{L}+")
_LETTERS = bytes(c if chr(c).isalpha() else 0x20 for c in range(256))  # Latin-1, all else blank
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_in(text: str) -> list[str]:
    """Lower-case runs of letters."""
    low = text.lower()
    try:
        return low.encode("latin-1").translate(_LETTERS).decode("latin-1").split()
    except UnicodeEncodeError:
        return _RUN.findall(low)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(columns, word index) of the n-grams of ``<word>`` for every word, repeats kept."""
    cp = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(words)), np.fromiter((len(w) + 2 for w in words), np.int64, len(words)))
    cols, owner = [], []
    for n in GRAMS:
        if len(cp) < n:
            continue
        h = np.full(len(cp) - n + 1, n, np.uint64)
        for j in range(n):
            h = (h ^ cp[j:len(cp) - n + 1 + j]) * _MIX
            h ^= h >> np.uint64(29)
        inside = of[:len(h)] == of[n - 1:]
        cols.append(((h[inside] * _MIX) >> np.uint64(64 - BITS)).astype(np.int64))
        owner.append(of[:len(h)][inside])
    return np.concatenate(cols), np.concatenate(owner)


@dataclass
class Model:
    """``langs`` in order; per column and language the weight times idf times ``SCALE``; the biases; the temperature."""

    langs: list[str]
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None
    temperature: float = 1.0
    name: str = field(default_factory=lambda: uuid.uuid4().hex)  # of the fit; a worker keeps the words it met by it


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], labels: np.ndarray, langs: list[str], idf: np.ndarray, epochs: int = EPOCHS, alpha: float = ALPHA,
          beta: float = BETA, l1: float = L1, l2: float = L2, seed: int = 13) -> Model:
    """FTRL-proximal over the texts one by one: ``labels`` index ``langs``; the bias column has no penalty."""
    k, size = len(langs), 1 << BITS
    rows = []
    for t in texts:
        ws = words_in(t)
        if not ws:
            rows.append(None)
            continue
        cols, count = np.unique(grams(ws)[0], return_counts=True)
        rows.append((np.append(cols, size), np.append(SCALE * idf[cols] * count / count.sum(), 1.0)))
    z, n = np.zeros((size + 1, k)), np.zeros((size + 1, k))
    one, two = np.full((size + 1, 1), l1), np.full((size + 1, 1), l2)
    one[size] = two[size] = 0.0

    def weight(at: np.ndarray | slice) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - one[at], 0.0)
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + two[at])

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            if rows[i] is None:
                continue
            at, x = rows[i]
            w = weight(at)
            p = softmax(x @ w)
            p[labels[i]] -= 1.0
            g = x[:, None] * p[None, :]
            new = n[at] + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(n[at])) / alpha * w
            n[at] = new
    w = weight(slice(None))
    return Model(langs, w[:size] * idf[:, None] * SCALE, w[size])


def temperature_of(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss of ``softmax(z / t)``, by golden section on its logarithm."""
    if not len(y):
        return 1.0

    def loss(u: float) -> float:
        s = z / np.exp(u)
        top = s.max(axis=1)
        return float((top + np.log(np.exp(s - top[:, None]).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    lo, hi, r = -3.0, 3.0, (5 ** 0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


class Scorer:
    """Logits of whole texts; each distinct word's part is computed once and kept, up to ``KEPT_WORDS``."""

    def __init__(self, model: Model) -> None:
        self.model, self.k = model, len(model.langs)
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.parts = np.zeros((0, self.k + 1))

    def learn(self, words: list[str]) -> None:
        """Per word: sums of the weights of its n-grams by language, and how many n-grams it has."""
        for lo in range(0, len(words), 20_000):
            part = words[lo:lo + 20_000]
            cols, owner = grams(part)
            own = [np.bincount(owner, self.model.weights[cols, c], len(part)) for c in range(self.k)]
            own.append(np.bincount(owner, minlength=len(part)).astype(float))
            self.at.update(zip(part, range(len(self.parts), len(self.parts) + len(part))))
            self.parts = np.concatenate([self.parts, np.stack(own, axis=1)])

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """One row a text; a row of nan where there is no letter."""
        out = np.full((len(texts), self.k), np.nan)
        if not self.k:
            return out
        if len(self.at) > KEPT_WORDS:
            self.clear()
        counts = [Counter(words_in(t)) if t else Counter() for t in texts]
        self.learn([w for w in dict.fromkeys(w for c in counts for w in c) if w not in self.at])
        for i, c in enumerate(counts):
            if c:
                s = np.fromiter(c.values(), float, len(c)) @ self.parts[[self.at[w] for w in c]]
                out[i] = s[:-1] / s[-1] + self.model.bias
        return out


_SCORERS: dict[str, Scorer] = {}


def scorer_for(model: Model) -> Scorer:
    """One scorer, with the words it knows, for all tasks of a Python worker that use the same fit."""
    if model.name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model.name] = Scorer(model)
    _SCORERS[model.name].model = model
    return _SCORERS[model.name]


def bucket_of(name: str) -> Column:
    """crc32 of the id as text, modulo 4; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(4)), F.lit(-1))


@lru_cache(maxsize=1)
def known_columns() -> dict[str, np.ndarray]:
    """The n-gram columns of the words that a Python worker has met."""
    return {}


def document_frequencies(learn: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts, and per column the number of texts with it; one vector a map task, added up by column."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, texts, known = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, bool), 0, known_columns()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                texts += 1
                ws = set(words_in(t or ""))
                if len(known) > KEPT_WORDS:
                    known.clear()
                if new := [w for w in ws if w not in known]:
                    cols, owner = grams(new)
                    order = np.argsort(owner, kind="stable")
                    known.update(zip(new, np.split(cols[order].astype(np.int32), np.flatnonzero(np.diff(owner[order])) + 1)))
                if ws:
                    seen[np.concatenate([known[w] for w in ws])] = True
                    met = np.flatnonzero(seen)
                    total[met] += 1
                    seen[met] = False
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(total[at], texts), pa.int64())], ["col", "n"])

    got = learn.select("text").mapInArrow(count, "col long, n long").groupBy("col").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << BITS, np.int64)
    inside = got["col"].to_numpy() >= 0
    out[got["col"].to_numpy()[inside]] = got["n"].to_numpy()[inside]
    return int(got["n"].to_numpy()[~inside].sum()), out


def windows_of(texts: pd.Series) -> pd.Series:
    """At most ``WINDOWS`` windows of ``SPAN`` words of each text, evenly spread from its first word to its last."""
    def cut(t: str | None) -> list[str]:
        ws = words_in(t or "")
        k = min(WINDOWS, max(1, -(-len(ws) // SPAN)))
        starts = [0] if k == 1 else [round(i * max(0, len(ws) - SPAN) / (k - 1)) for i in range(k)]
        return [" ".join(ws[s:s + SPAN]) for s in starts]
    return texts.map(cut)


def fit(docs: DataFrame, sample: int = SAMPLE, classes: int = CLASSES) -> Model:
    """A model from the rows that are not held out and have a language."""
    learn = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (bucket_of("doc_id") != 2))
    found = learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(classes).collect()
    if not found:
        return Model([])
    langs = sorted(r["lang"] for r in found)
    each = max(1, sample // len(langs))
    texts, df = document_frequencies(learn)
    idf = np.log((1.0 + texts) / (1.0 + df)) + 1.0
    # a draw below three times the wanted share of its language first, so that only few texts are sorted
    share = F.element_at(F.create_map(*[x for r in found for x in (F.lit(r["lang"]), F.lit(min(2.0, (3.0 * each + 50) / r["n"])))]), F.col("lang"))
    drawn = (learn.withColumn("h", F.xxhash64("doc_id", "text"))
             .where(F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) < share)
             .withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("r") <= each))
    picked = materialize(drawn.select("text", "lang", (F.col("r") % 5 == 0).alias("tune")))
    cut = F.pandas_udf(windows_of, "array<string>")
    rows = picked.where(~F.col("tune")).select("lang", cut("text").alias("t")).toPandas()
    index = {x: i for i, x in enumerate(langs)}
    flat = sorted((index[x], t) for x, ts in zip(rows["lang"], rows["t"]) for t in ts)  # in one order, however the rows came
    model = train([t for _, t in flat], np.array([c for c, _ in flat], np.int64), langs, idf)
    kept = picked.where("tune").select("lang", F.pandas_udf(_logits(model), "array<double>")("text").alias("z")).toPandas()
    kept = kept[kept["z"].map(lambda z: not np.isnan(z[0]))] if len(kept) else kept
    order = sorted(zip(kept["z"].map(tuple), kept["lang"])) if len(kept) else []
    model.temperature = temperature_of(np.array([z for z, _ in order]), np.array([index[x] for _, x in order], np.int64))
    return model


def _logits(model: Model) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = scorer_for(model)
        for texts in batches:
            yield pd.Series(list(scorer.logits(texts.tolist())))
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return run


def scorer_of(model: Model) -> Callable[[Iterator[pd.Series]], Iterator[pd.DataFrame]]:
    """Pandas function from texts to (language, score)."""
    names = np.array([*model.langs, UNKNOWN], object)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = scorer_for(model)
        for texts in batches:
            if not scorer.k:
                yield pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": np.zeros(len(texts))})
                continue
            z = scorer.logits(texts.tolist())
            none = np.isnan(z[:, 0])
            p = softmax(np.where(none[:, None], 0.0, z) / model.temperature)
            best = np.where(none, scorer.k, p.argmax(axis=1))
            yield pd.DataFrame({"lang_pred": names[best], "score": np.where(none, 0.0, p.max(axis=1, initial=0.0))})
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    udf = F.pandas_udf(scorer_of(model), "lang_pred string, score double")
    return (docs.select("doc_id", (bucket_of("doc_id") == 2).alias("held_out"), udf(F.col("text").cast("string")).alias("o"))
            .select("doc_id", "held_out", "o.lang_pred", "o.score"))


def language_id(docs: DataFrame) -> DataFrame:
    return identify(docs, fit(docs))
