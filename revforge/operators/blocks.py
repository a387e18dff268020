"""Texts as blocks of term counts: what naive Bayes reads where the texts are many.

A block is a row that holds some thousand texts: its distinct terms once, and for each text the numbers of its terms with
their counts as arrays. Tokens are counted in the task that cuts them, so neither tokens nor (text, term) rows are
exchanged or written. What must meet the other texts is one row per (block, term): partial counts of a fit, and the
terms whose counts a prediction needs, so the commonest word has as many rows as there are blocks.

The tokens are those of ``functions.text.word_tokens(clean_ascii(text))``, lower-cased: a text of printable ASCII is cut by the
same pattern, over bytes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import CLITICS, NEGATION, SPLIT_WORDS
from .layout import KEYED_BYTES, parts_of

# Bytes of input files whose texts make one block.
BLOCK_BYTES = 12 << 20
BLOCKS = "dataset string, block long, uids array<string>, starts binary, ids binary, tfs binary, terms array<string>"
DELETED = bytes([*range(0x20), *range(0x7F, 0x100)])  # all but printable ASCII, as ``NON_PRINTABLE``; UTF-8 has no other bytes above
TOKEN = re.compile(rb"[a-z0-9]+(?:[-.'/_][a-z0-9]+|[,:][0-9][a-z0-9]*)*|\.\.\.|--|[^ a-z0-9]")
SPLIT = {w.encode(): n for w, n in SPLIT_WORDS}
ENDINGS = [NEGATION.encode(), *[c.encode() for c in CLITICS]]


def tokens_of(raw: bytes) -> list[bytes]:
    """Lower-cased words and punctuation of a UTF-8 text, contractions whole."""
    return TOKEN.findall(raw.translate(None, DELETED).lower())


def parts_of_token(token: bytes) -> tuple[bytes, ...]:
    """The parts of one token as ``word_tokens`` splits it."""
    if token in SPLIT:
        return token[:SPLIT[token]], token[SPLIT[token]:]
    for e in ENDINGS if b"'" in token else ():
        if token.endswith(e) and len(token) > len(e):
            return token[:-len(e)], token[-len(e):]
    return (token,)


class Numbers(dict):
    """The number of each key, given at its first use."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Counted:
    """The texts of one block as they come in; a text's id may come again."""

    def __init__(self) -> None:
        self.uids, self.tokens = Numbers(), Numbers()
        self.held: list[np.ndarray] = []

    def add(self, uid: str, raw: bytes) -> None:
        if found := Counter(tokens_of(raw)):
            at, n = (np.fromiter(x, np.int32, len(found)) for x in (map(self.tokens.__getitem__, found), found.values()))
            self.held.append(np.stack([np.full(len(at), self.uids[uid], np.int32), at, n]))

    def row(self, dataset: str, block: int) -> list | None:
        if not self.held:
            return None
        terms = Numbers()
        parts = [[terms[p] for p in parts_of_token(t)] for t in self.tokens]
        text, token, n = np.concatenate(self.held, axis=1).astype(np.int64)
        self.held = []
        first = np.array([p[0] for p in parts])
        second = np.array([p[1] if len(p) > 1 else -1 for p in parts])[token]
        also = second >= 0
        key = np.append(text * len(terms) + first[token], text[also] * len(terms) + second[also])
        n = np.append(n, n[also])
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        key, n = key[at], np.add.reduceat(n, at)
        starts = np.searchsorted(key // len(terms), np.arange(len(self.uids) + 1))
        return [dataset, block, list(self.uids), starts.astype(np.int64).tobytes(), (key % len(terms)).astype(np.int32).tobytes(), n.astype(np.int32).tobytes(),
                [t.decode() for t in terms]]


def term_blocks(texts: DataFrame, text: str = "review") -> DataFrame:
    """Blocks of ``uid`` and text; the texts of a block belong to one dataset, which is what an id names before its first colon."""
    kinds = pa.schema([("dataset", pa.string()), ("block", pa.int64()), ("uids", pa.list_(pa.string())), ("starts", pa.binary()),
                       ("ids", pa.binary()), ("tfs", pa.binary()), ("terms", pa.list_(pa.string()))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counted] = {}
        for b in batches:
            for uid, dataset, raw in zip(*[b.column(c).to_pylist() for c in ("uid", "dataset", "raw")]):
                if raw:
                    held.setdefault(dataset, Counted()).add(uid, raw)
        no = TaskContext.get().partitionId()
        for i, d in enumerate(sorted(held)):
            if (row := held[d].row(d, (no << 16) + i)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array([v], k.type) for v, k in zip(row, kinds)], schema=kinds)

    raw = texts.where(F.col("uid").isNotNull()).select("uid", F.substring_index("uid", ":", 1).alias("dataset"), F.col(text).cast("binary").alias("raw"))
    return raw.repartition(parts_of(texts, BLOCK_BYTES), "uid").mapInArrow(pack, BLOCKS)


def are_blocks(tf: DataFrame) -> bool:
    return "terms" in tf.columns


class Block:
    """One row of ``term_blocks``."""

    def __init__(self, row: dict) -> None:
        self.uids, self.terms = row["uids"], row["terms"]
        self.starts, self.ids, self.tfs = np.frombuffer(row["starts"], np.int64), np.frombuffer(row["ids"], np.int32), np.frombuffer(row["tfs"], np.int32)

    def texts(self) -> np.ndarray:
        """The text of each entry."""
        return np.repeat(np.arange(len(self.uids)), np.diff(self.starts))


def _met(blocks: DataFrame, of: DataFrame):
    """Each block with its rows of ``of``, in as many parts as the blocks' bytes ask for (numbers are small, the work is not)."""
    n = parts_of(blocks, KEYED_BYTES)
    return blocks.repartition(n, "block").groupBy("block").cogroup(of.repartition(n, "of").groupBy("of"))


def cell_counts(blocks: DataFrame, cells: DataFrame, names: list[str]) -> DataFrame:
    """term, texts, names...: how often a term occurs in the texts of each cell. ``cells``: uid, cells array<int>, the numbers of
    the names that a text counts for; texts without a row count for none. One row per term."""
    of = blocks.select(F.col("block").alias("of"), F.posexplode("uids").alias("text", "uid")).join(cells, "uid").select("of", "text", "cells")

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * (1 + len(names))
        terms: list[str] = []
        for row in left.to_pylist():
            b, m = Block(row), len(row["terms"])
            text, cell = right["text"].to_numpy(), right["cells"].combine_chunks()
            labelled = np.zeros(len(b.uids), bool)
            labelled[text] = True
            entry = b.texts()
            seen = np.bincount(b.ids[labelled[entry]], minlength=m)
            held = np.zeros(m * len(names), np.int64)
            flat, first, n = cell.flatten().to_numpy(), cell.offsets.to_numpy()[:-1] - cell.offsets[0].as_py(), np.diff(cell.offsets.to_numpy())
            for nth in range(n.max(initial=0)):  # a text has a cell in each of a few groups
                own = np.full(len(b.uids), -1)
                own[text[n > nth]] = flat[first[n > nth] + nth]
                kept = own[entry] >= 0
                held += np.bincount(b.ids[kept].astype(np.int64) * len(names) + own[entry[kept]], b.tfs[kept], len(held)).astype(np.int64)
            got = [seen, *held.reshape(m, len(names)).T]
            kept = seen > 0
            terms += [t for t, k in zip(b.terms, kept) if k]
            out = [np.append(x, g[kept]) for x, g in zip(out, got)]
        return pa.table([pa.array(terms, pa.string()), *[pa.array(x, pa.int64()) for x in out]], names=["term", "texts", *names])

    schema = "term string, " + ", ".join(f"{c} long" for c in ["texts", *names])
    counted = _met(blocks, of).applyInArrow(count, schema)
    return counted.groupBy("term").agg(*[F.sum(c).alias(c) for c in ["texts", *names]])


def block_sums(blocks: DataFrame, counts: DataFrame, columns: int, plan: list[list[list[int]]], alphas: list[float], schema: str) -> DataFrame:
    """One row per text: for each model its known tokens, and for each of its classes and smoothing values the sum of the
    weights ``ln((c + a) / a)`` of its terms. ``counts``: term, counts as count times ``columns`` plus the column's number;
    ``plan``: for each model and class the columns whose counts make its own."""
    of = blocks.select(F.col("block").alias("of"), F.posexplode("terms").alias("id", "term")).join(counts, "term").select("of", "id", "counts")
    names = [x.split()[0] for x in schema.split(", ")]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in names]
        for row in left.to_pylist():
            b = Block(row)
            known = right["counts"].combine_chunks()
            held = np.zeros((columns, len(b.terms)))
            count, col = np.divmod(known.flatten().to_numpy(), columns)
            held[col, np.repeat(right["id"].to_numpy(), np.diff(known.offsets.to_numpy()))] = count
            entry, n = b.texts(), len(b.uids)
            made: list = [b.uids]
            for classes in plan:
                totals = [held[kept].sum(axis=0) for kept in classes]
                made.append(np.bincount(entry, b.tfs * np.logical_or.reduce([t > 0 for t in totals])[b.ids], n).astype(np.int64))
                for t in totals:
                    for a in alphas:
                        made.append(np.bincount(entry, b.tfs * np.log((t + a) / a)[b.ids], n))
            for x, m in zip(out, made):
                x.append(m)
        return pa.table([pa.array(np.concatenate(x) if x else []) if i else pa.array([u for part in x for u in part], pa.string()) for i, x in enumerate(out)], names=names)

    return _met(blocks, of).applyInArrow(score, schema)
