"""Packing by bounded-space online best fit.

Every task reads its documents in order, tokenizes them and keeps ``OPEN`` windows of ``WINDOW`` tokens. A
document longer than a window fills whole windows by itself; the rest goes to the open window it fits
best. If none has room, the fullest one is emitted and a new one opened. The windows still open at the
end are leftovers: their pieces from ``MERGE`` tasks at a time are packed again, longest first, best fit.

Memory is bounded by the open windows and one Arrow batch; the merge gets at most MERGE * OPEN windows a
group, so it grows in groups, not in size. The pieces are written once (committed files), so a lost
executor repeats only its own tasks.

Defined results: null or empty text is the end token alone (one piece of length 1); a document of k
windows exactly makes k pieces; repeated rows are packed each; a null doc_id stays null; an empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of
from .tokens import END_ID, tokenizer

WINDOW = 2048
OPEN = 64
MERGE = 16
_MERGED = 1 << 62  # sequence ids of merged windows; other windows carry their task's number
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, leftover long"


def cut(n: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of a document of n tokens: whole windows, then the rest."""
    return [(s, min(window, n - s)) for s in range(0, n, window)]


class OpenWindows:
    """At most ``limit`` open windows; ``place`` returns the pieces of the windows that closed."""

    def __init__(self, window: int, limit: int | None) -> None:
        self.window, self.limit = window, limit
        self.by_room: list[tuple[int, int]] = []  # (tokens free, window number), least free first
        self.pieces: dict[int, list[tuple]] = {}
        self.made = 0

    def place(self, length: int, piece: tuple) -> list[list[tuple]]:
        closed = []
        at = bisect_left(self.by_room, (length, -1))
        if at < len(self.by_room):
            free, no = self.by_room.pop(at)
        else:
            if self.limit and len(self.by_room) >= self.limit:
                closed.append(self.pieces.pop(self.by_room.pop(0)[1]))
            free, no = self.window, self.made
            self.made += 1
            self.pieces[no] = []
        self.pieces[no].append((*piece, no, self.window - free))
        if free > length:
            insort(self.by_room, (free - length, no))
        else:
            closed.append(self.pieces.pop(no))
        return closed

    def rest(self) -> Iterator[list[tuple]]:
        for _, no in self.by_room:
            yield self.pieces[no]


def _packer(path: str | None, window: int, limit: int, with_ids: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizer(path)
        task = TaskContext.get().partitionId()
        windows = OpenWindows(window, limit)
        names = [c.split()[0] for c in PIECE.split(", ")] + ["ids"] * with_ids

        def frame(closed: list[list[tuple]], leftover: int) -> pd.DataFrame:
            rows = [(*p[:5], (task << 32) + p[-2], p[-1], leftover, *p[5:-2]) for w in closed for p in w]
            out = pd.DataFrame(rows, columns=names)
            out["doc_id"] = out["doc_id"].astype("Int64")
            return out

        for batch in batches:
            closed: list[list[tuple]] = []
            for doc_id, ids in zip(batch["doc_id"], tok.encode(batch["text"])):
                n = len(ids) // 4
                for start, length in cut(n, window):
                    own = ids[4 * start:4 * (start + length)]
                    piece = (None if pd.isna(doc_id) else int(doc_id), start, length, zlib.crc32(own), n, *([own] * with_ids))
                    closed += windows.place(length, piece)
            if closed:
                yield frame(closed, -1)
        left = list(windows.rest())
        if left:
            yield frame(left, task // MERGE)

    return run


def _merge(window: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "sequence_id", "offset"], ascending=[False, True, True, True, True])
        windows = OpenWindows(window, None)
        group = int(rows["leftover"].iloc[0])
        lengths = rows["length"].tolist()
        where: dict[int, tuple[int, int]] = {}
        for i, n in enumerate(lengths):
            for w in windows.place(n, (i,)):
                where.update({p[0]: p[1:] for p in w})
        for w in windows.rest():
            where.update({p[0]: p[1:] for p in w})
        rows["sequence_id"] = [_MERGED + (group << 32) + where[i][0] for i in range(len(lengths))]
        rows["offset"] = [where[i][1] for i in range(len(lengths))]
        rows["doc_id"] = rows["doc_id"].astype("Int64")
        return rows

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, open_windows: int = OPEN,
         with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with
    ``with_ids`` the piece's ids (binary, little-endian unsigned 32 bit)."""
    schema = PIECE + (", ids binary" if with_ids else "")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    pieces = materialize(texts.mapInPandas(_packer(vocabulary, window, open_windows, with_ids), schema))
    done = pieces.where(F.col("leftover") < 0)
    merged = pieces.where(F.col("leftover") >= 0).groupBy("leftover").applyInPandas(_merge(window), schema)
    return done.unionByName(merged).drop("leftover")


__all__ = ["END_ID", "WINDOW", "cut", "pack"]
