"""Repair of damaged conversations by a square-root checkpointed dynamic program.

Every row of a conversation is kept, given the role user or assistant, or deleted, and empty turns may be inserted
anywhere, so that the role initials read ``(s?(ua)+)?`` at the least cost; of the cheapest sequences of edits the
ASCII-least is taken. The automaton has four states, so the least cost from a row to the end is a vector of four.

Rows are numbered by a range shuffle without texts and cut into blocks of the square root of their conversation's
length (``LEAST`` rows at least). Going backwards, only the vectors at block borders (checkpoints) are stored: a block
is a four by four matrix of least costs, and the matrices of a conversation, not its rows, meet in one row. Going
forwards, each block rebuilds its own vectors from the checkpoint behind it and walks its tight edits, ASCII-least
first; where a conversation has several blocks, each first walks from all four states, and the state in which a block
is entered follows from these exits. So no task holds more than the square root of a conversation.

Defined results: rows are taken by turn (nulls first), then role, then the text's sha256; null role and text count as
one space; a role is read by its first character, an empty role as a space; null conv_id is a conversation of its own;
equal rows are interchangeable (the later ones are duplicates); other columns are not read; empty tables give empty
results. The texts of a conversation meet in the order of its turns only in ``digest``, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import checked_broadcast
from ..operators.ordering import MAX_BROADCAST_GROUPS, rank_within
from .common import key_of, materialize

LEAST = 256
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
INF = 1 << 50
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: what an inserted or re-roled row becomes in each state, and where a kept row of each initial leads
TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "x": {}}
INITIALS = "suax"


def _options() -> dict[str, list[list[tuple[str, int, int]]]]:
    """Per code of a row (a hex digit: initial, 4 if truncated, 8 if it must go) and state: (edit, cost, next state)."""
    out = {}
    for code in range(16):
        extra = TRUNCATED if code & 4 else 0
        rows = []
        for state in range(4):
            ways = [("D", DELETE, state)]
            if not code & 8:
                if state in KEEP[INITIALS[code & 3]]:
                    ways.append(("K", extra, KEEP[INITIALS[code & 3]][state]))
                ways.append(("R", REROLE + extra, TURN[state]))
            rows.append(ways)
        out[f"{code:x}"] = rows
    return out


OPTIONS = _options()


def with_inserts(v: list[int]) -> list[int]:
    """Least costs when turns may be inserted first (two lead through all states that inserts reach)."""
    return [min(v[p], INSERT + v[TURN[p]], 2 * INSERT + v[TURN[TURN[p]]]) for p in range(4)]


END = with_inserts([0, INF, INF, 0])


def backward(codes: str, end: list[int]) -> list[list[int]]:
    """Least cost by state before each row, and ``end`` behind the last."""
    out = [end]
    for code in reversed(codes):
        after = out[-1]
        out.append(with_inserts([min([c + after[q] for _, c, q in ways]) for ways in OPTIONS[code]]))
    return out[::-1]


def matrix(codes: str) -> list[int]:
    """Least cost from each state before the block to each state behind it, row by row."""
    columns = [backward(codes, [0 if p == q else INF for p in range(4)])[0] for q in range(4)]
    return [min(columns[q][p], INF) for p in range(4) for q in range(4)]


def checkpoints(matrices: list[list[int]]) -> list[list[int]]:
    """The cost vector behind each block."""
    out = [END]
    for m in reversed(matrices[1:]):
        out.append([min(m[4 * p + q] + out[-1][q] for q in range(4)) for p in range(4)])
    return out[::-1]


def walk(codes: str, end: list[int], state: int, last: bool) -> tuple[str, list[tuple[int, int]], int, int]:
    """(audit, per edit (row or -1, new role's state or -1), state behind the block, cost to the conversation's end)."""
    costs = backward(codes, end)
    audit, made, cost = [], [], costs[0][state]
    for i, code in enumerate(codes):
        while True:
            here = costs[i][state]
            ways = [(e, q) for e, c, q in OPTIONS[code][state] if c + costs[i + 1][q] == here]
            if INSERT + costs[i][TURN[state]] == here:
                ways.append(("I", TURN[state]))
            edit, after = min(ways)
            audit.append(edit)
            made.append((-1 if edit == "I" else i, after if edit in "IR" else -1))
            state = after
            if edit != "I":
                break
    while last and costs[-1][state]:
        state = TURN[state]
        audit.append("I")
        made.append((-1, state))
    return "".join(audit), made, state, cost


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the rows with the faults that the crc of ``conv_id:turn`` picks."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    text = F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return (rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("_kind")).where(F.col("_kind") != 0)
            .select("conv_id", "turn", F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("_n"))
            .drop("_n"))


def initial(role: Column) -> Column:
    """Index in ``INITIALS``."""
    first = F.substring(role, 1, 1)
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)


def numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with texts: rid, role, text; rows without: k, pos, rid, turn, blank, duplicate, truncated, code)."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    wide = materialize(rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("rid")))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    narrow = wide.select(key_of("conv_id").alias("k"), "turn", "role", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), "rid",
                         blank.alias("blank"), cut.alias("cut"))
    ranked = materialize(rank_within(narrow, ["k"], [F.col("turn"), F.col("role"), F.col("sha"), F.col("rid")], name="pos"))
    # the first of equal rows by a summed minimum; the join is on the row, so that a text met often is no hot key
    firsts = ranked.groupBy("k", "role", "sha").agg(F.min("pos").alias("pos")).select("k", "pos", F.lit(True).alias("first"))
    joined = ranked.join(firsts, ["k", "pos"], "left")
    duplicate = F.col("first").isNull() & ~F.col("blank")
    out = joined.select("k", (F.col("pos") - 1).alias("pos"), "rid", "turn", "role", "blank", duplicate.alias("duplicate"),
                        (F.col("cut") & ~F.col("blank") & ~duplicate).alias("truncated"))
    code = initial(F.col("role")) + F.when(F.col("truncated"), 4).otherwise(0) + F.when(F.col("blank") | F.col("duplicate"), 8).otherwise(0)
    return wide.select("rid", "role", "text"), materialize(out.withColumn("code", F.lower(F.hex(code))).drop("role"))


def blocks_of(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """k, block, blocks (of the conversation), codes and rids of a block's rows in order."""
    sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("k").alias("k2"), "n", F.greatest(F.lit(least), F.ceil(F.sqrt("n"))).cast("long").alias("b"))
    cut = rows.join(checked_broadcast(sizes, MAX_BROADCAST_GROUPS), F.col("k") == F.col("k2"))
    own = cut.groupBy("k", F.floor(F.col("pos") / F.col("b")).alias("block"), F.ceil(F.col("n") / F.col("b")).cast("long").alias("blocks")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "code", "rid"))).alias("r"))
    return own.select("k", "block", "blocks", F.array_join(F.transform("r", lambda x: x["code"]), "").alias("codes"),
                      F.transform("r", lambda x: x["rid"]).alias("rids"))


def _per_batch(fn, columns: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([fn(r) for r in b.itertuples(index=False)], columns=columns)
    return run


def _entries(exits: list[list[int]]) -> list[int]:
    out = [START]
    for e in exits[:-1]:
        out.append(int(e[out[-1]]))
    return out


def _edits(r) -> tuple:
    end = END if r.ends is None else [int(x) for x in r.ends]
    audit, made, _, cost = walk(r.codes, end, START if r.entry is None or pd.isna(r.entry) else int(r.entry), r.block == r.blocks - 1)
    return (r.k, r.block, audit, cost, [{"edit": e, "rid": None if i < 0 else int(r.rids[i]), "role": ROLES.get(q)} for e, (i, q) in zip(audit, made)])


def edits(blocks: DataFrame) -> DataFrame:
    """k, block, audit, cost (from the block to the end) and made: per edit its letter, the row's rid and the new role."""
    many = blocks.where(F.col("blocks") > 1).select("k", "block", "blocks", "codes")
    costs = many.mapInPandas(_per_batch(lambda r: (r.k, r.block, matrix(r.codes)), ["k", "block", "m"]), "k string, block long, m array<long>")
    chain = costs.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("block", "m"))).alias("c")).select(
        "k", F.transform("c", lambda x: x["m"]).alias("m"))
    ends = chain.mapInPandas(_per_batch(lambda r: (r.k, checkpoints([[int(x) for x in m] for m in r.m])), ["k", "v"]), "k string, v array<array<long>>")
    marks = materialize(ends.select("k", F.posexplode("v").alias("block", "ends")).withColumn("block", F.col("block").cast("long")))
    behind = many.join(marks, ["k", "block"])
    exits = behind.mapInPandas(
        _per_batch(lambda r: (r.k, r.block, [walk(r.codes, [int(x) for x in r.ends], s, False)[2] for s in range(4)]), ["k", "block", "x"]),
        "k string, block long, x array<int>")
    enter = exits.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("block", "x"))).alias("c")).select("k", F.transform("c", lambda x: x["x"]).alias("x"))
    entered = enter.mapInPandas(_per_batch(lambda r: (r.k, _entries(r.x)), ["k", "e"]), "k string, e array<int>")
    entries = entered.select("k", F.posexplode("e").alias("block", "entry")).withColumn("block", F.col("block").cast("long"))
    full = blocks.join(marks.join(entries, ["k", "block"]), ["k", "block"], "left")
    return full.select("k", "block", "blocks", "codes", "rids", "ends", F.col("entry").cast("int").alias("entry")).mapInPandas(
        _per_batch(_edits, ["k", "block", "audit", "cost", "made"]),
        "k string, block long, audit string, cost long, made array<struct<edit:string,rid:long,role:string>>")


def repaired(made: DataFrame, wide: DataFrame) -> DataFrame:
    """k, block, seq, edit, role, text of the rows that stay, in the order of (block, seq)."""
    rows = made.select("k", "block", F.posexplode("made").alias("seq", "m")).select("k", "block", "seq", "m.edit", F.col("m.role").alias("new"), "m.rid")
    rows = rows.where(F.col("edit") != "D").withColumn("rid", F.coalesce("rid", F.lit(-1) - F.pmod(F.xxhash64("k", "block", "seq"), F.lit(1 << 40))))
    return rows.join(wide, "rid", "left").select("k", "block", "seq", "edit", F.coalesce("new", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def repair(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """The repaired rows: k (the conv_id behind ``=``, empty for null), block, seq, edit, role, text."""
    wide, narrow = numbered(rows.select("conv_id", "turn", "role", "text"))
    return repaired(materialize(edits(materialize(blocks_of(narrow, least)))), wide)


def digest(rows: DataFrame) -> DataFrame:
    """k, repaired_sha256: of the ``role:text`` of a conversation's rows, newline-joined, read as a sorted stream."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for b in batches:
            keys, shas = [], []
            for k, role, text in zip(*(b.column(c).to_pylist() for c in ("k", "role", "text"))):
                if k != key:
                    if key is not None:
                        keys.append(key)
                        shas.append(sha.hexdigest())
                    key, sha = k, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(shas, pa.string())], ["k", "repaired_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([sha.hexdigest()], pa.string())], ["k", "repaired_sha256"])

    return (rows.select("k", "block", "seq", "role", "text").repartition("k").sortWithinPartitions("k", "block", "seq")
            .mapInArrow(run, "k string, repaired_sha256 string"))


def _illegal(codes: Column) -> Column:
    """Adjacent pairs of initials that are not su, ua or au."""
    at = lambda i: F.conv(F.substr(codes, i, F.lit(1)), 16, 10).cast("int").bitwiseAND(F.lit(3))
    bad = F.filter(F.sequence(F.lit(1), F.length(codes) - 1), lambda i: ~F.concat(at(i).cast("string"), at(i + 1).cast("string")).isin("01", "12", "21"))
    return F.when(F.length(codes) > 1, F.size(bad)).otherwise(0)


def summary(rows: DataFrame, blocks: DataFrame, made: DataFrame) -> DataFrame:
    """k, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation."""
    by_turn = rows.groupBy("k", "turn").agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")])
    faults = by_turn.groupBy("k").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
                                      *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    ends = blocks.groupBy("k").agg(F.sort_array(F.collect_list(F.struct(
        "block", F.concat(F.substring("codes", 1, 1), F.substring("codes", -1, 1)).alias("ends"), _illegal(F.col("codes")).alias("inside")))).alias("c"))
    border = F.transform("c", lambda x, i: F.when(i > 0, _illegal(F.concat(F.substring(F.get("c", i - 1)["ends"], 2, 1), F.substring(x["ends"], 1, 1)))).otherwise(0) + x["inside"])
    illegal = ends.select("k", F.aggregate(border, F.lit(0).cast("long"), lambda a, x: a + x).alias("illegal"))
    audits = made.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("block", "audit"))).alias("a"), F.max(F.when(F.col("block") == 0, F.col("cost"))).alias("cost"))
    audits = audits.select("k", "cost", F.array_join(F.transform("a", lambda x: x["audit"]), "").alias("audit"))
    return faults.join(illegal, "k").join(audits, "k")


def repair_digest(conversations: DataFrame, least: int = LEAST) -> DataFrame:
    """The digest row of every conversation of the table, damaged and repaired."""
    base = conversations.select("conv_id", "turn", "role", "text")
    wide, rows = numbered(damage(base))
    blocks = materialize(blocks_of(rows, least))
    made = materialize(edits(blocks))
    ids = base.select("conv_id").distinct().withColumn("k", key_of("conv_id"))
    out = ids.join(summary(rows, blocks, made), "k", "left").join(digest(repaired(made, wide)), "k", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
