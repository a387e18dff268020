"""Merkle manifest of a table by a butterfly exchange.

A row's leaf is the sha256 of its typed fields; the leaves of a source, by doc_id, are the bottom of a tree of runs of
``FANOUT``; the sources' subroots, by source, are the bottom of the tree above. Leaves get their exact position by a
range shuffle of digests only (no text), and aligned partitions of ``FANOUT ** DEPTH`` leaves build their lowest levels
locally. Then partitions swap: in each round the groups of one run send their root to each other, one message for each
receiving partition (with unequal groups, a sender serves every partition whose place is its own place modulo the size
of its group), and every partition hashes the ancestor itself. After the rounds within sources, the same exchange runs over
groups of whole sources. So each partition ends with the siblings of all upper levels and the root, no result travels
back down, and a hot source is many partitions. A partition's row is some kilobytes, however many rows it stands for.

Only the numbers of partitions by source and of sources (no hashes) are read to lay out the rounds; the groups of a
run of sources are a table joined by run.

Defined results: a null field is ``-``; null source is a source of its own, first; null doc_id sorts first; rows with
one doc_id follow by leaf, and equal rows are leaves of their own that may change places; null or empty text is a leaf
like any other; other columns are not read; an empty table gives an empty result. A null doc_id is never tampered with.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import checked_broadcast
from ..operators.ordering import MAX_BROADCAST_GROUPS, rank_within
from .common import materialize

FANOUT = 16
DEPTH = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else byte count, ``:``, value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_of(fields: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[field(fields[k]) for k in FIELDS]).cast("binary"), 256)


def tampered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf and found (the leaf of the row as found later: tampered with in a fifth of the ids).

    The digests are written once, with a row number that only keeps equal rows apart."""
    own = {k: F.col(k) for k in FIELDS}
    hit = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    leaf = leaf_of(own)
    found = F.when(hit, leaf_of({**own, "text": tampered(F.col("text"))}))
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.unhex(leaf).alias("leaf"),
                       F.unhex(found).alias("found"), F.monotonically_increasing_id().alias("row"))
    return materialize(rows)


def partitions(rows: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """(leaves with src and part, the layout by source: src, leaves, parts, first).

    ``src`` is the place of the source in their order, ``part`` the place of the partition among all partitions (those
    of source 0 first); ``first`` is the first partition of the source."""
    size = fanout ** depth
    ranked = rank_within(rows, ["source"], [F.col("doc_id"), F.col("leaf"), F.col("row")], name="pos")
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("leaves"))
    counts = counts.withColumn("parts", F.ceil(F.col("leaves") / size).cast("long"))
    layout = running_total(counts, "source", "parts")
    own = checked_broadcast(layout.withColumnRenamed("source", "s"), MAX_BROADCAST_GROUPS)
    placed = (ranked.join(own, ranked["source"].eqNullSafe(own["s"]))
              .select("doc_id", "leaf", "found", "src", "leaves", "first", (F.col("pos") - 1).alias("pos"))
              .withColumn("part", F.col("first") + F.floor(F.col("pos") / size)))
    return placed.drop("first"), layout


def running_total(counts: DataFrame, key: str, value: str) -> DataFrame:
    """``counts`` (one row a key) with ``src`` (place of the key, nulls first) and ``first`` (sum of ``value`` before it):
    totals by range partition, each row adds those before its own, so that no window spans all keys."""
    from pyspark.sql import Window

    ranged = materialize(counts.repartitionByRange(key).withColumn("p", F.spark_partition_id()))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # one row a range partition
    base = ranged.groupBy("p").agg(F.sum(value).alias("v"), F.count(F.lit(1)).alias("n")).select(
        "p", F.coalesce(F.sum("v").over(before), F.lit(0)).alias("v0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    within = Window.partitionBy("p").orderBy(key)
    return (ranged.join(F.broadcast(base), "p")
            .withColumn("src", (F.col("n0") + F.row_number().over(within) - 1).cast("long"))
            .withColumn("first", (F.col("v0") + F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)).cast("long"))
            .drop("p", "v0", "n0"))


def levels_of(n: int, fanout: int = FANOUT) -> int:
    """Levels from n nodes to one."""
    k = 0
    while n > 1:
        n, k = -(-n // fanout), k + 1
    return k


def subtree(hashes: list[str], levels: int, fanout: int = FANOUT) -> list[list[str]]:
    """The nodes of each level, ``levels`` times reduced."""
    out = [hashes]
    for _ in range(levels):
        out.append([digest(out[-1][i:i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def _roots(fanout: int, depth: int):
    """Per partition its root. The leaves of a group are those of one partition, at most ``fanout ** depth``."""
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by("pos")
        n = t["leaves"][0].as_py()
        top = subtree([x.hex() for x in t["leaf"].to_pylist()], min(depth, levels_of(n, fanout)), fanout)[-1][0]
        src = t["src"][0].as_py()
        yield pa.RecordBatch.from_pydict({"part": [key[0].as_py()], "src": [src], "root": [top]})
    return run


def butterfly(parts: DataFrame, layout: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """part, subroot, root and proof: per upper level the place in the run and the run's nodes.

    ``parts``: part, src, root of each partition. One shuffle a round; a partition's message to itself carries what it
    has gathered."""
    own = layout.select("src", "parts", "first")
    spread = own.agg(F.max("parts").alias("p"), F.count(F.lit(1)).alias("s")).first()
    state = (parts.join(checked_broadcast(own, MAX_BROADCAST_GROUPS), "src")
             .select("part", "src", "parts", "first", "root", F.expr("array()").cast("array<struct<digit:int,run:array<string>>>").alias("proof")))
    width = 1
    while width < (spread["p"] or 0):  # groups of `width` partitions of one source
        at = F.col("part") - F.col("first")
        run = F.floor(at / (width * fanout)) * (width * fanout)
        group = F.floor(at / width) * width
        size = F.least(F.lit(width), F.col("parts") - group)
        starts = F.when(F.col("parts") > width, F.sequence(run, F.least(run + width * fanout, F.col("parts")) - 1, F.lit(width)))
        groups = F.transform(starts, lambda g: F.struct((F.col("first") + g).alias("start"), F.least(F.lit(width), F.col("parts") - g).alias("size")))
        state = _round(state.select("*", groups.alias("groups"), (F.col("first") + group).alias("start"), size.alias("size")))
        width *= fanout
    state = state.withColumn("subroot", F.col("root"))
    width = 1
    while width < (spread["s"] or 0):  # groups of `width` sources
        group, run = F.floor(F.col("src") / width), F.floor(F.col("src") / (width * fanout))
        met = (layout.groupBy(run.alias("run"), group.alias("g")).agg(F.min("first").alias("start"), F.sum("parts").alias("size"))
               .groupBy("run").agg(F.sort_array(F.collect_list(F.struct("start", "size"))).alias("groups")))  # at most `fanout` a run
        joined = state.withColumn("run", run).join(checked_broadcast(met, MAX_BROADCAST_GROUPS), "run")
        mine = F.get(F.filter("groups", lambda g: (g["start"] <= F.col("part")) & (F.col("part") < g["start"] + g["size"])), F.lit(0))
        state = _round(joined.withColumn("mine", mine).select(*state.columns, "groups", F.col("mine.start").alias("start"), F.col("mine.size").alias("size")))
        width *= fanout
    return state.select("part", "subroot", "root", "proof")


def _round(state: DataFrame) -> DataFrame:
    """One swap: each partition sends its root to one partition or more of every group of its run, and hashes what it got.
    A row whose ``groups`` is null has no sibling level left and stays as it is."""
    keep = [c for c in state.columns if c not in ("part", "root", "groups", "start", "size")]
    place = F.col("part") - F.col("start")

    def receivers(g: Column) -> Column:
        return F.when(g["start"] == F.col("start"), F.array(F.col("part"))).otherwise(F.when(
            place < g["size"], F.transform(F.sequence(place, g["size"] - 1, F.col("size")), lambda o: g["start"] + o)).otherwise(F.array().cast("array<bigint>")))

    to = F.coalesce(F.flatten(F.transform("groups", receivers)), F.array(F.col("part")))
    sent = state.withColumn("to", F.explode(to))
    # what the receiver keeps comes with its message to itself
    carried = F.when(F.col("to") == F.col("part"), F.struct(*keep))
    got = sent.groupBy(F.col("to").alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("start", "root"))).alias("run"), F.max(carried).alias("own"),
        F.max(F.when(F.col("to") == F.col("part"), F.struct(F.col("groups").isNotNull().alias("open"), F.col("start")))).alias("me"))
    nodes = F.transform("run", lambda x: x["root"])
    digit = (F.array_position(F.transform("run", lambda x: x["start"]), F.col("me.start")) - 1).cast("int")
    up = got.select("part", *[F.col(f"own.{c}").alias(c) for c in keep if c != "proof"], F.col("me.open").alias("open"),
                    F.col("own.proof").alias("proof"), nodes.alias("nodes"), digit.alias("digit"))
    return up.select("part", *[c for c in keep if c != "proof"],
                     F.when(F.col("open"), F.sha2(F.array_join("nodes", "").cast("binary"), 256)).otherwise(F.get("nodes", F.lit(0))).alias("root"),
                     F.when(F.col("open"), F.concat("proof", F.array(F.struct(F.col("digit").alias("digit"), F.col("nodes").alias("run")))))
                     .otherwise(F.col("proof")).alias("proof"))


def fold(node: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that ``node`` leads to with the runs of the path, its own place taken by what was folded so far."""
    for digit, run in path:
        node = digest([*run[:digit], node, *run[digit + 1:]])
    return node


def _proofs(fanout: int, depth: int, with_proof: bool):
    """Per leaf of a partition the proof's digest and the root that the found leaf leads to; the lower levels are
    built again here, the upper ones came by the exchange."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        t = left.sort_by("pos")
        tree = subtree([x.hex() for x in t["leaf"].to_pylist()], min(depth, levels_of(t["leaves"][0].as_py(), fanout)), fanout)
        upper = [(p["digit"], p["run"]) for p in right["proof"][0].as_py()]
        above = "".join(x for d, r in upper for i, x in enumerate(r) if i != d)
        roots: dict[str, str] = {}  # of the local top: one value unless a leaf was tampered with
        out: dict[str, list] = {"proof_sha256": [], "folded_root": []} | ({"proof": []} if with_proof else {})
        for i, own in enumerate(t["found"].to_pylist()):
            path, at = [], i
            for nodes in tree[:-1]:
                lo = at - at % fanout
                path.append((at - lo, nodes[lo:lo + fanout]))
                at //= fanout
            siblings = [x for d, r in path for j, x in enumerate(r) if j != d]
            out["proof_sha256"].append(digest([*siblings, above]))
            top = fold(own.hex() if own is not None else tree[0][i], path)
            if top not in roots:
                roots[top] = fold(top, upper)
            out["folded_root"].append(roots[top])
            if with_proof:
                out["proof"].append([r[:d] + r[d + 1:] for d, r in path + upper])
        if with_proof:
            out["proof"] = pa.array(out["proof"], pa.list_(pa.list_(pa.string())))
        n = t.num_rows
        return pa.table({"doc_id": t["doc_id"], "leaf": tree[0], "subroot": pa.array([right["subroot"][0].as_py()] * n, pa.string()),
                         "root": pa.array([right["root"][0].as_py()] * n, pa.string()), **out})
    return run


def manifest(docs: DataFrame, fanout: int = FANOUT, depth: int = DEPTH, with_proof: bool = False) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row; ``with_proof`` adds the siblings
    of every level (some kilobytes a row)."""
    rows, layout = partitions(leaves(docs.select(*FIELDS)), fanout, depth)
    layout = materialize(layout)
    rows = materialize(rows)
    roots = rows.select("part", "src", "pos", "leaves", "leaf").groupBy("part").applyInArrow(_roots(fanout, depth), "part long, src long, root string")
    upper = materialize(butterfly(materialize(roots), layout, fanout))
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string" + ", proof array<array<string>>" * with_proof
    out = rows.groupBy("part").cogroup(upper.groupBy("part")).applyInArrow(_proofs(fanout, depth, with_proof), schema)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
