"""Sharding over fixed virtual slots.

Every row hashes into one of ``SLOTS`` slots. Bytes are summed per slot, and a versioned slot-to-shard
map (at most SLOTS rows a version) says where a slot lives. The first version places slots, largest
first, on the least loaded shard; later versions edit the map: ``rebalance`` moves few slots from the
fullest to the emptiest shard, ``grow`` adds a shard that takes slots only into itself. Rows never move
unless their slot does.

Rows hash by (doc_id, text checksum), so copies of a text spread over slots. Defined results: a null
text has size 1 and checksum 0; a null doc_id hashes as its own value; equal rows share a slot and get
their own row numbers; an empty table gives an empty result and an empty map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_of

SLOTS = 4096
SHARDS = 8


def slot_of(slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int")


def with_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of every row; the only pass over the texts."""
    raw = text_of().cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text_of()).cast("long") + 1).alias("size"),
                       F.crc32(raw).alias("text_crc32"))
    return rows.withColumn("virtual_slot", slot_of(slots))


def slot_sizes(rows: DataFrame) -> DataFrame:
    """(virtual_slot, rows, bytes): partial sums on the map side, at most SLOTS rows."""
    return rows.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))


def _least_loaded(slots: Column, loads: Column) -> Column:
    """Fold over slots (largest first): each goes to the shard with the smallest load, ties to the lower."""
    start = F.struct(loads.alias("loads"), F.expr("cast(array() as array<int>)").alias("to"))

    def place(state: Column, slot: Column) -> Column:
        at = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int")
        grown = F.transform(state["loads"], lambda x, i: F.when(i + 1 == at, x + slot["bytes"]).otherwise(x))
        return F.struct(grown.alias("loads"), F.concat(state["to"], F.array(at - 1)).alias("to"))

    return F.aggregate(slots, start, place, lambda state: state["to"])


def first_map(sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 1 of the map: (map_version, virtual_slot, shard, rows, bytes).

    One row holds the array of all slots: its length is the fixed number of slots, whatever the input.
    """
    order = F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("_less"), "virtual_slot", "bytes", "rows")))
    one = sizes.agg(order.alias("slots")).where(F.size("slots") > 0)
    zero = F.array_repeat(F.lit(0).cast("long"), shards)
    one = one.select("slots", _least_loaded(F.col("slots"), zero).alias("to"))
    pairs = one.select(F.explode(F.arrays_zip("slots", "to")).alias("p"))
    return pairs.select(F.lit(1).alias("map_version"), F.col("p.slots.virtual_slot").alias("virtual_slot"),
                        F.col("p.to").alias("shard"), F.col("p.slots.rows").alias("rows"),
                        F.col("p.slots.bytes").alias("bytes"))


def rebalance(slot_map: DataFrame, sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version for new slot sizes. A shard over the mean gives up its smallest slots until it is at
    the mean; those slots go, largest first, to the least loaded shards. All other slots stay."""
    fresh = (sizes.join(slot_map.select("map_version", "virtual_slot", "shard"), "virtual_slot", "left")
             .withColumn("map_version", F.max("map_version").over(Window.partitionBy()) + 1))
    mean = F.sum("bytes").over(Window.partitionBy()) / F.lit(float(shards))
    keep_order = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    held = fresh.withColumn("_run", F.sum("bytes").over(keep_order)).withColumn("_mean", mean)
    first = F.row_number().over(keep_order) == 1
    held = held.withColumn("_moves", F.col("shard").isNull() | ((F.col("_run") > F.col("_mean")) & ~first))
    stay, move = held.where(~F.col("_moves")), held.where("_moves")
    load = stay.groupBy("shard").agg(F.sum("bytes").alias("l")).agg(F.map_from_entries(F.collect_list(F.struct("shard", "l"))).alias("m"))
    loads = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.coalesce(F.try_element_at(F.col("m"), s), F.lit(0).cast("long")))
    one = move.agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("_less"), "virtual_slot", "bytes", "rows", "map_version"))).alias("slots")).crossJoin(load)
    one = one.select("slots", _least_loaded(F.col("slots"), loads).alias("to")).where(F.size("slots") > 0)
    p = one.select(F.explode(F.arrays_zip("slots", "to")).alias("p"))
    moved = p.select(F.col("p.slots.map_version").alias("map_version"), F.col("p.slots.virtual_slot").alias("virtual_slot"),
                     F.col("p.to").alias("shard"), F.col("p.slots.rows").alias("rows"), F.col("p.slots.bytes").alias("bytes"))
    return stay.select(moved.columns).unionByName(moved)


def grow(slot_map: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version with shard number ``shards`` added: every old shard gives slots of about
    1 / (shards + 1) of its bytes, smallest first, to the new one; nothing moves between old shards."""
    order = Window.partitionBy("shard").orderBy("bytes", "virtual_slot")
    total = F.sum("bytes").over(Window.partitionBy("shard"))
    gives = F.sum("bytes").over(order) * (shards + 1) <= total
    return slot_map.select((F.col("map_version") + 1).alias("map_version"), "virtual_slot",
                           F.when(gives, F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"), "rows", "bytes")


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """(rows, map): every row with its virtual_slot, shard and its row number ``slot`` in the shard
    (gapless from 0), and the stored map. Row numbers come from the slots' row counts plus a numbering
    inside one slot, so no task orders a whole shard."""
    rows = materialize(with_slots(docs, slots))
    slot_map = materialize(first_map(slot_sizes(rows), shards))
    start = F.coalesce(F.sum("rows").over(Window.partitionBy("shard").orderBy("virtual_slot")
                                          .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = materialize(slot_map.select("map_version", "virtual_slot", "shard", start.alias("_start")))
    inside = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")) - 1
    numbered = rows.withColumn("_in", inside).join(placed, "virtual_slot")
    out = numbered.select("doc_id", "size", "text_crc32", "virtual_slot", "map_version", "shard",
                          (F.col("_start") + F.col("_in")).cast("long").alias("slot"))
    return out, slot_map


def shard_digest(docs: DataFrame) -> DataFrame:
    rows, _ = shard(docs)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
