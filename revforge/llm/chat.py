"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only that
reply's text is trainable. A turn is written ``<|role|>\\n`` text ``<|end|>\\n``; inside texts and roles
``&`` and ``<`` (in roles ``|`` too) are written ``&amp;``, ``&lt;``, ``&bar;``, so no text can hold a
control string, and the original is read back exactly. Turns after the last reply (or a conversation
without one) are kept in one context-only example whose loss span is empty, so no turn is lost.

A conversation is the unit of the output (its digest is one SHA-256 over all turns), so its turns meet
in one row; conversations spread over tasks by conv_id, and the examples are made from that row without
another shuffle. Defined results: null text or role is empty; turns with equal numbers go by role, then
text; a null conv_id is a conversation of its own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, text_of

END = "<|end|>\n"
REPLY = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescaped(text: Column) -> Column:
    for mark, plain in (("&bar;", "|"), ("&lt;", "<"), ("&amp;", "&")):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def format_turn(role: Column, text: Column) -> Column:
    head = F.replace(escaped(role), F.lit("|"), F.lit("&bar;"))
    return F.concat(F.lit("<|"), head, F.lit("|>\n"), escaped(text), F.lit(END))


def format_chat(conversations: DataFrame) -> DataFrame:
    """One row per example: conv_id, example (from 0), is_last, formatted, loss_start, loss_end (code
    points from 0, end exclusive; equal where nothing is trainable)."""
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                    text_of().alias("text"))
    convs = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    convs = convs.select("conv_id", F.transform("_turns", lambda t: F.struct(
        format_turn(t["role"], t["text"]).alias("seg"), (t["role"] == REPLY).alias("reply"),
        F.length(escaped(t["text"])).alias("chars"))).alias("_segs"))
    n = F.size("_segs")
    last_is_target = F.element_at("_segs", -1)["reply"]
    targets = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(F.col("_segs"), i)["reply"] | (i == n))
    ex = convs.select("conv_id", "_segs", F.posexplode(targets).alias("example", "_at"))
    full = F.array_join(F.transform(F.slice("_segs", F.lit(1), F.col("_at")), lambda s: s["seg"]), "")
    ex = ex.select("conv_id", "example", (F.col("_at") == n).alias("is_last"),
                   F.element_at("_segs", F.col("_at"))["reply"].alias("_reply"),
                   F.element_at("_segs", F.col("_at"))["chars"].alias("_chars"), full.alias("formatted"))
    stop = F.length("formatted") - F.lit(len(END))
    return ex.select("conv_id", "example", "is_last", "formatted",
                     F.when(F.col("_reply"), stop - F.col("_chars")).otherwise(F.length("formatted")).alias("loss_start"),
                     F.when(F.col("_reply"), stop).otherwise(F.length("formatted")).alias("loss_end"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted example."""
    parts = F.split(formatted, r"<\|end\|>\n")

    def turn(p: Column) -> Column:
        return let(F.substring_index(p, "|>\n", 1), lambda head: F.struct(
            unescaped(F.substr(head, F.lit(3))).alias("role"),
            unescaped(F.substr(p, F.length(head) + 4)).alias("text")))

    return F.transform(F.filter(parts, lambda p: p != ""), turn)


def read_loss(formatted: Column, start: Column, stop: Column) -> Column:
    return unescaped(F.substr(formatted, start + 1, stop - start))


def chat_digest(conversations: DataFrame) -> DataFrame:
    """Per conversation, all of it read back from the examples' formatted text and loss spans."""
    spark = conversations.sparkSession
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise(REPLY).alias("role"), F.lit(probe).alias("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                "role", "text").unionByName(extra)
    ex = format_chat(rows)
    said = F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    ex = ex.select("conv_id", "example", F.length("formatted").alias("_chars"),
                   read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("_loss"),
                   F.when(F.col("is_last"), F.sha2(said.cast("binary"), 256)).alias("_sha"),
                   F.when(F.col("is_last"), F.size(read_turns(F.col("formatted")))).alias("_n"))
    loss = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "_loss"))), lambda x: x["_loss"]), "")
    out = ex.groupBy("conv_id").agg(F.max("_n").cast("long").alias("n_turns"), F.max("_sha").alias("turns_sha256"),
                                    loss.alias("_text"), F.sum("_chars").alias("formatted_chars"),
                                    F.count(F.lit(1)).alias("n_examples"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("_text").cast("long").alias("loss_chars"),
                      F.sha2(F.col("_text").cast("binary"), 256).alias("loss_sha256"),
                      F.col("formatted_chars").cast("long").alias("formatted_chars"), "n_examples")
