"""Token-level operators.

Everything per token is a column expression or a join against a *vocabulary* table (one row per
distinct term). Expensive per-term work (stems, lemmas) is done once per distinct term, never per
occurrence, and joined back.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import MAX_TOKENS, NOUN_SUFFIX_RULES, STOP_WORDS
from ..functions.stem import stem
from ..functions.text import clean_ascii, drop_stop_words, join_tokens, word_tokens
from ..session import materialize
from .joins import checked_broadcast, term_join
from .layout import by_key, parts_of, spread
from .ordering import ordered_index

# Vocabulary maps up to this many terms are broadcast; larger ones take a shuffle join (AQE
# splits a hot term's partition).
MAX_BROADCAST_TERMS = 2_000_000
# Bytes of written token lists that one group of ``map_token_lists`` holds.
BLOCK_BYTES = 4 << 20
# Special ids of a fixed-length encoding.
PAD_ID, UNK_ID, BOS_ID, EOS_ID = 0, 1, 2, 3
N_SPECIAL = 4


def token_table(df: DataFrame, text: str = "review", key: str = "row_id", clean: bool = False, most: int | None = None,
                keyed: bool = False) -> DataFrame:
    """``key, pos, term``: one row per token of the raw text (pos is 0-based), or of its first ``most`` tokens.

    ``clean`` deletes everything but printable ASCII first, as the classifiers' inputs have it; ``keyed`` lays the texts
    out for an aggregate by key and term (``by_key``)."""
    source = clean_ascii(text) if clean else F.col(text)
    tokens = word_tokens(source)
    return (by_key if keyed else spread)(df, key).select(key, F.posexplode(tokens if most is None else F.slice(tokens, 1, most)).alias("pos", "term"))


def tokenized(df: DataFrame, text: str = "review", out: str = "tokens", key: str = "row_id") -> DataFrame:
    """F3 as an array column, of the raw text."""
    return spread(df, key).withColumn(out, word_tokens(text))


def remove_stopwords(df: DataFrame, tokens: str = "tokens", out: str = "no_stopwords") -> DataFrame:
    """F6 + F7: drop stop words (case-insensitive test, case kept) and join back to text."""
    return df.withColumn(out, join_tokens(drop_stop_words(F.col(tokens))))


def stopword_antijoin(tokens: DataFrame, term: str = "term") -> DataFrame:
    """The same filter as an anti-join of the token table against the (fixed-size) stop list."""
    spark = tokens.sparkSession
    stops = spark.createDataFrame([(w,) for w in STOP_WORDS], "stop string")
    return tokens.join(F.broadcast(stops), F.lower(F.col(term)) == F.col("stop"), "left_anti")


def vocabulary(tokens: DataFrame, write: bool = False) -> DataFrame:
    """Distinct terms of a token table (one partial + final aggregate).

    With ``write`` the vocabulary is written once under the checkpoint folder, for plans that use it
    several times (it is far smaller than the token table it saves re-tokenizing)."""
    v = tokens.select("term").distinct()
    return materialize(v) if write else v


def lexicon(terms: list[DataFrame]) -> DataFrame:
    """Lexicon for lemmas: distinct lower-cased forms of the given term tables.

    Passing the corpus vocabulary (not its token table) lets the plan reuse the vocabulary's
    exchange, so the corpus is tokenized once for both."""
    out = None
    for t in terms:
        part = t.select(F.lower("term").alias("word"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def _suffix_candidates(term: Column) -> Column:
    """The term itself plus every noun-suffix rewrite that applies (as an array, no join)."""
    cands = [term]
    for suf, rep in NOUN_SUFFIX_RULES:
        stem_len = F.length(term) - F.lit(len(suf))
        cand = F.concat(F.left(term, stem_len), F.lit(rep))
        cands.append(F.when(term.endswith(suf) & (stem_len + F.lit(len(rep)) > 0), cand))
    return F.array_compact(F.array(*cands))


def lemma_vocabulary(vocab: DataFrame, lex: DataFrame) -> DataFrame:
    """``term -> lemma`` for every term of the vocabulary table (``term``, distinct).

    Candidates are semi-joined to the lexicon; the shortest hit wins (ties alphabetical); a term
    with no hit maps to itself. Case is kept: the lexicon is lower-case, so a capitalised form only
    matches itself.
    """
    # spread: a small written vocabulary is one file (one task); the aggregate by term reuses the layout
    cands = spread(vocab, "term").select("term", F.explode(_suffix_candidates(F.col("term"))).alias("cand"))
    hits = cands.join(lex.withColumn("hit", F.lit(True)), F.col("cand") == F.col("word"), "left")
    best = hits.groupBy("term").agg(F.min(F.when(F.col("hit"), F.struct(F.length("cand").alias("n"), F.col("cand")))).alias("b"))
    return best.select("term", F.coalesce(F.col("b.cand"), F.col("term")).alias("lemma"))


def stem_vocabulary(tokens: DataFrame) -> DataFrame:
    """``term -> stem`` computed once per distinct term, in column expressions."""
    vocab = tokens.select("term").distinct()
    # AQE coalesces the small distinct output into few partitions; spread it before the long expression
    return spread(vocab, "term").select("term", stem(F.col("term")).alias("stem"))


def map_terms(tokens: DataFrame, mapping: DataFrame, value: str, key: str = "row_id") -> DataFrame:
    """Join each token to its vocabulary value and re-assemble each text in token order."""
    mapped = term_join(tokens, mapping, "term", "left", MAX_BROADCAST_TERMS).withColumn(value, F.coalesce(F.col(value), F.col("term")))
    return mapped.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", value))), lambda x: x[value]),
                     " ").alias(value),
        F.count(F.lit(1)).alias("n_tokens"))


def token_lists(df: DataFrame, text: str = "review", key: str = "row_id") -> DataFrame:
    """``key, tokens``: the tokens of each text that has any, written once for plans that read them several times."""
    lists = materialize(tokenized(df.select(key, text), text, key=key).select(key, "tokens"))
    return lists.filter(F.size("tokens") > 0)  # of the written column: in front of it each text would be tokenized twice


def listed_terms(lists: DataFrame) -> DataFrame:
    """``term``: one row per token of ``token_lists``."""
    return lists.select(F.explode("tokens").alias("term"))


def map_token_lists(lists: DataFrame, mapping: DataFrame, value: str, key: str = "row_id") -> DataFrame:
    """``map_terms`` of token lists, for a vocabulary of any size.

    Texts are dealt by their key into blocks of about ``BLOCK_BYTES`` of written lists. A block's distinct terms, not its
    tokens, are joined to the vocabulary, and each block's texts meet its part of the mapping in one group. So a list is
    moved once, whole, and no task holds more than a block and its terms. Lists of one key are merged by position."""
    blocks = parts_of(lists, BLOCK_BYTES)
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).alias("_blk")
    # a token has no blank or control character; as one string a list takes a third of the bytes of an array
    dealt = lists.select(block, key, F.array_join("tokens", "\n").alias("tokens"))
    wanted = lists.select(block, F.explode("tokens").alias("term")).distinct()
    # the commonest terms have a row in every block, no more
    known = wanted.join(mapping, "term", "left").select(F.col("_blk").alias("_at"), "term", F.coalesce(F.col(value), F.col("term")).alias("to"))
    key_type = lists.schema[key].dataType.simpleString()

    def assemble(texts: pa.Table, terms: pa.Table) -> pa.Table:
        to = dict(zip(terms["term"].to_pylist(), terms["to"].to_pylist()))
        by: dict = {}
        for k, tokens in zip(texts[key].to_pylist(), texts["tokens"].to_pylist()):
            by.setdefault(k, []).append([to[t] for t in tokens.split("\n")])
        out = [found[0] if len(found) == 1 else [v for _, v in sorted(x for f in found for x in enumerate(f))] for found in by.values()]
        return pa.table({key: pa.array(list(by), texts.schema.field(key).type), value: pa.array([" ".join(o) for o in out], pa.string()),
                         "n_tokens": pa.array([len(o) for o in out], pa.int64())})

    return dealt.groupBy("_blk").cogroup(known.groupBy("_at")).applyInArrow(assemble, f"{key} {key_type}, {value} string, n_tokens long")


def vocab_fit(tokens: DataFrame, size: int | None = None) -> DataFrame:
    """M4: all lower-cased terms, most frequent first (ties by term), ids after the special ids.

    The whole vocabulary is numbered by range partitions. With ``size`` only that many terms are kept, by a
    bounded top-k (``TakeOrderedAndProject``) that keeps the ranking off a single-partition window.
    """
    counts = tokens.groupBy(F.lower("term").alias("word")).agg(F.count(F.lit(1)).alias("freq"))
    if size is None:
        numbered = ordered_index(counts, [F.col("freq").desc(), F.col("word")], name="token_id")
        return numbered.withColumn("token_id", F.col("token_id") - 1 + F.lit(N_SPECIAL))
    top = counts.orderBy(F.col("freq").desc(), F.col("word")).limit(size)
    w = Window.orderBy(F.col("freq").desc(), F.col("word"))
    return top.withColumn("token_id", (F.row_number().over(w) - 1 + F.lit(N_SPECIAL)).cast("int"))


def encode_fixed(docs: DataFrame, tokens: DataFrame, vocab: DataFrame, key: str = "row_id",
                 length: int = MAX_TOKENS) -> DataFrame:
    """Ids truncated and padded to exactly ``length`` (bos, ids..., eos, pad...), plus mask.

    Truncation is a filter on ``pos`` before the vocabulary join; terms that the vocabulary lacks get the
    unk id; the vocabulary is broadcast only behind a check of its size.
    """
    body = length - 2
    kept = tokens.filter(F.col("pos") < F.lit(body)).withColumn("word", F.lower("term"))
    known = checked_broadcast(vocab.select("word", F.col("token_id").cast("long")), MAX_BROADCAST_TERMS)
    ids = kept.join(known, "word", "left").select(
        key, "pos", F.coalesce(F.col("token_id"), F.lit(UNK_ID).cast("long")).alias("token_id"))
    seqs = ids.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "token_id"))).alias("s"))
    core = F.coalesce(F.transform(F.col("s"), lambda x: x["token_id"]), F.array().cast("array<bigint>"))
    framed = F.concat(F.array(F.lit(BOS_ID).cast("long")), core, F.array(F.lit(EOS_ID).cast("long")))
    out = docs.select(key).join(seqs, key, "left").withColumn("_f", framed)
    pad = F.array_repeat(F.lit(PAD_ID).cast("long"), F.lit(length) - F.size("_f"))
    return out.select(
        key,
        F.concat(F.col("_f"), pad).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1).cast("long"), F.size("_f")), pad).alias("attention_mask"),
    )
