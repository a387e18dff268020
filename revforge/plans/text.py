"""Registered token-level queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import MAX_TOKENS
from ..functions.text import drop_stop_words
from ..operators import textops
from ..operators.columns import filter_present
from ..sources import bindings
from .common import normalise


def _docs(spark: SparkSession, root: str) -> DataFrame:
    return bindings.raw_reviews(spark, root).select("row_id", "review")


def _bench_tokens(spark: SparkSession, root: str) -> DataFrame:
    b = bindings.read_table(spark, root, "benchmark").select(
        F.col("item_id").cast("long").alias("row_id"), F.col("text").alias("review"))
    return textops.token_table(b)


def q_tokenize_words(spark: SparkSession, root: str) -> DataFrame:
    t = textops.tokenized(_docs(spark, root))
    return normalise(t.select("row_id", F.size("tokens").alias("n_tokens"),
                              F.md5(F.array_join("tokens", " ")).alias("tokens_md5")))


def q_remove_stopwords(spark: SparkSession, root: str) -> DataFrame:
    t = textops.remove_stopwords(textops.tokenized(_docs(spark, root)))
    return normalise(t.select(
        "row_id", F.size(drop_stop_words(F.col("tokens"))).alias("n_kept"),
        F.md5("no_stopwords").alias("kept_md5")))


def q_stopword_antijoin(spark: SparkSession, root: str) -> DataFrame:
    kept = textops.stopword_antijoin(textops.token_table(_docs(spark, root)))
    return normalise(kept.groupBy("row_id").agg(F.count(F.lit(1)).alias("n_kept")))


def q_lemma_vocab(spark: SparkSession, root: str) -> DataFrame:
    vocab = textops.vocabulary(textops.token_table(_docs(spark, root)), write=True)
    lex = textops.lexicon([vocab, textops.vocabulary(_bench_tokens(spark, root))])
    return normalise(textops.lemma_vocabulary(vocab, lex))


def q_lemmatize_text(spark: SparkSession, root: str) -> DataFrame:
    lists = textops.token_lists(_docs(spark, root))
    vocab = textops.vocabulary(textops.listed_terms(lists), write=True)
    lex = textops.lexicon([vocab, textops.vocabulary(_bench_tokens(spark, root))])
    lem = textops.map_token_lists(lists, textops.lemma_vocabulary(vocab, lex), "lemma")
    return normalise(lem.select("row_id", "n_tokens", F.md5("lemma").alias("lemma_md5")))


def q_stem_vocab(spark: SparkSession, root: str) -> DataFrame:
    return normalise(textops.stem_vocabulary(textops.token_table(_docs(spark, root))))


def q_stem_text(spark: SparkSession, root: str) -> DataFrame:
    lists = textops.token_lists(_docs(spark, root))
    st = textops.map_token_lists(lists, textops.stem_vocabulary(textops.listed_terms(lists)), "stem")
    return normalise(st.select("row_id", "n_tokens", F.md5("stem").alias("stem_md5")))


def q_vocab_fit(spark: SparkSession, root: str) -> DataFrame:
    toks = textops.token_table(filter_present(_docs(spark, root)), clean=True)
    return normalise(textops.vocab_fit(toks))


def q_encode_fixed(spark: SparkSession, root: str) -> DataFrame:
    docs = filter_present(_docs(spark, root))
    toks = textops.token_table(docs, clean=True)
    first = textops.token_table(docs, clean=True, most=MAX_TOKENS - 2)  # no more of a text is exploded than an encoding holds
    enc = textops.encode_fixed(docs, first, textops.vocab_fit(toks))
    return normalise(enc.select(
        "row_id", F.size("input_ids").alias("n_ids"),
        F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_real"),
        F.md5(F.array_join("input_ids", " ")).alias("ids_md5")))


QUERIES = {
    "tokenize_words": q_tokenize_words,
    "remove_stopwords": q_remove_stopwords,
    "stopword_antijoin": q_stopword_antijoin,
    "lemma_vocab": q_lemma_vocab,
    "lemmatize_text": q_lemmatize_text,
    "stem_vocab": q_stem_vocab,
    "stem_text": q_stem_text,
    "vocab_fit": q_vocab_fit,
    "encode_fixed": q_encode_fixed,
}
