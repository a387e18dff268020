"""The registered queries of this subpackage: thin digests over the operators, production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, chat, langid, merkle, mixing, neardup, packing, pii, quality, repair, sharding, substrings, toxicity
from .common import table
from .oracle import SQL

__all__ = ["QUERIES", "SQL"]


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.every_twentieth(table(spark, sf_dir, "embeddings"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_digest(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digest(table(spark, sf_dir, "conversations"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_digest(table(spark, sf_dir, "conversations"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_personal_data, op2_near_duplicates, op3_nearest_vectors, op4_pack, op5_repeated_substrings, op6_quality_rules,
        op7_chat_format, op8_toxicity, op9_mix_sources, op10_shard, op11_merkle_manifest, op12_conversation_repair,
        op13_language_id)
}
