"""Registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, hnsw, maxent, mixing, radix, secrets, simhash, substring, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(spark, _table(spark, sf_dir, "documents"))


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(spark, _table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(spark, docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return maxent.score(spark, docs, maxent.train(spark, docs))


def op6_embedding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_groups(spark, _table(spark, sf_dir, "embeddings"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, _table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(spark, _table(spark, sf_dir, "documents"))


def op10_exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix.exact_groups(spark, _table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_secret_ownership, op2_bpe, op3_repeated_passages, op4_toxicity, op5_lm_scores, op6_embedding_groups, op7_source_mix, op8_chat_format,
        op9_simhash_groups, op10_exact_groups)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_ownership": secrets.scan_sql(),
        "op6_embedding_groups": hnsw.near_groups_sql(),
        "op8_chat_format": chat.format_chats_sql(),
        "op10_exact_groups": radix.exact_groups_sql(),
    }
