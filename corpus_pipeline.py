"""The corpus pipeline: raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import bpe, mixing, radix, simhash, toxicity
from plumbline.llm.shelf import Shelf, fresh


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; all others stay.

    The model is fitted on the labelled ones among ``docs`` (a bounded sample);
    without labels of both classes nothing is rejected.  Null, empty and
    wordless texts stay; very long texts are judged by all their windows;
    repeated rows share their fate; an empty table stays empty; further
    columns pass through, whatever their names.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(spark, docs, model)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the one with the smallest id (ties: by the other columns).

    Rows with a null text all stay, empty texts are equal, very long ones are
    compared to their end; of repeated rows one stays; a null id comes after
    all others; an empty table stays empty; further columns pass through.
    """
    return radix.drop_exact_duplicates(spark, docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id (an integer).

    Rows without an id, and null, empty and wordless texts, have no near copy
    and stay; very long texts are taken whole; rows that repeat an id share
    its fate; an empty table stays empty; further columns pass through.
    """
    return simhash.drop_near_duplicates(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources reach their target weights; every document comes at least once.

    The partitions are the shards, in their random order.  A null source is a
    source of its own; null ids, null, empty and very long texts are documents
    like others; repeated rows go together and count once; an empty table
    stays empty; further columns pass through, also such as are called shard,
    epoch or order_key.
    """
    (shard, epoch, key) = fresh(docs, "shard", "epoch", "order_key")
    return mixing.mix(spark, docs, outputs=(shard, epoch, key)).drop(shard, epoch, key)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, one row for each.

    A null text has null ids, an empty one none; very long texts are encoded
    whole; ids, null and repeated ones too, pass through; an empty table gives
    an empty result; further columns are ignored.
    """
    return bpe.encode(spark, docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact), ("simhash_dedup", drop_near), ("mixing", mix_sources), ("bpe", encode)]

#: A trained network, a random deal and BPE are beyond SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages stands a written table."""
    shelf = Shelf(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = shelf.put(docs)
    return docs
