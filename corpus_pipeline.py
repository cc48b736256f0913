"""Training-corpus pipeline: five stages over ``documents``, each one of the
operators of ``quarry.llm`` applied to all that the stage before kept.

1. quality: documents that the classifier scores under its threshold go.
2. near_dedup: one document of each SimHash component stays.
3. suffix_dedup: bytes covered by a 100-byte string that starts earlier go
   from the texts; every document stays.
4. decontaminate: documents that cover a benchmark item go.
5. tokenize: token ids and decoded text of every document left.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next one's docs. All but the last return the columns of
``documents``. Nulls, empty tables and repeated rows are handled as the
operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontam, mil_quality, simhash, suffix_dedup, trie_bpe
from quarry.llm.queries import bpe_digest, table, vocabulary
from quarry.plans.sizing import materialize
from quarry.session import checkpoint_dir, ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents of ``docs`` outside the held-out fold."""
    ship_package(spark)
    return mil_quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return simhash.keep_one(docs)


def suffixes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return suffix_dedup.cut_texts(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return bpe_digest(trie_bpe.encode_decode(docs, vocabulary("byte_bpe_50k.json")))


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffixes),
    ("decontaminate", decontaminate),
    ("tokenize", tokenize),
]

#: No SQL: a learned classifier, XXH64 fingerprints and BPE are not expressible.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the documents of ``sf_dir``."""
    checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
