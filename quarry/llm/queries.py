"""Registered queries of this package: ``opN_<name>`` applies operator N with
production parameters to its whole table and derives the digest columns."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import checkpoint_dir, ship_package

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            checkpoint_dir(spark)
            ship_package(spark)
            return fn(spark, sf_dir)

        REGISTRY[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        return run
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file (installed beside the tokenizer libraries)."""
    import public_tokenizers
    return public_tokenizers.path(name)


@register("op6_simhash")
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import simhash
    dup = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return dup.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register("op8_bpe")
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import trie_bpe
    out = trie_bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return bpe_digest(out)


def bpe_digest(out: DataFrame) -> DataFrame:
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@register("op10_jump_shards")
def op10_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import jump_shard
    out = jump_shard.assign_shards(table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@register("op2_decontamination")
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import decontam
    return decontam.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op3_license_scan")
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import license_scan
    out = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    return out.drop("spans")


@register("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import mil_quality
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = mil_quality.fit(docs, table(spark, sf_dir, "labels"))
    out = mil_quality.score(docs, model)
    return out.select("doc_id", mil_quality.held_out().alias("held_out"), "score",
                      F.when(F.col("score") >= mil_quality.THRESHOLD, 1).otherwise(0).alias("predicted"))


@register("op4_fingerprints")
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import fingerprints
    out = fingerprints.compare_with_next(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
                      "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@register("op9_warc")
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import warc
    out = warc.archive_pages(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


@register("op5_lattice_lm")
def op5_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import lattice_lm
    return lattice_lm.score_texts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@register("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import suffix_dedup
    out = suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


@register("op11_nn_descent")
def op11_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import nn_descent
    items = table(spark, sf_dir, "embeddings")
    return nn_descent.neighbours(items, items.filter(F.col("vec_id") % 20 == 0), k=20)


@register("op12_hard_negatives", """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same,
         CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
 AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 5
""")
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import bond
    items = table(spark, sf_dir, "embeddings")
    flipped = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return bond.mine(items.withColumn("label", flipped), F.col("id") % 100 == 0)


@register("op13_importance")
def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import importance
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
