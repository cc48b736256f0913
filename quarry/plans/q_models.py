"""Model-backed queries (rows-only: their output depends on a fitted or
pluggable model, so no SQL twin exists): ANN search and recall, offline
and pluggable embeddings, batch completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import embedding as EM
from quarry.operators import inference as M
from quarry.operators import retrieval as R
from quarry.operators import scorers as U
from quarry.operators import vector_index as VI
from quarry.plans.catalog import register
from quarry.plans.sizing import shared_path
from quarry.sources.tables import corpus, doc_vectors, query_vectors, table


def _vectors(spark, sf_dir):
    return doc_vectors(spark, sf_dir).join(corpus(spark, sf_dir).select("doc_id"), "doc_id", "left_semi")


@register("vector_search_ann")
def vector_search_ann(spark, sf_dir):
    """R2: build the index, store it by cell, search the stored one."""
    path = EM.save_ivf(EM.build_ivf(_vectors(spark, sf_dir)), shared_path(spark, "ivf"))
    return EM.vector_search_ann(query_vectors(spark, sf_dir), None, k=10, index=EM.load_ivf(spark, path))


@register("ann_recall")
def ann_recall(spark, sf_dir):
    qv, vec = query_vectors(spark, sf_dir), _vectors(spark, sf_dir)
    idx = EM.build_ivf(vec)
    approx = EM.vector_search_ann(qv, vec, k=10, index=idx)
    exact = R.vector_search(qv, vec, k=10)
    return EM.ann_recall(approx, exact)


@register("embed_corpus")
def embed_corpus(spark, sf_dir):
    e = EM.embed_corpus(corpus(spark, sf_dir))
    return e.select("doc_id", F.size("embedding").alias("dims"), "input_tokens")


@register("embed_remote")
def embed_remote(spark, sf_dir):
    """E1 through the pluggable scorer contract (deterministic fake)."""
    d = corpus(spark, sf_dir).select("doc_id", "text")
    e = U.apply_scorer(d, U.fake_embedder(64), "embedding array<float>, input_tokens int", ["doc_id"])
    return e.select("doc_id", F.size("embedding").alias("dims"), "input_tokens")


@register("batch_complete")
def batch_complete(spark, sf_dir):
    """M2/M3/M4 over user turns through the pluggable client (fake)."""
    conv = table(spark, sf_dir, "conversations").filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("prompt"))
    out = M.batch_complete(conv, "prompt", U.fake_completer("gpt-4o-mini"), base_wait=0.0)
    costed = M.usage_cost(out.withColumn("deployment", F.lit("gpt-4o-mini")))
    return costed.select("conv_id", "turn", "model", "input_tokens", "output_tokens", "total_tokens",
                         "cost_usd", "finish_reason", "error")


@register("vector_search_quantised")
def vector_search_quantised(spark, sf_dir):
    """R2 by residual product codes: build, store, load and search."""
    path = VI.save_quantised(VI.build_quantised(_vectors(spark, sf_dir)), shared_path(spark, "pq"))
    return VI.quantised_search(query_vectors(spark, sf_dir), VI.load_quantised(spark, path), k=10)


@register("quantised_recall")
def quantised_recall(spark, sf_dir):
    """R3 of the quantised index: recall, and the share of exact vectors read."""
    qv, vec = query_vectors(spark, sf_dir), _vectors(spark, sf_dir)
    return VI.recall_and_reads(qv, VI.build_quantised(vec), R.vector_search(qv, vec, k=10), k=10)
