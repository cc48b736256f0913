"""Readers for the corpus tables and the standard query frames built on them.

Tables are plain parquet; reading through ``spark.read.parquet`` keeps
column pruning and filter pushdown in the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query set: every ``benchmark`` item as (query_id, query)."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"),
                                                   F.col("text").alias("query"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query vectors: (query_id, embedding) for every benchmark item: the
    components of embeddings row vec_id = item_id in reverse (items without one
    drop), so that a query has the table's distribution and is no row of it."""
    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.reverse("embedding").alias("embedding"))
    return emb.join(search_queries(spark, sf_dir).select("query_id"), "query_id", "left_semi")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as (doc_id, text, lang, source, n_chars)."""
    return table(spark, sf_dir, "documents")


def doc_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors keyed like documents: embeddings.vec_id = documents.doc_id."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def eval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation cases from conversations: each user turn t with an
    assistant reply at t+1 is a case (question = user text, answer = reply,
    context = text of turn t-1 or '', ground_truth = the assistant text at
    t+3 or ''). case_id = "conv_id:turn".

    One shuffle instead of three self-joins: every message is emitted under
    the case keys it serves (as question, answer, context or ground truth)
    and the cases are assembled by one aggregation on (conv_id, case turn),
    a fine-grained key, so one very long conversation still spreads over
    many tasks.
    """
    conv = table(spark, sf_dir, "conversations")
    user, asst = F.col("role") == "user", F.col("role") == "assistant"

    def as_(kind, turn, cond=None):
        s_ = F.struct(turn.alias("t"), F.lit(kind).alias("kind"))
        return s_ if cond is None else F.when(cond, s_)

    roles = F.filter(F.array(as_("question", F.col("turn"), user),
                             as_("answer", F.col("turn") - 1, asst),
                             as_("context", F.col("turn") + 1),
                             as_("ground_truth", F.col("turn") - 3, asst)), lambda x: x.isNotNull())
    keyed = conv.select("conv_id", "text", F.inline(roles))

    def pick(kind):
        return F.max(F.when(F.col("kind") == kind, F.col("text"))).alias(kind)

    cases = keyed.groupBy("conv_id", "t").agg(pick("question"), pick("answer"), pick("context"),
                                              pick("ground_truth"), F.max((F.col("kind") == "question").cast("int")).alias("hq"),
                                              F.max((F.col("kind") == "answer").cast("int")).alias("ha"))
    return cases.filter((F.col("hq") == 1) & (F.col("ha") == 1)).select(
        F.concat_ws(":", "conv_id", "t").alias("case_id"), "question", "answer",
        F.coalesce("context", F.lit("")).alias("context"), F.coalesce("ground_truth", F.lit("")).alias("ground_truth"))


# event_type -> model deployment for usage rows derived from
# events; "error" events map to a deployment missing from the price list.
EVENT_DEPLOYMENT = {
    "click": "gpt-4o",
    "view": "gpt-4o-mini",
    "purchase": "gpt-4-turbo",
    "signup": "text-embedding-3-large",
    "error": "custom-finetune",
}


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model-call usage rows from the events table (see ``usage_rows``)."""
    return usage_rows(table(spark, sf_dir, "events"))


def usage_rows(ev: DataFrame) -> DataFrame:
    """Model-call usage rows from events (batch or stream): (event_id, ts,
    user_id, deployment, input_tokens = round(value * 100), output_tokens =
    props.k * 10)."""
    m = F.create_map(*[x for k, v in EVENT_DEPLOYMENT.items() for x in (F.lit(k), F.lit(v))])
    return ev.select("event_id", "ts", "user_id",
                     F.coalesce(F.try_element_at(m, F.col("event_type")), F.col("event_type")).alias("deployment"),
                     F.round(F.col("value") * 100).cast("int").alias("input_tokens"),
                     (F.get_json_object("props", "$.k").cast("int") * 10).alias("output_tokens"))
