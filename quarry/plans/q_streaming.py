"""Streaming queries: each runs a Structured Streaming job over a file
stream of the given tables (AvailableNow) and returns its sink. The oracle
is the batch equivalent; for append-mode windows only windows closed by the
final watermark (max event time - delay) are emitted, so the SQL keeps
exactly those."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import evaluation as V
from quarry.plans import q_evaluation as QE
from quarry.plans import q_inference as QI
from quarry.plans import q_safety as QS
from quarry.plans import q_search as QR
from quarry.plans.catalog import ORACLE, register
from quarry.plans.sizing import write_shared
from quarry.sources.tables import eval_cases, table, usage_rows
from quarry.streaming import drift as G
from quarry.streaming import jobs as J

_FMT = "yyyy-MM-dd HH:mm:ss"
_SFMT = "'%Y-%m-%d %H:%M:%S'"


@register("stream_moderation", sql=f"""
WITH s AS (
  SELECT doc_id, {QS._sev_cols_sql('toks')}, {QS._attack_sql('text')} AS jailbreak_detected
  FROM (SELECT doc_id, text, {QS.Q.words('text')} AS toks FROM documents))
SELECT doc_id, jailbreak_detected, hate, self_harm, sexual, violence,
       (hate = 0 AND self_harm = 0 AND sexual = 0 AND violence = 0 AND NOT jailbreak_detected) AS is_safe
FROM s
""")
def stream_moderation(spark, sf_dir):
    out = J.run_available(J.moderation(J.file_stream(spark, sf_dir, "documents.parquet")), "moderation")
    return out.select("doc_id", "jailbreak_detected", "hate", "self_harm", "sexual", "violence", "is_safe")


def _usage_stream(spark, sf_dir):
    return usage_rows(J.file_stream(spark, sf_dir, "events.parquet"))


_WM = "mx AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM costed)"


@register("stream_usage_tumbling", sql=f"""
WITH {QI.USAGE_SQL}, {_WM}
SELECT strftime(date_trunc('hour', ts), {_SFMT}) AS window_start,
       strftime(date_trunc('hour', ts) + INTERVAL 1 HOUR, {_SFMT}) AS window_end,
       count(*) AS calls, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(sum(cost_usd), 8) AS cost_usd
FROM costed, mx GROUP BY date_trunc('hour', ts), wm
HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= wm
""")
def stream_usage_tumbling(spark, sf_dir):
    out = J.run_available(J.usage_windows(_usage_stream(spark, sf_dir), "tumbling"), "usage-tumbling")
    return out.select(F.date_format("w.start", _FMT).alias("window_start"),
                      F.date_format("w.end", _FMT).alias("window_end"), "calls", "total_tokens",
                      F.round("cost_usd", 8).alias("cost_usd"))


@register("stream_usage_sliding", sql=f"""
WITH {QI.USAGE_SQL}, {_WM},
x AS (SELECT date_trunc('hour', ts) - to_hours(CAST(i AS BIGINT)) AS ws, total_tokens, cost_usd
      FROM costed CROSS JOIN range(24) t(i))
SELECT strftime(ws, {_SFMT}) AS window_start, strftime(ws + INTERVAL 24 HOUR, {_SFMT}) AS window_end,
       count(*) AS calls, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(sum(cost_usd), 8) AS cost_usd
FROM x, mx GROUP BY ws, wm HAVING ws + INTERVAL 24 HOUR <= wm
""")
def stream_usage_sliding(spark, sf_dir):
    out = J.run_available(J.usage_windows(_usage_stream(spark, sf_dir), "sliding"), "usage-sliding")
    return out.select(F.date_format("w.start", _FMT).alias("window_start"),
                      F.date_format("w.end", _FMT).alias("window_end"), "calls", "total_tokens",
                      F.round("cost_usd", 8).alias("cost_usd"))


@register("stream_usage_session", sql=f"""
WITH {QI.USAGE_SQL}, {_WM},
s AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
                       OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE
                     THEN 1 ELSE 0 END AS brk FROM costed),
g AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM s)
SELECT user_id, strftime(min(ts), {_SFMT}) AS window_start,
       strftime(max(ts) + INTERVAL 30 MINUTE, {_SFMT}) AS window_end,
       count(*) AS calls, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(sum(cost_usd), 8) AS cost_usd
FROM g, mx GROUP BY user_id, sid, wm HAVING max(ts) + INTERVAL 30 MINUTE <= wm
""")
def stream_usage_session(spark, sf_dir):
    out = J.run_available(J.usage_windows(_usage_stream(spark, sf_dir), "session"), "usage-session")
    return out.select("user_id", F.date_format("w.start", _FMT).alias("window_start"),
                      F.date_format("w.end", _FMT).alias("window_end"), "calls", "total_tokens",
                      F.round("cost_usd", 8).alias("cost_usd"))


@register("stream_deltas", sql=ORACLE["assemble_deltas"])
def stream_deltas(spark, sf_dir):
    """Assistant turns split into deltas plus one final marker per
    request, staged as a parquet stream and assembled with per-request
    state."""
    conv = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    rid = F.concat_ws(":", "conv_id", "turn").alias("request_id")
    pieces = F.regexp_extract_all("text", F.lit(QI._DELTA_RE), 0)
    d = conv.select(rid, F.posexplode(pieces).alias("seq", "delta"))
    d = d.withColumn("is_final", F.lit(False))
    fin = conv.select(rid, F.size(pieces).alias("seq"), F.lit(None).cast("string").alias("delta"),
                      F.lit(True).alias("is_final")).filter("seq > 0")
    # event time: the conversations stand a minute apart
    at = F.timestamp_seconds(F.lit(1704067200) + F.substring_index("request_id", ":", 1).cast("bigint") * 60).alias("ts")
    src = J.file_stream(spark, write_shared(d.unionByName(fin).select("*", at), "deltas"))
    out = J.run_available(J.assemble_stream(src, timeout="1 hour"), "deltas")
    return out.select("request_id", F.md5("content").alias("content_md5"), "n_deltas")


@register("stream_upsert", sql=ORACLE["upsert_documents"])
def stream_upsert(spark, sf_dir):
    """T4: the S3 update batch arriving as a stream, merged by foreachBatch."""
    src = J.file_stream(spark, write_shared(QR._updates(spark, sf_dir), "updates"))
    path = J.upsert_stream(src, QR.search_docs(spark, sf_dir), n_buckets=16)
    return spark.read.parquet(path).select("id", "version", "category")


_EVAL_TS_SQL = f"""
WITH {QE.RESULTS_SQL},
r AS (SELECT res2.*, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(split_part(case_id, ':', 1) AS BIGINT)) AS ts FROM res2),
mx AS (SELECT max(ts) - INTERVAL 10 MINUTE AS wm FROM r)
SELECT strftime(time_bucket(INTERVAL 10 MINUTE, ts), {_SFMT}) AS window_start, count(*) AS total,
       CAST(sum(CAST(overall_score >= 3.0 AS BIGINT)) AS BIGINT) AS passed, round(avg(overall_score), 6) AS avg_overall
FROM r, mx GROUP BY time_bucket(INTERVAL 10 MINUTE, ts), wm
HAVING time_bucket(INTERVAL 10 MINUTE, ts) + INTERVAL 10 MINUTE <= wm
"""


@register("stream_pass_rate", sql=_EVAL_TS_SQL)
def stream_pass_rate(spark, sf_dir):
    """T5: evaluation results stamped with an event time derived from the
    conversation id (one minute per conversation), rolled up per 10
    minutes with a 10-minute watermark delay."""
    res = V.evaluate(eval_cases(spark, sf_dir)).select(
        "case_id", "overall_score", "passed",
        F.timestamp_seconds(F.lit(1704067200) + F.substring_index("case_id", ":", 1).cast("bigint") * 60).alias("ts"))
    src = J.file_stream(spark, write_shared(res, "eval-results"))
    out = J.run_available(J.pass_rate_windows(src, delay="10 minutes", size="10 minutes"), "pass-rate")
    return out.select(F.date_format("w.start", _FMT).alias("window_start"), "total", "passed",
                      F.round("avg_overall", 6).alias("avg_overall"))


@register("stream_drift")
def stream_drift(spark, sf_dir):
    """P10 and P11 as a stream (rows-only: sketches are not exact): hourly sketches
    of each feature leave the stream as their windows close; merged by day, they
    are held against the sketch of the first week."""
    cut = F.lit("2024-01-08").cast("timestamp_ntz")
    features = {"value": F.col("value"), "k": F.get_json_object("props", "$.k")}
    live = J.file_stream(spark, sf_dir, "events.parquet").filter(F.col("ts") >= cut)
    closed = J.run_available(G.window_sketches(G.feature_values(live, features, ["ts"])), "drift")
    past = table(spark, sf_dir, "events").filter(F.col("ts") < cut)
    days = G.merge_sketches(closed.withColumn("day", F.date_format("w.start", "yyyy-MM-dd")), ["day", "feature"])
    return G.sketch_drift(days, G.reference_sketches(G.feature_values(past, features, [])))
