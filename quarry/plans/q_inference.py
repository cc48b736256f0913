"""Model-call table queries: messages, usage and cost, JSON replies,
streamed deltas, running history, templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.templates import render, render_sql
from quarry.operators import inference as M
from quarry.plans.catalog import register
from quarry.sources.tables import EVENT_DEPLOYMENT, table, usage_events

_DEP_CASE = "CASE event_type " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_DEPLOYMENT.items()) + " ELSE event_type END"

USAGE_SQL = f"""
usage AS (
  SELECT event_id, ts, user_id, {_DEP_CASE} AS deployment,
         CAST(round(value * 100) AS INTEGER) AS input_tokens,
         CAST(json_extract_string(props, '$.k') AS INTEGER) * 10 AS output_tokens
  FROM events),
prices AS (
  SELECT deployment, CAST(i AS DOUBLE) AS input_per_1k, CAST(o AS DOUBLE) AS output_per_1k
  FROM (VALUES {', '.join(f"('{d}', {i}, {o})" for d, i, o in M.TOKEN_PRICES)}) v(deployment, i, o)),
costed AS (
  SELECT u.*, coalesce(u.input_tokens, 0) + coalesce(u.output_tokens, 0) AS total_tokens,
         CAST(coalesce(u.input_tokens, 0) AS DOUBLE) / 1000.0 * coalesce(p.input_per_1k, 0.0)
         + CAST(coalesce(u.output_tokens, 0) AS DOUBLE) / 1000.0 * coalesce(p.output_per_1k, 0.0) AS cost_usd,
         p.input_per_1k IS NOT NULL AS priced
  FROM usage u LEFT JOIN prices p USING (deployment))
"""


@register("usage_cost", sql=f"""
WITH {USAGE_SQL}
SELECT event_id, user_id, deployment, input_tokens, output_tokens, total_tokens,
       round(cost_usd, 10) AS cost_usd, priced
FROM costed
""")
def usage_cost(spark, sf_dir):
    c = M.usage_cost(usage_events(spark, sf_dir))
    return c.select("event_id", "user_id", "deployment", "input_tokens", "output_tokens",
                    "total_tokens", F.round("cost_usd", 10).alias("cost_usd"), "priced")


@register("usage_rollup", sql=f"""
WITH {USAGE_SQL}
SELECT deployment, strftime(date_trunc('month', ts), '%Y-%m') AS month,
       strftime(date_trunc('day', ts), '%Y-%m-%d') AS day,
       GROUPING(deployment, date_trunc('month', ts), date_trunc('day', ts)) AS grouping_id,
       count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
       CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
       CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(sum(cost_usd), 8) AS cost_usd
FROM costed
GROUP BY ROLLUP (deployment, date_trunc('month', ts), date_trunc('day', ts))
""")
def usage_rollup(spark, sf_dir):
    r = M.usage_rollup(M.usage_cost(usage_events(spark, sf_dir)))
    return r.select("deployment", F.date_format("month", "yyyy-MM").alias("month"),
                    F.date_format("day", "yyyy-MM-dd").alias("day"), "grouping_id", "calls",
                    "input_tokens", "output_tokens", "total_tokens",
                    F.round("cost_usd", 8).alias("cost_usd"))


@register("json_mode", sql="""
SELECT event_id,
       CASE WHEN trim(props) LIKE '{%}' AND json_valid(trim(props))
            THEN TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k,
       CASE WHEN NOT (trim(props) LIKE '{%}' AND json_valid(trim(props))) OR props IS NULL
            THEN 'Model returned invalid JSON: ' || left(coalesce(props, ''), 200) END AS error
FROM events
""")
def json_mode(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "props")
    out = M.json_mode(ev, "props", "k INT")
    return out.select("event_id", F.col("parsed.k").alias("k"), "error")


@register("chat_messages", sql="""
WITH sys AS (SELECT conv_id, text AS system FROM conversations WHERE role = 'system' AND turn = 0),
u AS (SELECT c.conv_id, c.turn, c.text, s.system FROM conversations c LEFT JOIN sys s USING (conv_id)
      WHERE c.role = 'user'),
m AS (
  SELECT conv_id, turn, 0 AS msg_no, 'system' AS role, system AS content FROM u WHERE coalesce(system, '') <> ''
  UNION ALL
  SELECT conv_id, turn, CASE WHEN coalesce(system, '') <> '' THEN 1 ELSE 0 END, 'user', text FROM u)
SELECT conv_id, turn, msg_no, role, md5(content) AS content_md5 FROM m
""")
def chat_messages(spark, sf_dir):
    """M1 per user turn: the conversation's system text (turn-0 system row,
    if any) then the user text."""
    conv = table(spark, sf_dir, "conversations")
    sys_ = conv.filter((F.col("role") == "system") & (F.col("turn") == 0)).select(
        "conv_id", F.col("text").alias("system"))
    u = conv.filter(F.col("role") == "user").join(sys_, "conv_id", "left")
    msgs = u.select("conv_id", "turn", F.posexplode(M.chat_messages(F.col("text"), F.col("system")))
                    .alias("msg_no", "m"))
    return msgs.select("conv_id", "turn", "msg_no", F.col("m.role").alias("role"),
                       F.md5(F.col("m.content")).alias("content_md5"))


# A token with the white space after it; white space at the start of a text is a piece too.
_DELTA_RE = r"\S+\s*|\s+"


@register("assemble_deltas", sql=f"""
WITH d AS (
  SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS request_id, UNNEST(regexp_extract_all(text, '{_DELTA_RE}', 0)) AS delta,
         UNNEST(range(0, len(regexp_extract_all(text, '{_DELTA_RE}', 0)))) AS seq
  FROM conversations WHERE role = 'assistant')
SELECT request_id, md5(string_agg(delta, '' ORDER BY seq)) AS content_md5, count(*) AS n_deltas
FROM d WHERE delta IS NOT NULL AND delta <> '' GROUP BY request_id
""")
def assemble_deltas(spark, sf_dir):
    """M9 over assistant turns split into streamed deltas (each token with
    its trailing whitespace), then reassembled in order."""
    conv = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    d = conv.select(F.concat_ws(":", "conv_id", "turn").alias("request_id"),
                    F.posexplode(F.regexp_extract_all("text", F.lit(_DELTA_RE), 0)).alias("seq", "delta"))
    out = M.assemble_deltas(d)
    return out.select("request_id", F.md5("content").alias("content_md5"),
                      F.col("n_deltas").cast("long").alias("n_deltas"))


@register("conversation_history", sql="""
SELECT conv_id, turn, role,
       count(*) OVER w AS history_messages, CAST(sum(length(text)) OVER w AS BIGINT) AS history_chars
FROM conversations WHERE role <> 'system' OR turn = 0
WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def conversation_history(spark, sf_dir):
    return M.conversation_history(table(spark, sf_dir, "conversations"))


@register("tool_calls", sql="""
SELECT l_orderkey AS request_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, lower(l_returnflag),
                                                            CAST(l_partkey AS VARCHAR) || '}') - 1 AS call_no,
       'call_' || CAST(l_linenumber AS VARCHAR) AS id, 'ship_' || lower(l_returnflag) AS function,
       '{"partkey":' || CAST(l_partkey AS VARCHAR) || '}' AS arguments
FROM lineitem
""")
def tool_calls(spark, sf_dir):
    """M7 over replies built from orders: one call per line, in line order
    (an order has a handful of lines, so its list is small)."""
    call = F.struct(F.col("l_linenumber").alias("no"),
                    F.concat(F.lit("call_"), F.col("l_linenumber").cast("string")).alias("id"),
                    F.concat(F.lit("ship_"), F.lower("l_returnflag")).alias("function"),
                    F.to_json(F.struct(F.col("l_partkey").alias("partkey"))).alias("arguments"))
    replies = (table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("request_id"))
               .agg(F.array_sort(F.collect_list(call)).alias("tool_calls")))
    out = M.tool_calls(replies, ["request_id"])
    return out.withColumn("call_no", F.col("call_no").cast("long"))


TEMPLATE = "[{{$role}} #{{$turn}} of conversation {{$conv_id}}] {{$text}}"


@register("render_template", sql=f"""
SELECT conv_id, turn, md5({render_sql(TEMPLATE)}) AS prompt_md5, length({render_sql(TEMPLATE)}) AS prompt_chars
FROM conversations
""")
def render_template(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    p = render(TEMPLATE)
    return conv.select("conv_id", "turn", F.md5(p).alias("prompt_md5"), F.length(p).cast("long").alias("prompt_chars"))
