"""Answer-evaluation queries over cases derived from conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.templates import render_sql
from quarry.operators import evaluation as V
from quarry.plans import sqlfrag as Q
from quarry.plans.catalog import register
from quarry.sources.tables import eval_cases

CASES_SQL = """
cases AS (
  SELECT CAST(u.conv_id AS VARCHAR) || ':' || CAST(u.turn AS VARCHAR) AS case_id, u.text AS question, a.text AS answer,
         coalesce(p.text, '') AS context, coalesce(g.text, '') AS ground_truth
  FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  LEFT JOIN conversations p ON p.conv_id = u.conv_id AND p.turn = u.turn - 1
  LEFT JOIN conversations g ON g.conv_id = u.conv_id AND g.turn = u.turn + 3 AND g.role = 'assistant'
  WHERE u.role = 'user')
"""

_PARTS = {
    "groundedness": ("len(list_intersect(ad, cd))", "len(ad)"),
    "relevance": ("len(list_intersect(qd, ad))", "len(qd)"),
    "coherence": ("len(ad)", "len(aw)"),
    "fluency": ("len(list_filter(aw, lambda w: length(w) BETWEEN 2 AND 12))", "len(aw)"),
}


def _judge_sql() -> str:
    rows = []
    for i, m in enumerate(V.METRICS):
        hit, tot = _PARTS[m]
        score = f"(1 + CAST(round(4.0 * {Q.ratio(hit, tot)}) AS INTEGER))"
        raw = (f"CASE WHEN len(aw) = 0 THEN 'nope' ELSE '{{\"score\": ' || CAST({score} AS VARCHAR) || "
               f"', \"reasoning\": \"{m}: ' || CAST({hit} AS VARCHAR) || ' of ' || CAST({tot} AS VARCHAR) || '\"}}' END")
        rows.append(f"SELECT case_id, {i} AS metric_no, '{m}' AS metric, {raw} AS raw FROM jt")
    return f"""
jt AS (SELECT case_id, aw, list_distinct(aw) AS ad, list_distinct({Q.words('question')}) AS qd,
              list_distinct({Q.words('context')}) AS cd
       FROM (SELECT *, {Q.words('answer')} AS aw FROM cases)),
judge AS ({' UNION ALL '.join(rows)})
"""


PARSE_SQL = """
parsed AS (
  SELECT case_id, metric,
         CASE WHEN trim(raw) LIKE '{%}' AND json_valid(trim(raw))
              THEN coalesce(TRY_CAST(json_extract_string(trim(raw), '$.score') AS DOUBLE), 0.0)
              ELSE 0.0 END AS score,
         CASE WHEN trim(raw) LIKE '{%}' AND json_valid(trim(raw))
              THEN coalesce(json_extract_string(trim(raw), '$.reasoning'), '')
              ELSE 'Evaluation error: invalid judge reply: ' || left(coalesce(raw, ''), 50) END AS reasoning
  FROM judge)
"""


def _sim_sql(a: str, b: str) -> str:
    x, y = f"list_distinct({Q.space_tokens(a)})", f"list_distinct({Q.space_tokens(b)})"
    inter = f"len(list_intersect({x}, {y}))"
    return (f"greatest(0.0, least(1.0, coalesce(CAST({inter} AS DOUBLE) / "
            f"NULLIF(sqrt(CAST(len({x}) AS DOUBLE) * len({y})), 0), 0.0)))")


def _f1_sql(a: str, b: str) -> str:
    p, g = f"list_distinct({Q.space_tokens(a)})", f"list_distinct({Q.space_tokens(b)})"
    inter = f"CAST(len(list_intersect({p}, {g})) AS DOUBLE)"
    prec, rec = f"({inter} / NULLIF(len({p}), 0))", f"({inter} / NULLIF(len({g}), 0))"
    return (f"CASE WHEN len({p}) > 0 AND len({g}) > 0 AND {inter} > 0 "
            f"THEN 2.0 * {prec} * {rec} / ({prec} + {rec}) ELSE 0.0 END")


RESULTS_SQL = f"""
{CASES_SQL},
{_judge_sql()},
{PARSE_SQL},
wide AS (
  SELECT case_id,
         {', '.join(f"coalesce(max(score) FILTER (WHERE metric = '{m}'), 0.0) AS {m}" for m in V.METRICS)}
  FROM parsed GROUP BY case_id),
res AS (
  SELECT c.case_id, c.question,
         {', '.join(f'coalesce(w.{m}, 0.0) AS {m}' for m in V.METRICS)},
         CASE WHEN c.ground_truth <> '' THEN {_sim_sql('c.answer', 'c.ground_truth')} ELSE 0.0 END AS similarity,
         CASE WHEN c.ground_truth <> '' THEN {_f1_sql('c.answer', 'c.ground_truth')} ELSE 0.0 END AS f1_score
  FROM cases c LEFT JOIN wide w USING (case_id)),
res2 AS (
  SELECT *, coalesce((CASE WHEN groundedness > 0 THEN groundedness ELSE 0 END
                      + CASE WHEN relevance > 0 THEN relevance ELSE 0 END
                      + CASE WHEN coherence > 0 THEN coherence ELSE 0 END
                      + CASE WHEN fluency > 0 THEN fluency ELSE 0 END)
                     / NULLIF((groundedness > 0)::INT + (relevance > 0)::INT + (coherence > 0)::INT
                              + (fluency > 0)::INT, 0), 0.0) AS overall_score
  FROM res)
"""


def _results(spark, sf_dir):
    return V.evaluate(eval_cases(spark, sf_dir))


def _r6(c):
    return F.round(F.col(c), 6).alias(c)


@register("judge_prompts", sql=f"""
WITH {CASES_SQL}
SELECT case_id, metric_no, metric, md5(prompt) AS prompt_md5, length(prompt) AS prompt_chars FROM (
  {' UNION ALL '.join(
    f"SELECT case_id, {i} AS metric_no, '{m}' AS metric, "
    + render_sql(V.PROMPTS[m])
    + " AS prompt FROM cases" for i, m in enumerate(V.METRICS))})
""")
def judge_prompts(spark, sf_dir):
    p = V.judge_prompts(eval_cases(spark, sf_dir))
    return p.select("case_id", "metric_no", "metric", F.md5("prompt").alias("prompt_md5"),
                    F.length("prompt").cast("long").alias("prompt_chars"))


@register("judge_parse", sql=f"""
WITH {CASES_SQL}, {_judge_sql()}, {PARSE_SQL}
SELECT case_id, metric, score, reasoning FROM parsed
""")
def judge_parse(spark, sf_dir):
    raw = V.offline_judge(eval_cases(spark, sf_dir))
    s, r = V.judge_parse("raw")
    return raw.select("case_id", "metric", s.alias("score"), r.alias("reasoning"))


@register("eval_records", sql=f"""
WITH {RESULTS_SQL}
SELECT case_id, question, {', '.join(f'round({m}, 6) AS {m}' for m in V.METRICS)},
       round(similarity, 6) AS similarity, round(f1_score, 6) AS f1_score,
       round(overall_score, 6) AS overall_score, overall_score >= 3.0 AS passed
FROM res2
""")
def eval_records(spark, sf_dir):
    r = V.eval_records(_results(spark, sf_dir))
    return r.select("case_id", "question", *[_r6(m) for m in V.METRICS], _r6("similarity"),
                    _r6("f1_score"), _r6("overall_score"), "passed")


@register("token_f1", sql=f"""
WITH {CASES_SQL}
SELECT case_id, round(CASE WHEN ground_truth <> '' THEN {_f1_sql('answer', 'ground_truth')} ELSE 0.0 END, 6) AS f1_score
FROM cases
""")
def token_f1(spark, sf_dir):
    c = eval_cases(spark, sf_dir)
    f1 = F.when(F.col("ground_truth") != "", V.token_f1("answer", "ground_truth")).otherwise(F.lit(0.0))
    return c.select("case_id", F.round(f1, 6).alias("f1_score"))


_SUMMARY_SQL = f"""
WITH {RESULTS_SQL},
s AS (
  SELECT count(*) AS total, CAST(coalesce(sum(CAST(overall_score >= 3.0 AS BIGINT)), 0) AS BIGINT) AS passed,
         {', '.join(f'coalesce(avg({m}), 0.0) AS avg_{m}' for m in V.METRICS)},
         coalesce(avg(overall_score), 0.0) AS avg_overall
  FROM res2)
"""


@register("eval_summary", sql=f"""
{_SUMMARY_SQL}
SELECT total, passed, {', '.join(f'round(avg_{m}, 6) AS avg_{m}' for m in V.METRICS)},
       round(avg_overall, 6) AS avg_overall,
       round(coalesce(CAST(passed AS DOUBLE) / NULLIF(total, 0), 0.0), 6) AS pass_rate
FROM s
""")
def eval_summary(spark, sf_dir):
    s = V.eval_summary(_results(spark, sf_dir))
    return s.select("total", "passed", *[_r6(f"avg_{m}") for m in V.METRICS], _r6("avg_overall"),
                    _r6("pass_rate"))


@register("metrics_long", sql=f"""
{_SUMMARY_SQL},
w AS (SELECT *, coalesce(CAST(passed AS DOUBLE) / NULLIF(total, 0), 0.0) AS pass_rate FROM s)
SELECT name, round(value, 6) AS value FROM (
  SELECT 'rag.groundedness' AS name, avg_groundedness AS value FROM w UNION ALL
  SELECT 'rag.relevance', avg_relevance FROM w UNION ALL
  SELECT 'rag.coherence', avg_coherence FROM w UNION ALL
  SELECT 'rag.fluency', avg_fluency FROM w UNION ALL
  SELECT 'rag.overall', avg_overall FROM w UNION ALL
  SELECT 'rag.pass_rate', pass_rate FROM w)
""")
def metrics_long(spark, sf_dir):
    m = V.metrics_long(V.eval_summary(_results(spark, sf_dir)))
    return m.select("name", _r6("value"))


@register("judge_scores", sql=f"""
WITH {CASES_SQL}, {_judge_sql()}
SELECT case_id, metric_no, metric, raw FROM judge
""")
def judge_scores(spark, sf_dir):
    """V2: the judge's raw replies, one per (case, metric)."""
    return V.offline_judge(eval_cases(spark, sf_dir))


@register("eval_wide", sql=f"""
WITH {RESULTS_SQL}
SELECT case_id, {', '.join(f'round({m}, 6) AS {m}' for m in V.METRICS)} FROM res
""")
def eval_wide(spark, sf_dir):
    """V4: long judge scores pivoted to one row per case."""
    raw = V.offline_judge(eval_cases(spark, sf_dir))
    s, r = V.judge_parse("raw")
    wide = V.eval_wide(raw.select("case_id", "metric", s.alias("score"), r.alias("reasoning")))
    return wide.select("case_id", *[_r6(m) for m in V.METRICS])


@register("overall_score", sql=f"""
WITH {RESULTS_SQL}
SELECT case_id, round(overall_score, 6) AS overall_score, overall_score >= 3.0 AS passed FROM res2
""")
def overall_score(spark, sf_dir):
    """V5/V6: mean of the positive scores; passed at >= 3.0."""
    return _results(spark, sf_dir).select("case_id", _r6("overall_score"), "passed")


@register("ground_truth_metrics", sql=f"""
WITH {RESULTS_SQL}
SELECT case_id, round(similarity, 6) AS similarity, round(f1_score, 6) AS f1_score FROM res
""")
def ground_truth_metrics(spark, sf_dir):
    """V8: similarity and F1 only where ground truth is non-empty."""
    return _results(spark, sf_dir).select("case_id", _r6("similarity"), _r6("f1_score"))
