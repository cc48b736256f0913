"""Answer evaluation: judge prompts, judge scoring and parsing, per-case
scores, token F1, similarity, batch summary and metric rows.

Cases are rows (case_id, question, answer, context, ground_truth). The
judge runs on the long (case, metric, prompt) table so a remote judge can
batch calls; the built-in judge is a column expression (JVM side).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.templates import render

METRICS = ("groundedness", "relevance", "coherence", "fluency")
PASS_THRESHOLD = 3.0

# Our own judge instructions (scale 1-5, JSON reply). One pass per row:
# placeholders are {{$name}}, values are never re-substituted.
PROMPTS = {
    "groundedness": (
        "Rate from 1 to 5 how well every statement of the ANSWER is backed by the CONTEXT "
        "(1: invented or contradicting, 5: fully backed).\n"
        "CONTEXT:\n{{$context}}\nQUESTION: {{$question}}\nANSWER: {{$answer}}\n"
        'Reply with JSON only: {"score": <1-5>, "reasoning": "<short>"}'),
    "relevance": (
        "Rate from 1 to 5 how directly the ANSWER addresses the QUESTION "
        "(1: off topic, 5: complete).\n"
        "QUESTION: {{$question}}\nANSWER: {{$answer}}\n"
        'Reply with JSON only: {"score": <1-5>, "reasoning": "<short>"}'),
    "coherence": (
        "Rate from 1 to 5 how logically the ANSWER is organised "
        "(1: impossible to follow, 5: clear and well ordered).\n"
        "QUESTION: {{$question}}\nANSWER: {{$answer}}\n"
        'Reply with JSON only: {"score": <1-5>, "reasoning": "<short>"}'),
    "fluency": (
        "Rate from 1 to 5 the language quality of the ANSWER "
        "(1: barely readable, 5: natural and correct).\n"
        "ANSWER: {{$answer}}\n"
        'Reply with JSON only: {"score": <1-5>, "reasoning": "<short>"}'),
}


def judge_prompts(cases: DataFrame) -> DataFrame:
    """V1: (case_id, metric, prompt), four rows per case in metric order."""
    arr = F.array(*[F.struct(F.lit(i).alias("metric_no"), F.lit(m).alias("metric"),
                             render(PROMPTS[m]).alias("prompt"))
                    for i, m in enumerate(METRICS)])
    return cases.select("case_id", F.inline(arr))


def _ratio(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def offline_judge(cases: DataFrame) -> DataFrame:
    """V2 built-in judge: (case_id, metric, raw) where raw is the judge's
    JSON reply. Word-overlap ratios mapped to 1..5:
      groundedness: share of distinct answer words found in the context
      relevance:    share of distinct question words found in the answer
      coherence:    distinct / total answer words (repetition lowers it)
      fluency:      share of answer words of 2..12 letters
    An empty answer makes the judge fail (reply "nope"), which the parser
    turns into score 0 with an error reasoning.
    """
    aw = T.words("answer")
    staged = cases.select("case_id", aw.alias("aw"), F.array_distinct(aw).alias("ad"),
                          F.array_distinct(T.words("question")).alias("qd"),
                          F.array_distinct(T.words("context")).alias("cd"))
    parts = {
        "groundedness": (F.size(F.array_intersect("ad", "cd")), F.size("ad")),
        "relevance": (F.size(F.array_intersect("qd", "ad")), F.size("qd")),
        "coherence": (F.size("ad"), F.size("aw")),
        "fluency": (F.size(F.filter("aw", lambda w: F.length(w).between(2, 12))), F.size("aw")),
    }
    rows = []
    for i, m in enumerate(METRICS):
        hit, tot = parts[m]
        score = (F.lit(1) + F.round(F.lit(4.0) * _ratio(hit, tot)).cast("int"))
        raw = F.when(F.size("aw") == 0, F.lit("nope")).otherwise(F.concat(
            F.lit('{"score": '), score.cast("string"), F.lit(', "reasoning": "'), F.lit(m),
            F.lit(": "), hit.cast("string"), F.lit(" of "), tot.cast("string"), F.lit('"}')))
        rows.append(F.struct(F.lit(i).alias("metric_no"), F.lit(m).alias("metric"), raw.alias("raw")))
    return staged.select("case_id", F.inline(F.array(*rows)))


def judge_parse(raw: Column | str) -> tuple[Column, Column]:
    """V3: (score DOUBLE, reasoning STRING) from a judge reply.

    Valid replies are JSON objects: the trimmed text must be one object
    and nothing else. score = float(score) (numbers or numeric
    strings; missing -> 0.0; anything else -> 0.0), never clamped; reasoning
    defaults to "". Invalid replies give (0.0, "Evaluation error: ...").
    """
    r = F.col(raw) if isinstance(raw, str) else raw
    t = F.trim(r)
    valid = T.json_object(r)
    sval = F.get_json_object(t, "$.score")
    score = F.when(valid, F.coalesce(sval.try_cast("double"), F.lit(0.0))).otherwise(F.lit(0.0))
    reason = F.when(valid, F.coalesce(F.get_json_object(t, "$.reasoning"), F.lit(""))).otherwise(
        F.concat(F.lit("Evaluation error: invalid judge reply: "), F.left(F.coalesce(r, F.lit("")), F.lit(50))))
    return score, reason


def eval_wide(parsed: DataFrame) -> DataFrame:
    """V4: long (case_id, metric, score, reasoning) -> one row per case with
    the four scores and a reasoning map."""
    return (parsed.groupBy("case_id")
            .pivot("metric", list(METRICS))
            .agg(F.first("score").alias("score"), F.first("reasoning").alias("reasoning"))
            .select("case_id",
                    *[F.coalesce(F.col(f"{m}_score"), F.lit(0.0)).alias(m) for m in METRICS],
                    F.map_from_arrays(F.array(*[F.lit(m) for m in METRICS]),
                                      F.array(*[F.coalesce(F.col(f"{m}_reasoning"), F.lit(""))
                                                for m in METRICS])).alias("reasoning")))


def overall_score(*scores: Column) -> Column:
    """V5: mean of the scores that are > 0; none -> 0.0."""
    arr = F.filter(F.array(*scores), lambda s: s > 0)
    total = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)
    return F.coalesce(F.try_divide(total, F.size(arr).cast("double")), F.lit(0.0))


def token_f1(prediction: Column | str, truth: Column | str) -> Column:
    """V7: F1 over lower-cased whitespace token *sets*; 0.0 when either is
    empty or nothing overlaps."""
    p = F.array_distinct(T.space_tokens(prediction))
    g = F.array_distinct(T.space_tokens(truth))
    inter = F.size(F.array_intersect(p, g)).cast("double")
    prec = F.try_divide(inter, F.size(p).cast("double"))
    rec = F.try_divide(inter, F.size(g).cast("double"))
    f1 = F.try_divide(2.0 * prec * rec, prec + rec)
    return F.when((F.size(p) > 0) & (F.size(g) > 0) & (inter > 0), f1).otherwise(F.lit(0.0))


def set_similarity(a: Column | str, b: Column | str) -> Column:
    """Offline stand-in for embedding similarity: cosine of the two
    distinct-word indicator vectors, |A n B| / sqrt(|A| |B|), in [0, 1]."""
    x = F.array_distinct(T.space_tokens(a))
    y = F.array_distinct(T.space_tokens(b))
    inter = F.size(F.array_intersect(x, y)).cast("double")
    sim = F.try_divide(inter, F.sqrt(F.size(x).cast("double") * F.size(y).cast("double")))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(sim, F.lit(0.0))))


def evaluate(cases: DataFrame, judge: Callable[[DataFrame], DataFrame] | None = None,
             similarity: Callable[[Column, Column], Column] | None = None,
             threshold: float = PASS_THRESHOLD) -> DataFrame:
    """V1-V8: per-case evaluation result rows.

    ``judge(cases) -> (case_id, metric, raw)`` defaults to the offline judge;
    a remote judge plugs in through ``quarry.operators.scorers``.
    similarity and F1 are computed only when ground truth is non-empty.
    """
    raw = (judge or offline_judge)(cases)
    sc, rs = judge_parse("raw")
    parsed = raw.select("case_id", "metric", sc.alias("score"), rs.alias("reasoning"))
    wide = eval_wide(parsed)
    sim = similarity or set_similarity
    gt = F.coalesce(F.col("ground_truth"), F.lit(""))
    has_gt = gt != ""
    base = cases.select("case_id", "question", "answer", "context", "ground_truth")
    out = base.join(wide, "case_id", "left")
    ov = overall_score(*[F.col(m) for m in METRICS])
    return out.select(
        "case_id", "question", "answer", "context", "ground_truth",
        *[F.coalesce(F.col(m), F.lit(0.0)).alias(m) for m in METRICS],
        F.when(has_gt, sim(F.col("answer"), gt)).otherwise(F.lit(0.0)).alias("similarity"),
        F.when(has_gt, token_f1(F.col("answer"), gt)).otherwise(F.lit(0.0)).alias("f1_score"),
        "reasoning",
    ).withColumn("overall_score", overall_score(*[F.col(m) for m in METRICS])) \
     .withColumn("passed", F.col("overall_score") >= F.lit(threshold))


def eval_records(results: DataFrame) -> DataFrame:
    """The 9-field flat record (answer/context/ground truth/reasoning
    dropped)."""
    return results.select("case_id", "question", *METRICS, "similarity", "f1_score",
                          "overall_score", "passed")


def eval_summary(results: DataFrame) -> DataFrame:
    """V9: one row: total, passed, averages of the four metrics (zeros
    included) and of overall, pass_rate; an empty input gives zeros."""
    agg = results.agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum(F.col("passed").cast("long")), F.lit(0)).alias("passed"),
        *[F.coalesce(F.avg(m), F.lit(0.0)).alias(f"avg_{m}") for m in METRICS],
        F.coalesce(F.avg("overall_score"), F.lit(0.0)).alias("avg_overall"),
    )
    return agg.withColumn("pass_rate", F.coalesce(F.try_divide(F.col("passed").cast("double"),
                                                               F.col("total").cast("double")),
                                                  F.lit(0.0)))


def metrics_long(summary: DataFrame, run_date: Column | None = None) -> DataFrame:
    """The six published gauges as (name, value) rows."""
    names = [("rag.groundedness", "avg_groundedness"), ("rag.relevance", "avg_relevance"),
             ("rag.coherence", "avg_coherence"), ("rag.fluency", "avg_fluency"),
             ("rag.overall", "avg_overall"), ("rag.pass_rate", "pass_rate")]
    arr = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("value"))
                    for n, c in names])
    out = summary.select(F.inline(arr))
    if run_date is not None:
        out = out.withColumn("run_date", run_date)
    return out


def write_metrics(metrics: DataFrame, path: str) -> None:
    """S6 sink: append to a parquet metrics table partitioned by run_date."""
    metrics.write.mode("append").partitionBy("run_date").parquet(path)
