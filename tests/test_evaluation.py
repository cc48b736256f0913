
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import vectors as VX
from quarry.operators import evaluation as V


def test_judge_parse_cases(spark):
    raws = ['{"score": 4, "reasoning": "ok"}', '{"score": 4.5}', '{"score": "5"}', '{"score": 7}',
            '{"score": 0}', '{"score": true}', '{"score": null}', '{"reasoning": "r"}', "[1]", "nope",
            '{"score":4} x', None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    s, r = V.judge_parse("raw")
    out = [(x.s, x.r) for x in df.select("i", s.alias("s"), r.alias("r")).orderBy("i").collect()]
    scores = [o[0] for o in out]
    assert scores == [4.0, 4.5, 5.0, 7.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    assert out[0][1] == "ok" and out[1][1] == "" and out[7][1] == "r"
    for i in (8, 9, 10, 11):
        assert out[i][1].startswith("Evaluation error:")


def _py_overall(xs):
    pos = [x for x in xs if x > 0]
    return sum(pos) / len(pos) if pos else 0.0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from([0.0, 1.0, 2.5, 3.0, 4.0, 5.0]), min_size=4, max_size=4))
def test_overall_score_matches_python(spark, xs):
    df = spark.createDataFrame([tuple(xs)], "a double, b double, c double, d double")
    got = df.select(V.overall_score(*[F.col(c) for c in "abcd"]).alias("o")).collect()[0].o
    assert got == pytest.approx(_py_overall(xs))


def _py_f1(p, g):
    pt, gt = set(p.lower().split()), set(g.lower().split())
    if not pt or not gt:
        return 0.0
    inter = pt & gt
    if not inter:
        return 0.0
    pr, rc = len(inter) / len(pt), len(inter) / len(gt)
    return 2 * pr * rc / (pr + rc)


words = st.lists(st.sampled_from(["a", "B", "b", "cat", "Cat!", "dog", "x"]), max_size=6).map(" ".join)


@settings(max_examples=30, deadline=None)
@given(words, words)
def test_token_f1_matches_python(spark, p, g):
    df = spark.createDataFrame([(p, g)], "p string, g string")
    got = df.select(V.token_f1("p", "g").alias("f")).collect()[0].f
    assert got == pytest.approx(_py_f1(p, g))


def test_cosine_clamped_edge_cases(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]),
                                ([1.0, 2.0], [1.0, 2.0, 3.0]), ([1.0, 1.0], [2.0, 2.0])],
                               "a array<double>, b array<double>")
    out = [r.c for r in df.select(VX.cosine_clamped("a", "b").alias("c")).collect()]
    assert out[0] == 0.0 and out[1] == 0.0 and out[2] == 0.0 and out[3] == pytest.approx(1.0)


def test_evaluate_summary_and_metrics(spark):
    cases = spark.createDataFrame([
        (1, "what is the refund window", "the refund window is 30 days", "refund window is 30 days", "30 days"),
        (2, "q", "", "ctx", ""),  # empty answer: judge fails -> zeros
        (3, "{braces}", "answer with {braces}", "answer with {braces}", "")],
        "case_id long, question string, answer string, context string, ground_truth string")
    res = V.evaluate(cases)
    rows = {r.case_id: r for r in res.collect()}
    assert rows[2].overall_score == 0.0 and not rows[2].passed
    assert rows[2].reasoning["fluency"].startswith("Evaluation error")
    assert rows[1].f1_score == pytest.approx(_py_f1("the refund window is 30 days", "30 days"))
    assert rows[3].similarity == 0.0 and rows[3].f1_score == 0.0  # no ground truth
    s = V.eval_summary(res).collect()[0]
    assert s.total == 3
    assert s.avg_fluency == pytest.approx(sum(r.fluency for r in rows.values()) / 3)  # zeros included
    assert s.pass_rate == pytest.approx(s.passed / 3)
    m = V.metrics_long(V.eval_summary(res)).collect()
    assert [x.name for x in m] == ["rag.groundedness", "rag.relevance", "rag.coherence", "rag.fluency",
                                   "rag.overall", "rag.pass_rate"]
    assert len(V.eval_records(res).columns) == 10  # case_id + the 9 record fields


def test_eval_summary_empty(spark):
    empty = spark.createDataFrame([], "case_id long, groundedness double, relevance double, coherence double, "
                                      "fluency double, overall_score double, passed boolean")
    s = V.eval_summary(empty).collect()[0]
    assert s.total == 0 and s.passed == 0 and s.pass_rate == 0.0 and s.avg_overall == 0.0


def test_judge_prompts_four_per_case(spark):
    cases = spark.createDataFrame([(1, "Q", "A", "C", "")],
                                  "case_id long, question string, answer string, context string, ground_truth string")
    p = V.judge_prompts(cases).orderBy("metric_no").collect()
    assert [r.metric for r in p] == list(V.METRICS)
    assert "CONTEXT:\nC" in p[0].prompt and "CONTEXT" not in p[3].prompt


def test_metrics_sink_partitioned_append(spark, tmp_path):
    summary = spark.createDataFrame([(2, 1, 4.0, 3.0, 5.0, 4.0, 4.0, 0.5)],
                                    "total long, passed long, avg_groundedness double, avg_relevance double, "
                                    "avg_coherence double, avg_fluency double, avg_overall double, pass_rate double")
    m = V.metrics_long(summary, run_date=F.lit("2024-01-02"))
    V.write_metrics(m, str(tmp_path / "metrics"))
    V.write_metrics(m, str(tmp_path / "metrics"))
    back = spark.read.parquet(str(tmp_path / "metrics"))
    assert back.count() == 12 and back.filter("name = 'rag.pass_rate'").first().value == 0.5
