"""Inputs that once gave wrong answers: odd query vectors, several JSON values,
redelivered deltas, missing roles, empty batches, rows without an id."""

import datetime as dt

import pytest
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import functions as F

from quarry.operators import evaluation as V
from quarry.operators import inference as M
from quarry.operators import retrieval as R
from quarry.plans import sizing
from quarry.sources import search_table as S
from quarry.streaming import jobs as J


def test_a_query_vector_of_another_length_only_empties_itself(spark):
    vec = "doc_id long, embedding array<double>"
    docs = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [1.0, 1.0, 1.0, 1.0]), (4, None)], vec)
    asked = [(1, [1.0, 0.1, 0.0]), (2, [0.0, 1.0, 0.2]), (3, [1.0, 0.0, 0.0, 0.0]), (4, [1.0] * 5), (5, None), (6, []),
             (7, [0.0, 0.0, 0.0]), (8, [1.0, None, 0.0]), (9, [float("nan"), 1.0, 0.0])]
    q = spark.createDataFrame(asked, "query_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.doc_id) for r in R.vector_search(q, docs, k=5).collect())
    assert got == [(1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 2, 1), (3, 1, 3)]
    assert R.vector_search(q.limit(0), docs, k=5).count() == 0


def test_filters_as_text(spark):
    docs = spark.createDataFrame([(1, "red fox", "en", 5), (2, "red hen", "de", 9), (3, "red cow", "en", 9)],
                                 "doc_id long, text string, lang string, n_chars long")
    q = spark.createDataFrame([(1, "red", [1.0, 0.0])], "query_id long, query string, embedding array<double>")
    vecs = docs.select("doc_id", F.array(F.lit(1.0), F.col("doc_id").cast("double")).alias("embedding"))
    text = "lang = 'en' AND NOT n_chars < 6 OR doc_id IN (2)"
    assert {r.doc_id for r in R.keyword_search(q, docs, k=5, doc_filter=text).collect()} == {2, 3}
    out = R.vector_search(q, vecs, k=5, docs=docs, doc_filter=text, select_fields=["lang"])
    assert {(r.doc_id, r.lang) for r in out.collect()} == {(2, "de"), (3, "en")}
    assert {r.doc_id for r in R.hybrid_search(q, q, docs, vecs, k=5, doc_filter=text).collect()} == {2, 3}
    with pytest.raises(ParseException):
        R.vector_search(q, vecs, k=5, docs=docs, doc_filter="lang = = 'en'")
    with pytest.raises(AnalysisException):
        R.keyword_search(q, docs, k=5, doc_filter="no_such_column = 1")


def test_a_text_filter_reaches_the_scan(spark):
    docs = R.filtered(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "lang = 'en' AND n_chars > 500")
    plan = docs.select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "GreaterThan(n_chars,500)" in plan


def test_documents_without_an_id_are_no_hits_in_any_search(spark):
    docs = spark.createDataFrame([(None, "red red red"), (1, "red fox"), (2, "blue")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "red")], "query_id long, query string")
    assert [r.doc_id for r in R.keyword_search(q, docs, k=1).collect()] == [1]
    assert [r.doc_id for r in R.keyword_boolean(q.withColumn("must", F.lit("red")), docs, k=1).collect()] == [1]


JSON = [('{"k": 1}', True), ('{"k": 1} {"k": 2}', False), ('{"k": 1}, {"k": 2}', False), ('{"k": 1} done', False),
        ('{"k": 1}}', False), ('{"k": 1}]', False), (' {"k": 1}\n ', None), ("[1]", False), ("", False), (None, False),
        ('{"k": 1, "t": "} {"}', True)]


def test_json_replies_are_one_whole_object(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(JSON)], "i int, t string")
    for r in M.json_mode(df, "t", "k INT").collect():
        if JSON[r.i][1] is not None:
            assert (r.error is None) == JSON[r.i][1] and (r.parsed is not None and r.parsed.k == 1) == JSON[r.i][1]
    score, reason = V.judge_parse("t")
    bad = spark.createDataFrame([('{"score": 4} {"x":1}',), ('{"score": 4}',), ('{"score": 4} ok',)], "t string")
    assert [r.s for r in bad.select(score.alias("s")).collect()] == [0.0, 4.0, 0.0]


def test_history_keeps_rows_without_a_role_and_orders_ties(spark):
    rows = [("c", 0, "system", "abc"), ("c", 1, None, "xy"), ("c", 1, "user", "z"), ("c", 2, "system", "late"), ("c", 3, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    got = [(r.turn, r.role, r.history_messages, r.history_chars) for r in M.conversation_history(df).orderBy("history_messages").collect()]
    assert got == [(0, "system", 1, 3), (1, None, 2, 5), (1, "user", 3, 6), (3, "assistant", 4, 6)]


def test_upsert_of_nothing_and_into_a_plain_table(spark):
    cols = "id string, content string, content_vector array<float>, version int"
    base = S.conform(spark.createDataFrame([("1", "a", None, 1), ("2", "b", None, 1)], cols), 3)
    new, counts = S.upsert(base, base.limit(0))
    assert [tuple(r) for r in counts.collect()] == [(0, 0)] and new.count() == 2
    plain = base.drop("valid", "version")
    new, counts = S.upsert(plain, S.conform(spark.createDataFrame([("2", "c", None, 1), ("3", "d", None, 1)], cols), 3))
    assert new.columns == plain.columns and {r.id: r.content for r in new.collect()} == {"1": "a", "2": "c", "3": "d"}
    assert [tuple(r) for r in counts.collect()] == [(2, 0)]


@pytest.mark.parametrize("timeout", [None, "10 minutes"])
def test_redelivered_deltas_give_one_response(spark, timeout):
    t = dt.datetime(2024, 1, 1)
    at = lambda m: t + dt.timedelta(minutes=m)
    schema = "request_id string, seq int, delta string, is_final boolean, ts timestamp"
    path = sizing.shared_path(spark, "again")
    files = [[("r", 1, "b", False, at(0)), ("r", 2, None, True, at(0))], [("r", 0, "a", False, at(1)), ("q", 0, "x", False, at(1))],
             [("r", 0, "a", False, at(1))], [("r", 1, "b", False, at(2)), ("r", 2, None, True, at(2))],
             [("z", 0, "z", False, at(60))], [("z", 1, None, True, at(120))], [("y", 0, "y", False, at(180))]]
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    out = J.run_available(J.assemble_stream(J.file_stream(spark, path, max_files_per_trigger=1), timeout=timeout), "again")
    got = sorted((r.request_id, r.content, r.abandoned) for r in out.collect() if r.request_id in "rq")
    assert got == ([("q", "x", True)] if timeout else []) + [("r", "ab", False)]
