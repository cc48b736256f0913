import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import retrieval as R


def test_result_order_code_rule_and_reranked_first(spark):
    # Sort fixture: A (0.9, 0.0), B (0.5, 0.8), C (0.7, 0.95).
    df = spark.createDataFrame([(1, "A", 0.9, 0.0, 1), (1, "B", 0.5, 0.8, 2), (1, "C", 0.7, 0.95, 3)],
                               "query_id long, content string, score double, reranker_score double, rank int")
    got = [r.content for r in R.result_order(df).orderBy("final_rank").collect()]
    assert got == ["C", "A", "B"]  # reranker score if > 0 else search score
    got2 = [r.content for r in R.result_order(df, reranked_first=True).orderBy("final_rank").collect()]
    assert got2 == ["C", "B", "A"]


def test_result_order_search_response(spark):
    df = spark.createDataFrame([(1, "doc1", 0.85, 0.95, 1), (1, "doc2", 0.7, 0.72, 2)],
                               "query_id long, id string, score double, reranker_score double, rank int")
    assert [r.id for r in R.result_order(df).orderBy("final_rank").collect()] == ["doc1", "doc2"]


def test_result_order_stable_on_ties(spark):
    df = spark.createDataFrame([(1, "x", 0.5, None, 2), (1, "y", 0.5, None, 1)],
                               "query_id long, id string, score double, reranker_score double, rank int")
    assert [r.id for r in R.result_order(df).orderBy("final_rank").collect()] == ["y", "x"]


def test_top_k_must_be_positive(spark):
    q = spark.createDataFrame([(1, "a")], "query_id long, query string")
    d = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        R.keyword_search(q, d, k=0)


def _bm25_brute(queries, docs, k1=1.2, b=0.75):
    import math
    import re
    tok = lambda s: re.findall(r"[^\W_]+", s.lower())
    dt = {d: tok(t) for d, t in docs}
    n = len(dt)
    avgdl = sum(len(v) for v in dt.values()) / n
    out = {}
    for qid, qtext in queries:
        for term in set(tok(qtext)):
            dfreq = sum(1 for v in dt.values() if term in v)
            if not dfreq:
                continue
            idf = math.log(1 + (n - dfreq + 0.5) / (dfreq + 0.5))
            for d, v in dt.items():
                tf = v.count(term)
                if tf:
                    s = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(v) / avgdl))
                    out[(qid, d)] = out.get((qid, d), 0.0) + s
    return out


def test_keyword_search_matches_brute_force(spark):
    docs = [(1, "the cat sat on the mat"), (2, "a dog and a cat"), (3, "birds fly high"),
            (4, "the the the cat"), (5, "")]
    queries = [(10, "cat mat"), (11, "dog birds"), (12, "nothing here")]
    qd = spark.createDataFrame(queries, "query_id long, query string")
    dd = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.query_id, r.doc_id): r.score for r in R.keyword_search(qd, dd, k=10).collect()}
    exp = _bm25_brute(queries, docs)
    assert set(got) == set(exp)
    for key, v in exp.items():
        assert got[key] == pytest.approx(round(v, 6), abs=1e-6)


def test_keyword_boolean_constraints(spark):
    docs = spark.createDataFrame([(1, "red apple pie"), (2, "green apple tart"), (3, "red pie apple")],
                                 "doc_id long, text string")
    q = spark.createDataFrame([(1, "apple", "apple", "green", "apple pie")],
                              "query_id long, query string, must string, must_not string, phrase string")
    got = [r.doc_id for r in R.keyword_boolean(q, docs, k=10).collect()]
    assert got == [1]  # doc 3 lacks the phrase, doc 2 has the excluded word


def test_vector_search_matches_numpy(spark):
    rng = np.random.default_rng(0)
    dv = rng.normal(size=(50, 8))
    qv = rng.normal(size=(3, 8))
    dv[7] = 0.0  # zero vector never scores
    vecs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(dv)],
                                 "doc_id long, embedding array<float>")
    qs = spark.createDataFrame([(100 + i, [float(x) for x in v]) for i, v in enumerate(qv)],
                               "query_id long, embedding array<float>")
    got = R.vector_search(qs, vecs, k=5).orderBy("query_id", "rank").collect()
    d32 = dv.astype(np.float32).astype(np.float64)
    q32 = qv.astype(np.float32).astype(np.float64)
    for i in range(3):
        sims = []
        for j in range(50):
            n = np.linalg.norm(d32[j])
            if n > 0:
                sims.append((round(float(q32[i] @ d32[j] / (np.linalg.norm(q32[i]) * n)), 6), j))
        exp = [j for _, j in sorted(sims, key=lambda t: (-t[0], t[1]))[:5]]
        assert [r.doc_id for r in got if r.query_id == 100 + i] == exp


def test_rrf_fusion_outer_join(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, doc_id long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, doc_id long, rank int")
    out = {r.doc_id: r.score for r in R.rrf_fuse(a, b, k=3).collect()}
    assert out[11] == pytest.approx(1 / 62 + 1 / 61)
    assert out[10] == pytest.approx(1 / 61)
    assert out[12] == pytest.approx(1 / 62)


def test_rag_context_rank_order(spark):
    hits = spark.createDataFrame([(1, 2, 2), (1, 1, 1)], "query_id long, doc_id long, rank int")
    docs = spark.createDataFrame([(1, "first"), (2, "second")], "doc_id long, text string")
    assert R.rag_context(hits, docs).collect()[0].context == "first\nsecond"
    assert R.rag_context(hits, docs, sep="\n\n").collect()[0].context == "first\n\nsecond"


def test_result_metadata_excludes_core_fields(spark):
    df = spark.createDataFrame([("1", "c", "s", "t", "x", 5)],
                               "id string, content string, source string, title string, category string, n int")
    m = R.result_metadata(df).collect()[0].metadata
    assert m == {"category": "x", "n": "5"}


def test_indexed_search_matches_on_the_fly(spark, tmp_path):
    from quarry.sources import search_index as SI
    docs = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "a dog and a cat"), (3, "birds fly"),
                                  (4, "")], "doc_id long, text string")
    qs = spark.createDataFrame([(10, "cat mat"), (11, "dog birds fly")], "query_id long, query string")
    path = SI.build_index(docs, str(tmp_path / "idx"), n_buckets=4)
    a = sorted(tuple(r) for r in SI.keyword_search_index(qs, path, k=3).collect())
    b = sorted(tuple(r) for r in R.keyword_search(qs, docs, k=3).collect())
    assert a == b


def test_vector_search_filter_and_field_selection(spark):
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "doc_id long, embedding array<float>")
    docs = spark.createDataFrame([(1, "a", "en"), (2, "b", "fr"), (3, "c", "en")], "doc_id long, text string, lang string")
    qs = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, embedding array<float>")
    out = R.vector_search(qs, vecs, k=2, docs=docs, doc_filter=F.col("lang") == "en", select_fields=["text"])
    rows = sorted((r["rank"], r.doc_id, r.text) for r in out.collect())
    assert rows == [(1, 1, "a"), (2, 3, "c")]  # doc 2 filtered out before ranking


def test_block_scorer_with_tiny_arrow_batches(spark):
    # Documents straddle Arrow batches: the carried-over tail must join the next batch.
    docs = [(i, " ".join(["cat", "dog", "mat", "bird"][: 1 + i % 4] * (1 + i % 3))) for i in range(40)]
    queries = [(1, "cat mat"), (2, "dog bird"), (3, "bird")]
    qd = spark.createDataFrame(queries, "query_id long, query string")
    dd = spark.createDataFrame(docs, "doc_id long, text string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {(r.query_id, r.doc_id): r.score for r in R.keyword_search(qd, dd, k=40).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    exp = _bm25_brute(queries, docs)
    assert set(got) == set(exp)
    for key, v in exp.items():
        assert got[key] == pytest.approx(round(v, 6), abs=1e-6)


def test_string_keys_on_both_bm25_paths(spark, monkeypatch):
    q = spark.createDataFrame([("qa", "red fox"), ("qb", "blue")], "query_id string, query string")
    d = spark.createDataFrame([("d1", "red fox runs"), ("d2", "blue sky"), ("d3", "red"), ("d4", None)],
                              "doc_id string, text string")
    small = sorted(map(tuple, R.keyword_search(q, d, k=2).collect()))
    assert [r[:2] for r in small] == [("qa", "d1"), ("qa", "d3"), ("qb", "d2")]
    monkeypatch.setattr(R, "BLOCK_MAX_CELLS", 0)
    assert sorted(map(tuple, R.keyword_search(q, d, k=2).collect())) == small


def test_string_keys_in_vector_search(spark):
    q = spark.createDataFrame([("qa", [1.0, 0.0])], "query_id string, embedding array<double>")
    v = spark.createDataFrame([("x", [2.0, 0.0]), ("y", [0.0, 1.0])], "doc_id string, embedding array<double>")
    assert [r["doc_id"] for r in R.vector_search(q, v, k=2).orderBy("rank").collect()] == ["x", "y"]


def test_matched_set_is_not_cut(spark):
    q = spark.createDataFrame([(1, "common")], "query_id long, query string")
    d = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("common word").alias("text"),
                                F.when(F.col("id") < 400, "a").otherwise("b").alias("source"))
    got = R.facets(R.matched_set(q, d), d, ["source"]).collect()
    assert sorted((r["value"], r["n"]) for r in got) == [("a", 400), ("b", 100)]


def test_hit_passages_lists_captions_and_puts_answers_on_every_hit(spark):
    docs = spark.createDataFrame([
        (1, "Red fox runs. The red fox sleeps in a red den. A fox. Nothing here."),
        (2, "Red fox here. Red fox here. Blue."), (3, "Quiet blue sea."), (4, ""), (5, None)],
        "doc_id long, text string")
    queries = spark.createDataFrame([("a", "red fox den"), ("b", "zebra"), ("c", None)], "query_id string, query string")
    hits = spark.createDataFrame(
        [("a", 2, 1), ("a", 1, 2), ("a", 3, 3), ("a", 4, 4), ("a", 5, 5), ("a", 9, 6), ("b", 1, 1), ("c", 1, 1),
         ("none", 1, 1)], "query_id string, doc_id long, rank int")
    got = {(r["query_id"], r["doc_id"]): r for r in R.hit_passages(hits, queries, docs, per_hit=2, per_query=3).collect()}
    assert len(got) == 9
    best, first = "The red fox sleeps in a red den.", "Red fox runs."
    assert got["a", 1]["captions"] == [best, first]
    assert got["a", 2]["captions"] == ["Red fox here.", "Red fox here."]
    for d in (3, 4, 5, 9):
        assert got["a", d]["captions"] == []
    # the best of all hits, on every hit of the query
    assert all(got["a", d]["answers"] == [best, first, "Red fox here."] for d in (1, 2, 3, 4, 5, 9))
    for q in ("b", "c", "none"):
        assert got[q, 1]["captions"] == [] and got[q, 1]["answers"] == [] and got[q, 1]["rank"] == 1
    with pytest.raises(ValueError):
        R.hit_passages(hits, queries, docs, per_hit=0)


def test_hit_passages_with_no_hits(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a")], "query_id long, query string")
    hits = spark.createDataFrame([], "query_id long, doc_id long, rank int")
    out = R.hit_passages(hits, queries, docs)
    assert out.collect() == [] and out.columns[-2:] == ["captions", "answers"]


def test_keyword_boolean_scores_only_what_its_constraints_leave(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "red fox runs home"), (2, "red red dog runs"), (3, "home fox red"), (4, None), (5, "cat runs home")],
                                 "doc_id int, text string")
    q = spark.createDataFrame([(1, "red runs home", "red", "dog", "fox runs"), (2, "runs home", None, "cat", None),
                               (3, "red", None, None, "red fox"), (None, "home runs", None, "cat", None), (4, "home", "runs", "fox", None)],
                              "query_id int, query string, must string, must_not string, phrase string")
    written, keep = {}, R.materialize
    monkeypatch.setattr(R, "materialize", lambda df, name: written.setdefault(name, keep(df, name)))
    got = {}
    for r in R.keyword_boolean(q, docs, k=10).collect():
        got.setdefault(r.query_id, set()).add(r.doc_id)
    assert got == {1: {1}, 2: {1, 2, 3}, 3: {1}, None: {1, 2, 3}, 4: {5}}
    hits = {(r.query_id, r.doc_id) for r in written["boolean-pairs"].filter("hit").collect()}
    assert hits == {(1, 1), (3, 1), (4, 2), (4, 5)}  # of the queries that ask for words; scored in these alone
