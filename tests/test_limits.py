"""Inputs that caps, edges and size switches must not change."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry import session
from quarry.operators import extraction as D
from quarry.operators import inference as M
from quarry.operators import mlpipe as P
from quarry.operators import safety as S
from quarry.plans import sizing
from quarry.plans.sizing import write_shared
from quarry.streaming import jobs as J


@pytest.mark.parametrize("parts", [4, 16])
@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_history_of_many_rows_equals_a_window(spark, parts, adaptive):
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        # 400,000 rows: 300 conversations, one of them with a quarter of all rows
        conv = spark.range(400_000).select(
            F.when(F.col("id") < 100_000, F.lit(0)).otherwise(F.col("id") % 299 + 1).alias("conv_id"),
            F.col("id").alias("turn"), F.when(F.col("id") % 7 == 0, "system").otherwise("user").alias("role"),
            F.repeat(F.lit("x"), (F.col("id") % 5).cast("int")).alias("text"))
        w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
        want = conv.filter("role <> 'system' OR turn = 0").select(
            "conv_id", "turn", "role", F.count(F.lit(1)).over(w).alias("history_messages"),
            F.sum(F.length("text")).over(w).alias("history_chars"))
        got = M.conversation_history(conv, block_turns=1000)
        assert got.count() == want.count()
        assert got.exceptAll(want).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.enabled", old[1])


def test_blocklist_entry_of_any_length(spark):
    docs = spark.createDataFrame([(1, "the Apache License, version two applies to all of it"), (2, "apache license")], "doc_id long, text string")
    bl = spark.createDataFrame([("l", "apache license version two"), ("l", "license version two applies to all of it")],
                               "list_name string, term string")
    got = sorted(tuple(r) for r in S.blocklist_match(docs, bl).collect())
    assert got == [(1, "l", "apache license version two", 1), (1, "l", "license version two applies to all of it", 2)]
    assert S.blocklist_match(docs, bl.limit(0)).collect() == []


def test_ks_of_close_values(spark):
    a = spark.createDataFrame([(i * 1e-5,) for i in range(100)], "x double")
    b = spark.createDataFrame([(0.002 + i * 1e-5,) for i in range(100)], "x double")
    assert P.ks_statistic(a, b, "x").first().ks == 1.0
    assert P.ks_statistic(a, a, "x").first().ks == 0.0


def test_running_counts_beside_an_outlier(spark):
    values = [float(i % 700) for i in range(2000)] + [1e15, -1e15]
    c = P.value_counts(spark.createDataFrame([(v,) for v in values], "x double"), "x", "n")
    got = {r.v: (r.cum_n, r.all_n) for r in P.cumulative_counts(c, ["n"]).collect()}
    assert got == {v: (sum(x <= v for x in values), len(values)) for v in set(values)}
    assert P.cumulative_counts(c.filter("false"), ["n"]).collect() == []


def test_psi_uses_reference_deciles(spark):
    # a heavy tail puts equal-width bins all in one; deciles still see the shift
    a = spark.createDataFrame([(float(i),) for i in range(1000)] + [(1e9,)], "x double")
    b = spark.createDataFrame([(float(i) + 300,) for i in range(1000)], "x double")
    assert P.psi(a, a, "x").first().psi == pytest.approx(0.0)
    assert P.psi(a, b, "x").first().psi > 0.25


def test_word_across_a_segment_edge(spark):
    rows = [(i, "x" * (i - 1) + " idiot end " + "y" * 40) for i in range(1, 60)] + [(99, "a" * 45 + "idiot" + "a" * 45)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.hate for r in S.segment_max_severity(df, seg_chars=20).collect()}
    assert all(got[i] == 2 for i in range(1, 60))
    assert got[99] == 0  # inside a longer word


def test_orders_without_lines_stay(spark):
    o = spark.createDataFrame([(1, 1, 5.0, "a"), (2, 1, 6.0, "b"), (2, 1, 4.0, "b")],
                              "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string")
    li = spark.createDataFrame([(1, 2.0, 0.1, 0.2, "R")],
                               "l_orderkey long, l_quantity double, l_discount double, l_tax double, l_returnflag string")
    c = spark.createDataFrame([(1, "seg")], "c_custkey long, c_mktsegment string")
    got = {r.o_orderkey: r for r in P.order_features(o, li, c).collect()}
    assert len(got) == 2 and got[2].n_lines == 0.0 and got[2].label == 0 and got[2].o_totalprice == 4.0


def test_markdown_of_empty_grids(spark):
    tabs = spark.createDataFrame([(1, 0, 1, 0, 2), (2, 0, 1, 1, 0), (3, 0, 1, 1, 1)],
                                 "doc_id long, table_no int, page int, rows int, columns int")
    cells = spark.createDataFrame([(3, 0, 0, 0, 0, "c")],
                                  "doc_id long, table_no int, ordinal int, row_index int, column_index int, content string")
    md = D.table_markdown(cells, tabs)
    got = {r.doc_id: r.markdown for r in md.collect()}
    assert got[1] == "" and got[2].split("\n")[0] == "|  |" and got[3] == "| c |\n| --- |"
    docs = spark.createDataFrame([(3,), (4,)], "doc_id long")
    out = {r.doc_id: r.tables_markdown for r in D.doc_tables_markdown(md, tabs, docs=docs).collect()}
    assert out == {3: "### Table 1 (Page 1)\n| c |\n| --- |", 4: ""}


def test_counts_of_nulls(spark):
    df = spark.range(1).select(F.col("id").alias("doc_id"),
                               F.from_json(F.lit(None).cast("string"), D.RESPONSE_SCHEMA).alias("response"))
    r = D.doc_counts(D.parse_response(df, "m")).first()
    assert (r.page_count, r.table_count, r.field_count) == (0, 0, 0)


def test_deltas_after_the_marker(spark):
    t0 = dt.datetime(2024, 1, 1)
    schema = "request_id long, seq int, delta string, is_final boolean, ts timestamp"
    path = sizing.shared_path(spark, "late-deltas")
    for rows in ([(1, 0, "a", False, t0)], [(1, 2, None, True, t0), (2, 1, None, True, t0)],
                 [(1, 1, "b", False, t0), (2, 0, "c", False, t0), (2, 0, "c", False, t0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    out = {r.request_id: (r.content, r.n_deltas) for r in
           J.run_available(J.assemble_stream(J.file_stream(spark, path, max_files_per_trigger=1)), "late").collect()}
    assert out == {1: ("ab", 2), 2: ("c", 1)}


def test_size_check_moves_no_rows_and_counts_bytes(spark):
    df = spark.range(1000).select(F.repeat(F.lit("x"), 100).alias("s"))
    assert sizing.measured(df) == (1000, 100_000)
    plan = lambda d: d._jdf.queryExecution().toString()
    assert "broadcast" in plan(sizing.broadcast_if_bounded(df)).lower()
    assert "broadcast" not in plan(sizing.broadcast_if_bounded(df, max_bytes=10_000)).lower()
    assert "broadcast" not in plan(sizing.broadcast_if_bounded(df, max_rows=10)).lower()


def test_shared_folder_rule():
    assert session.local_master("local[4]") and session.local_master("local")
    assert not session.local_master("local-cluster[2,1,1024]") and not session.local_master("spark://host:7077")

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session())


def test_vector_candidates_are_k_rows_a_task_despite_ties(spark, monkeypatch):
    import numpy as np

    from quarry.operators import retrieval as R
    rng = np.random.default_rng(3)
    rows = [(f"d{i:04d}", [1.0, 0.0, 0.0] if i % 3 else rng.normal(size=3).tolist()) for i in range(900)]
    rows += [("bad", [float("nan"), 0.0, 0.0]), ("zero", [0.0, 0.0, 0.0]), ("short", [1.0]), ("none", None)]
    vec = spark.createDataFrame(rows, "doc_id string, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(1, [2.0, 0.0, 0.0]), (2, [0.3, 1.0, -0.5])], "query_id long, embedding array<double>")
    monkeypatch.setattr(R, "SIM_BLOCK_CELLS", 40)  # set before the scorer is built: many chunks a batch
    cand = R.vector_candidates(q, vec, 5)
    assert cand.count() <= 3 * 2 * 5
    want = []
    for qid, qv in ((1, [2.0, 0.0, 0.0]), (2, [0.3, 1.0, -0.5])):
        qv = np.array(qv) / np.linalg.norm(qv)
        sims = [(-round(float(np.dot(v, qv) / np.linalg.norm(v)), 6), d) for d, v in rows[:900]]
        want += [(qid, d, rank + 1) for rank, (_, d) in enumerate(sorted(sims)[:5])]
    got = [(r.query_id, r.doc_id, r["rank"]) for r in R.vector_search(q, vec, k=5).collect()]
    assert sorted(got) == sorted(want)


def test_clean_scratch_deletes_own_tables_only(spark, tmp_path):
    import os
    old = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    try:
        path = sizing.write_shared(spark.range(3), "x").removeprefix("file:")
        other = os.path.join(os.path.dirname(os.path.dirname(path)), "other-app")
        os.makedirs(other)
        assert os.path.isdir(path) and sizing.clean_scratch(spark)
        assert not os.path.exists(path) and os.path.isdir(other)
    finally:
        spark.sparkContext.setCheckpointDir(os.path.dirname(old))


def test_index_buckets_follow_the_corpus(spark, monkeypatch):
    from quarry.sources import search_index as SI
    docs = spark.createDataFrame([(i, "alpha beta " * 20) for i in range(50)], "doc_id long, text string")
    assert SI.buckets_for(docs) == SI.MIN_BUCKETS and SI.buckets_for(docs.limit(0)) == SI.MIN_BUCKETS
    monkeypatch.setattr(SI, "BUCKET_BYTES", 100)
    assert SI.buckets_for(docs) == 50 * 220 // 100
