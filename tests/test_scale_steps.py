"""Steps that are done once: what an input grows to is neither computed nor shuffled again."""

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import extraction as D
from quarry.operators import mlpipe as P
from quarry.operators import retrieval as R
from quarry.operators import safety as S
from quarry.plans.catalog import queries
from quarry.sources import search_index as SI
from quarry.sources import search_table as ST

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entities_are_looked_for_once_a_step(spark):
    df = spark.createDataFrame([("a &amp;lt; &#65;&#x42; &nope; &lt;",), ("plain",), (None,)], "t string")
    out = df.select(D.decode_entities(F.col("t")).alias("t"))
    assert _plan(out).count("&[A-Za-z][A-Za-z0-9]*;") == 1
    assert [r.t for r in out.collect()] == ["a &lt; AB &nope; <", "plain", None]


def test_exploded_arrays_are_computed_once(spark):
    df = spark.createDataFrame([(1, "A b. C d."), (2, ""), (3, None)], "doc_id long, text string")
    out = T.posexplode_once(df, ["doc_id"], T.sentences("text"), "n", "s")
    assert _plan(out).count("regexp_extract_all") == 1
    assert [tuple(r) for r in out.orderBy("doc_id", "n").collect()] == [(1, 0, "A b."), (1, 1, "C d.")]


def test_markdown_takes_one_shuffle_and_rows_of_cells(spark):
    tabs = spark.createDataFrame([(1, 0, 2, 2), (None, 0, 1, 1), (2, 0, 2, 1), (2, 0, 2, 1)], "doc_id long, table_no int, rows int, columns int")
    cells = [(1, 0, 1, 0, 0, "x"), (1, 0, 7, 0, 0, "y"), (1, 0, 2, 1, 1, "z"), (1, 0, 3, 5, 0, "out"), (1, 0, 4, 0, 2, "out"),
             (9, 0, 0, 0, 0, "no table"), (2, 0, 0, 1, 0, None)]
    flat = spark.createDataFrame(cells, "doc_id long, table_no int, ordinal int, row_index int, column_index int, content string")
    packed = flat.groupBy("doc_id", "table_no", "row_index").agg(F.collect_list(F.struct("column_index", "ordinal", "content")).alias("cells"))
    for given in (flat, packed):
        got = sorted(((r.doc_id or 0, r.markdown) for r in D.table_markdown(given, tabs).collect()))
        twice = "|  |\n| --- |\n|  |\n| --- |\n|  |\n|  |"
        assert got == [(0, ""), (1, "| y |  |\n| --- | --- |\n|  | z |"), (2, twice), (2, twice)]
    p = _plan(D.table_markdown(flat, tabs))
    assert "Join" not in p and p.count("Exchange hashpartitioning") == 1


def test_an_order_and_a_line_are_shuffled_once(spark):
    p = _plan(queries()["doc_result"](spark, SF))
    assert p.count("Exchange hashpartitioning") == 2


def test_terms_are_counted_in_their_row(spark, tmp_path):
    docs = {1: "b a b", 2: "", 3: None, 4: "C c d"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    out = T.term_counts(df, ["doc_id"], T.words("text"), marker=True)
    want = {(i, t): n for i, s in docs.items() for t, n in Counter((s or "").lower().split()).items()} | {(i, None): 1 for i in docs}
    assert {(r.doc_id, r.term): r.tf for r in out.collect()} == want and "Exchange" not in _plan(out)
    # equal ids still meet
    again = df.unionByName(df.filter("doc_id < 3"))
    SI.write_postings(again, str(tmp_path / "p"), 4)
    got = {(r.doc_id, r.term): r.tf for r in spark.read.parquet(str(tmp_path / "p")).collect()}
    assert got == {k: n * (2 if k[0] < 3 else 1) for k, n in want.items()}


def test_shingles_hold_a_slice_of_tokens(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 50, n)) for n in rng.integers(0, 200, 300)] + [None, ""]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([None, *range(1, 302)], pa.int64()), "t": texts})

    def scan():
        return pa.Table.from_batches(S._shingle_scan(4)(iter([batch]))).to_pylist()

    whole, held, hashed = scan(), [], pd.util.hash_array
    monkeypatch.setattr(S, "SCAN_BYTES", 2_000)
    monkeypatch.setattr(pd.util, "hash_array", lambda x, **k: held.append(len(x)) or hashed(x, **k))
    assert scan() == whole and max(held) < 1_000 < sum(held)


def test_block_scores_equal_the_join(spark):
    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in rng.integers(0, 30, 40))) for i in range(80)], "doc_id long, text string")
    qs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in rng.integers(0, 30, 4))) for i in range(6)], "query_id long, query string")
    got = {(r.query_id, r.doc_id): r.score for r in R.keyword_search(qs, docs, k=80).collect()}
    want = {(r.query_id, r.doc_id): r.raw for r in R.bm25_scores(qs, docs).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got)


def test_captions_cut_hits_only(spark):
    docs = spark.createDataFrame([(1, "Red fox. Blue fox here."), (2, "none")], "doc_id long, text string")
    qs = spark.createDataFrame([(5, "blue fox")], "query_id long, query string")
    hits = spark.createDataFrame([(5, 1), (5, 2)], "query_id long, doc_id long")
    out = R.captions(hits, qs, docs)
    assert _plan(out).count("[^.!?") == 1
    assert [tuple(r) for r in out.collect()] == [(5, 1, "Blue fox here.", 2)]


def test_severity_texts_are_read_once(spark):
    docs = spark.createDataFrame([(i, "bad words" if i % 2 else "fine words", "en") for i in range(60)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    model, scored = P.severity_model(docs, labels)
    assert "text" not in _plan(scored)      # scored from the written counts
    kept = {r.doc_id: r.p_toxic for r in scored.collect()}
    direct = model.transform(docs.filter(F.col("doc_id").isin(list(kept)))).collect()
    assert len(model.stages) == 5 and all(abs(kept[r.doc_id] - r.probability[1]) < 1e-9 for r in direct)


def test_update_rows_are_shuffled_once(spark):
    df = ST.conform(spark.createDataFrame([("1", "a", None, 1), ("2", "b", None, 3)], "id string, content string, content_vector array<float>, version int"), 3)
    upd = ST.conform(spark.createDataFrame([("1", "x", None, 2), ("1", "y", None, 1), ("2", "old", None, 2), ("3", "n", None, None)],
                                           "id string, content string, content_vector array<float>, version int"), 3)
    new, counts = ST.upsert(df, upd)
    assert _plan(new).count("partial_max_by(struct(") == 1
    assert {r.id: r.content for r in new.collect()} == {"1": "x", "2": "b", "3": "n"} and tuple(counts.first()) == (3, 0)
