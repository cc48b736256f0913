"""Driver contract: entry() smoke, registry coverage, and every registered
query against its SQL oracle on the sf0.001 tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import digest  # noqa: E402
from type_diff import DUCK  # noqa: E402
from quarry.plans import catalog  # noqa: E402
from quarry.sources.tables import TABLES  # noqa: E402

SF = "/root/testdata/sf0.001"
ROWS_ONLY = {"train_gbt", "severity_model", "analyze_batch", "vector_search_ann", "ann_recall", "embed_corpus",
             "embed_remote", "batch_complete", "sweep", "stream_drift", "vector_search_quantised", "quantised_recall", "feature_importances"}


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["query_id", "doc_id", "score", "rank", "vector_rank", "keyword_rank"]


def test_every_query_has_oracle_or_is_rows_only():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    own = set(catalog.queries())
    assert own - set(o) == ROWS_ONLY


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    s_rows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    d_cols = [d[0] for d in cur.description]
    d_rows = cur.fetchall()
    assert sorted(df.columns) == sorted(d_cols)
    assert digest(df.columns, s_rows)[0] == digest(d_cols, d_rows)[0]
    s_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    d_types = {c: DUCK.get(str(t), str(t)) for c, t in zip(d_cols, [d[1] for d in cur.description])}
    assert s_types == d_types
