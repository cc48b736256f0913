"""The quantised index: exact on a full shortlist, recall and reads on a small one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import retrieval as R
from quarry.operators import vector_index as VI
from quarry.session import ship_package

VEC = "doc_id long, embedding array<double>"
ASKED = "query_id string, embedding array<double>"


@pytest.fixture(scope="module")
def data(spark):
    ship_package(spark)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 32))
    x[:1200] = x[0] + 0.3 * rng.normal(size=(1200, 32))     # a third of all rows in one place
    q = np.concatenate([rng.normal(size=(30, 32)), x[:5] + 0.2 * rng.normal(size=(5, 32))])
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [
        (9001, None), (9002, [0.0] * 32), (9003, [1.0] * 31), (9004, [float("nan")] * 32), (None, x[3].tolist())], VEC)
    asked = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(q)] + [
        ("short", [1.0] * 31), ("zero", [0.0] * 32), ("none", None)], ASKED)
    return docs.repartition(4), asked


def test_recall_without_self_matches_and_reads(spark, data, tmp_path):
    docs, asked = data
    index = VI.load_quantised(spark, VI.save_quantised(VI.build_quantised(docs, block_rows=600), str(tmp_path / "pq")))
    assert index.exact.count() == 4000 == index.codes.select("doc_id").distinct().count()
    assert index.codes.agg(F.max(F.octet_length("code"))).first()[0] == 8      # 256 bytes of float64 become 8
    sizes = [r["count"] for r in index.codes.groupBy("block").count().collect()]
    assert max(sizes) <= 600 and index.codes.groupBy("block").agg(F.countDistinct("cell").alias("c")).agg(F.max("c")).first()[0] == 1
    exact = R.vector_search(asked, docs.filter("doc_id < 9000"), k=10)
    got = VI.recall_and_reads(asked, index, exact, k=10, per_hit=20).agg(
        F.avg("recall"), F.max("read_share"), F.count(F.lit(1))).first()
    assert got[0] >= 0.9 and got[1] <= 0.2 and got[2] == 35


def test_a_shortlist_of_everything_is_exact(spark, data):
    docs, asked = data
    index = VI.build_quantised(docs.filter("doc_id < 300 OR doc_id > 9000 OR doc_id IS NULL"), n_cells=5, block_rows=40)
    exact = R.vector_search(asked, docs.filter("doc_id < 300"), k=7)
    key = lambda df: sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())
    assert key(VI.quantised_search(asked, index, k=7, per_hit=300)) == key(exact)


def test_no_vectors(spark, data):
    docs, asked = data
    index = VI.build_quantised(docs.filter("doc_id > 9000"))
    assert VI.quantised_search(asked, VI.build_quantised(docs.limit(0)), k=3).count() == 0
    assert VI.quantised_search(asked, index, k=3).count() in (0, 1)     # the one vector of 31 components
