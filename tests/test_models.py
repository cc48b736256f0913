"""Metric floors for the rows-only (model-backed) operators, seeded."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import embedding as EM
from quarry.operators import mlpipe as P
from quarry.operators import retrieval as R
from quarry.sources.tables import corpus, doc_vectors, query_vectors, table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vecs(spark):
    v = doc_vectors(spark, SF).join(corpus(spark, SF).select("doc_id"), "doc_id", "left_semi")
    return query_vectors(spark, SF), v


def test_ann_recall_full_probe_is_exact(spark, vecs):
    qv, v = vecs
    idx = EM.build_ivf(v, n_cells=8)
    exact = R.vector_search(qv, v, k=10)
    full = EM.ann_recall(EM.vector_search_ann(qv, v, k=10, nprobe=8, index=idx), exact)
    assert full.agg(F.min("recall")).first()[0] == pytest.approx(1.0)


def test_ann_recall_of_few_probes_on_clustered_vectors(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(8, 16))
    near = lambda i: (centre[i % 8] + 0.1 * rng.normal(size=16)).tolist()
    v = spark.createDataFrame([(i, near(i)) for i in range(400)], "doc_id long, embedding array<double>")
    qv = spark.createDataFrame([(i, near(i)) for i in range(16)], "query_id long, embedding array<double>")
    idx = EM.build_ivf(v, n_cells=8)
    got = EM.ann_recall(EM.vector_search_ann(qv, v, k=10, nprobe=2, index=idx), R.vector_search(qv, v, k=10))
    assert got.agg(F.min("recall")).first()[0] >= 0.9
    # more than two cells are there to leave out
    assert idx[1].select("cell").distinct().count() >= 5


def test_saved_index_gives_the_same(spark, vecs, tmp_path):
    qv, v = vecs
    idx = EM.build_ivf(v, n_cells=6, max_fit=100)
    kept = EM.load_ivf(spark, EM.save_ivf(idx, str(tmp_path / "ivf")))
    assert kept[1].count() == v.count()
    rows = lambda i: sorted(tuple(r) for r in EM.vector_search_ann(qv, None, k=5, nprobe=3, index=i).collect())
    assert rows(kept) == rows(idx)


def test_ann_recall_of_the_default_probes(spark):
    sf = "/root/testdata/sf0.1"
    v = doc_vectors(spark, sf).join(corpus(spark, sf).select("doc_id"), "doc_id", "left_semi")
    qv = query_vectors(spark, sf)
    got = EM.ann_recall(EM.vector_search_ann(qv, v, k=10), R.vector_search(qv, v, k=10))
    assert got.agg(F.avg("recall")).first()[0] >= 0.9


def test_severity_model_recall_on_english(spark):
    _, scored = P.severity_model(table(spark, SF, "documents"), table(spark, SF, "labels"))
    en = scored.filter((F.col("lang") == "en") & (F.col("label") == 1))
    n = en.count()
    if n:
        hit = en.filter(F.col("prediction") == 1).count()
        assert hit / n >= 0.5


def test_embed_corpus_unit_norm(spark):
    e = EM.embed_corpus(corpus(spark, "/root/testdata/sf0.001"), dims=64)
    norms = e.select(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x).alias("n2")).collect()
    assert all(abs(r.n2 - 1.0) < 1e-6 or r.n2 == 0.0 for r in norms)
