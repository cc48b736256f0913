"""Physical-plan properties the operators rely on at scale."""

from pyspark.sql import functions as F

from quarry.operators import retrieval as R
from quarry.operators import safety as S
from quarry.sources.tables import corpus, doc_vectors, query_vectors, search_queries

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_partial_before_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("query_id"), F.col("id").alias("doc_id"),
                                  F.rand(1).alias("score"))
    p = _plan(R.top_k_per_query(df, 3))
    assert "WindowGroupLimit" in p and "Partial" in p and "Final" in p


def test_doc_filter_reaches_parquet_scan(spark):
    docs = corpus(spark, SF).filter(F.col("lang") == "en")
    qt = R.query_terms(search_queries(spark, SF))
    p = _plan(R.term_frequencies(docs, qt))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in p
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in p


def test_exact_vector_search_has_no_cartesian_product(spark):
    out = R.vector_search(query_vectors(spark, SF), doc_vectors(spark, SF), k=5, docs=corpus(spark, SF))
    p = _plan(out)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "MapInPandas" in p or "PythonMapInArrow" in p or "MapInArrow" in p


def test_lexicon_severity_is_row_local(spark):
    p = _plan(S.severity_lexicon(corpus(spark, SF)))
    assert "Exchange" not in p  # no shuffle: one projection over the scan


def test_document_texts_stay_in_their_scan(spark):
    """Hits are broadcast to the documents; no exchange carries a document text."""
    docs, qs = corpus(spark, SF), search_queries(spark, SF)
    hits = R.keyword_search(qs, docs, k=3)
    for out in (R.captions(hits, qs, docs), R.rerank(hits, qs, docs, title_col=None, category_col=None)):
        p = _plan(out)
        assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p
        scan = [x for x in p.splitlines() if "text" in x and "Exchange" in x]
        assert not [x for x in scan if "hashpartitioning" in x and "text#" in x]


def test_boolean_search_reads_the_documents_twice(spark):
    qs = search_queries(spark, SF).withColumn("must", F.lit("the")).withColumn("must_not", F.lit("zebra"))
    p = _plan(R.keyword_boolean(qs.withColumn("phrase", F.lit(None).cast("string")), corpus(spark, SF), k=3))
    assert p.count("documents.parquet") == 0  # only the written (doc, term) tables are left
