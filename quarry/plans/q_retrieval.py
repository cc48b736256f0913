"""Retrieval queries over documents / embeddings / benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import retrieval as R
from quarry.plans.catalog import register
from quarry.sources.tables import corpus, doc_vectors, query_vectors, search_queries

# Shared SQL fragments (DuckDB). Tokeniser: lower-case, letter/digit runs.
_TOK = r"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+', 0)"

_BM25_CTE = """
d AS (SELECT doc_id, {tok_text} AS toks FROM documents {where}),
st AS (SELECT count(*) AS n_docs, avg(CAST(len(toks) AS DOUBLE)) AS avgdl FROM d),
q AS (SELECT DISTINCT item_id AS query_id, unnest({tok_q}) AS term FROM benchmark),
p AS (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM d),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM p
       WHERE term IN (SELECT term FROM q) GROUP BY doc_id, dl, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
kw_raw AS (
  SELECT q.query_id, tf.doc_id,
         sum(ln(1 + (st.n_docs - df.df + 0.5) / (df.df + 0.5)) * tf.tf * (1.2 + 1)
             / (tf.tf + 1.2 * (1 - 0.75 + 0.75 * tf.dl / st.avgdl))) AS raw
  FROM tf JOIN df USING (term) JOIN q USING (term) CROSS JOIN st
  GROUP BY q.query_id, tf.doc_id),
kw AS (
  SELECT query_id, doc_id, round(raw, 6) AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 6) DESC, doc_id) AS rank
  FROM kw_raw)
"""


def bm25_cte(where: str = "") -> str:
    return _BM25_CTE.format(tok_text=_TOK.format(x="text"), tok_q=_TOK.format(x="text"), where=where)


_VEC_CTE = """
qv AS (SELECT b.item_id AS query_id, list_reverse(CAST(e.embedding AS DOUBLE[])) AS qe
       FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
dv AS (SELECT e.vec_id AS doc_id, CAST(e.embedding AS DOUBLE[]) AS de
       FROM embeddings e WHERE e.vec_id IN (SELECT doc_id FROM documents {where})),
vs_raw AS (SELECT query_id, doc_id, list_cosine_similarity(qe, de) AS raw FROM qv CROSS JOIN dv),
vs AS (
  SELECT query_id, doc_id, round(raw, 6) AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 6) DESC, doc_id) AS rank
  FROM vs_raw)
"""


def vec_cte(where: str = "") -> str:
    return _VEC_CTE.format(where=where)


@register("keyword_search", sql=f"""
WITH {bm25_cte()}
SELECT query_id, doc_id, score, rank FROM kw WHERE rank <= 10
""")
def keyword_search(spark, sf_dir):
    return R.keyword_search(search_queries(spark, sf_dir), corpus(spark, sf_dir), k=10)


@register("vector_search", sql=f"""
WITH {vec_cte()}
SELECT query_id, doc_id, score, rank FROM vs WHERE rank <= 10
""")
def vector_search(spark, sf_dir):
    return R.vector_search(query_vectors(spark, sf_dir), doc_vectors(spark, sf_dir), k=10,
                           docs=corpus(spark, sf_dir))


@register("hybrid_search", sql=f"""
WITH {bm25_cte()}, {vec_cte()},
f AS (
  SELECT coalesce(v.query_id, k.query_id) AS query_id, coalesce(v.doc_id, k.doc_id) AS doc_id,
         v.rank AS vector_rank, k.rank AS keyword_rank,
         coalesce(1.0 / (60.0 + v.rank), 0.0) + coalesce(1.0 / (60.0 + k.rank), 0.0) AS fused
  FROM (SELECT * FROM vs WHERE rank <= 20) v
  FULL OUTER JOIN (SELECT * FROM kw WHERE rank <= 20) k
    ON v.query_id = k.query_id AND v.doc_id = k.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, doc_id) AS rank FROM f)
SELECT query_id, doc_id, round(fused, 9) AS score, rank, vector_rank, keyword_rank
FROM r WHERE rank <= 10
""")
def hybrid_search(spark, sf_dir):
    return R.hybrid_search(search_queries(spark, sf_dir), query_vectors(spark, sf_dir),
                           corpus(spark, sf_dir), doc_vectors(spark, sf_dir), k=10)


@register("filtered_search", sql=f"""
WITH {bm25_cte("WHERE lang = 'en'")}
SELECT query_id, doc_id, score, rank FROM kw WHERE rank <= 10
""")
def filtered_search(spark, sf_dir):
    return R.keyword_search(search_queries(spark, sf_dir), corpus(spark, sf_dir), k=10,
                            doc_filter=F.col("lang") == "en")


@register("filtered_vector_search", sql=f"""
WITH {vec_cte("WHERE lang = 'en' AND n_chars > 500")}
SELECT query_id, v.doc_id, score, rank, d.source, d.lang
FROM vs v JOIN documents d USING (doc_id) WHERE rank <= 10
""")
def filtered_vector_search(spark, sf_dir):
    """R11 as text and R13: filter, then exact search, then the chosen fields."""
    return R.vector_search(query_vectors(spark, sf_dir), doc_vectors(spark, sf_dir), k=10,
                           docs=corpus(spark, sf_dir), doc_filter="lang = 'en' AND n_chars > 500",
                           select_fields=["source", "lang"])


@register("filtered_hybrid_search", sql=f"""
WITH {bm25_cte("WHERE lang IN ('en', 'de') AND NOT n_chars < 300")}, {vec_cte("WHERE lang IN ('en', 'de') AND NOT n_chars < 300")},
f AS (
  SELECT coalesce(v.query_id, k.query_id) AS query_id, coalesce(v.doc_id, k.doc_id) AS doc_id,
         v.rank AS vector_rank, k.rank AS keyword_rank,
         coalesce(1.0 / (60.0 + v.rank), 0.0) + coalesce(1.0 / (60.0 + k.rank), 0.0) AS fused
  FROM (SELECT * FROM vs WHERE rank <= 20) v
  FULL OUTER JOIN (SELECT * FROM kw WHERE rank <= 20) k
    ON v.query_id = k.query_id AND v.doc_id = k.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, doc_id) AS rank FROM f)
SELECT query_id, doc_id, round(fused, 9) AS score, rank, vector_rank, keyword_rank
FROM r WHERE rank <= 10
""")
def filtered_hybrid_search(spark, sf_dir):
    """R11 as text on both legs of the hybrid search."""
    return R.hybrid_search(search_queries(spark, sf_dir), query_vectors(spark, sf_dir), corpus(spark, sf_dir),
                           doc_vectors(spark, sf_dir), k=10, doc_filter="lang IN ('en', 'de') AND NOT n_chars < 300")
