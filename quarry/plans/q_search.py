"""Search-table lifecycle and result-shaping queries, embeddings helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions import vectors as VX
from quarry.operators import retrieval as R
from quarry.plans import sqlfrag as Q
from quarry.plans.catalog import ORACLE, register
from quarry.plans.q_retrieval import bm25_cte, vec_cte
from quarry.plans.sizing import spread
from quarry.sources import search_table as S
from quarry.sources.tables import corpus, doc_vectors, query_vectors, search_queries, table

DIMS = 64  # vector length of the embeddings table


def search_docs(spark, sf_dir):
    """Documents (+ their vectors) conformed to the search-table schema."""
    d = corpus(spark, sf_dir).join(doc_vectors(spark, sf_dir), "doc_id", "left")
    rows = d.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"),
                    F.substring_index("text", "\n", 1).alias("title"), "source",
                    F.col("lang").alias("category"), F.col("embedding").alias("content_vector"),
                    F.lit(1).alias("version"))
    return S.conform(rows, DIMS)


@register("search_table", sql="""
SELECT CAST(d.doc_id AS VARCHAR) AS id, length(split_part(d.text, chr(10), 1)) AS title_chars, d.source,
       d.lang AS category, coalesce(len(e.embedding), 0) AS vector_dims,
       (e.embedding IS NULL OR len(e.embedding) = 64) AS valid
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id
""")
def search_table(spark, sf_dir):
    t = search_docs(spark, sf_dir)
    return t.select("id", F.length("title").cast("long").alias("title_chars"), "source", "category",
                    F.coalesce(F.size("content_vector"), F.lit(0)).cast("long").alias("vector_dims"), "valid")


def _updates(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("id"), F.col("url").alias("content"),
        F.col("url").alias("title"), F.lit("web").alias("source"), F.lit(1).alias("version"))
    refreshed = (corpus(spark, sf_dir).join(doc_vectors(spark, sf_dir), "doc_id")
                 .select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"),
                         F.substring_index("text", "\n", 1).alias("title"), "source",
                         F.lit("refreshed").alias("category"), F.col("embedding").alias("content_vector"),
                         F.lit(2).alias("version")))
    return S.conform(pages.unionByName(refreshed, allowMissingColumns=True), DIMS)


@register("upsert_documents", sql="""
WITH base AS (SELECT CAST(doc_id AS VARCHAR) AS id, 1 AS version, lang AS category FROM documents),
upd AS (SELECT 'page-' || CAST(page_id AS VARCHAR) AS id, 1 AS version, CAST(NULL AS VARCHAR) AS category FROM pages
        UNION ALL
        SELECT CAST(d.doc_id AS VARCHAR), 2, 'refreshed' FROM documents d
        WHERE d.doc_id IN (SELECT vec_id FROM embeddings))
SELECT * FROM base WHERE id NOT IN (SELECT id FROM upd)
UNION ALL SELECT * FROM upd
""")
def upsert_documents(spark, sf_dir):
    new, _ = S.upsert(search_docs(spark, sf_dir), _updates(spark, sf_dir))
    return new.select("id", "version", "category")


@register("upsert_counts", sql="""
WITH upd AS (SELECT 'page-' || CAST(page_id AS VARCHAR) AS id FROM pages
             UNION ALL SELECT CAST(d.doc_id AS VARCHAR) FROM documents d WHERE d.doc_id IN (SELECT vec_id FROM embeddings)
             UNION ALL SELECT CASE WHEN c_acctbal >= 0 THEN 'customer-' || CAST(c_custkey AS VARCHAR) END FROM customer)
SELECT count(DISTINCT id) AS succeeded, count(*) FILTER (id IS NULL) AS failed FROM upd
""")
def upsert_counts(spark, sf_dir):
    """S3 counts: the update batch with customers beside it, of whom those in
    debt have no id and fail."""
    owners = S.conform(table(spark, sf_dir, "customer").select(
        F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("customer-"), F.col("c_custkey").cast("string"))).alias("id"),
        F.col("c_name").alias("content"), F.lit("crm").alias("source"), F.lit(1).alias("version")), DIMS)
    _, counts = S.upsert(search_docs(spark, sf_dir), _updates(spark, sf_dir).unionByName(owners))
    return counts


@register("delete_documents", sql="""
WITH ids AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id FROM labels WHERE toxic = 1),
t AS (SELECT CAST(doc_id AS VARCHAR) AS id FROM documents)
SELECT (SELECT count(*) FROM t WHERE id IN (SELECT id FROM ids)) AS deleted,
       (SELECT count(*) FROM t WHERE id NOT IN (SELECT id FROM ids)) AS remaining
""")
def delete_documents(spark, sf_dir):
    ids = table(spark, sf_dir, "labels").filter(F.col("toxic") == 1).select(F.col("doc_id").cast("string").alias("id"))
    remaining, deleted = S.delete(search_docs(spark, sf_dir), ids)
    return deleted.crossJoin(remaining.agg(F.count(F.lit(1)).alias("remaining")))


@register("index_stats", sql="""
SELECT count(*) AS document_count,
       CAST(coalesce(sum(strlen(CAST(d.doc_id AS VARCHAR)) + coalesce(strlen(d.text), 0)
                         + coalesce(strlen(split_part(d.text, chr(10), 1)), 0) + coalesce(strlen(d.source), 0)
                         + coalesce(strlen(d.lang), 0) + 4 * coalesce(len(e.embedding), 0)), 0) AS BIGINT)
         AS storage_size_bytes,
       'search' AS index_name
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id
""")
def index_stats(spark, sf_dir):
    return S.stats(search_docs(spark, sf_dir))


# ------------------------------------------------------ result shaping

HYBRID_CTE = f"""
{bm25_cte()}, {vec_cte()},
f AS (
  SELECT coalesce(v.query_id, k.query_id) AS query_id, coalesce(v.doc_id, k.doc_id) AS doc_id,
         coalesce(1.0 / (60.0 + v.rank), 0.0) + coalesce(1.0 / (60.0 + k.rank), 0.0) AS fused
  FROM (SELECT * FROM vs WHERE rank <= 20) v
  FULL OUTER JOIN (SELECT * FROM kw WHERE rank <= 20) k ON v.query_id = k.query_id AND v.doc_id = k.doc_id),
hy AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, doc_id) AS rank
                      FROM f) WHERE rank <= 10)
"""


def _cov(needle: str, hay: str) -> str:
    return Q.ratio(f"len(list_intersect({needle}, {hay}))", f"len({needle})")


RERANK_CTE = f"""
{HYBRID_CTE},
qw AS (SELECT item_id AS query_id, list_distinct({Q.words('text')}) AS qw FROM benchmark),
dd AS (SELECT doc_id, list_distinct({Q.words("split_part(text, chr(10), 1)")}) AS tw,
              list_distinct({Q.words('text')}) AS cw, list_distinct({Q.words('lang')}) AS gw FROM documents),
rr AS (
  SELECT h.query_id, h.doc_id, h.rank, round(h.fused, 9) AS score,
         round(4.0 * (0.0 + 2.0 * {_cov('qw', 'tw')} + 1.0 * {_cov('qw', 'cw')} + 1.0 * {_cov('qw', 'gw')}) / 4.0, 6)
           AS reranker_score
  FROM hy h JOIN qw USING (query_id) JOIN dd USING (doc_id))
"""


def _reranked(spark, sf_dir):
    hits = R.hybrid_search(search_queries(spark, sf_dir), query_vectors(spark, sf_dir),
                           corpus(spark, sf_dir), doc_vectors(spark, sf_dir), k=10)
    docs = corpus(spark, sf_dir).select("doc_id", "text", F.substring_index("text", "\n", 1).alias("title"),
                                        F.col("lang").alias("category"))
    return R.rerank(hits.select("query_id", "doc_id", "score", "rank"), search_queries(spark, sf_dir), docs)


@register("rerank", sql=f"""
WITH {RERANK_CTE}
SELECT query_id, doc_id, rank, reranker_score FROM rr
""")
def rerank(spark, sf_dir):
    return _reranked(spark, sf_dir).select("query_id", "doc_id", "rank", "reranker_score")


@register("result_order", sql=f"""
WITH {RERANK_CTE}
SELECT query_id, doc_id, reranker_score,
       row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN reranker_score > 0 THEN reranker_score
                                                              ELSE score END DESC, rank) AS final_rank
FROM rr
""")
def result_order(spark, sf_dir):
    out = R.result_order(_reranked(spark, sf_dir))
    return out.select("query_id", "doc_id", "reranker_score", "final_rank")


CAPTIONS_CTE = f"""
{bm25_cte()},
hits AS (SELECT query_id, doc_id FROM kw WHERE rank <= 10),
qw AS (SELECT item_id AS query_id, list_distinct({Q.words('text')}) AS qw FROM benchmark),
se AS (SELECT doc_id, UNNEST(s) AS sentence, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS sent_no
       FROM (SELECT doc_id, {Q.sentences('text')} AS s FROM documents
             WHERE doc_id IN (SELECT doc_id FROM hits))),
sc AS (SELECT h.query_id, h.doc_id, se.sentence, se.sent_no,
              len(list_intersect(qw.qw, list_distinct({Q.words('se.sentence')}))) AS overlap
       FROM hits h JOIN qw USING (query_id) JOIN se USING (doc_id)),
caps AS (SELECT query_id, doc_id, sentence AS caption, overlap FROM (
           SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY overlap DESC, sent_no) AS r
           FROM sc WHERE overlap > 0) WHERE r = 1)
"""


def _captions(spark, sf_dir):
    qs, docs = search_queries(spark, sf_dir), corpus(spark, sf_dir)
    hits = R.keyword_search(qs, spread(docs.select("doc_id", "text")), k=10)
    return R.captions(hits, qs, docs)


@register("captions", sql=f"""
WITH {CAPTIONS_CTE}
SELECT query_id, doc_id, caption, overlap FROM caps
""")
def captions(spark, sf_dir):
    return _captions(spark, sf_dir).select("query_id", "doc_id", "caption",
                                           F.col("overlap").cast("long").alias("overlap"))


@register("answers", sql=f"""
WITH {CAPTIONS_CTE}
SELECT query_id, caption AS answer, doc_id AS answer_doc_id FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, doc_id) AS r FROM caps) WHERE r = 1
""")
def answers(spark, sf_dir):
    return R.answers(_captions(spark, sf_dir))


@register("hit_passages", sql=f"""
WITH {CAPTIONS_CTE},
top3 AS (SELECT * FROM sc WHERE overlap > 0
         QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY overlap DESC, sent_no) <= 3),
c AS (SELECT query_id, doc_id, string_agg(sentence, chr(10) ORDER BY overlap DESC, sent_no) AS captions,
             count(*) AS n_captions FROM top3 GROUP BY ALL),
a AS (SELECT query_id, string_agg(sentence, chr(10) ORDER BY overlap DESC, doc_id, sent_no) AS answers FROM (
        SELECT * FROM top3 QUALIFY row_number() OVER (
          PARTITION BY query_id ORDER BY overlap DESC, doc_id, sent_no) <= 3) GROUP BY query_id)
SELECT k.query_id, k.doc_id, k.rank, coalesce(c.n_captions, 0) AS n_captions,
       coalesce(c.captions, '') AS captions, coalesce(a.answers, '') AS answers
FROM (SELECT * FROM kw WHERE rank <= 10) k LEFT JOIN c USING (query_id, doc_id) LEFT JOIN a USING (query_id)
""")
def hit_passages(spark, sf_dir):
    qs, docs = search_queries(spark, sf_dir), corpus(spark, sf_dir)
    out = R.hit_passages(R.keyword_search(qs, docs, k=10), qs, docs)
    return out.select("query_id", "doc_id", "rank", F.size("captions").cast("long").alias("n_captions"),
                      F.array_join("captions", "\n").alias("captions"), F.array_join("answers", "\n").alias("answers"))


@register("facets", sql=f"""
WITH {bm25_cte()},
hits AS (SELECT query_id, doc_id FROM kw_raw),
l AS (SELECT h.query_id, 'source' AS facet, d.source AS value FROM hits h JOIN documents d USING (doc_id)
      UNION ALL
      SELECT h.query_id, 'lang', d.lang FROM hits h JOIN documents d USING (doc_id)),
c AS (SELECT query_id, facet, value, count(*) AS n FROM l GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, facet ORDER BY n DESC, value) AS facet_rank FROM c)
WHERE facet_rank <= 10
""")
def facets(spark, sf_dir):
    qs, docs = search_queries(spark, sf_dir), corpus(spark, sf_dir)
    return R.facets(R.matched_set(qs, docs), docs, ["source", "lang"])


@register("search_table_hybrid", sql=f"""
WITH {bm25_cte()}, {vec_cte()},
v AS (SELECT query_id, CAST(doc_id AS VARCHAR) AS id, row_number() OVER (
        PARTITION BY query_id ORDER BY round(raw, 6) DESC, CAST(doc_id AS VARCHAR)) AS vr FROM vs_raw),
k AS (SELECT query_id, CAST(doc_id AS VARCHAR) AS id, row_number() OVER (
        PARTITION BY query_id ORDER BY round(raw, 6) DESC, CAST(doc_id AS VARCHAR)) AS kr FROM kw_raw),
legs AS (SELECT query_id, id, vr, NULL AS kr FROM v WHERE vr <= 20
         UNION ALL SELECT query_id, id, NULL, kr FROM k WHERE kr <= 20),
g AS (SELECT query_id, id, coalesce(1.0 / (60.0 + max(vr)), 0.0) + coalesce(1.0 / (60.0 + max(kr)), 0.0) AS fused
      FROM legs GROUP BY query_id, id)
SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, id) AS rank FROM g)
WHERE rank <= 10
""")
def search_table_hybrid(spark, sf_dir):
    """R6 over the search table itself, whose ids are strings."""
    t = search_docs(spark, sf_dir)
    docs = t.select(F.col("id").alias("doc_id"), F.col("content").alias("text"))
    vecs = t.filter(F.col("content_vector").isNotNull()).select(F.col("id").alias("doc_id"),
                                                               F.col("content_vector").alias("embedding"))
    hits = R.hybrid_search(search_queries(spark, sf_dir), query_vectors(spark, sf_dir), docs, vecs, k=10)
    return hits.select("query_id", F.col("doc_id").alias("id"), "rank")


@register("sorted_listing", sql="""
SELECT doc_id, n_chars FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 10
""")
def sorted_listing(spark, sf_dir):
    d = corpus(spark, sf_dir)
    return R.sorted_listing(d, [F.col("n_chars").desc(), F.col("doc_id").asc()], 10,
                            doc_filter=F.col("lang") == "en").select("doc_id", "n_chars")


@register("result_metadata", sql=f"""
WITH {bm25_cte()},
hits AS (SELECT kw.query_id, CAST(kw.doc_id AS VARCHAR) AS id, d.lang, d.n_chars
         FROM kw JOIN documents d USING (doc_id) WHERE kw.rank <= 10)
SELECT query_id, id, 'query_id' AS key, CAST(query_id AS VARCHAR) AS value FROM hits UNION ALL
SELECT query_id, id, 'lang', lang FROM hits UNION ALL
SELECT query_id, id, 'n_chars', CAST(n_chars AS VARCHAR) FROM hits
""")
def result_metadata(spark, sf_dir):
    qs, docs = search_queries(spark, sf_dir), corpus(spark, sf_dir)
    hits = docs.join(R.hit_side(R.keyword_search(qs, docs, k=10).select("query_id", "doc_id")), "doc_id").select(
        "query_id", F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"),
        "source", "lang", "n_chars")
    m = R.result_metadata(hits)
    return m.select("query_id", "id", F.explode("metadata").alias("key", "value"))


@register("rag_context", sql=f"""
WITH {bm25_cte()}
SELECT kw.query_id, md5(string_agg(d.text, chr(10) ORDER BY kw.rank)) AS context_md5,
       CAST(sum(length(d.text)) + count(*) - 1 AS BIGINT) AS context_chars
FROM kw JOIN documents d USING (doc_id) WHERE kw.rank <= 5 GROUP BY kw.query_id
""")
def rag_context(spark, sf_dir):
    qs, docs = search_queries(spark, sf_dir), corpus(spark, sf_dir)
    ctx = R.rag_context(R.keyword_search(qs, docs, k=5), docs)
    return ctx.select("query_id", F.md5("context").alias("context_md5"),
                      F.length("context").cast("long").alias("context_chars"))


@register("keyword_boolean", sql=f"""
WITH {bm25_cte()},
dt AS (SELECT doc_id, UNNEST(toks) AS term, generate_subscripts(toks, 1) - 1 AS pos FROM d),
qt AS (SELECT item_id AS query_id, {Q.words('text')} AS t FROM benchmark),
cons AS (SELECT query_id, t[1] AS must, t[len(t)] AS mustnot, t[2] AS p1, t[3] AS p2 FROM qt),
hm AS (SELECT DISTINCT c.query_id, dt.doc_id FROM cons c JOIN dt ON dt.term = c.must),
hn AS (SELECT DISTINCT c.query_id, dt.doc_id FROM cons c JOIN dt ON dt.term = c.mustnot),
hp AS (SELECT DISTINCT c.query_id, a.doc_id FROM cons c JOIN dt a ON a.term = c.p1
       JOIN dt b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 AND b.term = c.p2),
ok AS (SELECT query_id, doc_id, raw FROM kw_raw
       WHERE (query_id, doc_id) IN (SELECT query_id, doc_id FROM hm)
         AND (query_id, doc_id) NOT IN (SELECT query_id, doc_id FROM hn)
         AND (query_id, doc_id) IN (SELECT query_id, doc_id FROM hp))
SELECT * FROM (SELECT query_id, doc_id, round(raw, 6) AS score,
                      row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 6) DESC, doc_id) AS rank FROM ok)
WHERE rank <= 10
""")
def keyword_boolean(spark, sf_dir):
    """R5 with per-query constraints derived from the query text: the first
    word is required, the last word excluded, words 2-3 form a phrase."""
    qs = search_queries(spark, sf_dir)
    w = T.words("query")
    q = qs.select("query_id", "query", F.element_at(w, 1).alias("must"), F.element_at(w, -1).alias("must_not"),
                  F.concat_ws(" ", F.try_element_at(w, F.lit(2)), F.try_element_at(w, F.lit(3))).alias("phrase"))
    return R.keyword_boolean(q, corpus(spark, sf_dir), k=10)


# ------------------------------------------------------------ embeddings

@register("embed_reduce", sql="""
WITH r AS (SELECT vec_id, CAST(embedding AS DOUBLE[])[1:16] AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nv FROM r)
SELECT vec_id, len(v) AS dims, round(v[1] / nv, 6) AS v1,
       round(sqrt(list_sum(list_transform(v, lambda x: (x / nv) * (x / nv)))), 6) AS norm
FROM n
""")
def embed_reduce(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", VX.reduce_dims("embedding", 16).alias("v"))
    return e.select("vec_id", F.size("v").cast("long").alias("dims"), F.round(F.get("v", 0), 6).alias("v1"),
                    F.round(VX.norm("v"), 6).alias("norm"))


@register("embed_dims", sql="""
SELECT vec_id, coalesce(len(embedding), 0) AS dims, coalesce(len(embedding) = 64, false) AS valid FROM embeddings
""")
def embed_dims(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    d = F.coalesce(F.size("embedding"), F.lit(0)).cast("long")
    return e.select("vec_id", d.alias("dims"), F.coalesce(F.size("embedding") == DIMS, F.lit(False)).alias("valid"))


@register("cosine_clamped", sql="""
SELECT a.vec_id,
       round(greatest(0.0, least(1.0, coalesce(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))
             / NULLIF(sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])))
                      * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 0), 0.0))), 6)
         AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")
def cosine_clamped(spark, sf_dir):
    """E4 between each vector and the next vector id (a 1:1 equi-join)."""
    e = table(spark, sf_dir, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("nxt"))
    return e.join(b, "vec_id").select("vec_id", F.round(VX.cosine_clamped("embedding", "nxt"), 6).alias("similarity"))


@register("keyword_search_indexed", sql=ORACLE["keyword_search"])
def keyword_search_indexed(spark, sf_dir):
    """R4 through the persisted index (S2): build the bucketed postings
    once under the shared folder, then answer the query batch from the
    buckets of its terms only."""
    from quarry.plans.sizing import shared_path
    from quarry.sources import search_index as SI
    docs = corpus(spark, sf_dir).select("doc_id", "text")
    path = SI.build_index(spread(docs), shared_path(spark, "bm25-index"), SI.buckets_for(docs))
    return SI.keyword_search_index(search_queries(spark, sf_dir), path, k=10)
