"""Persisted BM25 index for the search table (the postings and statistics
the service keeps for its searchable fields).

Layout under one folder:
  postings/  (doc_id, dl, term, tf) partitioned by ``bucket`` =
             pmod(xxhash64(term), n_buckets), so a query batch reads only
             the buckets of its own terms (partition pruning);
  df/        (term, df) partitioned the same way;
  stats/     one row (n_docs, avgdl, n_buckets).
Building tokenises the corpus once; querying never touches document text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import retrieval as R
from quarry.plans.sizing import BROADCAST_MAX_ROWS, bounded_count, fixed_broadcast

#: Term buckets at least, and text bytes from which there is one more.
MIN_BUCKETS = 64
BUCKET_BYTES = 1 << 30


def _bucket(col, n: int):
    return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")


def buckets_for(docs: DataFrame, text_col: str = "text") -> int:
    """Term buckets for a corpus: one for every ``BUCKET_BYTES`` of text, so a
    bucket's size does not grow with the corpus."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    return max(MIN_BUCKETS, -(-size // BUCKET_BYTES))


def write_postings(docs: DataFrame, path: str, n_buckets: int, text_col: str = "text") -> None:
    """(doc_id, dl, term, tf) by term bucket at ``path``; bucket -1 has a row with term
    NULL for each document, whose tf is the number of rows that are the document.
    Terms are counted inside their row, and only where ids repeat (a scan of the
    ids tells) do equal documents still have to meet in a shuffle of their own."""
    counts = T.term_counts(docs, ["doc_id"], T.words(text_col), marker=True)
    if not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        counts = counts.groupBy("doc_id", "dl", "term").agg(F.sum("tf").alias("tf"))
    bucket = F.when(F.col("term").isNotNull(), _bucket(F.col("term"), n_buckets)).otherwise(F.lit(-1))
    counts.withColumn("bucket", bucket).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def build_index(docs: DataFrame, path: str, n_buckets: int | None = None, text_col: str = "text") -> str:
    """Tokenise once, count each document's terms where it stands, write postings
    by term bucket (``n_buckets`` of them, by default sized from the corpus; a
    bucket with a frequent term is split over files), one shuffle, then derive df and corpus
    statistics from the written postings (one row per document with term NULL
    carries its length)."""
    n_buckets = n_buckets or buckets_for(docs, text_col)
    write_postings(docs, f"{path}/postings", n_buckets, text_col)
    spark = docs.sparkSession
    post = spark.read.parquet(f"{path}/postings")
    (post.filter(F.col("bucket") >= 0).groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df"))
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/df"))
    (post.filter(F.col("bucket") == -1)
     .agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.col("dl").cast("double")).alias("avgdl"))
     .withColumn("n_buckets", F.lit(n_buckets))
     .write.mode("overwrite").parquet(f"{path}/stats"))
    return path


def keyword_search_index(queries: DataFrame, path: str, k: int | None = None,
                         k1: float = R.BM25_K1, b: float = R.BM25_B, query_col: str = "query") -> DataFrame:
    """R4 over a built index: read only the term buckets of the query
    vocabulary, weight postings with the stored df and statistics, score
    with the same block scorer as the on-the-fly path."""
    k = R._check_k(k)
    spark: SparkSession = queries.sparkSession
    stats = spark.read.parquet(f"{path}/stats")
    n_buckets = int(stats.select("n_buckets").first()[0])
    qt = R.query_terms(queries, query_col)
    small = bounded_count(qt, BROADCAST_MAX_ROWS) <= BROADCAST_MAX_ROWS
    buckets = sorted({r[0] for r in qt.select(_bucket(F.col("term"), n_buckets)).distinct().collect()})
    vocab = qt.select("term").distinct()
    hint = F.broadcast if small else (lambda x: x)
    post = (spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin(buckets))
            .join(hint(vocab), "term", "left_semi"))
    dft = (spark.read.parquet(f"{path}/df").filter(F.col("bucket").isin(buckets))
           .join(hint(vocab), "term", "left_semi").select("term", "df"))
    idf = F.log(1.0 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + k1 * (1.0 - b + b * F.col("dl") / F.col("avgdl"))
    w = (post.join(hint(dft), "term").crossJoin(fixed_broadcast(stats.select("n_docs", "avgdl")))
         .select("doc_id", "term", (idf * F.col("tf") * (k1 + 1.0) / norm).alias("w")))
    scored = R.score_weights(qt, w, small, k)
    scored = scored.select("query_id", "doc_id", F.round("raw", R.SCORE_DIGITS).alias("score"))
    return R.top_k_per_query(scored, k)
