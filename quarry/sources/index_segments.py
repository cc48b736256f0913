"""A BM25 index kept up by upserts and deletes (S3, S4 on R4).

Every change writes one new segment and touches no file of an earlier one:

  postings/segment=s/bucket=b  (doc_id, dl, term, tf) of the segment's documents;
                               bucket -1 (term NULL) names them, and is read once to write
  docs/segment=s               (doc_id, dl)
  tombstones/segment=s         (doc_id): what older segments hold of it is dead
  merged/segment=s             (bucket): older segments of the bucket are replaced
  commits/segment=s            (n_docs, total_len, n_buckets), written last

A segment without its commit row is not there: a job that dies leaves the index
as it was, and its next try writes the same segment number again. Statistics
are carried from commit to commit (documents and lengths replaced are taken
off, new ones added), and document frequencies are counted from the live
postings of the query's terms, so results equal those of an index built anew.

``compact`` rewrites the live postings of those buckets that hold dead rows or
rows of several segments, into a new segment; other buckets stay as they are.
One writer at a time; readers may run beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import retrieval as R
from quarry.plans.sizing import BROADCAST_MAX_ROWS, bounded_count, broadcast_if_bounded, fixed_broadcast, materialize
from quarry.sources.search_index import _bucket, buckets_for, write_postings


class Segments:
    """What is committed: numbers, statistics, bucket count."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        rows = spark.read.parquet(f"{path}/commits").orderBy("segment").collect()    # a row a change
        self.numbers = [r["segment"] for r in rows]
        self.last, last = self.numbers[-1], rows[-1]
        self.n_docs, self.total_len, self.n_buckets = last["n_docs"], last["total_len"], last["n_buckets"]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}").filter(F.col("segment").isin(self.numbers))

    def _alive(self, rows: DataFrame) -> DataFrame:
        dead = self.table("tombstones").groupBy("doc_id").agg(F.max("segment").alias("__dead"))
        return rows.join(dead, "doc_id", "left").filter("__dead IS NULL OR segment >= __dead").drop("__dead")

    def docs(self) -> DataFrame:
        return self._alive(self.table("docs"))

    def current(self, buckets: list[int] | None = None) -> DataFrame:
        """Postings that no compaction has replaced, dead ones included."""
        rows = self.table("postings").filter("bucket >= 0")
        if buckets is not None:
            rows = rows.filter(F.col("bucket").isin(buckets))
        merged = self.table("merged").groupBy("bucket").agg(F.max("segment").alias("__from"))    # a row a bucket at most
        return rows.join(F.broadcast(merged), "bucket", "left").filter("__from IS NULL OR segment >= __from").drop("__from")

    def postings(self, buckets: list[int] | None = None) -> DataFrame:
        return self._alive(self.current(buckets))


def _commit(spark, path: str, segment: int, n_docs: int, total_len: int, n_buckets: int) -> None:
    spark.createDataFrame([(n_docs, total_len, n_buckets)], "n_docs long, total_len long, n_buckets int") \
        .coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/segment={segment}")


def _write(path: str, segment: int, docs: DataFrame, dead: DataFrame, n_buckets: int, text_col: str) -> DataFrame:
    """The files of a segment; returns its documents as written."""
    at = f"{path}/postings/segment={segment}"
    write_postings(docs, at, n_buckets, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    named = docs.sparkSession.read.schema(f"doc_id {kind}, dl int, tf long, bucket int").parquet(at).filter("bucket = -1")
    named.select("doc_id", "dl", F.explode(F.array_repeat(F.lit(0), F.col("tf").cast("int")))).select("doc_id", "dl") \
        .write.mode("overwrite").parquet(f"{path}/docs/segment={segment}")
    dead.select("doc_id").distinct().write.mode("overwrite").parquet(f"{path}/tombstones/segment={segment}")
    _merged(docs.sparkSession, [], path, segment)
    return docs.sparkSession.read.parquet(f"{path}/docs/segment={segment}")


def _merged(spark, buckets: list[int], path: str, segment: int) -> None:
    spark.createDataFrame([(b,) for b in buckets], "bucket int").coalesce(1).write.mode("overwrite").parquet(f"{path}/merged/segment={segment}")


def _totals(docs: DataFrame) -> tuple[int, int]:
    r = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("dl").cast("long")), F.lit(0)).alias("s")).first()
    return int(r["n"]), int(r["s"])


def create(docs: DataFrame, path: str, n_buckets: int | None = None, text_col: str = "text") -> str:
    """A new index at ``path`` over ``docs`` (one row an id; rows without an id are left out)."""
    docs = docs.filter("doc_id IS NOT NULL")
    n_buckets = n_buckets or buckets_for(docs, text_col)
    n, total = _totals(_write(path, 0, docs, docs.limit(0), n_buckets, text_col))
    _commit(docs.sparkSession, path, 0, n, total, n_buckets)
    return path


def apply(path: str, upserts: DataFrame, deletes: DataFrame | None = None, text_col: str = "text") -> int:
    """One change: documents to add or replace (one row an id) and ids to
    delete. An id in both is replaced. Returns the segment's number."""
    spark = upserts.sparkSession
    at = Segments(spark, path)
    segment = at.last + 1
    upserts = upserts.filter("doc_id IS NOT NULL")
    ids = upserts.select("doc_id")
    if deletes is not None:
        ids = ids.unionByName(deletes.select("doc_id").filter("doc_id IS NOT NULL"))
    new = _write(path, segment, upserts, ids, at.n_buckets, text_col)
    gone = spark.read.parquet(f"{path}/tombstones/segment={segment}")
    (n_new, len_new), (n_old, len_old) = _totals(new), _totals(at.docs().join(gone.select("doc_id"), "doc_id", "left_semi"))
    _commit(spark, path, segment, at.n_docs - n_old + n_new, at.total_len - len_old + len_new, at.n_buckets)
    return segment


def compact(spark: SparkSession, path: str) -> list[int]:
    """Merge the buckets that hold dead rows or rows of several segments;
    returns them. Their older files are no longer read."""
    at = Segments(spark, path)
    now, live = at.current(), at.postings()
    facts = now.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("segment").alias("s"))
    kept = live.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"))
    todo = sorted(r["bucket"] for r in facts.join(kept, "bucket", "left").filter("s > 1 OR k IS NULL OR k < n").collect())
    if not todo:
        return []
    segment = at.last + 1
    rows = at.postings(todo).select("doc_id", "dl", "term", "tf", "bucket")
    rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/segment={segment}")
    at.table("docs").limit(0).select("doc_id", "dl").write.mode("overwrite").parquet(f"{path}/docs/segment={segment}")
    at.table("tombstones").limit(0).select("doc_id").write.mode("overwrite").parquet(f"{path}/tombstones/segment={segment}")
    _merged(spark, todo, path, segment)
    _commit(spark, path, segment, at.n_docs, at.total_len, at.n_buckets)
    return todo


def search(queries: DataFrame, path: str, k: int | None = None, k1: float = R.BM25_K1, b: float = R.BM25_B,
           query_col: str = "query") -> DataFrame:
    """R4 over the live documents: (query_id, doc_id, score, rank)."""
    k = R._check_k(k)
    at = Segments(queries.sparkSession, path)
    qt = materialize(R.query_terms(queries, query_col), "segment-terms")
    small = bounded_count(qt, BROADCAST_MAX_ROWS) <= BROADCAST_MAX_ROWS
    buckets = sorted(r[0] for r in qt.select(_bucket(F.col("term"), at.n_buckets)).distinct().collect())    # n_buckets at most
    post = materialize(at.postings(buckets).join(broadcast_if_bounded(qt.select("term").distinct()), "term", "left_semi")
                       .select("doc_id", "dl", "term", "tf"), "segment-postings")
    dft = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = queries.sparkSession.createDataFrame([(at.n_docs, at.total_len / max(at.n_docs, 1))], "n_docs long, avgdl double")
    idf = F.log(1.0 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + k1 * (1.0 - b + b * F.col("dl") / F.col("avgdl"))
    w = (post.join(broadcast_if_bounded(dft), "term").crossJoin(fixed_broadcast(stats))
         .select("doc_id", "term", (idf * F.col("tf") * (k1 + 1.0) / norm).alias("w")))
    scored = R.score_weights(qt, w, small, k).select("query_id", "doc_id", F.round("raw", R.SCORE_DIGITS).alias("score"))
    return R.top_k_per_query(scored, k)
