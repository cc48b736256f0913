"""Retrieval: BM25 keyword search, exact and approximate vector search,
reciprocal-rank fusion, reranking, result shaping.

Conventions: a *queries* frame has ``query_id`` plus ``query`` (text) and/or
``embedding``; a *docs* frame has ``doc_id`` and ``text``; a *vectors* frame
has ``doc_id`` and ``embedding``. Ranked outputs are (query_id, doc_id,
score, rank) with rank starting at 1, scores rounded to 6 decimals and ties
broken by doc_id, so every engine produces the same order.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from quarry.functions import text as T
from quarry.plans.sizing import (BROADCAST_MAX_ROWS, bounded_count, broadcast_if_bounded,
                                 fixed_broadcast, materialize)

# Fixed values (published defaults): BM25 k1/b (Robertson & Zaragoza 2009),
# RRF constant 60 (Cormack et al. 2009), default top_k 10.
BM25_K1 = 1.2
BM25_B = 0.75
RRF_K = 60
DEFAULT_TOP_K = 10

SCORE_DIGITS = 6


def _check_k(k: int | None) -> int:
    if k is None:
        return DEFAULT_TOP_K
    if k <= 0:
        raise ValueError(f"top_k must be positive, got {k}")
    return k


def filtered(docs: DataFrame, doc_filter: Column | str | None) -> DataFrame:
    """Documents that meet a filter, given as a Column or as text in
    Spark SQL (``"lang = 'en' AND n_chars > 500"``). It applies before ranking
    and reaches the scan; text that is no predicate over the documents'
    columns raises Spark's error when the search is built."""
    return docs if doc_filter is None else docs.filter(doc_filter)


def top_k_per_query(scored: DataFrame, k: int, score: str = "score",
                    key: str = "query_id", tie: str = "doc_id") -> DataFrame:
    """Keep the k best rows per key (score desc, tie asc), adding ``rank``.

    ``row_number() <= k`` is planned as WindowGroupLimit, applied partially
    before the shuffle, so a key with billions of candidates only moves k rows
    per input partition.
    """
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(tie).asc())
    return (scored.withColumn("rank", F.row_number().over(w).cast("long"))
            .filter(F.col("rank") <= k))


# --------------------------------------------------------------------------
# BM25 (R4, R5, R11)
# --------------------------------------------------------------------------

def query_terms(queries: DataFrame, query_col: str = "query") -> DataFrame:
    """(query_id, term): distinct word tokens of each query."""
    return T.explode_tokens(queries, ["query_id"], F.array_distinct(T.words(query_col)))


def doc_terms(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, dl, pos, term): every token occurrence with its document length."""
    return T.explode_tokens(docs, ["doc_id"], T.words(text_col), with_len="dl", with_pos="pos")


def _neighbours(df: DataFrame, key: str, tokens: str, pos: str) -> DataFrame:
    """(key, pos, term, before, after): every token with those beside it."""
    toks, none = F.col(tokens), F.array(F.lit(None).cast("string"))
    beside = F.arrays_zip(toks.alias("term"), F.concat(none, toks).alias("before"), F.slice(toks, F.lit(2), F.size(toks)).alias("after"))
    out = T.posexplode_once(df.filter(F.size(toks) > 0).select(key, beside.alias("__z")), [key], "__z", pos, "__v")
    return out.select(key, pos, "__v.*").filter("term IS NOT NULL")


def term_frequencies(docs: DataFrame, terms: DataFrame, text_col: str = "text",
                     broadcast_terms: bool = True) -> DataFrame:
    """(doc_id, dl, term, tf) restricted to ``terms`` (distinct term column),
    plus exactly one row per document with term NULL (the document marker).

    The document is tokenised once, and a NULL marker is appended to its tokens.
    Tokens not in the (broadcast) query vocabulary go before anything is
    aggregated. The same aggregate then feeds the corpus statistics (marker
    rows), document frequencies and term frequencies.
    """
    vocab = terms.select("term").distinct().withColumn("__q", F.lit(True))
    if broadcast_terms:
        vocab = F.broadcast(vocab)
    staged = docs.select("doc_id", F.coalesce(T.words(text_col), F.array().cast("array<string>"))
                         .alias("__toks"))
    staged = staged.select("doc_id", F.size("__toks").alias("dl"),
                           F.concat("__toks", F.array(F.lit(None).cast("string"))).alias("__toks"))
    occ = staged.select("doc_id", "dl", F.explode_outer("__toks").alias("term"))
    occ = occ.join(vocab, "term", "left").filter(F.col("term").isNull() | F.col("__q"))
    return occ.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def _bm25_weights(queries: DataFrame, docs: DataFrame, k1: float, b: float, query_col: str,
                  text_col: str):
    """(qt, w, small): query terms, per-(doc, term) BM25 weights (query
    independent) and whether the query side passed the broadcast check."""
    qt = query_terms(queries, query_col)
    small = bounded_count(qt, BROADCAST_MAX_ROWS) <= BROADCAST_MAX_ROWS
    # One pass over the corpus; its small (doc, query term) aggregate is
    # written once and shared by the statistics, df and tf consumers.
    agg = materialize(term_frequencies(docs, qt, text_col, broadcast_terms=small), "bm25-tf")
    stats = agg.filter(F.col("term").isNull()).agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg(F.col("dl").cast("double")).alias("avgdl"))
    tf = agg.filter(F.col("term").isNotNull())
    df_ = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    hint = F.broadcast if small else (lambda x: x)
    idf = F.log(1.0 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + k1 * (1.0 - b + b * F.col("dl") / F.col("avgdl"))
    w = (tf.join(hint(df_), "term").crossJoin(fixed_broadcast(stats))  # stats: one row
         .select("doc_id", "term", (idf * F.col("tf") * (k1 + 1.0) / norm).alias("w")))
    return qt, w, small


def bm25_scores(queries: DataFrame, docs: DataFrame, k1: float = BM25_K1, b: float = BM25_B,
                query_col: str = "query", text_col: str = "text") -> DataFrame:
    """(query_id, doc_id, raw) for every doc sharing a term with a query.

    The per-(doc, term) weight is query-independent, so it is computed once
    before the join with the query terms multiplies rows by the number of
    queries sharing each term.
    """
    qt, w, small = _bm25_weights(queries, docs, k1, b, query_col, text_col)
    hint = F.broadcast if small else (lambda x: x)
    return w.join(hint(qt), "term").groupBy("query_id", "doc_id").agg(F.sum("w").alias("raw"))


# Largest query x term incidence matrix (uint8, broadcast) for the block scorer.
BLOCK_MAX_CELLS = 50_000_000


# Score-matrix cells (docs x queries) held at once by the block scorer.
BLOCK_SCORE_CELLS = 32_000_000


def _candidate_schema(queries: DataFrame, docs: DataFrame) -> ST.StructType:
    """(query_id, doc_id, raw) with the key types of the two sides."""
    return ST.StructType([ST.StructField("query_id", queries.schema["query_id"].dataType),
                          ST.StructField("doc_id", docs.schema["doc_id"].dataType),
                          ST.StructField("raw", ST.DoubleType())])


def _key_array(keys: list) -> np.ndarray:
    """Keys as a numpy array: integers as they are, any other type as objects."""
    if keys and isinstance(keys[0], int):
        return np.array(keys, dtype=np.int64)
    out = np.empty(len(keys), dtype=object)
    out[:] = keys
    return out


def _bm25_block_scorer(q_ids, term_index, inc, k: int):
    """Per partition (rows hash-partitioned and sorted by doc): dense
    doc-block x query scores = sum of w * incidence[term], rounded as the
    result is, then a local top-k per query in the final order (score, then
    id): k rows, however many documents tie.

    Arrow batches are streamed: the rows of the last document of a batch
    (which may continue in the next one) are carried over, so memory holds
    one batch plus one document, and the score matrix is built for blocks
    of at most ``BLOCK_SCORE_CELLS`` cells.
    """
    nq = inc.shape[1]
    doc_block = max(1, BLOCK_SCORE_CELLS // max(1, nq))
    row_step = max(1, 4_000_000 // max(1, nq))

    def score_rows(pdf):
        t_idx = pdf["term"].map(term_index).to_numpy()
        docs, d_idx = np.unique(pdf["doc_id"].to_numpy(), return_inverse=True)
        order = np.argsort(d_idx, kind="stable")
        d_idx, t_idx = d_idx[order], t_idx[order]
        wv = pdf["w"].to_numpy(dtype=np.float64)[order]
        cuts = np.searchsorted(d_idx, np.arange(0, len(docs) + doc_block, doc_block))
        for bi in range(len(cuts) - 1):
            r0, r1 = cuts[bi], cuts[bi + 1]
            if r0 >= r1:
                continue
            base = bi * doc_block
            nb = min(doc_block, len(docs) - base)
            scores = np.zeros((nb, nq))
            for lo in range(r0, r1, row_step):
                hi = min(r1, lo + row_step)
                d = d_idx[lo:hi] - base     # in order: a document's rows are one run
                first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
                scores[d[first]] += np.add.reduceat(wv[lo:hi, None] * inc[t_idx[lo:hi]], first, axis=0)
            out_q, out_d, out_s = [], [], []
            for j in range(nq):
                nz = np.nonzero(scores[:, j] > 0)[0]
                col = np.round(scores[:, j], SCORE_DIGITS)
                if len(nz) > k:
                    # documents stand in order of their ids: ties go to the first
                    kth = np.partition(col[nz], len(nz) - k)[len(nz) - k]
                    above = nz[col[nz] > kth]
                    nz = np.concatenate((above, nz[col[nz] == kth][:k - len(above)]))
                out_q.append(np.full(len(nz), q_ids[j], dtype=q_ids.dtype))
                out_d.append(docs[base + nz])
                out_s.append(col[nz])
            yield pd.DataFrame({"query_id": np.concatenate(out_q), "doc_id": np.concatenate(out_d),
                                "raw": np.concatenate(out_s)})

    def score(batches):
        carry = None
        for pdf in batches:
            if pdf.empty:
                continue
            if carry is not None:
                pdf = pd.concat([carry, pdf], ignore_index=True)
            last = pdf["doc_id"].iloc[-1]
            tail = pdf["doc_id"].to_numpy() == last
            carry = pdf[tail]
            head = pdf[~tail]
            if not head.empty:
                yield from score_rows(head)
        if carry is not None and not carry.empty:
            yield from score_rows(carry)

    return score


def bm25_top_candidates(queries: DataFrame, docs: DataFrame, k: int, k1: float = BM25_K1,
                        b: float = BM25_B, query_col: str = "query", text_col: str = "text") -> DataFrame:
    """(query_id, doc_id, raw): a superset of each query's BM25 top-k,
    scoring straight from the documents table (one corpus pass)."""
    qt, w, small = _bm25_weights(queries, docs, k1, b, query_col, text_col)
    return score_weights(qt, w, small, k)


def score_weights(qt: DataFrame, w: DataFrame, small: bool, k: int) -> DataFrame:
    """Sum per-(doc, term) weights over each query's terms, keeping a
    superset of the per-query top-k.

    When the query x term incidence matrix is within ``BLOCK_MAX_CELLS``
    (checked), the weights are hash-partitioned by document and each
    partition scores its documents against all queries with numpy (one
    dense block per partition, no per-(query, doc, term) rows), keeping a
    local top-k. Otherwise the join-and-aggregate plan is used.
    """
    if small:
        rows = qt.collect()  # bounded by BROADCAST_MAX_ROWS
        q_ids = sorted({r["query_id"] for r in rows})
        terms = sorted({r["term"] for r in rows})
        if q_ids and len(q_ids) * len(terms) <= BLOCK_MAX_CELLS:
            qpos = {q: i for i, q in enumerate(q_ids)}
            tpos = {t: i for i, t in enumerate(terms)}
            inc = np.zeros((len(terms), len(q_ids)), dtype=np.uint8)
            for r in rows:
                inc[tpos[r["term"]], qpos[r["query_id"]]] = 1.0
            bc = qt.sparkSession.sparkContext.broadcast((_key_array(q_ids), tpos, inc))

            def fn(batches, bc=bc):
                qi, tp, m = bc.value
                return _bm25_block_scorer(qi, tp, m, k)(batches)

            # Hash-partition by document (AQE may coalesce small partitions),
            # sorted so each document's rows arrive together.
            return (w.repartition("doc_id").sortWithinPartitions("doc_id")
                    .mapInPandas(fn, _candidate_schema(qt, w)))
    hint = F.broadcast if small else (lambda x: x)
    return w.join(hint(qt), "term").groupBy("query_id", "doc_id").agg(F.sum("w").alias("raw"))


def keyword_search(queries: DataFrame, docs: DataFrame, k: int | None = None,
                   doc_filter: Column | str | None = None, k1: float = BM25_K1, b: float = BM25_B,
                   query_col: str = "query", text_col: str = "text") -> DataFrame:
    """BM25 top-k per query. ``doc_filter`` is applied before ranking
    and before the corpus statistics, like a filtered index search. A document
    without an id cannot be named in a result, so it is never a hit (in any
    search); it still counts in the corpus statistics."""
    k = _check_k(k)
    docs = filtered(docs, doc_filter)
    scored = bm25_top_candidates(queries, docs, k + 1, k1, b, query_col, text_col)  # one may be of the NULL id
    scored = scored.filter(F.col("doc_id").isNotNull()).select(
        "query_id", "doc_id", F.round("raw", SCORE_DIGITS).alias("score"))
    return top_k_per_query(scored, k)


def keyword_boolean(queries: DataFrame, docs: DataFrame, k: int | None = None,
                    must: str | None = "must", must_not: str | None = "must_not",
                    phrase: str | None = "phrase", query_col: str = "query",
                    text_col: str = "text") -> DataFrame:
    """BM25 over the free terms, restricted to docs containing every
    ``must`` word, none of the ``must_not`` words and the ``phrase`` as
    consecutive tokens. Each of the three is a per-query STRING column (or
    NULL / missing for no constraint)."""
    k = _check_k(k)
    cols = set(queries.columns)
    qt, w, _ = _bm25_weights(queries, docs, BM25_K1, BM25_B, query_col, text_col)
    none = F.lit(None)

    def asked(role, words, off=none, before=none, after=none):
        return words.select("query_id", "term", F.lit(role).alias("role"), off.cast("int").alias("off"),
                            before.cast("string").alias("before"), after.cast("string").alias("after"))

    # What a query asks of a term, and what it needs: all its must words, and as
    # many words of its phrase at one start.
    roles, needs = asked("score", qt), []
    if must and must in cols:
        req = T.explode_tokens(queries, ["query_id"], F.array_distinct(T.words(must))).distinct()
        roles = roles.unionByName(asked("must", req))
        needs.append(req.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_req")))
    if must_not and must_not in cols:
        roles = roles.unionByName(asked("bad", T.explode_tokens(queries, ["query_id"], F.array_distinct(T.words(must_not))).distinct()))
    if phrase and phrase in cols:
        ph = queries.select("query_id", T.words(phrase).alias("ptoks")).filter(F.size("ptoks") > 0)
        roles = roles.unionByName(asked("phrase", _neighbours(ph, "query_id", "ptoks", "off"), F.col("off"), F.col("before"), F.col("after")))
        many = ph.groupBy("query_id").count().filter("count > 1").select(F.col("query_id").alias("__q"))
        roles = roles.join(broadcast_if_bounded(many), F.col("query_id").eqNullSafe(F.col("__q")) & (F.col("role") == "phrase"), "left_semi") \
            .withColumn("before", none.cast("string")).withColumn("after", none.cast("string")) \
            .unionByName(roles.join(broadcast_if_bounded(many), F.col("query_id").eqNullSafe(F.col("__q")) & (F.col("role") == "phrase"), "left_anti"))
        needs.append(ph.groupBy("query_id").agg(F.collect_set(F.size("ptoks")).alias("n_ph")))
    roles = materialize(roles, "boolean-roles")
    constrained = roles.filter("role <> 'score'").select("term").distinct()
    toks = docs.filter("doc_id IS NOT NULL").select("doc_id", T.words(text_col).alias("__toks"))
    occ = materialize(_neighbours(toks, "doc_id", "__toks", "pos")
                      .join(broadcast_if_bounded(constrained), "term", "left_semi"), "boolean-occ")
    # The constraints are judged first, on their words alone and dealt by document.
    # Must and excluded words count once a document; of a phrase's words only those
    # with the right neighbours are left before queries multiply them. Where a query
    # or a document comes more than once, all its words count, as they always did.
    twice = materialize(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "boolean-twice")
    dealt = occ.repartition("doc_id").join(broadcast_if_bounded(twice.withColumn("__many", F.lit(True))), "doc_id", "left") \
        .withColumn("__all", F.col("__many").isNotNull())
    words = roles.filter("role IN ('must', 'bad')").select("query_id", "term", "role")
    present = dealt.select("doc_id", "term").distinct().join(broadcast_if_bounded(words), "term").groupBy("query_id", "doc_id").agg(
        none.cast("int").alias("start"), F.sum((F.col("role") == "must").cast("int")).alias("have"),
        F.max((F.col("role") == "bad").cast("int")).alias("bad"), F.lit(0).cast("long").alias("m"))
    stands = roles.filter("role = 'phrase'").select("query_id", "off", F.col("term").alias("__t"), F.col("before").alias("__b"), F.col("after").alias("__a"))
    # A phrase occurs at start s when token s+off equals phrase term off for every off.
    beside = (F.col("__b").isNull() | (F.col("before") == F.col("__b"))) & (F.col("__a").isNull() | (F.col("after") == F.col("__a")))
    at = dealt.join(broadcast_if_bounded(stands), (F.col("term") == F.col("__t")) & (F.col("__all") | beside))
    starts = present.unionByName(at.groupBy("query_id", "doc_id", (F.col("pos") - F.col("off")).alias("start")).agg(
        F.lit(0).cast("long").alias("have"), F.lit(0).alias("bad"), F.count(F.lit(1)).alias("m")))
    for n in needs:
        starts = starts.join(broadcast_if_bounded(n), "query_id", "left")
    whole = F.array_contains("n_ph", F.col("m").cast("int")) if "n_ph" in starts.columns else F.lit(True)
    ask_ph = F.col("n_ph").isNotNull() if "n_ph" in starts.columns else F.lit(False)
    ask_req = F.coalesce(F.col("n_req"), F.lit(0)) if "n_req" in starts.columns else F.lit(0)
    judged = starts.groupBy("query_id", "doc_id").agg(
        F.max("bad").alias("bad"), (F.max("have") >= F.max(ask_req)).alias("has_all"),
        F.max(~ask_ph | (F.col("start").isNotNull() & whole)).alias("has_phrase"), F.max(ask_ph | (ask_req > 0)).alias("asks"))
    pairs = materialize(judged.filter("CASE WHEN asks THEN bad = 0 AND has_all AND has_phrase ELSE bad = 1 END")
                        .select("query_id", "doc_id", (F.col("bad") == 0).alias("hit")), "boolean-pairs")
    # A query that asks for words is scored in the documents that have them, any
    # other in all but those with an excluded word.
    asking = materialize(functools.reduce(DataFrame.unionByName, [n.select("query_id") for n in needs]).filter("query_id IS NOT NULL").distinct()
                         if needs else roles.select("query_id").limit(0), "boolean-asking")
    score = materialize(roles.filter("role = 'score'").select("query_id", "term").join(
        broadcast_if_bounded(asking.withColumn("asks", F.lit(True))), "query_id", "left"), "boolean-score")
    if score.filter("asks IS NULL").isEmpty():
        w = w.join(broadcast_if_bounded(pairs.select("doc_id").distinct()), "doc_id", "left_semi")
    judged = pairs.select(F.col("query_id").alias("__q"), F.col("doc_id").alias("__d"), "hit")
    scored = (w.repartition("doc_id").join(broadcast_if_bounded(score), "term").join(
        broadcast_if_bounded(judged), F.col("query_id").eqNullSafe(F.col("__q")) & F.col("doc_id").eqNullSafe(F.col("__d")), "left")
        .filter("CASE WHEN asks THEN hit ELSE hit IS NULL END"))
    scored = scored.groupBy("query_id", "doc_id").agg(F.sum("w").alias("raw")).filter("raw IS NOT NULL")
    scored = scored.select("query_id", "doc_id", F.round("raw", SCORE_DIGITS).alias("score"))
    return top_k_per_query(scored, k)


# --------------------------------------------------------------------------
# Exact vector search
# --------------------------------------------------------------------------

# Bytes of query vectors shipped to executors per block (float64 matrix).
QUERY_BLOCK_BYTES = 64 * 1024 * 1024


# Similarity-matrix cells (vectors x queries) computed at once.
SIM_BLOCK_CELLS = 16_000_000


def _best(found: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of each query in the final order (score, then id)."""
    ranked = found.sort_values(["q", "raw", "doc_id"], ascending=[True, False, True], na_position="first")
    return ranked.groupby("q", sort=False).head(k)


def _block_scorer(q_ids: np.ndarray, q_mat: np.ndarray, k: int):
    """Per-task scorer: cosine (rounded as the result is) of every vector
    against the query block, and one running top-k per query over all batches
    of the task. Ranking is the final one, by score and then id, so a task
    holds and hands on k rows a query, however many vectors tie. Batches are
    cut into row chunks so a similarity block stays under
    ``SIM_BLOCK_CELLS`` cells."""
    step = max(1, SIM_BLOCK_CELLS // max(1, q_mat.shape[0]))

    def chunk_top(m, ids, nrm):
        order = pd.Series(ids).sort_values(na_position="first").index.to_numpy()
        m, ids, nrm = m[order], ids[order], nrm[order]
        sims = np.round((m @ q_mat.T) / nrm[:, None], SCORE_DIGITS)  # query rows are unit length
        if len(ids) > k:
            kth = np.partition(sims, len(ids) - k, axis=0)[len(ids) - k]
            ties = sims == kth
            # rows stand in order of their ids: of those that tie, k are enough
            picked = (sims > kth) | (ties & (np.cumsum(ties, axis=0, dtype=np.int32) <= k))
        else:
            picked = np.ones(sims.shape, dtype=bool)
        row, q = np.nonzero(picked)
        return pd.DataFrame({"q": q, "doc_id": ids[row], "raw": sims[row, q]})

    def score(batches):
        held, size = [], 0
        for pdf in batches:
            if pdf.empty:
                continue
            vecs = pdf["embedding"].tolist()
            dims = np.fromiter((len(v) if v is not None else -1 for v in vecs), dtype=np.int64,
                               count=len(vecs))
            ok = dims == q_mat.shape[1]
            if not ok.any():
                continue
            m = np.stack([np.asarray(v, dtype=np.float64) for v, g in zip(vecs, ok) if g])
            ids = pdf["doc_id"].to_numpy()[ok]
            nrm = np.linalg.norm(m, axis=1)
            good = (nrm > 0) & np.isfinite(nrm)
            m, ids, nrm = m[good], ids[good], nrm[good]
            for lo in range(0, len(ids), step):
                held.append(chunk_top(m[lo:lo + step], ids[lo:lo + step], nrm[lo:lo + step]))
                size += len(held[-1])
                if len(held) > 1 and size > 4 * k * len(q_ids):
                    held = [_best(pd.concat(held, ignore_index=True), k)]
                    size = len(held[0])
        if held:
            best = _best(pd.concat(held, ignore_index=True), k)
            yield pd.DataFrame({"query_id": q_ids[best["q"].to_numpy()], "doc_id": best["doc_id"].to_numpy(),
                                "raw": best["raw"].to_numpy()})

    return score


def vector_candidates(queries: DataFrame, vectors: DataFrame, k: int,
                      block_bytes: int = QUERY_BLOCK_BYTES) -> DataFrame:
    """(query_id, doc_id, raw cosine) superset of the per-query top-k.

    The query set is split into blocks whose matrix fits ``block_bytes``;
    each block is collected (bounded), broadcast and scored against the
    vector table with one BLAS matrix product per Arrow batch. A task keeps
    one running top-k per query over all its batches. The vector table is
    scanned once per block and never shuffled before the top-k.

    A query meets vectors of its own length only: one of another length than
    the table's has no hits, whatever the other queries are. So have queries
    that are NULL, empty, zero or hold NULL or non-finite components.
    """
    spark = queries.sparkSession
    qv = queries.select("query_id", "embedding").filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    sizes = qv.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row a length
    schema = _candidate_schema(queries, vectors)
    vec = vectors.select("doc_id", "embedding")
    parts = []
    for d, n in sorted((r["d"], r["n"]) for r in sizes):
        same = qv.filter(F.size("embedding") == d)
        n_blocks = max(1, math.ceil(n / max(1, block_bytes // (8 * d))))
        for blk in range(n_blocks):
            part = same if n_blocks == 1 else same.filter(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == blk)
            rows = [r for r in part.collect() if None not in r["embedding"]]  # bounded by block_bytes
            if not rows:
                continue
            ids = _key_array([r["query_id"] for r in rows])
            mat = np.array([np.asarray(r["embedding"], dtype=np.float64) for r in rows])
            norms = np.linalg.norm(mat, axis=1)
            keep = (norms > 0) & np.isfinite(norms)
            ids, mat = ids[keep], mat[keep] / norms[keep][:, None]
            if len(ids) == 0:
                continue
            bc = spark.sparkContext.broadcast((ids, mat))

            def fn(batches, bc=bc):
                i, m = bc.value
                return _block_scorer(i, m, k)(batches)

            parts.append(vec.mapInPandas(fn, schema))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def vector_search(queries: DataFrame, vectors: DataFrame, k: int | None = None,
                  docs: DataFrame | None = None, doc_filter: Column | None = None,
                  select_fields: list[str] | None = None) -> DataFrame:
    """Exact cosine top-k per query, optional pre-filter (R11) on the
    documents table and field selection (R13)."""
    k = _check_k(k)
    if docs is not None:
        keep = filtered(docs, doc_filter)
        vectors = vectors.join(keep.select("doc_id"), "doc_id", "left_semi")
    cand = vector_candidates(queries, vectors, k)
    ranked = top_k_per_query(
        cand.select("query_id", "doc_id", F.round("raw", SCORE_DIGITS).alias("score")), k)
    if select_fields and docs is not None:
        ranked = ranked.join(docs.select("doc_id", *select_fields), "doc_id", "left")
    return ranked


# --------------------------------------------------------------------------
# Fusion, reranking and result order
# --------------------------------------------------------------------------

def rrf_fuse(*legs: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of ranked legs (query_id, doc_id, rank).

    Legs are FULL OUTER joined on (query_id, doc_id); a doc missing from a leg
    contributes 0 for it. Output (query_id, doc_id, score, rank, rank_<i>).
    """
    joined = None
    terms = []
    for i, leg in enumerate(legs):
        leg = leg.select("query_id", "doc_id", F.col("rank").alias(f"rank_{i}"))
        joined = leg if joined is None else joined.join(leg, ["query_id", "doc_id"], "full_outer")
        terms.append(F.coalesce(F.lit(1.0) / (F.lit(float(rrf_k)) + F.col(f"rank_{i}")), F.lit(0.0)))
    fused = terms[0]
    for t in terms[1:]:
        fused = fused + t
    scored = joined.withColumn("score", fused)
    return top_k_per_query(scored, k)


def hybrid_search(queries: DataFrame, query_vecs: DataFrame, docs: DataFrame,
                  vectors: DataFrame, k: int | None = None, doc_filter: Column | str | None = None,
                  fetch: int | None = None) -> DataFrame:
    """Vector leg (``query_vecs`` against ``vectors``) and BM25 leg
    (``queries`` text against ``docs``), each fetching 2k candidates, fused by
    RRF, top k. Vectors without a document in ``docs`` are ignored."""
    k = _check_k(k)
    fetch = fetch or 2 * k
    d = filtered(docs, doc_filter)
    kw = keyword_search(queries, d, fetch)
    vs = vector_search(query_vecs, vectors, fetch, docs=d)
    fused = rrf_fuse(vs, kw, k=k)
    return fused.select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank",
                        F.col("rank_0").alias("vector_rank"), F.col("rank_1").alias("keyword_rank"))


def hit_side(hits: DataFrame) -> DataFrame:
    """Hits ready to be joined to the documents: written once, and broadcast
    when their measured rows and bytes allow, so that the documents (and their
    texts) stay in their scan partitions."""
    return broadcast_if_bounded(materialize(hits, "hits"))


def rerank(candidates: DataFrame, queries: DataFrame, docs: DataFrame,
           title_col: str | None = "title", content_col: str = "text",
           category_col: str | None = "category",
           weights: tuple[float, float, float] = (2.0, 1.0, 1.0)) -> DataFrame:
    """R7 offline scorer: weighted share of query words found in title (2),
    content (1) and category (1) of each candidate, scaled to 0..4 like a
    semantic reranker score. Only candidate rows are scored."""
    q = queries.select("query_id", F.array_distinct(T.words("query")).alias("qw"))
    cols = set(docs.columns)
    fields = []
    for name, w in zip((title_col, content_col, category_col), weights):
        if name and name in cols:
            fields.append((name, w))
    d = docs.select("doc_id", *[F.col(n).alias(f"w_{n}") for n, _ in fields])
    total_w = sum(w for _, w in fields)
    expr = sum((F.lit(w) * T.coverage("qw", f"w_{n}") for n, w in fields), F.lit(0.0))
    hits = hit_side(candidates.join(broadcast_if_bounded(q), "query_id"))
    out = d.join(hits, "doc_id")
    for n, _ in fields:
        out = out.withColumn(f"w_{n}", F.array_distinct(T.words(f"w_{n}")))
    out = out.withColumn("reranker_score", F.round(F.lit(4.0) * expr / F.lit(total_w), SCORE_DIGITS))
    return out.select("query_id", "doc_id", *[c for c in candidates.columns if c not in ("query_id", "doc_id")],
                      "reranker_score")


def result_order(results: DataFrame, reranked_first: bool = False,
                 score: str = "score", reranker: str = "reranker_score",
                 orig: str = "rank") -> DataFrame:
    """Per query, order by reranker score when > 0 else search score,
    descending; stable on the incoming rank. ``reranked_first`` puts every
    row with a reranker score ahead of those without."""
    rr = F.coalesce(F.col(reranker), F.lit(0.0))
    sc = F.coalesce(F.col(score), F.lit(0.0))
    key = F.when(rr > 0, rr).otherwise(sc)
    order = [key.desc(), F.col(orig).asc()]
    if reranked_first:
        order = [(rr > 0).desc()] + order
    w = Window.partitionBy("query_id").orderBy(*order)
    return results.withColumn("final_rank", F.row_number().over(w).cast("long"))


# --------------------------------------------------------------------------
# Captions, answers, facets, context, metadata
# --------------------------------------------------------------------------

def passages(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, sent_no, sentence) with sentence numbers from 0."""
    return docs.select("doc_id", F.posexplode(T.sentences(text_col)).alias("sent_no", "sentence"))


def _hit_sentences(h: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id, sent_no, sentence, overlap) of the sentences of hits that
    share words with the query; ``h`` brings those as ``qw``. Sentences are cut and
    weighed once, and only in documents that are hits."""
    weighed = F.transform(T.sentences("text"), lambda s: F.struct(
        s.alias("sentence"), F.size(F.array_intersect("qw", F.array_distinct(T.words(s)))).alias("overlap")))
    j = docs.select("doc_id", "text").join(h, "doc_id")
    return T.posexplode_once(j, ["query_id", "doc_id"], weighed, "sent_no", "s").select(
        "query_id", "doc_id", "sent_no", "s.sentence", "s.overlap").filter(F.col("overlap") > 0)


def captions(hits: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Best passage of each hit by query-word overlap (count of distinct
    query words in the sentence); ties by earliest sentence; hits with no
    overlapping sentence get no caption."""
    q = queries.select("query_id", F.array_distinct(T.words("query")).alias("qw"))
    h = hit_side(hits.select("query_id", "doc_id").join(broadcast_if_bounded(q), "query_id"))
    scored = _hit_sentences(h, docs)
    # Best sentence per hit as an aggregate (partial aggregation map-side),
    # ordered by overlap, then the earliest sentence.
    best = scored.groupBy("query_id", "doc_id").agg(F.max_by(
        F.struct("sentence", "overlap"), F.struct("overlap", (-F.col("sent_no")).alias("neg_no"))).alias("b"))
    return best.select("query_id", "doc_id", F.col("b.sentence").alias("caption"), F.col("b.overlap").alias("overlap"))


def answers(caps: DataFrame) -> DataFrame:
    """Per query, the single best caption across its hits (overlap desc,
    doc_id asc), to be joined back onto every hit of the query."""
    w = Window.partitionBy("query_id").orderBy(F.col("overlap").desc(), F.col("doc_id").asc())
    return (caps.withColumn("r", F.row_number().over(w)).filter("r = 1")
            .select("query_id", F.col("caption").alias("answer"), F.col("doc_id").alias("answer_doc_id")))


def hit_passages(hits: DataFrame, queries: DataFrame, docs: DataFrame, per_hit: int = 3,
                 per_query: int = 3) -> DataFrame:
    """R9 and R10 on whole results: every hit with its list of ``captions`` and
    its query's list of ``answers``.

    Captions are a hit's ``per_hit`` sentences with most distinct query words
    (ties: the earlier sentence). Answers are the ``per_query`` best captions of
    all hits of the query (ties: smaller doc_id, then the earlier sentence) and
    stand on every hit, also on one without captions. Lists run from the best
    and are empty where no sentence shares a word with the query; hits whose
    query or document is not there keep their row. Documents that share an id
    give their sentences to the one hit.

    Both lists are top-k windows, cut in each task before the shuffle; texts do
    not leave their scan, and lists hold at most k sentences.
    """
    per_hit, per_query = _check_k(per_hit), _check_k(per_query)
    hits = materialize(hits, "passage-hits")
    q = queries.select("query_id", F.array_distinct(T.words("query")).alias("qw"))
    h = hit_side(hits.select("query_id", "doc_id").distinct().join(broadcast_if_bounded(q), "query_id"))
    scored = _hit_sentences(h, docs)
    best = [F.col("overlap").desc(), F.col("doc_id").asc(), F.col("sent_no").asc(), F.col("sentence").asc()]
    kept = scored.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(*best))) \
        .filter(F.col("r") <= per_hit)
    kept = materialize(kept, "passages")  # at most per_hit sentences a hit; read twice
    top = kept.withColumn("a", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))) \
        .filter(F.col("a") <= per_query)

    def listed(rank: str):
        return F.transform(F.array_sort(F.collect_list(F.struct(rank, "sentence"))), lambda x: x["sentence"])

    none = F.array().cast("array<string>")
    caps = kept.groupBy("query_id", "doc_id").agg(listed("r").alias("captions"))
    ans = top.groupBy("query_id").agg(listed("a").alias("answers"))
    return (hits.join(caps, ["query_id", "doc_id"], "left").join(ans, "query_id", "left")
            .withColumn("captions", F.coalesce("captions", none))
            .withColumn("answers", F.coalesce("answers", none)))


def matched_set(queries: DataFrame, docs: DataFrame, query_col: str = "query",
                text_col: str = "text") -> DataFrame:
    """(query_id, doc_id) of every document that shares a term with a query."""
    qt = query_terms(queries, query_col)
    occ = T.explode_tokens(docs, ["doc_id"], F.array_distinct(T.words(text_col)))
    return occ.join(broadcast_if_bounded(qt), "term").select("query_id", "doc_id").distinct()


def facets(hits: DataFrame, docs: DataFrame, facet_cols: list[str], top_n: int = 10) -> DataFrame:
    """Per query and facet field, counts of each value over the matched
    set; top_n values by count desc then value asc."""
    j = hits.select("query_id", "doc_id").join(docs.select("doc_id", *facet_cols), "doc_id")
    longs = j.select("query_id", F.explode(F.array(*[
        F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in facet_cols
    ])).alias("f")).select("query_id", "f.facet", "f.value")
    counts = longs.groupBy("query_id", "facet", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("query_id", "facet").orderBy(F.col("n").desc(), F.col("value").asc())
    return counts.withColumn("facet_rank", F.row_number().over(w).cast("long")).filter(F.col("facet_rank") <= top_n)


def sorted_listing(docs: DataFrame, sort_cols: list[Column], k: int,
                   doc_filter: Column | None = None) -> DataFrame:
    """A filtered listing ordered by sortable fields, first k rows
    (planned as TakeOrderedAndProject: a top-k per partition, then merge)."""
    if doc_filter is not None:
        docs = docs.filter(doc_filter)
    return docs.orderBy(*sort_cols).limit(_check_k(k))


def rag_context(hits: DataFrame, docs: DataFrame, sep: str = "\n",
                rank_col: str = "rank") -> DataFrame:
    """Hit contents joined in rank order, one row per query. Only the k
    hits per query are gathered, so the array is bounded by k."""
    j = docs.select("doc_id", "text").join(hit_side(hits.select("query_id", "doc_id", rank_col)), "doc_id")
    agg = j.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col(rank_col).alias("r"), F.col("text").alias("t")))).alias("xs"))
    return agg.select("query_id", F.array_join(F.transform("xs", lambda x: x["t"]), sep).alias("context"))


def result_metadata(results: DataFrame, core=("id", "content", "source", "title", "content_vector")) -> DataFrame:
    """Pack the non-core, non-'@' fields of each result row into a
    MAP<STRING,STRING> ``metadata`` column."""
    extra = [c for c in results.columns if not c.startswith("@") and c not in core]
    if not extra:
        return results.withColumn("metadata", F.create_map().cast("map<string,string>"))
    m = F.map_from_arrays(F.array(*[F.lit(c) for c in extra]),
                          F.array(*[F.col(c).cast("string") for c in extra]))
    return results.withColumn("metadata", m)
