"""Quantised vector index (R2): cells, and residual product codes in them.

Build. Unit vectors are assigned to k-means cells. What is left after the cell's
centroid is cut into ``m`` parts, and each part is replaced by the number of its
nearest entry in a codebook of at most 256: a vector becomes ``m`` bytes. The
codebooks are fitted on a bounded sample, one Spark group per part; every
vector is coded. Codes are stored in blocks of one cell, ``BLOCK_ROWS`` at most
(a cell of any size is cut by a hash of the id); exact vectors stand apart.

Search. A query probes the blocks of its nearest cells (all of them by default:
codes are a small part of the vectors' size). In a task the codes of a block
are held and the queries stream past: a query's products with the centroid and
with every codebook entry are a table, and a vector's score is a sum of ``m``
look-ups. The best ``shortlist`` of each query, over all blocks, are then read
from the exact vectors and scored again.

Vectors that are NULL, zero, of another length than the commonest, or hold NULL
or non-finite components are not indexed; queries of that kind have no hits. A
NULL id is never a hit. Neither queries nor vectors pass through the driver; it
reads the centroids and codebooks (model parameters).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import vectors as VX
from quarry.operators.retrieval import SCORE_DIGITS, _check_k, top_k_per_query
from quarry.plans.sizing import materialize

#: Codes of a block at most, and dimensions that a code byte stands for.
BLOCK_ROWS = 65_536
PART_DIMS = 4
ENTRIES = 256
#: Vectors that cells and codebooks are fitted on, at most (about).
MAX_FIT = 100_000
FIT_ROUNDS = 15
#: Exact vectors read for each wanted hit.
SHORTLIST = 10


@dataclass
class QuantisedIndex:
    centroids: np.ndarray      # cells x dims
    books: list[np.ndarray]    # per part: entries x dims of the part
    codes: DataFrame           # block, cell, doc_id, code
    blocks: DataFrame          # cell, block
    exact: DataFrame           # doc_id, embedding

    def bounds(self) -> list[tuple[int, int]]:
        ends = np.cumsum([b.shape[1] for b in self.books])
        return list(zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True))


def lloyd(x: np.ndarray, k: int, rounds: int = FIT_ROUNDS, seed: int = 7) -> np.ndarray:
    """k-means centres of the rows of ``x`` (fewer if it has fewer distinct rows)."""
    rows = np.unique(x, axis=0)
    if len(rows) <= k:
        return rows
    centres = rows[np.random.default_rng(seed).choice(len(rows), k, replace=False)]
    for _ in range(rounds):
        near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, rows: int = 8192) -> np.ndarray:
    half = 0.5 * np.square(centres).sum(1)
    return np.concatenate([np.argmax(x[i:i + rows] @ centres.T - half, axis=1) for i in range(0, len(x), rows)]
                          or [np.zeros(0, np.int64)])


def usable(vectors: DataFrame) -> DataFrame:
    """(doc_id, embedding, u): rows that can be indexed, with their unit vector."""
    e = F.col("embedding").cast("array<double>")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    ok = (vectors.select("doc_id", e.alias("embedding")).filter("doc_id IS NOT NULL AND embedding IS NOT NULL")
          .filter(~bad & F.exists("embedding", lambda x: x != 0)))
    common = ok.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return ok.filter(F.size("embedding") == (common["d"] if common else 0)).withColumn("u", VX.l2_normalize("embedding"))


def build_quantised(vectors: DataFrame, n_cells: int | None = None, part_dims: int = PART_DIMS, max_fit: int = MAX_FIT,
                    seed: int = 7, block_rows: int = BLOCK_ROWS) -> QuantisedIndex:
    spark = vectors.sparkSession
    rows = materialize(usable(vectors), "pq-vectors")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("u")).alias("d")).first()
    n, dim = int(facts["n"]), int(facts["d"] or 0)
    if not n:
        empty = rows.select(F.lit(0).alias("block"), F.lit(0).alias("cell"), "doc_id", F.lit(b"").alias("code"))
        return QuantisedIndex(np.zeros((0, 0)), [], empty, empty.select("cell", "block"), rows.select("doc_id", "embedding"))
    n_cells = n_cells or max(1, min(int(math.sqrt(n)), max_fit // 40 or 1))
    cuts = [(a, min(a + part_dims, dim)) for a in range(0, dim, part_dims)]

    # the sample is a share of the rows by a hash of their id; one group a part
    share = 1 << 30
    take = math.ceil(share * min(1.0, max_fit / n))
    sample = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(share)) < take).select("u")
    cells = _fit(sample.select(F.lit(0).alias("part"), F.col("u").alias("x")), n_cells, seed)[0]
    cells = cells / np.maximum(np.linalg.norm(cells, axis=1, keepdims=True), 1e-12)
    left = sample.select(_residual(cells)("u").alias("r"))
    pieces = left.select(F.explode(F.array(*[F.struct(F.lit(j).alias("part"), F.slice("r", a + 1, b - a).alias("x"))
                                             for j, (a, b) in enumerate(cuts)])).alias("p")).select("p.part", "p.x")
    books = _fit(pieces, ENTRIES, seed)
    books = [books[j] for j in range(len(cuts))]

    @F.pandas_udf("struct<cell:int,code:binary>")
    def encode(u: pd.Series) -> pd.DataFrame:
        x = np.stack(u.to_numpy())
        cell = nearest(x, cells)
        rest = x - cells[cell]
        code = np.stack([nearest(rest[:, a:b], books[j]) for j, (a, b) in enumerate(cuts)], axis=1).astype(np.uint8)
        return pd.DataFrame({"cell": cell.astype("int32"), "code": [c.tobytes() for c in code]})

    coded = materialize(rows.select("doc_id", encode("u").alias("e")).select("doc_id", "e.cell", "e.code"), "pq-coded")
    sizes = coded.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()    # a row a cell
    first, at = {}, 0
    for r in sorted(sizes):
        split = -(-r["n"] // (block_rows // 2 or 1))     # hashing is uneven: half full on average
        first[r["cell"]] = (at, split)
        at += split
    where = spark.createDataFrame([(c, a, s) for c, (a, s) in first.items()], "cell int, first int, split int")
    placed = coded.join(F.broadcast(where), "cell").select(
        (F.col("first") + F.pmod(F.xxhash64("doc_id"), F.col("split"))).cast("int").alias("block"), "cell", "doc_id", "code")
    blocks = where.select("cell", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("split") - 1)).alias("block"))
    codes = materialize(placed.repartition("block").sortWithinPartitions("block"), "pq-codes")
    return QuantisedIndex(cells, books, codes, blocks, rows.select("doc_id", "embedding"))


def _fit(parts: DataFrame, k: int, seed: int) -> dict[int, np.ndarray]:
    """Centres of each part, fitted in one task a part (``parts`` is bounded)."""
    def fit(key, pdf):
        c = lloyd(np.stack(pdf["x"].to_numpy()).astype(np.float64), k, seed=seed)
        return pd.DataFrame({"part": key[0], "entry": range(len(c)), "x": list(c)})

    got: dict[int, list] = {}
    for r in parts.groupBy("part").applyInPandas(fit, "part int, entry int, x array<double>").orderBy("part", "entry").collect():
        got.setdefault(r["part"], []).append(r["x"])
    return {j: np.array(x) for j, x in got.items()}


def _residual(cells: np.ndarray):
    @F.pandas_udf("array<double>")
    def run(u: pd.Series) -> pd.Series:
        x = np.stack(u.to_numpy())
        return pd.Series(list(x - cells[nearest(x, cells)]))
    return run


def save_quantised(index: QuantisedIndex, path: str) -> str:
    spark = index.codes.sparkSession
    index.codes.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/codes")
    index.blocks.write.mode("overwrite").parquet(f"{path}/blocks")
    index.exact.write.mode("overwrite").parquet(f"{path}/exact")
    model = [(-1, i, c.tolist()) for i, c in enumerate(index.centroids)]
    model += [(j, i, c.tolist()) for j, b in enumerate(index.books) for i, c in enumerate(b)]
    spark.createDataFrame(model, "part int, entry int, x array<double>").write.mode("overwrite").parquet(f"{path}/model")
    return path


def load_quantised(spark: SparkSession, path: str) -> QuantisedIndex:
    model: dict[int, list] = {}
    for r in spark.read.parquet(f"{path}/model").orderBy("part", "entry").collect():
        model.setdefault(r["part"], []).append(r["x"])
    codes = spark.read.parquet(f"{path}/codes").select("block", "cell", "doc_id", "code")
    return QuantisedIndex(np.array(model.get(-1, [])), [np.array(model[j]) for j in sorted(model) if j >= 0], codes,
                          spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/exact"))


def _scan(index: QuantisedIndex, keep: int):
    """Codes of a block (kind 0), then its queries (kind 1): the best ``keep`` of the block for each."""
    cells, books, cuts = index.centroids, index.books, index.bounds()

    def run(batches):
        at, held, codes = None, [], None
        for b in batches:
            key = b.column("block").to_numpy() * 2 + b.column("kind").to_numpy()
            ends = np.append(np.flatnonzero(np.diff(key)) + 1, len(key)) if len(key) else []
            lo = 0
            for hi in ends:
                part, (block, kind) = b.slice(lo, hi - lo), divmod(int(key[lo]), 2)
                lo = hi
                if block != at:
                    at, held, codes = block, [], None
                if kind == 0:
                    held.append(part)
                    continue
                if codes is None:
                    if not held:
                        continue
                    whole = pa.Table.from_batches(held)
                    order = pc.sort_indices(whole, sort_keys=[("doc_id", "ascending")])
                    ids = whole["doc_id"].take(order).combine_chunks()
                    raw = b"".join(whole["code"].take(order).to_pylist())
                    codes = np.frombuffer(raw, np.uint8).reshape(len(ids), -1)
                    centre, held = cells[whole["cell"][0].as_py()], []
                for i, u in enumerate(part.column("u").to_pylist()):
                    q = np.asarray(u)
                    score = np.full(len(codes), q @ centre)
                    for j, (x, y) in enumerate(cuts):
                        score += (books[j] @ q[x:y])[codes[:, j]]
                    best = np.argsort(-score, kind="stable")[:keep] if len(score) <= 4 * keep else \
                        np.argpartition(-score, keep - 1)[:keep]
                    yield pa.RecordBatch.from_arrays(
                        [pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(best), np.int32)), part.column("query_id").slice(i, 1)).dictionary_decode(),
                         ids.take(pa.array(best)), pa.array(score[best])], names=["query_id", "doc_id", "approx"])
    return run


def shortlist(query_vecs: DataFrame, index: QuantisedIndex, size: int, nprobe: int | None = None) -> DataFrame:
    """(query_id, doc_id, approx, rank): the best ``size`` by code of each query."""
    kinds = {f.name: f.dataType.simpleString() for f in (query_vecs.schema["query_id"], index.codes.schema["doc_id"])}
    if not len(index.centroids):
        return query_vecs.sparkSession.createDataFrame(
            [], f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, approx double, rank long")
    cells, dim = index.centroids, index.centroids.shape[1]
    nprobe = min(nprobe or len(cells), len(cells))

    @F.pandas_udf("array<int>")
    def near(u: pd.Series) -> pd.Series:
        s = np.stack(u.to_numpy()) @ cells.T
        return pd.Series(list(np.argsort(-s, axis=1, kind="stable")[:, :nprobe].astype("int32")))

    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    asked = (query_vecs.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
             .filter(F.size("embedding") == dim).filter(~bad & F.exists("embedding", lambda x: x != 0))
             .select("query_id", VX.l2_normalize("embedding").alias("u")))
    probes = asked.withColumn("cell", F.explode(near("u"))).join(F.broadcast(index.blocks), "cell")  # a row a block of the index
    none = F.lit(None)
    rows = index.codes.select("block", F.lit(0).alias("kind"), "cell", "doc_id", "code",
                              none.cast(kinds["query_id"]).alias("query_id"), none.cast("array<double>").alias("u"))
    rows = rows.unionByName(probes.select("block", F.lit(1).alias("kind"), "cell", none.cast(kinds["doc_id"]).alias("doc_id"),
                                          none.cast("binary").alias("code"), "query_id", "u"))
    found = rows.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(
        _scan(index, size), f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, approx double")
    return top_k_per_query(found, size, score="approx")


def quantised_search(query_vecs: DataFrame, index: QuantisedIndex, k: int | None = None, nprobe: int | None = None,
                     per_hit: int = SHORTLIST) -> DataFrame:
    """R2: (query_id, doc_id, score, rank) by exact cosine over a shortlist of ``k x per_hit`` by code."""
    k = _check_k(k)
    best = shortlist(query_vecs, index, k * per_hit, nprobe)
    scored = (best.select("query_id", "doc_id").join(index.exact, "doc_id")
              .join(query_vecs.select("query_id", F.col("embedding").cast("array<double>").alias("qe")), "query_id")
              .select("query_id", "doc_id", F.round(VX.cosine("qe", "embedding"), SCORE_DIGITS).alias("score")))
    return top_k_per_query(scored, k)


def recall_and_reads(query_vecs: DataFrame, index: QuantisedIndex, exact_hits: DataFrame, k: int,
                     nprobe: int | None = None, per_hit: int = SHORTLIST) -> DataFrame:
    """R3 for this index: (query_id, recall, read_share): the share of the exact
    hits found, and of the indexed vectors whose exact values the query read."""
    got = quantised_search(query_vecs, index, k, nprobe, per_hit).select("query_id", "doc_id", F.lit(1).alias("h"))
    n = index.exact.count()
    reads = shortlist(query_vecs, index, k * per_hit, nprobe).groupBy("query_id").agg(
        (F.count(F.lit(1)) / F.lit(max(n, 1))).alias("read_share"))
    hit = exact_hits.select("query_id", "doc_id").join(got, ["query_id", "doc_id"], "left")
    recall = hit.groupBy("query_id").agg(F.avg(F.coalesce("h", F.lit(0)).cast("double")).alias("recall"))
    return recall.join(reads, "query_id", "left")
