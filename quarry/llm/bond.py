"""Hard-negative mining by a vertical (branch-and-bound) scan of dimensions.

Rows are dealt into blocks; a task holds a block by dimension, with each
dimension's smallest and largest value. For each anchor it reads the dimensions
in order of the anchor's descending magnitude. After every few dimensions the
smallest and largest contribution that the unread ones can make bound each
candidate's score, and the candidate bitmap shrinks:

1. positives: rows of the anchor's label whose upper bound reaches the count-th
   best lower bound stay, until the best are exact;
2. negatives: rows of other labels stay while their bounds still meet the score
   window of some positive and the best certain members of that window do not
   rule them out.

The blocks' best rows are merged per anchor by a window limit that works before
the shuffle as well. Every anchor meets every block: anchors are a stated query
set, and they travel to the blocks, not rows to anchors.

Defined cases. Rows with a null label or vector, or any null or non-finite
component, take no part, nor do vectors whose length is not the commonest (of
equally common lengths the largest). Equal rows are kept once with their number
and count as often; of an anchor's own copies one is the anchor, the others are
candidates. A null id is no anchor and sorts last. Components so large that a
score could pass 2**62 are an error. An empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm import packed
from quarry.llm.common import n_parts
from quarry.plans.sizing import materialize

POSITIVES = 5
NEGATIVES = 5
LOW, HIGH = 80, 100          # percent of the positive's score
BLOCK_ROWS = 131_072         # rows of a block at most, about
STEP = 8                     # dimensions read between two prunings
FEW = 32                     # candidates that are finished at once


def integer_rows(items: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(rid, id, label, vec of integers, copies): distinct rows that take part."""
    df = items.select(F.col(id_col).alias("id"), F.col(label_col).cast("long").alias("label"),
                      F.col(vec_col).cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    df = df.filter("vec IS NOT NULL AND label IS NOT NULL").filter(~bad)
    common = df.groupBy(F.size("vec").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("vec", F.abs))).alias("top")
    ).orderBy(F.desc("n"), F.desc("d")).first()
    dim = common["d"] if common else 0
    if common and common["top"] and (256 * common["top"] + 1) ** 2 * dim >= 2.0 ** 62:
        raise ValueError("components are too large for 64-bit scores")
    whole = F.transform("vec", lambda x: F.floor(F.lit(256.0) * x).cast("long"))
    grouped = (df.filter(F.size("vec") == dim).withColumn("vec", whole)
               .groupBy("id", "label", "vec").agg(F.count(F.lit(1)).alias("copies")))
    return materialize(grouped.withColumn("rid", F.monotonically_increasing_id()), "bond-rows")


class Block:
    """Rows of a block by dimension, in the order of their ids."""

    def __init__(self, rows: pa.Table):
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("id", "ascending"), ("rid", "ascending")]))
        flat, counts = packed.unpack(rows["vec"], np.int64)
        self.dims = np.ascontiguousarray(flat.reshape(rows.num_rows, int(counts[0])).T)
        self.low, self.high = (self.dims.min(1), self.dims.max(1)) if len(self.dims) else (np.zeros(0, np.int64),) * 2
        self.id = rows["id"].combine_chunks()
        self.rid, self.label, self.copies = (packed.long_values(rows[c]) for c in ("rid", "label", "copies"))

    def scan(self, anchor: np.ndarray, alive: np.ndarray, prune) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores) of the candidates that ``prune`` leaves; it gets
        the lower and upper bounds of the candidates and marks those to keep."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        a, low, high = anchor[order], anchor[order] * self.low[order], anchor[order] * self.high[order]
        least = np.append(np.cumsum(np.minimum(low, high)[::-1])[::-1], 0)     # of the dimensions from here on
        most = np.append(np.cumsum(np.maximum(low, high)[::-1])[::-1], 0)
        part = np.zeros(len(alive), np.int64)
        done = 0
        while done < len(a):
            step = len(a) - done if len(alive) <= FEW else STEP
            read = order[done:done + step]
            part += a[done:done + step] @ (self.dims[read][:, alive] if len(alive) < self.dims.shape[1] else self.dims[read])
            done += len(read)
            keep = prune(alive, part + least[done], part + most[done])
            if not keep.all():
                alive, part = alive[keep], part[keep]
            if not len(alive):
                break
        return alive, part


def _best(copies: np.ndarray, score: np.ndarray, k: int) -> int | None:
    """The k-th best score when row i counts copies[i] times; None if there are fewer."""
    if len(score) > 4 * k:
        at = np.argpartition(-score, k - 1)[:k]     # every row counts at least once
        copies, score = copies[at], score[at]
    by = np.argsort(-score, kind="stable")
    at = int(np.searchsorted(np.cumsum(copies[by]), k))
    return int(score[by[at]]) if at < len(by) else None


def _first(rows: np.ndarray, score: np.ndarray, copies: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best rows until k are reached, by score, then position (id order)."""
    by = np.lexsort((rows, -score))
    rows, score, copies = rows[by], score[by], copies[by]
    before = np.cumsum(copies) - copies
    keep = before < k
    return rows[keep], score[keep], np.minimum(copies[keep], k - before[keep])


def _others(block: Block, rid: int, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(candidates, their numbers) without the anchor itself."""
    copies = block.copies[alive] - (block.rid[alive] == rid)
    return alive[copies > 0], copies[copies > 0]


def _positives(block: Block, rid: int, label: int, vec: np.ndarray, k: int):
    alive, copies = _others(block, rid, np.flatnonzero(block.label == label))
    count = np.zeros(len(block.rid), np.int64)
    count[alive] = copies

    def prune(rows, least, most):
        cut = _best(count[rows], least, k)
        return np.ones(len(rows), bool) if cut is None else most >= cut

    rows, score = block.scan(vec, alive, prune)
    return [(0, *_first(rows, score, count[rows], k))]


def _negatives(block: Block, label: int, vec: np.ndarray, scores: np.ndarray, k: int, low: int, high: int):
    def prune(rows, least, most):
        keep = np.zeros(len(rows), bool)
        for s in scores:
            can = (high * most >= low * s) & (least <= s)
            sure = can & (high * least >= low * s) & (most <= s)
            cut = _best(block.copies[rows[sure]], least[sure], k) if sure.any() else None
            keep |= can if cut is None else can & (most >= cut)
        return keep

    rows, score = block.scan(vec, np.flatnonzero(block.label != label), prune)
    out = []
    for s in scores:
        inside = (high * score >= low * s) & (score <= s)
        out.append((s, *_first(rows[inside], score[inside], block.copies[rows[inside]], k)))
    return out


def _scan(find):
    """Blocks as they come (kind 0), then their anchors (kind 1), one at a time."""
    def run(batches):
        rows, block, at = [], None, None
        for t in packed.chunks(batches):
            key = packed.long_values(t["block"]) * 2 + packed.long_values(t["kind"])
            cuts = np.append(packed.starts_of(key), len(key))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part, (b, kind) = t.slice(lo, hi - lo), divmod(int(key[lo]), 2)
                if b != at:
                    rows, block, at = [], None, b
                if kind == 0:
                    rows.append(part)
                    continue
                if block is None and rows:
                    block, rows = Block(pa.concat_tables(rows)), []
                if block is not None:
                    yield _found(block, part, find)
    return run


def _found(block: Block, anchors: pa.Table, find) -> pa.RecordBatch:
    flat, counts = packed.unpack(anchors["vec"], np.int64)
    vecs = flat.reshape(anchors.num_rows, int(counts[0]))
    scores, sizes = packed.unpack(anchors["scores"], np.int64)
    scores = np.split(scores, np.cumsum(sizes)[:-1])
    rid, label = packed.long_values(anchors["rid"]), packed.long_values(anchors["label"])
    key, ref, rows, score, copies = [], [], [], [], []
    for i in range(len(rid)):
        for s, r, x, c in find(block, int(rid[i]), int(label[i]), vecs[i], scores[i]):
            key.append(np.full(len(r), rid[i]))
            ref.append(np.full(len(r), s, np.int64))
            rows.append(r)
            score.append(x)
            copies.append(c)
    rows = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    rest = [np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (key, ref, score, copies)]
    return pa.RecordBatch.from_arrays([pa.array(rest[0]), pa.array(rest[1]), block.id.take(pa.array(rows)),
                                       pa.array(rest[2]), pa.array(rest[3])], names=["anchor", "ref", "id", "score", "copies"])


def _pack_longs(col: str):
    @F.pandas_udf("binary")
    def run(s):
        return s.map(lambda v: np.asarray(v, np.int64).tobytes())
    return run(F.col(col))


def _meet(rows: DataFrame, anchors: DataFrame, blocks: int, find, k: int) -> DataFrame:
    """(anchor, ref, id, score, place): the k best rows that ``find`` gives for each anchor and ref."""
    spark = rows.sparkSession
    dealt = rows.withColumns({"block": F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int"), "kind": F.lit(0),
                              "scores": F.lit(b"")})
    asked = anchors.withColumns({"block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "kind": F.lit(1)})
    cols = ["block", "kind", "rid", "id", "label", "vec", "copies", "scores"]
    met = (dealt.select(cols).unionByName(asked.select(cols)).repartition(n_parts(spark), "block")
           .sortWithinPartitions("block", "kind"))
    kind = rows.schema["id"].dataType.simpleString()
    found = met.mapInArrow(_scan(find), f"anchor long, ref long, id {kind}, score long, copies long")
    one = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy")
    order = Window.partitionBy("anchor", "ref").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return one.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def mine(items: DataFrame, anchor, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)
    for the rows that ``anchor`` (a condition on ``id``) selects."""
    spark = items.sparkSession
    rows = integer_rows(items, id_col, vec_col, label_col)
    rows = materialize(rows.withColumn("vec", _pack_longs("vec")), "bond-packed")
    # at least one block a task, so that all tasks have work
    blocks = max(n_parts(spark), -(-rows.count() // block_rows))
    anchors = rows.filter(anchor)
    pos = materialize(_meet(rows, anchors.withColumn("scores", F.lit(b"")), blocks,
                            lambda b, rid, label, vec, _: _positives(b, rid, label, vec, positives), positives), "bond-positives")
    windows = pos.filter("score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_set("score")).alias("scores"))
    asked = anchors.join(windows.withColumnRenamed("anchor", "rid"), "rid").withColumn("scores", _pack_longs("scores"))
    neg = _meet(rows, asked, blocks, lambda b, rid, label, vec, s: _negatives(b, label, vec, s, negatives, low, high), negatives)
    pairs = pos.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("ref"), F.col("score").alias("positive_score"))
    out = pairs.join(neg.select("anchor", "ref", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                                F.col("score").alias("negative_score")), ["anchor", "ref"])
    names = anchors.select(F.col("rid").alias("anchor"), F.col("id").alias("anchor_id"), F.col("copies").alias("n"))
    return (out.join(names, "anchor").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
