"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

Build. Every distinct vector is a node with a list of its ``degree`` nearest
nodes found so far. The first lists come from runs of 64 nodes in the order of
random-projection signs. Then, round by round, each node gathers a sample of
its list and of the nodes that list it (two Spark joins: neighbours by node,
codes by neighbour) and compares them with each other: neighbours of neighbours
meet there. Pairs that beat the worst entry of a list travel to its owner,
which keeps the best. Only pairs with an entry new since the last round are
compared, and rounds end when few lists change.

Search. Lists and their reverse edges are stored by node, with the codes of the
neighbours, in a table bucketed by node. A query keeps a beam of its best nodes
and a round expands the best nodes of the beam that are not expanded yet: one
join of (node, query) requests with the stored lists. It ends when every node
of every beam is expanded. The best of the beam are then scored exactly, in
double precision over the original vectors, components in order.

Codes have 8 bits per component and a scale per vector; their integer products
are exact in float32 up to 1,040 components. The graph links vectors of close direction; beams are ordered by inner
product, and start at the query's own node, at a sample of nodes and at the
nodes of largest norm (so unequal norms are found).

Defined cases. Vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do vectors whose length is not the table's
commonest (of equally common lengths the largest). Equal vectors are one node:
of their rows the smallest ids stand for it, as many as a result can hold.
Repeated rows are rows of their own. A null id sorts after all others. Empty
tables give no rows. Other columns are not read.

Tables: the node table has a vector and its code a row; the graph about
(13 x degree) bytes a node; the stored lists (components + 12) x links bytes.
Nothing but the start nodes (``starts``, bounded) and counts reaches the driver.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm import packed
from quarry.llm.common import n_parts
from quarry.plans.sizing import materialize

DEGREE = 32          # entries of a neighbour list
SAMPLE = 16          # new (and old) entries a node takes into a round, and as many that list it
KEEP = 8             # pairs a node keeps for each member per comparison
ROUNDS = 8           # at most; a round that changes under SETTLED of all entries is the last
SETTLED = 0.05
LINKS = 48           # stored edges of a node: its list and the nodes that list it
BEAM = 320           # nodes a query keeps
EXPAND = 64          # nodes of a beam expanded in a round
STARTS = 256         # start nodes: half by hash, half by norm
RUN = 64             # nodes compared in a run of the first lists
TREES = 2
SLACK = 32           # nodes beyond k that are scored exactly

OLD, WAITING, PICKED, FRESH = 1, 2, 3, 4

LISTS = "u long, kind int, code binary, nb binary, sc binary, fl binary"
GRAPH = "u long, code binary, nb binary, sc binary, fl binary, thr float, fresh int"


@dataclass
class Index:
    nodes: DataFrame        # nid, vec (float64 bytes), code, scale, norm
    members: DataFrame      # nid, id, vec: rows of a node, smallest ids first, ``limit`` at most
    graph: DataFrame        # GRAPH rows
    layout: str             # bucketed table: u, nb, codes, scales
    starts: list            # (nid, code, scale)
    dim: int

    def drop(self, spark) -> None:
        spark.sql(f"DROP TABLE IF EXISTS {self.layout}")


def vectors(items: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec as array<double>) of the rows that take part."""
    df = items.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    df = df.filter("vec IS NOT NULL AND size(vec) > 0").filter(~bad).filter(F.exists("vec", lambda x: x != 0))
    common = df.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    # -0.0 and 0.0 are one value for grouping and the same factor in a product
    return df.filter(F.size("vec") == (common["d"] if common else 0)).withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))


def _encode(batches):
    for t in packed.chunks(batches):
        lists = t["vec"].combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        x = np.asarray(lists.flatten(), dtype=np.float64).reshape(t.num_rows, -1)
        top = np.abs(x).max(1)
        code = np.rint(x / top[:, None] * 127).astype(np.int8)
        one = np.ones(t.num_rows, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(packed.long_values(t["nid"])), packed.pack(x, one), packed.pack(code, one),
             pa.array(top / 127), pa.array(np.sqrt(np.square(x / top[:, None]).sum(1)) * top)],
            names=["nid", "vec", "code", "scale", "norm"])


def node_tables(items: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, members): distinct vectors, and the ``limit`` smallest ids of each."""
    rn = F.row_number().over(Window.partitionBy("vec").orderBy(F.col("id").asc_nulls_last()))
    members = (items.withColumn("rn", rn).filter(F.col("rn") <= limit)
               .withColumn("rid", F.monotonically_increasing_id())
               .withColumn("nid", F.min("rid").over(Window.partitionBy("vec"))).drop("rid"))
    members = materialize(members, "nnd-members")
    nodes = members.filter("rn = 1").select("nid", "vec").mapInArrow(
        _encode, "nid long, vec binary, code binary, scale double, norm double")
    return materialize(nodes, "nnd-nodes"), members


# ---------------------------------------------------------------- build

def _list_rows(owner, counts, item, score, flag, kind):
    n = len(owner)
    return pa.RecordBatch.from_arrays(
        [pa.array(owner), pa.array(np.full(n, kind, np.int32)), pa.nulls(n, pa.binary()),
         packed.pack(item, counts), packed.pack(score.astype(np.float32), counts), packed.pack(flag, counts)],
        names=["u", "kind", "code", "nb", "sc", "fl"])


def _unit(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = codes.astype(np.float32)
    return x, (1 / np.sqrt(np.square(x).sum(-1))).astype(np.float32)


def _compare(groups: np.ndarray, members: np.ndarray, fresh: np.ndarray, codes: np.ndarray, thr: np.ndarray,
             keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (u, c, score) of members of a group, one of them fresh, that beat
    u's threshold: the ``keep`` best for each member of each group. ``groups``
    are the starts of the runs."""
    sizes = np.diff(np.append(groups, len(members)))
    width = int(sizes.max())
    row = np.repeat(np.arange(len(groups)), sizes)
    col = np.arange(len(members)) - np.repeat(groups, sizes)
    x, inv = _unit(codes)
    grid = np.zeros((len(groups), width, x.shape[1]), np.float32)
    grid[row, col] = x
    scale, who, new = (np.zeros((len(groups), width), np.float32), np.full((len(groups), width), -1, np.int64),
                       np.zeros((len(groups), width), bool))
    scale[row, col], who[row, col], new[row, col] = inv, members, fresh
    least = np.full((len(groups), width), np.inf, np.float32)
    least[row, col] = thr
    s = np.matmul(grid, grid.transpose(0, 2, 1)) * scale[:, :, None] * scale[:, None, :]
    out = (s > least[:, :, None]) & (new[:, :, None] | new[:, None, :]) & (who[:, None, :] >= 0) \
        & (who[:, :, None] != who[:, None, :])
    s[~out] = -3
    if width > keep:
        cut = np.partition(s, width - keep, axis=2)[:, :, width - keep]
        out &= s >= cut[:, :, None]
    g, i, j = np.nonzero(out)
    return who[g, i], who[g, j], s[g, i, j]


def _emit(found: list, degree: int):
    u, c, s = (np.concatenate(x) for x in zip(*found, strict=True))
    owner, counts, item, score, flag = packed.best_lists(u, c, s, np.full(len(u), FRESH, np.int8), degree)
    return _list_rows(owner, counts, item, score, flag, 1)


def _first_lists(keep: int, degree: int):
    def run(batches):
        found, held = [], 0
        for t in packed.chunks(batches, RUN * 64):
            u = packed.long_values(t["u"])
            codes, _ = packed.unpack(t["code"], np.int8)
            codes = codes.reshape(len(u), -1)
            at = np.arange(0, len(u), RUN)
            got = _compare(at, u, np.ones(len(u), bool), codes, np.full(len(u), -2, np.float32), keep)
            found.append(got)
            held += len(got[0])
            if held > 200_000:
                yield _emit(found, degree)
                found, held = [], 0
        if held:
            yield _emit(found, degree)
    return run


def _signs(seed: int, dim: int):
    planes = np.random.default_rng(seed).normal(size=(dim, 62)).astype(np.float32)

    def run(batches):
        for t in packed.chunks(batches):
            codes, _ = packed.unpack(t["code"], np.int8)
            bits = codes.reshape(t.num_rows, dim).astype(np.float32) @ planes > 0
            key = (bits.astype(np.int64) << np.arange(61, -1, -1, dtype=np.int64)).sum(1)
            yield pa.RecordBatch.from_arrays([t["u"].combine_chunks(), t["code"].combine_chunks(), pa.array(key)],
                                             names=["u", "code", "key"])
    return run


def _picks(owner: np.ndarray, item: np.ndarray, among: np.ndarray, most: int, seed: int) -> np.ndarray:
    """Marks at most ``most`` of the marked entries of each owner, chosen by hash."""
    at = np.flatnonzero(among)
    by = at[np.lexsort((packed.mix(owner[at], item[at], seed), owner[at]))]
    first = packed.starts_of(owner[by])
    rank = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
    out = np.zeros(len(owner), bool)
    out[by[rank < most]] = True
    return out


def _merge_lists(degree: int, sample: int, seed: int):
    """Owners' rows (kind 0, with code) and offers (kind 1), sorted by owner: one
    list an owner. The last owner's best entries are carried on, never its rows."""
    def run(batches):
        carry = None    # (owner, code, items, scores, flags)

        def out(own, codes, owner, counts, item, score, flag):
            n = len(own)
            size = np.zeros(n, np.int64)
            size[np.searchsorted(own, owner)] = counts
            whose = np.repeat(owner, counts)
            fresh = flag == FRESH
            at = np.searchsorted(own, whose)
            flag = np.where(fresh, WAITING, flag).astype(np.int8)
            flag[_picks(whose, item, flag == WAITING, sample, seed)] = PICKED
            ends = np.cumsum(size) - 1
            thr = np.full(n, -2, np.float32)
            full = size >= degree
            thr[full] = score[ends[full]]
            return pa.RecordBatch.from_arrays(
                [pa.array(own), packed.pack(codes, np.ones(n, np.int64)), packed.pack(item, size),
                 packed.pack(score.astype(np.float32), size), packed.pack(flag, size), pa.array(thr),
                 pa.array(np.bincount(at[fresh], minlength=n).astype(np.int32))],
                names=["u", "code", "nb", "sc", "fl", "thr", "fresh"])

        for t in packed.chunks(batches, packed.CHUNK_ROWS * 2):
            u = packed.long_values(t["u"])
            own_at = packed.long_values(t["kind"]) == 0
            codes, size = packed.unpack(t["code"], np.int8)
            mine = int(own_at.sum())    # none where a long run of offers fills the chunk
            codes = codes.reshape(mine, -1) if mine else codes.reshape(0, len(carry[1]))
            item, counts = packed.unpack(t["nb"], np.int64)
            score, _ = packed.unpack(t["sc"], np.float32)
            flag, _ = packed.unpack(t["fl"], np.int8)
            flag = np.where(flag == PICKED, OLD, flag).astype(np.int8)
            owner, own = np.repeat(u, counts), u[own_at]
            if carry is not None:
                own = np.concatenate([[carry[0]], own])
                codes = np.concatenate([carry[1][None, :], codes]) if len(codes) else carry[1][None, :]
                owner = np.concatenate([np.full(len(carry[2]), carry[0]), owner])
                item, score, flag = (np.concatenate(x) for x in ((carry[2], item), (carry[3], score), (carry[4], flag)))
            who, counts, item, score, flag = packed.best_lists(owner, item, score, flag, degree)
            last = own[-1]
            tail = int(counts[-1]) if len(who) and who[-1] == last else 0
            body = len(item) - tail
            carry = (last, codes[-1], item[body:], score[body:], flag[body:])
            if len(own) > 1:
                yield out(own[:-1], codes[:-1], who[:len(who) - (tail > 0)], counts[:len(who) - (tail > 0)],
                          item[:body], score[:body], flag[:body])
        if carry is not None:
            n = len(carry[2])
            yield out(np.array([carry[0]]), carry[1][None, :], np.full(int(n > 0), carry[0]),
                      np.full(int(n > 0), n), carry[2], carry[3], carry[4])
    return run


def _members(sample: int, seed: int):
    """Who takes part in whose comparison: picked new and sampled old entries of
    each list, and the owner in the comparison of each of them."""
    def run(batches):
        for t in packed.chunks(batches):
            u = packed.long_values(t["u"])
            item, counts = packed.unpack(t["nb"], np.int64)
            flag, _ = packed.unpack(t["fl"], np.int8)
            owner = np.repeat(u, counts)
            new = flag == PICKED
            use = new | _picks(owner, item, flag == OLD, sample, seed)
            owner, item, new = owner[use], item[use], new[use]
            order = packed.mix(owner, item, seed + 1) >> 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([owner, item])), pa.array(np.concatenate([item, owner])),
                 pa.array(np.concatenate([new, new])), pa.array(np.concatenate([order, order + (1 << 62)]))],
                names=["v", "m", "isnew", "ord"])
    return run


def _local_join(keep: int, degree: int):
    def run(batches):
        found, held = [], 0
        for t in packed.whole_groups(batches, "v"):
            v = packed.long_values(t["v"])
            codes, _ = packed.unpack(t["code"], np.int8)
            codes = codes.reshape(len(v), -1)
            m, new = packed.long_values(t["m"]), np.asarray(t["isnew"])
            thr = np.asarray(t["thr"])
            at = np.append(packed.starts_of(v), len(v))
            for i in range(0, len(at) - 1, 256):
                lo, hi = at[i], at[min(i + 256, len(at) - 1)]
                got = _compare(at[i:min(i + 256, len(at) - 1)] - lo, m[lo:hi], new[lo:hi], codes[lo:hi], thr[lo:hi], keep)
                found.append(got)
                held += len(got[0])
            if held > 200_000:
                yield _emit(found, degree)
                found, held = [], 0
        if held:
            yield _emit(found, degree)
    return run


def _by_owner(rows: DataFrame, parts: int, *more: str) -> DataFrame:
    return rows.repartition(parts, "u").sortWithinPartitions("u", "kind", *more)


def build_graph(nodes: DataFrame, dim: int, degree: int = DEGREE, sample: int = SAMPLE, keep: int = KEEP,
                rounds: int = ROUNDS, settled: float = SETTLED) -> DataFrame:
    """GRAPH rows: the neighbour list of every node."""
    spark = nodes.sparkSession
    parts = n_parts(spark)
    base = nodes.select(F.col("nid").alias("u"), "code")
    own = base.select("u", F.lit(0).alias("kind"), "code", *(F.lit(b"").alias(c) for c in ("nb", "sc", "fl")))
    offers = own
    for tree in range(TREES):
        keyed = base.mapInArrow(_signs(tree + 1, dim), "u long, code binary, key long")
        runs = keyed.repartitionByRange(parts, "key", F.xxhash64("u")).sortWithinPartitions("key", F.xxhash64("u"))
        offers = offers.unionByName(runs.mapInArrow(_first_lists(keep, degree), LISTS))
    graph = materialize(_by_owner(offers, parts).mapInArrow(_merge_lists(degree, sample, 0), GRAPH), "nnd-graph")
    for r in range(1, rounds + 1):
        top = Window.partitionBy("v", "isnew").orderBy("ord")
        takes = (graph.select("u", "nb", "fl").mapInArrow(_members(sample, 2 * r), "v long, m long, isnew boolean, ord long")
                 .withColumn("rn", F.row_number().over(top)).filter(F.col("rn") <= 2 * sample).select("v", "m", "isnew"))
        met = takes.join(graph.select(F.col("u").alias("m"), "code", "thr"), "m")
        offers = met.repartition(parts, "v").sortWithinPartitions("v").mapInArrow(_local_join(keep, degree), LISTS)
        lists = graph.select("u", F.lit(0).alias("kind"), "code", "nb", "sc", "fl")
        graph = materialize(_by_owner(lists.unionByName(offers), parts)
                            .mapInArrow(_merge_lists(degree, sample, r), GRAPH), "nnd-graph")
        seen = graph.agg(F.sum("fresh").alias("f"), F.sum(F.octet_length("fl")).alias("n")).first()
        if not seen["n"] or (seen["f"] or 0) <= settled * seen["n"]:
            break
    return graph


def _reverse(batches):
    for t in packed.chunks(batches):
        item, counts = packed.unpack(t["nb"], np.int64)
        score, _ = packed.unpack(t["sc"], np.float32)
        one = np.ones(len(item), np.int64)
        if len(item):
            yield _list_rows(item, one, np.repeat(packed.long_values(t["u"]), counts), score,
                             np.full(len(item), WAITING, np.int8), 1)


def _explode(batches):
    for t in packed.chunks(batches):
        item, counts = packed.unpack(t["nb"], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(packed.long_values(t["u"]), counts)), pa.array(item)],
                                         names=["u", "c"])


def _layout(batches):
    for t in packed.whole_groups(batches, "u"):
        u = packed.long_values(t["u"])
        at = packed.starts_of(u)
        counts = np.diff(np.append(at, len(u)))
        codes, _ = packed.unpack(t["code"], np.int8)
        yield pa.RecordBatch.from_arrays(
            [pa.array(u[at]), packed.pack(packed.long_values(t["c"]), counts),
             packed.pack(codes.reshape(len(u), -1), counts),
             packed.pack(np.asarray(t["scale"]).astype(np.float32), counts)], names=["u", "nb", "codes", "scales"])


def build_index(items: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", limit: int = 21,
                degree: int = DEGREE, links: int = LINKS, starts: int = STARTS, **build) -> Index:
    """Index of every row of ``items`` that takes part; results hold at most ``limit`` rows."""
    spark = items.sparkSession
    nodes, members = node_tables(vectors(items, id_col, vec_col), limit)
    first = nodes.select("code").first()
    dim = len(first["code"]) if first else 0
    graph = build_graph(nodes, dim, degree=degree, **build)
    parts = n_parts(spark)
    lists = graph.select("u", F.lit(0).alias("kind"), "code", "nb", "sc", "fl")
    both = lists.unionByName(graph.select("u", "nb", "sc").mapInArrow(_reverse, LISTS))
    linked = _by_owner(both, parts).mapInArrow(_merge_lists(links, 0, 0), GRAPH)
    stored = (linked.select("u", "nb").mapInArrow(_explode, "u long, c long")
              .join(nodes.select(F.col("nid").alias("c"), "code", "scale"), "c")
              .repartition(parts, "u").sortWithinPartitions("u", "c")
              .mapInArrow(_layout, "u long, nb binary, codes binary, scales binary"))
    layout = f"nnd_layout_{uuid.uuid4().hex}"
    stored.write.bucketBy(parts, "u").sortBy("u").format("parquet").saveAsTable(layout)
    half = max(1, starts // 2)
    some = nodes.orderBy(F.xxhash64("nid")).limit(half).unionByName(nodes.orderBy(F.desc("norm"), "nid").limit(half))
    picked = {r["nid"]: (r["nid"], bytes(r["code"]), r["scale"]) for r in some.collect()}
    return Index(nodes, members, graph, layout, sorted(picked.values()), dim)


# ---------------------------------------------------------------- search

BEAMS = "u long, kind int, code binary, nb binary, sc binary, fl binary, thr float, open int"
EXPANDED, UNSEEN, NEXT = 0, 1, 2


def _start_beams(starts: list, beam: int, expand: int):
    ids = np.array([s[0] for s in starts], np.int64)
    codes = np.array([np.frombuffer(s[1], np.int8) for s in starts], np.float32)
    scales = np.array([s[2] for s in starts], np.float32)

    def run(batches):
        for t in packed.chunks(batches):
            u = packed.long_values(t["u"])
            q, _ = packed.unpack(t["code"], np.int8)
            q = q.reshape(len(u), -1)
            x = q.astype(np.float32)
            s = (x @ codes.T) * scales
            node = np.asarray(t["node"].combine_chunks().fill_null(-1)).astype(np.int64)
            mine = (np.square(x).sum(1) * np.asarray(t["scale"]).astype(np.float32)).astype(np.float32)
            has = node >= 0
            owner = np.concatenate([np.repeat(u, len(ids)), u[has]])
            item = np.concatenate([np.tile(ids, len(u)), node[has]])
            score = np.concatenate([s.ravel(), mine[has]])
            by = np.argsort(u, kind="stable")
            yield _beam_rows(u[by], q[by], *packed.best_lists(owner, item, score, np.full(len(owner), UNSEEN, np.int8), beam),
                             beam, expand)
    return run


def _beam_rows(own, codes, owner, counts, item, score, flag, beam, expand):
    n = len(own)
    size = np.zeros(n, np.int64)
    size[np.searchsorted(own, owner)] = counts
    whose = np.repeat(np.searchsorted(own, owner), counts)
    flag = flag.astype(np.int8)
    todo = np.flatnonzero(flag == UNSEEN)      # best first within an owner
    first = packed.starts_of(whose[todo])
    rank = np.arange(len(todo)) - np.repeat(first, np.diff(np.append(first, len(todo))))
    flag[todo[rank < expand]] = NEXT
    thr = np.full(n, -np.inf, np.float32)
    full = size >= beam
    thr[full] = score[(np.cumsum(size) - 1)[full]]
    return pa.RecordBatch.from_arrays(
        [pa.array(own), pa.array(np.zeros(n, np.int32)), packed.pack(codes, np.ones(n, np.int64)), packed.pack(item, size),
         packed.pack(score.astype(np.float32), size), packed.pack(flag, size), pa.array(thr),
         pa.array(np.bincount(whose[flag == NEXT], minlength=n).astype(np.int32))],
        names=["u", "kind", "code", "nb", "sc", "fl", "thr", "open"])


def _requests(batches):
    for t in packed.chunks(batches, 512):
        u = packed.long_values(t["u"])
        item, counts = packed.unpack(t["nb"], np.int64)
        flag, _ = packed.unpack(t["fl"], np.int8)
        codes, _ = packed.unpack(t["code"], np.int8)
        codes = codes.reshape(len(u), -1)
        at = np.repeat(np.arange(len(u)), counts)
        use = flag == NEXT
        at = at[use]
        if len(at):
            yield pa.RecordBatch.from_arrays(
                [pa.array(item[use]), pa.array(u[at]), packed.pack(codes[at], np.ones(len(at), np.int64)),
                 pa.array(np.asarray(t["thr"])[at])], names=["node", "q", "qcode", "thr"])


def _score_links(batches):
    for t in packed.chunks(batches, 1024):
        item, counts = packed.unpack(t["nb"], np.int64)
        codes, _ = packed.unpack(t["codes"], np.int8)
        scales, _ = packed.unpack(t["scales"], np.float32)
        q, _ = packed.unpack(t["qcode"], np.int8)
        q = q.reshape(t.num_rows, -1).astype(np.float32)
        at = np.repeat(np.arange(t.num_rows), counts)
        x = codes.reshape(len(item), -1).astype(np.float32)
        s = np.einsum("ij,ij->i", x, q[at]) * scales
        good = s > np.asarray(t["thr"])[at]
        at, item, s = at[good], item[good], s[good].astype(np.float32)
        owner, counts, item, s, flag = packed.best_lists(packed.long_values(t["q"])[at], item, s,
                                                         np.full(len(at), UNSEEN, np.int8), len(item) + 1)
        n = len(owner)
        yield pa.RecordBatch.from_arrays(
            [pa.array(owner), pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.binary()), packed.pack(item, counts),
             packed.pack(s, counts), packed.pack(flag, counts), pa.nulls(n, pa.float32()), pa.nulls(n, pa.int32())],
            names=["u", "kind", "code", "nb", "sc", "fl", "thr", "open"])


def _merge_beams(beam: int, expand: int):
    """Beams (kind 0) and what a round found for them, sorted by query. What one
    query receives in a round is at most ``expand`` x links entries."""
    def run(batches):
        for t in packed.whole_groups(batches, "u", 2048):
            u = packed.long_values(t["u"])
            own_at = packed.long_values(t["kind"]) == 0
            codes, _ = packed.unpack(t["code"], np.int8)
            item, counts = packed.unpack(t["nb"], np.int64)
            score, _ = packed.unpack(t["sc"], np.float32)
            flag, _ = packed.unpack(t["fl"], np.int8)
            flag = np.where(flag == NEXT, EXPANDED, flag).astype(np.int8)
            yield _beam_rows(u[own_at], codes.reshape(int(own_at.sum()), -1),
                             *packed.best_lists(np.repeat(u, counts), item, score, flag, beam), beam, expand)
    return run


def _best_nodes(k: int):
    def run(batches):
        for t in packed.chunks(batches):
            item, counts = packed.unpack(t["nb"], np.int64)
            rank = np.arange(len(item)) - np.repeat(np.cumsum(counts) - counts, counts)
            use = rank < k
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(packed.long_values(t["u"]), counts)[use]),
                                              pa.array(item[use])], names=["q", "node"])
    return run


def search_nodes(index: Index, queries: DataFrame, k: int, beam: int = BEAM, expand: int = EXPAND) -> DataFrame:
    """(q, node): the ``k`` best nodes of each query's beam. ``queries``: u (a
    key of its own), code, scale, node (the query's node in the index or null)."""
    spark = queries.sparkSession
    parts = n_parts(spark)
    beams = materialize(queries.mapInArrow(_start_beams(index.starts, beam, expand), BEAMS), "nnd-beams")
    stored = spark.table(index.layout).withColumnRenamed("u", "node")
    while beams.agg(F.max("open").alias("m")).first()["m"]:
        asked = beams.mapInArrow(_requests, "node long, q long, qcode binary, thr float")
        found = stored.join(asked, "node").select("q", "qcode", "thr", "nb", "codes", "scales").mapInArrow(_score_links, BEAMS)
        beams = materialize(_by_owner(beams.unionByName(found), parts).mapInArrow(_merge_beams(beam, expand), BEAMS), "nnd-beams")
    return beams.mapInArrow(_best_nodes(k), "q long, node long")


def dot(a: str, b: str):
    """Products added in the order of the components, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def neighbours(items: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20,
               beam: int = BEAM, expand: int = EXPAND, **build) -> DataFrame:
    """The ``k`` nearest rows found for each row of ``queries``, itself a row of
    ``items`` (same id and vector), other than that row: (query_id, rank from 1,
    vec_id, score), by score, then id."""
    spark = items.sparkSession
    index = build_index(items, id_col, vec_col, limit=k + 1, **build)
    asked = queries.select(F.col(id_col).alias("id"), F.transform(F.col(vec_col).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("vec"))
    asked = asked.groupBy("id", "vec").agg(F.count(F.lit(1)).alias("copies"))
    heads = index.members.filter("rn = 1").select("nid", "vec")
    asked = materialize(asked.join(heads, "vec").select("id", "nid", "copies"), "nnd-queries")
    starts = asked.select("nid").distinct().join(index.nodes.select("nid", "code", "scale"), "nid") \
        .select(F.col("nid").alias("u"), "code", "scale", F.col("nid").alias("node"))
    near = search_nodes(index, starts, k + 1 + SLACK, beam, expand)
    mine, other = heads.select(F.col("nid").alias("q"), F.col("vec").alias("qv")), heads.select(F.col("nid").alias("node"), "vec")
    scored = near.join(other, "node").join(mine, "q").select("q", "node", dot("qv", "vec").alias("score"))
    rows = scored.join(index.members.select(F.col("nid").alias("node"), F.col("id").alias("vec_id")), "node")
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "node"))
    hits = materialize(rows.withColumn("place", best).filter(F.col("place") <= k + 1), "nnd-hits")
    index.drop(spark)
    one = Window.partitionBy("id", "q")
    own = F.when((F.col("node") == F.col("q")) & F.col("vec_id").eqNullSafe(F.col("id")), F.col("place"))
    out = (asked.withColumnRenamed("nid", "q").join(hits, "q").withColumn("own", F.coalesce(F.min(own).over(one), F.lit(k + 2)))
           .filter("place <> own").withColumn("rank", F.when(F.col("place") > F.col("own"), F.col("place") - 1).otherwise(F.col("place")))
           .filter(F.col("rank") <= k))
    return out.select(F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), F.col("id").alias("query_id"),
                      F.col("rank").cast("int").alias("rank"), "vec_id", "score").drop("copy")
