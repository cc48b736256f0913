"""Nearest neighbours against brute force, and hard negatives against a plain loop."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import bond, nn_descent
from quarry.session import ship_package
from tests.llm.data import clash

ITEMS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                      T.StructField("label", T.IntegerType())])


def items(spark, rows, parts=3):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y)
                                  for i, v, y in rows], ITEMS).repartition(parts)


def takes_part(v, dim, zero_ok=False):
    return v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v) and (zero_ok or any(v))


def exact(rows, dim, k, asked):
    """(query_id, rank, vec_id, score) by plain loops over float32 values."""
    good = [(i, [float(np.float32(x)) for x in v]) for i, v, _ in rows if takes_part(v, dim)]
    out = []
    for n, (i, v) in enumerate(good):
        if i is None or not asked(i):
            continue
        hits = []
        for m, (j, w) in enumerate(good):
            if m != n:
                s = 0.0
                for a, b in zip(v, w, strict=True):
                    s += a * b
                hits.append((-s, j is None, j))
        hits.sort(key=lambda h: (h[0], h[1], h[2] or 0))
        out += [(i, r + 1, h[2], -h[0]) for r, h in enumerate(hits[:k])]
    return sorted(out, key=str)


def awkward(rng, n=300, dim=8):
    rows = [(i, rng.normal(size=dim) * rng.choice([0.2, 1, 5]), i % 4) for i in range(n)]
    same = rng.normal(size=dim)
    rows += [(n + i, same, i % 4) for i in range(120)]                 # a third of the rows: one vector
    rows += [(500, None, 1), (520, [0.0] * dim, 2), (540, [float("nan")] * dim, 3), (560, [1.0] * (dim - 1), 1),
             (580, [None] + [1.0] * (dim - 1), 2), (600, [float("inf")] * dim, 0), (620, [], 1), (640, same, None),
             (None, rng.normal(size=dim), 1), (None, same, 2), (660, rows[5][1], 3), (660, rows[5][1], 3), (20, rows[7][1], 1)]
    return rows


def test_neighbours_equal_brute_force_on_awkward_rows(spark):
    ship_package(spark)
    rows = awkward(np.random.default_rng(1))
    df = clash(items(spark, rows), "nid", "u", "score")
    got = nn_descent.neighbours(df, df.filter("vec_id % 20 = 0 AND embedding IS NOT NULL"), k=20)
    got = sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()), key=str)
    assert got == exact(rows, 8, 20, lambda i: i % 20 == 0)


def test_neighbours_of_few_rows_and_none(spark):
    ship_package(spark)
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 1.0], 1), (20, [0.0, 2.0], 1)]
    df = items(spark, rows)
    got = {(r.query_id, r["rank"], r.vec_id, r.score)
           for r in nn_descent.neighbours(df, df.filter("vec_id % 20 = 0"), k=20).collect()}
    assert got == {(0, 1, 1, 1.0), (0, 2, 20, 0.0), (20, 1, 1, 2.0), (20, 2, 0, 0.0)}
    one, none = items(spark, rows[:1]), items(spark, [])
    assert nn_descent.neighbours(one, one, k=20).count() == 0
    assert nn_descent.neighbours(none, none, k=20).count() == 0


def test_recall_on_vectors_without_clusters(spark):
    """6,000 random directions in 48 dimensions, a tenth of them near copies of one."""
    ship_package(spark)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(6000, 48)).astype(np.float32)
    v[:600] = v[0] + 0.05 * rng.normal(size=(600, 48))
    v[600:700] *= 6
    df = items(spark, [(i, x, 0) for i, x in enumerate(v.tolist())])
    got = nn_descent.neighbours(df, df.filter("vec_id % 20 = 0"), k=20).groupBy("query_id").agg(
        F.collect_set("vec_id").alias("ids")).collect()
    assert len(got) == 300
    found = 0
    for r in got:
        s = v.astype(float) @ v[r.query_id].astype(float)
        s[r.query_id] = -np.inf
        found += len(set(np.argsort(-s)[:20].tolist()) & set(r.ids))
    assert found / (300 * 20) >= 0.95


def plain_negatives(rows, dim, every=10):
    rows = [(i, y, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, y in rows
            if y is not None and takes_part(v, dim, zero_ok=True)]
    out = []
    for n, (i, y, a) in enumerate(rows):
        if i is None or i % every:
            continue
        s = sorted((-sum(p * q for p, q in zip(a, b, strict=True)), j is None, j or 0, z) for m, (j, z, b) in enumerate(rows) if m != n)
        for sp, none, j, _ in [x for x in s if x[3] == y][:5]:
            inside = [x for x in s if x[3] != y and 80 * -sp <= 100 * -x[0] <= 100 * -sp][:5]
            out += [(i, None if none else j, r + 1, None if x[1] else x[2], -sp, -x[0]) for r, x in enumerate(inside)]
    return sorted(out, key=str)


@pytest.mark.parametrize("scale", [1.0, 40.0])
def test_hard_negatives_equal_a_plain_loop(spark, scale):
    ship_package(spark)
    rows = [(i, None if v is None else [None if x is None else x * scale for x in v], y) for i, v, y in awkward(np.random.default_rng(5))]
    rows += [(10, rows[10][1], 2), (10, rows[10][1], 2), (700, [0.0] * 8, 1)]      # the anchor's own copies; a zero anchor
    df = clash(items(spark, rows), "rid", "block", "kind")
    got = bond.mine(df, F.col("id") % 10 == 0)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_negatives(rows, 8)


def test_hard_negatives_in_many_small_blocks_and_without_rows(spark):
    ship_package(spark)
    rows = awkward(np.random.default_rng(6), n=200)
    got = bond.mine(items(spark, rows), F.col("id") % 10 == 0, block_rows=20)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_negatives(rows, 8)
    assert bond.mine(items(spark, []), F.col("id") % 10 == 0).count() == 0
    assert bond.mine(items(spark, rows[:3]), F.col("id") % 10 == 0).count() == 0
    with pytest.raises(ValueError):
        bond.mine(items(spark, [(0, [1e30, 1.0], 1)]), F.col("id") % 10 == 0)


def test_scan_prunes_before_the_last_dimension():
    """Candidates are dropped on part of the dimensions, and the rest is exact."""
    import pyarrow as pa

    from quarry.llm import packed
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, size=(500, 40))
    x[:, :4] *= 100
    n = len(x)
    block = bond.Block(pa.table({"id": np.arange(n), "rid": np.arange(n), "label": np.zeros(n, np.int64),
                                 "copies": np.ones(n, np.int64), "vec": packed.pack(x.astype(np.int64), np.ones(n, np.int64))}))
    left = []
    plain = bond._best

    def prune(rows, least, most):
        left.append(len(rows))
        return most >= plain(np.ones(len(rows), np.int64), least, 5)

    rows, score = block.scan(x[0].astype(np.int64), np.arange(n), prune)
    true = x @ x[0]
    assert left[1] < n and len(left) >= 2
    assert set(np.argsort(-true, kind="stable")[:5]) <= set(rows) and (score == true[rows]).all()
