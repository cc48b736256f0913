import zlib

import numpy as np

from quarry.llm import mil_quality as mq
from tests.llm.data import awkward, clash, empty, frame

SF = "/root/testdata/sf0.01"


def tables(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_held_out_accuracy(spark):
    docs, labels = tables(spark)
    model = mq.fit(docs.select("doc_id", "text"), labels)
    out = mq.score(docs, model).join(labels, "doc_id").collect()
    held = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(held) > 50
    right = np.mean([(r["score"] >= mq.THRESHOLD) == (r["quality"] == 1) for r in held])
    kept = np.mean([r["score"] >= mq.THRESHOLD for r in held if r["quality"] == 1])
    assert right >= 0.95 and kept >= 0.95


def test_scores_ignore_other_columns_and_held_out_labels(spark):
    docs, labels = tables(spark, "/root/testdata/sf0.001")
    from pyspark.sql import functions as F
    turned = labels.withColumn("quality", F.when(mq.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = mq.score(docs, mq.fit(docs, labels)).select("doc_id", "score").collect()
    b = mq.score(docs.withColumn("lang", F.lit("xx")), mq.fit(docs, turned)).select("doc_id", "score").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_gradients_agree_with_differences():
    # training lowers the loss and the attention finds the one bad passage
    rng = np.random.default_rng(0)
    bags, y = [], []
    for i in range(200):
        g = rng.random((rng.integers(1, 6), mq.N_FEATURES)).astype(np.float32)
        bad = i % 2
        if bad:
            g[rng.integers(len(g)), :5] += 3
        bags.append(g)
        y.append(1.0 - bad)
    m = mq.train(bags, np.array(y), epochs=25)
    s = m.score_all(bags)
    assert np.mean((s > 0.5) == (np.array(y) > 0.5)) > 0.95
    one = np.array([m.score(g) for g in bags])
    assert np.allclose(one, s)


def test_awkward_rows(spark):
    docs, labels = tables(spark)
    model = mq.fit(docs, labels.unionByName(labels.limit(5)))
    rows = awkward()
    df = clash(frame(spark, rows), "score", "row")
    out = mq.score(df.drop("score"), model).collect()
    assert len(out) == len(rows) and all(0.0 <= r["score"] <= 1.0 for r in out)
    kept = mq.keep_quality(df, labels.limit(0))
    assert kept.columns == df.columns and kept.count() == len(rows)  # nothing learned: nothing rejected


def test_labels_with_nulls_and_one_class(spark):
    docs = frame(spark, [(i, f"text {i}") for i in range(20)])
    labels = spark.createDataFrame([(i, 1 if i % 2 else None, 0) for i in range(20)] + [(None, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    assert mq.fit(docs, labels).flat == 1.0
    assert mq.score(empty(spark), mq.Model(flat=0.5)).collect() == []


def test_empty_documents(spark):
    _, labels = tables(spark)
    assert mq.fit(empty(spark), labels).flat == 1.0
    assert mq.keep_quality(empty(spark), labels).collect() == []


def test_training_rows_and_passages_are_bounded(spark, monkeypatch):
    import random
    from tests.llm.data import prose
    rng = random.Random(2)
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2]
    # one id in many rows of different and of equal texts, one very long text
    rows = [(ids[0], prose(rng, 20)) for _ in range(30)] + [(ids[0], "same text")] * 30 + [(ids[1], "word " * 20000)] + \
        [(i, prose(rng, 30)) for i in ids[2:]]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in ids], "doc_id long, quality int, toxic int")
    taken = []
    monkeypatch.setattr(mq, "train", lambda bags, y: taken.append([len(g) for g in bags]))
    mq.fit(frame(spark, rows), labels)
    mq.fit(frame(spark, rows), labels, max_train=20)
    mq.fit(frame(spark, rows), labels, max_passages=100)
    assert len(taken[0]) == 30 + 1 + 1 + len(ids[2:]) and max(taken[0]) == 196
    assert len(taken[1]) == 20
    # whole texts only: the long one is left out, the others fit
    assert sorted(taken[2]) == sorted(taken[0])[:-1] and sum(taken[2]) <= 100 < sum(taken[0])
    mq.fit(frame(spark, rows), labels, max_passages=25)
    assert len(taken[3]) == 25 and set(taken[3]) <= set(taken[0])
