"""The index kept up by changes equals one built anew, and leaves other files alone."""

import os
import random

from quarry.operators import retrieval as R
from quarry.sources import index_segments as IX

WORDS = [f"w{i}" for i in range(60)]


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "doc_id long, text string")


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def hits(df):
    return sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def test_changes_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 30)))
    now = {i: text() for i in range(60)} | {60: None, 61: ""}
    q = spark.createDataFrame([(i, " ".join(rng.sample(WORDS, 3))) for i in range(5)] + [(9, "nothing"), (10, None)], "query_id long, query string")
    path = IX.create(frame(spark, now), str(tmp_path / "ix"), n_buckets=16)
    # replace some, add some, delete some (one that is not there, one that is also replaced)
    for change, gone in (({i: text() for i in (3, 4, 60, 70, 71)}, [5, 6, 999, 4]), ({70: text(), 5: text()}, [71])):
        before = files(path)
        IX.apply(path, frame(spark, change), spark.createDataFrame([(i,) for i in gone], "doc_id long"))
        now = {i: t for i, t in now.items() if i not in gone} | change
        after = files(path)
        assert all(after.get(f) == t for f, t in before.items())     # no file of an earlier segment changed
        at = IX.Segments(spark, path)
        assert at.n_docs == len(now) and at.total_len == sum(len((t or "").split()) for t in now.values())
        assert hits(IX.search(q, path, k=8)) == hits(R.keyword_search(q, frame(spark, now), k=8))
    # one document of one word: only that word's bucket is merged
    assert len(IX.compact(spark, path)) == 16 and IX.compact(spark, path) == []
    IX.apply(path, frame(spark, {80: "w7"}))
    now[80] = "w7"
    before = files(path)
    todo = IX.compact(spark, path)
    new = set(files(path)) - set(before)
    assert len(todo) == 1 and {f.split("bucket=")[1].split("/")[0] for f in new if "bucket=" in f} == {str(todo[0])}
    assert hits(IX.search(q, path, k=8)) == hits(R.keyword_search(q, frame(spark, now), k=8))


def test_a_change_that_died_leaves_the_index(spark, tmp_path):
    import shutil

    path = IX.create(frame(spark, {1: "a b", 2: "b c"}), str(tmp_path / "ix"), n_buckets=4)
    q = spark.createDataFrame([(1, "a b")], "query_id long, query string")
    before = hits(IX.search(q, path))
    IX.apply(path, frame(spark, {1: "c", 3: "a a"}))
    shutil.rmtree(f"{path}/commits/segment=1")       # as if it had ended before its commit
    assert hits(IX.search(q, path)) == before
    assert IX.apply(path, frame(spark, {3: "a"})) == 1     # the number is used again, over the dead files
    assert hits(IX.search(q, path)) == hits(R.keyword_search(q, frame(spark, {1: "a b", 2: "b c", 3: "a"})))
