"""Importance resampling against a plain pass, and the selection against sorting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.llm import importance
from quarry.session import ship_package
from tests.llm.data import awkward, clash, empty, frame, prose

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def features(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[k:k + n]).encode()) % 10_000 for n in (1, 2, 3) for k in range(len(w) - n + 1)]


def plain(docs, target):
    found = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for _, x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in range(10_000)}
    rows = []
    for i, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        rows.append((i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    pool = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = pool[:5 * len(pool) // 100]
    out = [(i, f, w, s, None) for i, n, f, w, s in rows]
    for rank, (i, _, f, w, s) in enumerate(drawn, 1):
        out[out.index((i, f, w, s, None))] = (i, f, w, s, rank)
    return sorted(out, key=str)


def test_equals_a_plain_pass(spark):
    ship_package(spark)
    rows = awkward(seed=3, n=140)
    rng = random.Random(4)
    target = [(1, rows[9][1]), (2, prose(rng, 50)), (3, None), (4, "")]
    got = importance.resample(clash(frame(spark, rows), "neg", "rank", "in"), frame(spark, target))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, target)


def test_no_target_and_no_documents(spark):
    ship_package(spark)
    rows = awkward(seed=8, n=40)
    got = importance.resample(frame(spark, rows), empty(spark))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, [])
    assert importance.resample(empty(spark), frame(spark, rows)).count() == 0


def test_text_ids_are_compared_as_text(spark):
    ship_package(spark)
    docs = frame(spark, [(i, prose(random.Random(i), 30)) for i in range(60)]).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    got = importance.resample(docs, empty(spark)).filter("rank IS NOT NULL").orderBy("rank").collect()
    assert [r["rank"] for r in got] == [1, 2, 3] and all(a.score >= b.score for a, b in zip(got, got[1:], strict=False))


@pytest.mark.parametrize("kind", ["spread", "hot", "equal"])
def test_cutoff_is_the_key_at_its_place(spark, kind):
    """Few keys may be read, so every round of the selection runs."""
    ship_package(spark)
    rng = random.Random(1)
    pick = {"spread": lambda: rng.randint(-10**6, 10**6), "hot": lambda: rng.choice([7, 7, 7, rng.randint(0, 20)]), "equal": lambda: 5}[kind]
    keys = [(pick(), rng.choice([0, 0, 1]), rng.randint(0, 40), rng.randint(0, 3)) for _ in range(900)]
    df = spark.createDataFrame(keys, "neg long, none int, id long, runs long").repartition(7)
    order = sorted(keys)
    for place in (2, 700):
        assert importance.cutoff(df, place, few=60) == order[place - 1]
    assert importance.cutoff(df, 0) is None and importance.cutoff(df, 901) is None


def test_hashes_of_words_of_any_length():
    texts = ["Hello wörld 12x z " * 3, "", "a", " .", "x" * 500 + " " + "y" * 70 + " b", "日本 語 text", "\x7f9~A_b"]
    doc, bucket, words = importance.runs_of([t.encode() for t in texts])
    for i, t in enumerate(texts):
        n, f = features(t)
        assert words[i] == n and sorted(bucket[doc == i]) == sorted(f)
