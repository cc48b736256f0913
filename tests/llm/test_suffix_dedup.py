import random
import re

import numpy as np

from quarry.llm import suffix_dedup as sd
from tests.llm.data import awkward, clash, empty, frame


def brute(rows, size=100):
    """Spans by a plain pass over all strings, in order of (id, text hash)."""
    docs = sorted({(sd.LAST_ID if i is None else i, sd.text_key((t or "").encode()), (t or "").encode()) for i, t in rows})
    seen, out = set(), {}
    for kid, rid, b in docs:
        spans = []
        for k in range(len(b) - size + 1):
            if b[k:k + size] in seen:
                spans.append((k, k + size))
            seen.add(b[k:k + size])
        out[kid, rid] = sd.merge_spans(spans)
    return out


def compare(spark, rows, **how):
    want = brute(rows)
    got = sd.dedup(frame(spark, rows), **how).collect()
    assert len(got) == len(rows)
    by_key = {}
    for r in got:
        by_key.setdefault(r["row"]["doc_id"], []).append(r)
    left = sorted((sd.LAST_ID if i is None else i, (t or "").encode()) for i, t in rows)
    have = []
    for i, rs in by_key.items():
        kid = sd.LAST_ID if i is None else i
        texts = [t for k, t in left if k == kid]
        assert len(texts) == len(rs)
        have += [(kid, r["n_bytes"], r["n_removed"], tuple((s["s"], s["e"]) for s in r["spans"]), bytes(r["kept"])) for r in rs]
    expect = []
    for kid, b in left:
        spans = want[kid, sd.text_key(b)]
        kept, at = b"", 0
        for s, e in spans:
            kept, at = kept + b[at:s], e
        expect.append((kid, len(b), sum(e - s for s, e in spans), tuple(spans), kept + b[at:]))
    assert sorted(have) == sorted(expect)


def test_matches_brute_force(spark):
    compare(spark, awkward())


def test_hot_anchors_give_the_same(spark):
    compare(spark, awkward(seed=2), hot=2)


def test_texts_of_one_id_are_gathered_apart(spark):
    # rows without an id, and rows of one id, are no group of their own in any exchange
    rows = [(None if i % 2 else 7, t) for i, (_, t) in enumerate(awkward(seed=4))]
    compare(spark, rows)
    compare(spark, rows, hot=2)
    plan = sd.dedup(frame(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(kid#\d+L, tid#\d+L, ", plan)
    assert not re.search(r"hashpartitioning\(kid#\d+L, \d+[,)]", plan)


def test_other_grams_give_the_same(spark):
    compare(spark, awkward(seed=3, n=15), gram=50)


def test_merge_of_many_shards(monkeypatch):
    rng = random.Random(5)
    core = bytes(rng.choice(b"abcd") for _ in range(400))
    segments = []
    for _ in range(60):
        s = rng.randrange(200)
        segments.append(core[s:s + rng.randint(100, 200)] if rng.random() < 0.7 else
                        bytes(rng.choice(b"ab") for _ in range(rng.randint(100, 180))))
    counts = [len(s) - 99 for s in segments]
    seen, want = set(), []
    for s in segments:
        strings = [s[i:i + 100] for i in range(len(s) - 99)]
        flags = []
        for x in strings:
            flags.append(x in seen)
            seen.add(x)
        want.append(np.array(flags))
    for shard in (200, 1000, 1 << 16):
        monkeypatch.setattr(sd, "SHARD", shard)
        got = sd.repeated_starts(segments, counts)
        assert all((a == b).all() for a, b in zip(got, want))


def test_equal_strings_share_anchors():
    rng = random.Random(8)
    a = bytes(rng.randrange(97, 110) for _ in range(3000))
    b = bytes(rng.randrange(97, 110) for _ in range(777)) + a[500:1500] + b"q" * 50
    def by_string(t):
        first, count, names = sd.anchors(np.frombuffer(t, dtype=np.uint8))
        assert count.sum() == len(t) - 99
        return {t[i:i + 100]: n for s, c, n in zip(first, count, names) for i in range(s, s + c)}
    x, y = by_string(a), by_string(b)
    assert len(x.keys() & y.keys()) >= 900
    assert all(x[k] == y[k] for k in x.keys() & y.keys())


def test_long_text_in_chunks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    raw = rng.integers(97, 105, 5000).astype(np.uint8)
    whole = sd.anchors(raw)
    monkeypatch.setattr(sd, "CHUNK", 700)
    first, count, names = sd.anchors(raw)
    expand = lambda f, c, n: np.repeat(n, c)
    assert (expand(*whole) == expand(first, count, names)).all()


def test_cut_texts_keeps_columns(spark):
    rows = awkward()
    df = clash(frame(spark, rows), "row", "kid", "spans", "kept")
    out = sd.cut_texts(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    got = out.collect()
    assert len(got) == len(rows)
    assert all(r["row"] == "own row" and (r["n_chars"] is None or r["n_chars"] == len(r["text"])) for r in got)


def test_empty(spark):
    assert sd.dedup(empty(spark)).collect() == []
