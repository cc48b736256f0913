import zlib
from collections import Counter

import numpy as np

from quarry.llm import jump_shard
from tests.llm.data import awkward, clash, empty, frame


def plain_jump(key, shards):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * jump_shard.JUMP_MULTIPLIER + 1) & ((1 << 64) - 1)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_matches_plain_loop():
    keys = np.array([0, 1, 2, -1, 10**12, *range(500)], dtype=np.int64)
    for n in (1, 2, 8, 9, 1000):
        got = jump_shard.jump_hash(keys.view(np.uint64), n)
        assert got.tolist() == [plain_jump(int(k), n) for k in keys]


def test_growth_moves_only_into_the_new_shard():
    keys = np.arange(20000, dtype=np.uint64)
    a, b = jump_shard.jump_hash(keys, 8), jump_shard.jump_hash(keys, 9)
    assert set(b[a != b]) == {8} and abs((a != b).mean() - 1 / 9) < 0.01
    assert max(Counter(a).values()) < 1.1 * 20000 / 8


def test_rows(spark):
    rows = awkward()
    for block in (200_000, 5):
        got = jump_shard.assign_shards(clash(frame(spark, rows), "size", "shard", "slot"), block_rows=block).collect()
        want = sorted(((i, 1 if t is None else len(t.encode()) + 1, zlib.crc32((t or "").encode()),
                        plain_jump(-1 if i is None else i, 8), plain_jump(-1 if i is None else i, 9)) for i, t in rows), key=str)
        assert sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got), key=str) == want
        for s in range(8):
            own = sorted([r for r in got if r["shard"] == s], key=lambda r: r["slot"])
            assert [r["slot"] for r in own] == list(range(len(own)))
            order = [(-1 if r["doc_id"] is None else r["doc_id"], r["text_crc32"]) for r in own]
            assert order == sorted(order)


def test_other_key_types(spark):
    df = spark.createDataFrame([("a", "x"), ("b", None), (None, "y")], "k string, text string")
    got = jump_shard.assign_shards(df, "k").collect()
    assert len(got) == 3 and all(0 <= r["shard"] < 8 for r in got)


def test_empty(spark):
    assert jump_shard.assign_shards(empty(spark)).collect() == []
