import xxhash

from quarry.llm import simhash
from tests.llm.data import awkward, clash, empty, frame


def brute(rows, max_bits=2):
    fps = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h)))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= max_bits:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    comp = {}
    for g in groups.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        for i in g:
            comp[i] = min(ids) if ids else None
    return sorted(((rows[i][0], fps[i], comp[i]) for i in range(len(rows))), key=str), len(groups)


def test_matches_brute_force(spark):
    rows = awkward()
    for bits in (2, 3):
        want, _ = brute(rows, bits)
        got = simhash.near_duplicates(frame(spark, rows), max_bits=bits).collect()
        assert sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got), key=str) == want


def test_links_chain_and_reach_radius(spark):
    # a chain of fingerprints two bits apart is one component, three bits apart are two
    fps = [0, 3, 15, 63, 1 << 40, (1 << 40) | 0b111]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = {(r["a"], r["b"]) for r in simhash.near_links(df, 2).collect()}
    assert (0, 3) in links and (3, 15) in links
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    assert not any({a, b} == {1 << 40, (1 << 40) | 7} for a, b in links)


def test_keep_one_of_each_group(spark):
    rows = awkward()
    _, groups = brute(rows)
    df = clash(frame(spark, rows), "row_key", "fp", "root")
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    assert out.count() == groups
    assert all(r["fp"] == "own fp" for r in out.collect())


def test_empty(spark):
    assert simhash.near_duplicates(empty(spark)).collect() == []
    assert simhash.keep_one(empty(spark)).collect() == []
