import random

from quarry.llm import decontam
from tests.llm.data import awkward, clash, empty, frame, prose

ITEM = "item_id long, text string"


def brute_tiling(doc, item, least):
    """Greedy tiling by trying every pair of places again after every tile; of
    equally long matches the first in the document, then in the item, is marked."""
    in_doc, in_item, covered, tiles, longest = set(), set(), 0, 0, 0
    while True:
        best = (0, 0, 0)
        for a in range(len(doc)):
            for p in range(len(item)):
                n = 0
                while (a + n < len(doc) and p + n < len(item) and doc[a + n] == item[p + n]
                       and a + n not in in_doc and p + n not in in_item):
                    n += 1
                if n > best[0]:
                    best = (n, a, p)
        n, a, p = best
        if n < least:
            return covered, tiles, longest
        in_doc.update(range(a, a + n))
        in_item.update(range(p, p + n))
        covered += n
        tiles += 1
        longest = max(longest, n)


def test_tiling_matches_brute_force():
    rng = random.Random(4)
    for _ in range(150):
        item = [rng.choice("abcdef") for _ in range(rng.randint(3, 25))]
        cut = rng.randrange(len(item))
        doc = [rng.choice("abcdefg") for _ in range(10)] + item[cut:] + ["x"] + item[:cut] + [rng.choice("abc") for _ in range(8)]
        block = decontam.Block.build([(1, " ".join(item))], 5)
        least = min(5, len(item))
        ms = block.matches(block.encode([t.encode() for t in doc])).get(0, [])
        assert decontam.tile(ms, len(item), least) == brute_tiling(doc, item, least)


def test_seeds_in_stretches_give_the_same(monkeypatch):
    rng = random.Random(8)
    items = [(1, "a " * 30), (2, "a b a b a b a b c d e f g"), (3, prose(rng, 25))]
    docs = [("a " * 200).split(), ("a b " * 60 + "c d e f g").split(), prose(rng, 50).split()]
    block = decontam.Block.build(items, 5)
    ids = [block.encode([t.encode() for t in d]) for d in docs + [sum(docs, []) + tokens for tokens in docs]]
    whole = [block.matches(i) for i in ids]
    assert any(whole)
    for size in (1, 7, 100):
        monkeypatch.setattr(decontam, "SEED_BLOCK", size)
        for i, want in zip(ids, whole):
            got = block.matches(i)
            assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def cases(rng):
    item = prose(rng, 40).split()
    other = prose(rng, 30).split()
    docs = [(1, prose(rng, 30) + " " + " ".join(item) + " " + prose(rng, 5)),        # whole
            (2, " ".join(item[20:]) + ". " + prose(rng, 9) + " " + " ".join(item[:20])),  # reordered
            (3, " ".join(item).upper().replace(" ", " , ")),                       # other case and marks
            (4, " ".join(item[:12])),                                              # too little
            (5, prose(rng, 80)), (6, None), (7, ""), (None, " ".join(other)), (8, "q w"), (8, "q w e")]
    bench = [(10, " ".join(item)), (11, " ".join(other)), (12, None), (13, ""), (14, "q w"), (None, "... !")]
    return docs, bench


def test_pairs(spark):
    docs, bench = cases(random.Random(1))
    b = clash(spark.createDataFrame(bench, ITEM), "doc_id", "coverage")
    for size in (1 << 20, 30):  # one block and many
        got = decontam.contaminated_pairs(clash(frame(spark, docs), "item_id", "coverage"), b, block_bytes=size).collect()
        pairs = sorted(((r["doc_id"], r["item_id"]) for r in got), key=str)
        assert pairs == sorted([(1, 10), (2, 10), (3, 10), (None, 11), (8, 14), (8, 14)], key=str)
        reordered = next(r for r in got if r["doc_id"] == 2)
        assert reordered["coverage"] == 1.0 and reordered["n_tiles"] == 2


def test_drop(spark):
    docs, bench = cases(random.Random(1))
    df = clash(frame(spark, docs), "item_id", "clean")
    out = decontam.drop_contaminated(df, spark.createDataFrame(bench, ITEM), block_bytes=100)
    assert out.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["4", "5", "6", "7"]


def test_clean_rows_stay(spark):
    bench = spark.createDataFrame([(1, prose(random.Random(99), 40))], ITEM)
    rows = awkward()
    assert decontam.contaminated_pairs(frame(spark, rows), bench).count() == 0
    assert decontam.drop_contaminated(frame(spark, rows), bench).count() == len(rows)


def test_empty(spark):
    none = spark.createDataFrame([], ITEM)
    some = spark.createDataFrame([(1, "a b c")], ITEM)
    assert decontam.contaminated_pairs(empty(spark), some).collect() == []
    assert decontam.contaminated_pairs(frame(spark, [(1, "a b c")]), none).collect() == []
    assert decontam.drop_contaminated(frame(spark, [(1, "a b c")]), none).count() == 1
