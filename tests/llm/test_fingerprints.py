import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import fingerprints as fp
from tests.llm.data import awkward, clash, empty, frame, prose


def plain_next(x):
    """One sequence's phrase names, name by name."""
    folded = []
    for v in x:
        if folded and folded[-1][0] == v:
            folded[-1][1] += 1
        else:
            folded.append([v, 1])
    if len(x) <= 1:
        return x
    top = 2 ** 64
    x = [v if c == 1 else plain_mix((v + c * int(fp._STEP)) % top) for v, c in folded]
    if len(x) == 1:
        return x

    def toss(y):
        out = []
        for a, b in zip(y, y[1:], strict=False):
            low = ((a ^ b) & -(a ^ b)).bit_length() - 1
            out.append(2 * low + (b >> low & 1))
        return out

    cuts = [0]
    if len(x) >= 6:
        labels = toss(toss(x))
        cuts += [j + 2 for j in range(1, len(labels) - 1) if labels[j] > labels[j - 1] and labels[j] > labels[j + 1]]
    out = []
    for a, b in zip(cuts, cuts[1:] + [len(x)], strict=True):
        out.append(plain_mix((sum(plain_mix((v + (k + 1) * int(fp._STEP)) % top) for k, v in enumerate(x[a:b])) + b - a) % top))
    return out


def plain_mix(x):
    x = (x ^ x >> 30) * int(fp._M1) % 2 ** 64
    x = (x ^ x >> 27) * int(fp._M2) % 2 ** 64
    return x ^ x >> 31


def plain_fingerprint(text):
    if not text:
        return "0" * 16 + "-" + "ffff" * 64
    levels = [[int(fp.BYTE_NAMES[b]) for b in text]]
    while len(levels) <= 3 or len(levels[-1]) > 1:
        levels.append(plain_next(levels[-1]))
    names, k = list(levels[3]), 2
    last = len(names)
    while k >= 0 and last < 16:
        names, last, k = names + levels[k], len(levels[k]), k - 1
    bins = [None] * 64
    for v in names:
        h = plain_mix((v + int(fp._M1)) % 2 ** 64)
        b, m = (h >> 16) % 64, plain_mix(h)
        bins[b] = m if bins[b] is None else min(bins[b], m)
    return f"{levels[-1][0]:016x}-" + "".join("ffff" if m is None else f"{m % 0xFFFF:04x}" for m in bins)


def test_texts_parsed_together_equal_a_plain_parse():
    rng = random.Random(9)
    texts = [(t or "").encode() for _, t in awkward(long_words=300)] + [b"", b"a", b"aaa", b"ab", b"aab" * 40, b"abcdef", b"abcde"]
    texts += [bytes(rng.choice(b"ab") for _ in range(n)) for n in range(1, 90)] + [prose(rng, n).encode() for n in range(30)]
    rng.shuffle(texts)
    assert fp.fingerprints(texts)[0] == [plain_fingerprint(t) for t in texts]


def brute(rows):
    docs = sorted(((i is None, i or 0, t or "", i) for i, t in rows), key=lambda r: r[:3])
    out = []
    for k, (_, _, t, i) in enumerate(docs):
        nxt = docs[(k + 1) % len(docs)][2]
        new = fp.edited(t, nxt)
        a, sa = fp.fingerprint(t.encode())
        assert a == plain_fingerprint(t.encode())
        b, sb = fp.fingerprint(new.encode())
        out.append((i, len(t), new, a, b, fp.likeness(sa, sb), fp.likeness(sa, fp.fingerprint(nxt.encode())[1])))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    for rows in (awkward(long_words=500), [(1, "only one")], [(7, None), (7, "b"), (7, "a"), (9, "c" * 100)]):
        df = clash(frame(spark, rows), "block", "tail", "at")
        got = sorted((tuple(r) for r in fp.compare_with_next(df).collect()), key=str)
        assert got == brute(rows)


def names_of(text, level):
    return set(fp.parse_all([text.encode()], level)[2].tolist())


def test_equal_substrings_share_interior_names():
    rng = random.Random(2)
    core = prose(rng, 400)
    for level in (1, 2, 3):
        names = [names_of(prose(rng, n) + " " + core + " " + prose(rng, 30), level) for n in (3, 77, 140)]
        own = len(names_of(core, level))
        assert len(names[0] & names[1] & names[2]) >= 0.9 * own


def test_equal_texts_are_equal_and_others_not():
    rng = random.Random(5)
    texts = [prose(rng, n).encode() for n in (0, 1, 2, 5, 20, 100, 1000)] + [b"a", b"aa", b"a" * 999, b"ab" * 500]
    names = [fp.fingerprint(t)[0] for t in texts]
    assert names == [fp.fingerprint(bytes(t))[0] for t in texts]
    assert len(set(names)) == len(set(texts))


def test_edits_stay_near():
    rng = random.Random(6)
    near, far = [], []
    for _ in range(30):
        a, b = prose(rng, 200), prose(rng, 200)
        near.append(fp.likeness(fp.fingerprint(a.encode())[1], fp.fingerprint(fp.edited(a, b).encode())[1]))
        far.append(fp.likeness(fp.fingerprint(a.encode())[1], fp.fingerprint(b.encode())[1]))
    assert np.mean(near) > 0.45 and np.mean(far) < 0.1 and min(near) > max(far)


def test_empty(spark):
    assert fp.compare_with_next(empty(spark)).collect() == []


def test_ids_that_are_no_integers(spark):
    with pytest.raises(TypeError):
        fp.compare_with_next(frame(spark, [(1, "a")]).withColumn("doc_id", F.lit("x")))
