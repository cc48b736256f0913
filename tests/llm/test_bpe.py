import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import queries, trie_bpe
from tests.llm.data import awkward, clash, empty, frame

PATH = queries.vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def test_matches_library(spark, library):
    rows = awkward(long_words=800) + [(900, "a<|endoftext|>b <|endoftext|>"), (901, "don't  stop\n\n  1234 ½ ٣ ///"),
                                      (902, "é‍\U0001F600" * 50), (903, "\x00\x1f\xa0　")]
    df = clash(frame(spark, rows), "ids", "decoded", "__text")
    got = trie_bpe.encode_decode(df.drop("__text"), PATH, keep=("doc_id", "lang")).collect()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, tuple(ids), library.decode(ids, skip_special_tokens=False)))
    assert sorted([(r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in got], key=str) == sorted(want, key=str)


def test_special_as_text(spark, library):
    got = trie_bpe.encode_decode(frame(spark, [(1, "x<|endoftext|>")]), PATH, special_as_text=True).first()
    assert 50256 not in got["ids"] and got["decoded"] == "x<|endoftext|>"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=24), min_size=1, max_size=6, unique=True))
def test_trie_equals_merging(words):
    known = test_trie_equals_merging.__dict__
    if "vocab" not in known:
        known["vocab"] = trie_bpe.load_vocabulary(PATH)
        known["enc"] = trie_bpe.TrieEncoder(known["vocab"])
    vocab = known["vocab"]
    got = known["enc"].encode(words)
    for w in words:
        assert list(got[w]) == [vocab["ids"][p] for p in trie_bpe.merge_pieces(w, vocab["ranks"])]


def test_side_by_side_equals_merging():
    vocab = trie_bpe.load_vocabulary(PATH)
    enc = trie_bpe.TrieEncoder(vocab)
    assert enc.ordered
    whole = [t for t in sorted(vocab["ids"])[::97] if trie_bpe.merge_pieces(t, vocab["ranks"]) == [t]]
    whole += [b"a", b"aa", b"-", b"--", b"---", b"----", b" ", b"  ", b"   ", b"    ", b"00", b"000", b"0000"]
    whole = [t for t in whole if t in vocab["ids"]]
    for a in whole[::3] + whole[-13:]:
        for b in whole[::5] + whole[-13:]:
            want = trie_bpe.merge_pieces(a + b, vocab["ranks"]) == [a, b]
            assert enc.fits(vocab["ids"][a], vocab["ids"][b]) == want, (a, b)


def test_unordered_merges():
    ids = {b"a": 0, b"b": 1, b"c": 2, b"bc": 3, b"abc": 4}
    vocab = {"ids": ids, "ranks": {(b"a", b"bc"): 0, (b"b", b"c"): 1}}
    enc = trie_bpe.TrieEncoder(vocab)
    assert not enc.ordered
    assert enc.encode([b"abc", b"aabcb"]) == {b"abc": [4], b"aabcb": [0, 4, 1]}


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(trie_bpe, "MEMO_WORDS", 10)
    vocab = trie_bpe.load_vocabulary(PATH)
    names = [b for b, _ in sorted(vocab["ids"].items(), key=lambda x: x[1])]
    enc = trie_bpe.TrieEncoder(vocab)
    for k in range(20):
        words = {f" w{k}{j}" for j in range(5)} | {"x" * (100 + k)}
        enc.remember(words, names)
        assert all(enc.spelt[w] == w.encode() for w in words)
        assert len(enc.memo) <= 11


def test_query_digest(spark, library):
    out = queries.bpe_digest(trie_bpe.encode_decode(frame(spark, [(1, "hello world"), (2, None)]), PATH))
    rows = {r["doc_id"]: r for r in out.collect()}
    ids = library.encode("hello world").ids
    assert rows[1]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert rows[2]["n_tokens"] == 0 and rows[2]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()


def test_empty(spark):
    assert trie_bpe.encode_decode(empty(spark), PATH).collect() == []
