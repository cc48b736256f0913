"""BPE encoding and decoding by prefix-sharing trie traversal.

A byte-pair encoding of a word is the only token sequence in which every
neighbouring pair is itself the encoding of its bytes. Therefore the encoding
of a prefix is fixed by its last token: among the tokens that end the prefix,
exactly one is compatible with the last token of what stands before it. The
distinct words of a batch are laid into a trie and walked depth first; each
node's last token is computed once from its ancestors, so a prefix that many
words share is encoded once.

The walk takes the words in byte order and keeps the path of the current
branch: going to the next word backs up to the shared prefix, which is what a
depth-first traversal of the trie does, without storing its closed branches.
A bounded memo keeps the encodings of words seen before in the task.

Defined cases: null text is empty (no ids, empty string); texts of any length
are encoded whole; every byte is a token, so every text has an encoding.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import common

# Fixed value: the public pre-tokenizer pattern of byte-level BPE files.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct words whose encodings a worker keeps, and the longest kept word.
MEMO_WORDS = 500_000
MEMO_BYTES = 64
#: Token pairs whose compatibility a worker keeps.
PAIR_MEMO = 500_000


def byte_letters() -> dict[str, int]:
    """The public byte alphabet: printable Latin-1 characters stand for
    themselves, the other bytes for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> dict:
    """Token bytes, merge ranks and special tokens of a byte-level BPE file.

    Read on the driver and shipped to the tasks: its size is that of the file
    (a fixed vocabulary), not of the data."""
    with open(path, "rb") as f:
        data = f.read()
    spec = json.loads(data)
    letters = byte_letters()
    raw = lambda s: bytes(letters[c] for c in s)
    ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
    ranks = {}
    for r, m in enumerate(spec["model"]["merges"]):
        a, b = m.split(" ") if isinstance(m, str) else m
        ranks[raw(a), raw(b)] = r
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    return {"key": hashlib.sha1(data).hexdigest(), "ids": ids, "ranks": ranks, "special": special}


def merge_pieces(data: bytes, ranks: dict) -> list[bytes]:
    """Plain pair merging of a short byte string: lowest rank first, leftmost first."""
    parts = [data[i:i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best = min((ranks.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
        if best[0] == 1 << 60:
            break
        a, b = parts[best[1]], parts[best[1] + 1]
        out, i = [], 0
        while i < len(parts):
            if i + 1 < len(parts) and parts[i] == a and parts[i + 1] == b:
                out.append(a + b)
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


class TrieEncoder:
    """Encodes sets of distinct words (bytes) by walking their trie.

    The tokens that end a prefix are read off an automaton over the token
    strings, built state by state as the words need it (at most one state for
    each prefix of a token)."""

    def __init__(self, vocab: dict):
        self.ids, self.ranks = vocab["ids"], vocab["ranks"]
        self.bytes_of = {i: t for t, i in self.ids.items()}
        self.base = max(self.bytes_of, default=0) + 2
        self.pairs: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}
        self.spelt: dict[str, bytes] = {}
        self.long: list[str] = []
        self.prefixes = {t[:k] for t in self.ids for k in range(len(t) + 1)}
        self.state_of: dict[bytes, int] = {}
        self.strings: list[bytes] = []
        self.ends: list[list[tuple[int, int]]] = []  # (token, length) that end a state's string, longest first
        self.goto: dict[int, int] = {}
        self.state(b"")
        # how a token comes about: its two parts and the rank of their merge
        made = {a + b: (a, b, r) for (a, b), r in self.ranks.items()}
        self.made = {self.ids[t]: (self.ids[a], self.ids[b], r) for t, (a, b, r) in made.items()}
        self.rank = {self.ids[a] * self.base + self.ids[b]: r for (a, b), r in self.ranks.items()}
        made_at = {t: r for t, (_, _, r) in made.items()}
        #: Each token has one merge, of a later rank than those of its parts.
        self.ordered = len(made) == len(self.ranks) and all(
            r > max(made_at.get(a, -1), made_at.get(b, -1)) for (a, b), r in self.ranks.items())
        self.edges: tuple[dict, dict] = ({}, {})

    def state(self, string: bytes) -> int:
        """The state whose string is the longest suffix of ``string`` that begins a token."""
        while string not in self.prefixes:
            string = string[1:]
        n = self.state_of.get(string)
        if n is None:
            n = self.state_of[string] = len(self.strings)
            self.strings.append(string)
            tails = [string[k:] for k in range(len(string))]
            self.ends.append([(self.ids[t], len(t)) for t in tails
                              if t in self.ids and merge_pieces(t, self.ranks) == [t]])
        return n

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The pieces that stand at an edge of a token (0: left, 1: right)
        while it is merged, each with the rank of the merge that absorbs it."""
        out = self.edges[side].get(token)
        if out is None:
            out, at = [(token, float("inf"))], token
            while at in self.made:
                step = self.made[at]
                at = step[side]
                out.append((at, step[2]))
            self.edges[side][token] = out
        return out

    def fits(self, left: int, right: int) -> bool:
        """Whether two tokens stand side by side in the encoding of their bytes
        (left -1: the start of a word).

        Merges run in ascending rank, so the two part company only if a piece
        at the right edge of one and a piece at the left edge of the other
        merge before either is absorbed by its own token; of equal ranks the
        leftmost merge comes first."""
        if left < 0:
            return True
        if not self.ordered:
            a, b = self.bytes_of[left], self.bytes_of[right]
            return merge_pieces(a + b, self.ranks) == [a, b]
        rank, starts = self.rank, self.edge(right, 0)
        for a, gone_a in self.edge(left, 1):
            for b, gone_b in starts:
                r = rank.get(a * self.base + b)
                if r is not None and r < gone_a and r <= gone_b:
                    return False
        return True

    def encode(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Encodings of distinct words, by a depth-first walk of their trie."""
        out = {}
        # of the branch's prefix of length d: last token, its length, automaton state
        last, sizes, states = [-1], [0], [0]
        branch = b""
        goto, ends, pairs, base = self.goto, self.ends, self.pairs, self.base
        for word in sorted(words):
            shared = 0
            top = min(len(word), len(branch))
            if word[:top] == branch[:top]:
                shared = top
            else:
                while word[shared] == branch[shared]:
                    shared += 1
            del last[shared + 1:], sizes[shared + 1:], states[shared + 1:]
            at = states[shared]
            for d in range(shared + 1, len(word) + 1):
                way = at << 8 | word[d - 1]
                at = goto.get(way, -1)
                if at < 0:
                    at = goto[way] = self.state(self.strings[way >> 8] + word[d - 1:d])
                for tok, size in ends[at]:
                    left = last[d - size]
                    key = left * base + tok
                    ok = pairs.get(key)
                    if ok is None:
                        if len(pairs) >= PAIR_MEMO:
                            pairs.clear()
                        ok = pairs[key] = self.fits(left, tok)
                    if ok:
                        last.append(tok)
                        sizes.append(size)
                        states.append(at)
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            branch = word
            codes, d = [], len(word)
            while d:
                codes.append(last[d])
                d -= sizes[d]
            codes.reverse()
            out[word] = codes
        return out

    def remember(self, words: set[str], spelling: list[bytes]) -> None:
        """See to it that the memo holds the words of a batch: their token ids
        (packed as 32-bit integers) and the bytes that the ids stand for."""
        for w in self.long:
            self.memo.pop(w, None)
            self.spelt.pop(w, None)
        new = words.difference(self.memo)
        if len(self.memo) + len(new) > MEMO_WORDS:
            self.memo = {w: c for w, c in self.memo.items() if w in words}
            self.spelt = {w: c for w, c in self.spelt.items() if w in words}
        raw = {w.encode(): w for w in new}
        for r, codes in self.encode(list(raw)).items():
            self.memo[raw[r]] = np.array(codes, dtype=np.int32).tobytes()
            self.spelt[raw[r]] = b"".join([spelling[i] for i in codes])
        self.long = [w for w in new if len(w) > MEMO_BYTES]  # not kept for the next batch


_ENCODERS: dict = {}  # per worker process: encoders by vocabulary


def encoder_for(key, vocab) -> TrieEncoder:
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = TrieEncoder(vocab.value)
    return _ENCODERS[key]


def encode_decode(df: DataFrame, vocab_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
                  special_as_text: bool = False) -> DataFrame:
    """``keep`` columns, ids (array<int>) and decoded (string) per row.

    ``special_as_text=False`` reads the file's special strings in a text as
    their tokens, as the public library does by default; the rest of the text
    is split by the file's pre-tokenizer pattern.
    """
    spark = df.sparkSession
    common.prepare(spark)
    vocab = load_vocabulary(vocab_path)
    special = {} if special_as_text else vocab["special"]
    tokens = {i: b for b, i in vocab["ids"].items()} | {i: s.encode() for s, i in vocab["special"].items()}
    size = max(tokens, default=-1) + 1
    shared = spark.sparkContext.broadcast(vocab)
    names = spark.sparkContext.broadcast([tokens.get(i, b"") for i in range(size)])
    key = vocab["key"]
    src = df.select(*keep, F.col(text_col).cast("string").alias("__text"))
    kinds = T.StructType([*src.select(*keep).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())),
                          T.StructField("decoded", T.StringType())])
    n_keep = len(keep)
    cut = regex.compile("|".join(regex.escape(s) for s in special)) if special else None

    def run(b: pa.RecordBatch) -> dict:
        enc = encoder_for(key, shared)
        split = regex.compile(SPLIT_PATTERN).findall
        docs = []
        for t in b.column(n_keep).to_pylist():
            if not t:
                docs.append([])
                continue
            if cut is None or not cut.search(t):
                docs.append([split(t)])
                continue
            pieces, at = [], 0
            for m in cut.finditer(t):
                pieces += [split(t[at:m.start()]), special[m.group()]]
                at = m.end()
            docs.append([*pieces, split(t[at:])])
        by_id = names.value
        words: set[str] = set()
        for d in docs:
            for p in d:
                if not isinstance(p, int):
                    words.update(p)
        enc.remember(words, by_id)
        codes_of, bytes_of = enc.memo.__getitem__, enc.spelt.__getitem__
        flat, offsets, decoded = [], [0], []
        for d in docs:
            size, text = 0, []
            for p in d:
                if isinstance(p, int):
                    codes = np.int32(p).tobytes()
                    text.append(by_id[p])
                else:
                    codes = b"".join(map(codes_of, p))
                    text.extend(map(bytes_of, p))
                flat.append(codes)
                size += len(codes) // 4
            offsets.append(offsets[-1] + size)
            decoded.append(b"".join(text).decode("utf-8", "replace"))
        packed = np.frombuffer(b"".join(flat), dtype=np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(packed))
        return {c: b.column(i) for i, c in enumerate(keep)} | {"ids": ids, "decoded": decoded}

    return common.per_batch(src, run, kinds)
