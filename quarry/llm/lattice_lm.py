"""Subword lattice likelihood: a unigram language model over the pieces of an
existing vocabulary, summed over all segmentations.

A text is lower-cased (A-Z), split into words, and written as the words with
the vocabulary's word mark before each. The model draws pieces one by one
until an end symbol, so the probability of a text is the sum over all its
segmentations of the product of their piece probabilities. A forward
recursion in log space gives that sum. Pieces do not reach over a word mark,
so the recursion splits at marks: the log probability of a text is the sum of
its words' plus the end's. Characters without a piece are spelt with the
vocabulary's byte pieces.

Piece weights start from the vocabulary's own scores. (A vocabulary whose
scores are merge ranks, as in BPE files, is read as a rank-frequency law:
weight 1 / (rank + 2).) They are re-estimated on the training rows by
expectation maximisation: forward-backward over the table of distinct words
with their counts, so every training token counts.

A word unigram model with add-one smoothing is returned beside it (base).

Defined cases: null text is empty and has the end token alone; words of any
length are summed whole; without training rows N and V are 0, base scores are
those of unseen tokens and piece weights stay those of the vocabulary;
repeated rows are scored each.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.plans.sizing import materialize

#: Most frequent training words whose statistics every task holds, and the bytes
#: that such a word has at most; the other words, long ones among them, are
#: joined. The two bound the broadcast's size (8 MB of words), not the result.
HOT_WORDS = 1 << 17
HOT_WORD_BYTES = 64
ROUNDS = 2
#: Expected count that every piece has besides those of the training rows.
SMOOTH = 0.1
#: Words longer than this (characters) are summed one by one.
LONG_WORD = 48
#: Words of one vectorised block.
WORD_BLOCK = 20_000
#: Distinct words that a task counts before it hands them on.
COUNTER_WORDS = 100_000
LOG10E = math.log10(math.e)
MARK = "▁"
_P = np.uint64(0x9E3779B97F4A7C15)
_NONE = -1


class Pieces:
    """Piece weights and a direct-address table from piece hashes to pieces."""

    def __init__(self, names: list[str], byte_ids: list[int], logp: np.ndarray):
        self.names, self.byte_ids, self.logp = names, byte_ids, logp
        self.end = len(names)  # the end symbol's place in logp
        usable = [(i, n) for i, n in enumerate(names) if n and MARK not in n[1:]]
        self.longest = max((len(n) for _, n in usable), default=1)
        self.ids = {n: i for i, n in usable}
        hashes = np.array([self.hash_one(n) for _, n in usable], dtype=np.uint64)
        bits = max(12, int(math.ceil(math.log2(8 * len(usable) + 1))))
        self.shift = np.uint64(64 - bits)
        cell = (hashes >> self.shift).astype(np.int64)
        # pieces that share a cell stand in its next slots
        order = np.argsort(cell, kind="stable")
        ranked = cell[order]
        slot = np.arange(len(cell)) - np.searchsorted(ranked, ranked)
        slots = int(slot.max()) + 1 if len(slot) else 1
        self.cell_hash = np.zeros((slots, 1 << bits), dtype=np.uint64)
        self.cell_id = np.full((slots, 1 << bits), _NONE, dtype=np.int32)
        self.cell_hash[slot, ranked] = hashes[order]
        self.cell_id[slot, ranked] = np.array([i for i, _ in usable], dtype=np.int32)[order]

        # most hashes asked for are of no piece: a wider table of flags turns them away
        self.flag_shift = np.uint64(64 - min(bits + 4, 24))
        self.flags = np.zeros(1 << min(bits + 4, 24), dtype=bool)
        self.flags[(hashes >> self.flag_shift).astype(np.int64)] = True

    @staticmethod
    def hash_step(h, code):
        return (h ^ code) * _P

    @classmethod
    def hash_one(cls, name: str) -> int:
        h = 0xCBF29CE484222325
        for ch in name:
            h = ((h ^ ord(ch)) * int(_P)) & ((1 << 64) - 1)
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), _NONE, dtype=np.int32)
        maybe = np.flatnonzero(self.flags[(h >> self.flag_shift).astype(np.int64)])
        h = h[maybe]
        cell = (h >> self.shift).astype(np.int64)
        for hashes, ids in zip(self.cell_hash, self.cell_id):
            hit = hashes[cell] == h
            out[maybe[hit]] = ids[cell[hit]]
        return out

    def spelt(self, ch: str) -> list[int]:
        return [self.byte_ids[b] for b in ch.encode("utf-8", "replace")]

    def spell_logp(self, ch: str) -> float:
        return float(sum(self.logp[i] for i in self.spelt(ch)))


def load_pieces(path: str) -> Pieces:
    """Pieces of a sentencepiece file with weights from its scores. Read on the
    driver; its size is that of the file."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    names, byte_ids, rank = [], [0] * 256, np.zeros(n)
    for i in range(n):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        names.append("" if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) else piece)
        rank[i] = n if not names[-1] or sp.get_score(i) < -n else -sp.get_score(i)
    weight = np.append(1.0 / (rank + 2.0), 1.0 / 100)  # the last is the end symbol
    return Pieces(names, byte_ids, np.log(weight / weight.sum()))


def code_points(words: list[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "replace"), dtype=np.uint32).reshape(len(words), n)


def lattice(p: Pieces, words: list[str], n: int):
    """Arcs of the lattices of words of n characters: {(start, size): (piece
    numbers, log weights)}, one array entry per word."""
    codes = code_points(words, n).astype(np.uint64)
    arcs = {}
    with np.errstate(over="ignore"):
        for s in range(n):
            h = np.full(len(words), 0xCBF29CE484222325, dtype=np.uint64)
            for size in range(1, min(p.longest, n - s) + 1):
                h = Pieces.hash_step(h, codes[:, s + size - 1])
                ids = p.find(h)
                if size == 1 or (ids >= 0).any():
                    arcs[s, size] = ids, np.where(ids >= 0, p.logp[ids], -np.inf)
            ids, w = arcs[s, 1]
            lost = np.flatnonzero(ids < 0)
            if len(lost):
                col = codes[lost, s]
                spell = {c: p.spell_logp(chr(int(c))) for c in np.unique(col)}
                w[lost] = [spell[c] for c in col]
    return arcs


def forward(arcs: dict, n: int, count: int, longest: int) -> np.ndarray:
    """alpha[i]: log probability of all segmentations of the first i characters."""
    alpha = np.full((n + 1, count), -np.inf)
    alpha[0] = 0.0
    for i in range(1, n + 1):
        terms = [alpha[i - size] + arcs[i - size, size][1] for size in range(1, min(longest, i) + 1) if (i - size, size) in arcs]
        alpha[i] = terms[0] if len(terms) == 1 else np.logaddexp.reduce(terms, axis=0)
    return alpha


def forward_long(p: Pieces, word: str) -> float:
    """Forward recursion of one long word, with a window of the longest piece."""
    alpha = [0.0]
    for i in range(1, len(word) + 1):
        best = []
        for size in range(1, min(p.longest, i) + 1):
            k = p.ids.get(word[i - size:i])
            if k is not None:
                best.append(alpha[i - size] + p.logp[k])
            elif size == 1:
                best.append(alpha[i - 1] + p.spell_logp(word[i - 1]))
        top = max(best)
        alpha.append(top + math.log(sum(math.exp(b - top) for b in best)))
    return alpha[-1]


def by_length(words: list[str]):
    """Places of equally long words, in blocks; long words alone."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for n, at in sorted(groups.items()):
        step = max(1, WORD_BLOCK // max(1, n // 8)) if n <= LONG_WORD else 1
        for i in range(0, len(at), step):
            yield n, at[i:i + step]


def marginals(p: Pieces, words: list[str]) -> np.ndarray:
    """log10 probability of each word over all segmentations (word mark included)."""
    marked = [MARK + w for w in words]
    out = np.zeros(len(words))
    for n, at in by_length(marked):
        if n > LONG_WORD:
            out[at[0]] = forward_long(p, marked[at[0]])
        else:
            arcs = lattice(p, [marked[i] for i in at], n)
            out[at] = forward(arcs, n, len(at), p.longest)[n]
    return out * LOG10E


def expected_counts(p: Pieces, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the counted words."""
    total = np.zeros(len(p.logp))
    marked = [MARK + w for w in words]
    for n, at in by_length(marked):
        if n > 4 * LONG_WORD:
            continue_long(p, marked[at[0]], float(counts[at[0]]), total)
            continue
        part = [marked[i] for i in at]
        weight = counts[at]
        arcs = lattice(p, part, n)
        alpha = forward(arcs, n, len(at), p.longest)
        beta = np.full((n + 1, len(at)), -np.inf)
        beta[n] = 0.0
        for i in range(n - 1, -1, -1):
            terms = [beta[i + s] + arcs[i, s][1] for s in range(1, min(p.longest, n - i) + 1) if (i, s) in arcs]
            beta[i] = terms[0] if len(terms) == 1 else np.logaddexp.reduce(terms, axis=0)
        z = alpha[n]
        for (s, size), (ids, w) in arcs.items():
            post = np.exp(alpha[s] + w + beta[s + size] - z) * weight
            seen = ids >= 0
            total += np.bincount(ids[seen], post[seen], minlength=len(total))
            if size == 1 and not seen.all():
                for i in np.flatnonzero(~seen):
                    for b in p.spelt(part[i][s]):
                        total[b] += post[i]
    return total


def continue_long(p: Pieces, word: str, weight: float, total: np.ndarray) -> None:
    """Forward-backward of one long word."""
    n = len(word)
    arcs = [[] for _ in range(n + 1)]  # by end: (start, log weight, pieces)
    for i in range(1, n + 1):
        for size in range(1, min(p.longest, i) + 1):
            k = p.ids.get(word[i - size:i])
            if k is not None:
                arcs[i].append((i - size, p.logp[k], [k]))
            elif size == 1:
                arcs[i].append((i - 1, p.spell_logp(word[i - 1]), p.spelt(word[i - 1])))
    alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    alpha[0] = beta[n] = 0.0
    for i in range(1, n + 1):
        alpha[i] = np.logaddexp.reduce([alpha[s] + w for s, w, _ in arcs[i]])
    for i in range(n, 0, -1):
        for s, w, _ in arcs[i]:
            beta[s] = np.logaddexp(beta[s], beta[i] + w)
    for i in range(1, n + 1):
        for s, w, ids in arcs[i]:
            for k in ids:
                total[k] += weight * math.exp(alpha[s] + w + beta[i] - alpha[n])


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def count_words(docs: DataFrame, train: Column, text_col: str) -> DataFrame:
    """(word, c): distinct words of all rows with their training counts (0:
    only in other rows). Tasks count their own batches first."""
    src = docs.select(F.col(text_col).cast("string").alias("text"), train.alias("train"))

    def rows(seen: Counter) -> pa.RecordBatch:
        words = pa.array(list(seen), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

    def run(batches):
        seen: Counter = Counter()
        for b in batches:
            for text, learn in zip(common.text_bytes(b.column(0)), b.column(1).to_pylist()):
                if learn:
                    seen.update(words_of(text))
                else:
                    for w in words_of(text):
                        seen[w] += 0
                if len(seen) >= COUNTER_WORDS:
                    yield rows(seen)
                    seen.clear()
        yield rows(seen)

    return src.mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def held_out(id_col: str = "doc_id") -> Column:
    return common.crc_fold(id_col, 7) == 2


def blocks(batches):
    """Arrow batches joined to tables of ``WORD_BLOCK`` words or a little more:
    words of one length are summed together, so more words make fuller vectors."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= WORD_BLOCK:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def fit_pieces(words: DataFrame, pieces: Pieces, n_docs: int, rounds: int = ROUNDS) -> Pieces:
    """Expectation maximisation over the table of counted words; each round
    sends one number per piece to the driver."""
    sc = words.sparkSession.sparkContext
    learn = words.filter("c > 0")
    for _ in range(rounds if n_docs else 0):
        shared = sc.broadcast(pieces)

        def run(batches, shared=shared):
            total = None
            for t in blocks(batches):
                got = expected_counts(shared.value, t.column(0).to_pylist(), t.column(1).to_numpy().astype(float))
                total = got if total is None else total + got
            if total is not None:
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["piece", "n"])

        got = learn.mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        total = np.full(len(pieces.logp), SMOOTH)
        for r in got:
            total[r["piece"]] += r["n"]
        total[pieces.end] += n_docs
        pieces = Pieces(pieces.names, pieces.byte_ids, np.log(total / total.sum()))
    return pieces


def score_texts(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text",
                held: Column | None = None, rounds: int = ROUNDS, hot_words: int = HOT_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score),
    one row per input row; ``held`` marks the rows not learned from."""
    spark = docs.sparkSession
    common.prepare(spark)
    sc = spark.sparkContext
    held = F.coalesce(held_out(id_col) if held is None else held, F.lit(False))
    n_docs = docs.filter(~held).count()
    words = materialize(count_words(docs, ~held, text_col), "lm-words")
    pieces = fit_pieces(words, load_pieces(vocab_path), n_docs, rounds)
    facts = words.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n_train = int(facts["n"] or 0) + n_docs          # the ends count as tokens
    v_train = int(facts["v"] or 0) + (1 if n_docs else 0)
    denominator = math.log10(n_train + v_train + 1)
    end_base, end_known = math.log10(n_docs + 1) - denominator, int(n_docs > 0)
    shared = sc.broadcast(pieces)
    end_score = float(pieces.logp[pieces.end]) * LOG10E

    def weigh(batches):
        for t in blocks(batches):
            logp = pa.array(marginals(shared.value, t.column(0).to_pylist()))
            yield from t.append_column("logp", logp).to_batches()

    scored = materialize(words.mapInArrow(weigh, "word string, c long, logp double"), "lm-scored")
    hot = sc.broadcast({r["word"].encode(): (r["c"], r["logp"]) for r in
                        scored.filter(F.octet_length("word") <= HOT_WORD_BYTES)
                        .orderBy(F.col("c").desc(), "word").limit(hot_words).collect()})
    src = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def split(b: pa.RecordBatch) -> dict:
        table = hot.value
        out: dict = {k: [] for k in ("n_tokens", "n_known", "base", "score", "words", "ns")}
        for text in common.text_bytes(b.column(2)):
            n = known = 0
            base = score = 0.0
            rare, ns = [], []
            for w, k in Counter(words_of(text)).items():
                n += k
                got = table.get(w)
                if got is None:
                    rare.append(w)
                    ns.append(k)
                else:
                    known += k if got[0] else 0
                    base += k * (math.log10(got[0] + 1) - denominator)
                    score += k * got[1]
            for key, v in (("n_tokens", n + 1), ("n_known", known + end_known), ("base", base + end_base),
                           ("score", score + end_score), ("ns", ns)):
                out[key].append(v)
            out["words"].append([w.decode() for w in rare])
        return {"doc_id": b.column(0), "held_out": b.column(1)} | out

    kind = dict(src.dtypes)["doc_id"]
    rows = common.per_batch(src, split, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, "
                            "score double, words array<string>, ns array<int>")
    # rows are written once: the row number below stays the same for both readers
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    rare = rows.select("row", F.explode(F.arrays_zip("words", "ns")).alias("t")) \
        .select("row", F.col("t.words").alias("word"), F.col("t.ns").alias("k")) \
        .join(scored, "word") \
        .groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("rare_known"),
                            F.sum(F.col("k") * (F.log10(F.col("c") + 1) - F.lit(denominator))).alias("rare_base"),
                            F.sum(F.col("k") * F.col("logp")).alias("rare_score"))
    add = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0)))
    return rows.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", add("n_known", "rare_known").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"), add("base", "rare_base").alias("base_score"),
        add("score", "rare_score").alias("score"))
