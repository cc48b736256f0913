"""Document fingerprints by locally consistent parsing.

A text is a sequence of byte names. Each level cuts the sequence into phrases
by deterministic coin tossing: repeats of a name are first folded into one,
every name gets a label from the lowest bit in which it differs from its
neighbour, labelling is repeated until labels are few, and phrases end at
local maxima of the labels. A phrase's name on the next level is a hash of
the names in it. Where a phrase ends depends only on a few names around, so
equal substrings are cut alike, whatever their offset: they share all phrase
names but those near their ends.

The fingerprint is the name of the whole text (the last level's single name)
and a sketch of phrase names (of one level; short texts, of the levels below
too): their hashes are dealt to bins
and each bin keeps 16 bits of its smallest hash. The likeness of two
fingerprints is the share of bins that agree among those either has filled,
an estimate of the Jaccard likeness of the phrase sets.

Defined cases: null text is empty; empty texts have an empty sketch and are
alike (1.0), and unlike others (0.0); texts of any length are parsed whole;
in a table of one document the next document is itself; rows with equal ids
follow each other in order of their text; null ids come last. Ids are
integers; another type is a TypeError.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common

#: Level whose phrase names are sketched (phrases of some 25 bytes), and bins.
LEVEL = 3
BINS = 64
EMPTY = 0xFFFF
#: Phrases under which the level below is sketched too, so that short texts have some.
FEW = 16
#: Characters whose texts a task parses together.
PARSE_CHARS = 1 << 19
#: Id blocks per shuffle partition.
BLOCKS_PER_PART = 4

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (wrapping arithmetic)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


with np.errstate(over="ignore"):
    BYTE_NAMES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _STEP)


def toss(x: np.ndarray) -> np.ndarray:
    """Label of each name from its left neighbour: twice the lowest bit in
    which they differ, plus that bit. Neighbours differ, so their labels do."""
    d = x[1:] ^ x[:-1]
    low = np.bitwise_count((d & (~d + np.uint64(1))) - np.uint64(1)).astype(np.uint64)
    return (low << np.uint64(1)) | ((x[1:] >> low) & np.uint64(1))


def next_levels(x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of many sequences at once: ``x`` holds them one
    after the other, ``size`` their lengths. A sequence of one name stays."""
    start = np.cumsum(size) - size
    # repeats of a name become one name of their count
    first = np.empty(len(x), bool)
    first[1:] = x[1:] != x[:-1]
    first[start[size > 0]] = True
    at = np.flatnonzero(first)
    if len(at) < len(x):
        counts = np.diff(np.append(at, len(x))).astype(np.uint64)
        many = np.flatnonzero(counts > 1)
        x = x[at]
        x[many] = mix(x[many] + counts[many] * _STEP)
        size = np.diff(np.append(np.searchsorted(at, start), len(at)))
        start = np.cumsum(size) - size
    n = len(x)
    if n == 0:
        return x, size
    cut = np.zeros(n, bool)
    if n >= 6:
        labels = toss(toss(x))  # label k belongs to name k + 2
        mid = labels[1:-1]
        cut[3:-1] = (mid > labels[:-2]) & (mid > labels[2:])
        # no phrase begins among the first three names or at the last one
        real, ends = start[size > 0], (start + size)[size > 0]
        for k in range(1, 3):
            near = real + k
            cut[near[near < ends]] = False
        cut[ends - 1] = False
        short = size < 6
        if short.any():
            cut[np.repeat(short, size)] = False
    cut[start[size > 0]] = True
    cuts = np.flatnonzero(cut)
    length = np.diff(np.append(cuts, n))
    place = np.arange(n) - np.repeat(cuts, length)
    terms = mix(x + (place.astype(np.uint64) + np.uint64(1)) * _STEP)
    out = mix(np.add.reduceat(terms, cuts) + length.astype(np.uint64))
    new = np.diff(np.append(np.searchsorted(cuts, start), len(cuts)))
    alone = start[size == 1]
    out[np.searchsorted(cuts, alone)] = x[alone]
    return out, new


def parse_all(texts: list[bytes], level: int = LEVEL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name of each whole text, text of each phrase name to sketch, that name).
    Sketched are the names of ``level``, and of each level below while the one
    above has under ``FEW`` phrases. The texts are parsed together, level by
    level; each gets the names that it would get alone."""
    size = np.array([len(t) for t in texts], np.int64)
    with np.errstate(over="ignore"):
        x = BYTE_NAMES[np.frombuffer(b"".join(texts), dtype=np.uint8)]
        low = []
        for k in range(level + 1):
            low.append((x, size))
            if k < level:
                x, size = next_levels(x, size)
        while (size > 1).any():
            x, size = next_levels(x, size)
        whole = np.zeros(len(texts), np.uint64)
        whole[size == 1] = x
    names, whose, use = [], [], np.ones(len(texts), bool)
    for x, size in reversed(low):
        names.append(x if use.all() else x[np.repeat(use, size)])
        whose.append(np.repeat(np.arange(len(texts)), size * use))
        use = use & (size < FEW)
        if not use.any():
            break
    return whole, np.concatenate(whose), np.concatenate(names)


def sketch_all(n: int, whose: np.ndarray, names: np.ndarray, bins: int = BINS) -> np.ndarray:
    """(texts x bins): 16 bits of the smallest hash in each bin; EMPTY where no name fell."""
    top = np.iinfo(np.uint64).max
    least = np.full(n * bins, top, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = mix(names + _M1)
        np.minimum.at(least, whose * bins + ((h >> np.uint64(16)) % np.uint64(bins)).astype(np.int64), mix(h))
    out = np.where(least != top, (least % np.uint64(EMPTY)).astype(np.uint16), np.uint16(EMPTY))
    return out.reshape(n, bins)


def fingerprints(texts: list[bytes], level: int = LEVEL, bins: int = BINS) -> tuple[list[str], np.ndarray]:
    """(fingerprint, sketch) of each text."""
    whole, whose, names = parse_all(texts, level)
    s = sketch_all(len(texts), whose, names, bins)
    text = s.astype(">u2").tobytes().hex()
    step = 4 * bins
    return [f"{int(w):016x}-{text[i * step:(i + 1) * step]}" for i, w in enumerate(whole)], s


def fingerprint(text: bytes, level: int = LEVEL, bins: int = BINS) -> tuple[str, np.ndarray]:
    names, s = fingerprints([text], level, bins)
    return names[0], s[0]


def likenesses(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, the share of agreeing bins among those filled in either sketch."""
    used = (a != EMPTY) | (b != EMPTY)
    n = used.sum(1)
    return np.where(n > 0, ((a == b) & used).sum(1) / np.maximum(n, 1), 1.0)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(likenesses(a[None, :], b[None, :])[0])


def edited(text: str, following: str) -> str:
    """The text with its last quarter (code points) replaced by the start of the next."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


def compare_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      level: int = LEVEL, bins: int = BINS) -> DataFrame:
    """(doc_id, n_chars, edited_text, fingerprint, edited_fingerprint,
    near_edited, near_next), one row per input row.

    Documents are dealt once by blocks of consecutive ids and sorted in their
    partition; a task streams over them, holding one document back. The first
    document of each block is also dealt to the block before, where it is the
    next of the last one.
    """
    spark = df.sparkSession
    common.integer_ids(df, id_col)
    common.prepare(spark)
    kind = dict(df.dtypes)[id_col]
    src = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = common.n_parts(spark)
    bounds = common.split_bounds(src, "doc_id", parts * BLOCKS_PER_PART)
    ids = src.select("doc_id", common.block_of(F.col("doc_id"), bounds).alias("block"))
    # one row per block (at most 4,097): its first id
    firsts = sorted((r["block"], r["low"]) for r in ids.groupBy("block").agg(F.min("doc_id").alias("low")).collect())
    before = {firsts[i][0]: firsts[i - 1][0] for i in range(len(firsts))}  # the first block's goes to the last
    home = src.withColumn("block", common.block_of(F.col("doc_id"), bounds))
    lead = F.create_map(*[x for b, low in firsts for x in (F.lit(b), F.lit(low).cast(kind))]) if firsts else None
    back = F.create_map(*[x for b, p in before.items() for x in (F.lit(b), F.lit(p))]) if firsts else None
    if firsts:
        home = home.withColumn("at", F.explode(F.when(
            F.col("doc_id").eqNullSafe(F.element_at(lead, F.col("block"))),
            F.array(F.struct(F.col("block").alias("b"), F.lit(0).alias("tail")),
                    F.struct(F.element_at(back, F.col("block")).alias("b"), F.lit(1).alias("tail"))))
            .otherwise(F.array(F.struct(F.col("block").alias("b"), F.lit(0).alias("tail"))))))
    else:
        home = home.withColumn("at", F.struct(F.col("block").alias("b"), F.lit(0).alias("tail")))
    dealt = home.select(F.col("at.b").alias("block"), F.col("at.tail").alias("tail"), "doc_id", "text") \
        .repartition(parts, "block") \
        .sortWithinPartitions("block", "tail", F.col("doc_id").asc_nulls_last(), "text")
    schema = (f"doc_id {kind}, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    from pyspark.sql import types as T
    arrow = common.arrow_schema(T._parse_datatype_string(schema))

    def flush(pairs):
        """Rows of (id, text, next text) in turn: own and edited texts parsed together."""
        new = [edited(t, f) for _, t, f in pairs]
        encoded = {}
        for t in (x for _, t, f in pairs for x in (t, f)):
            encoded.setdefault(t, len(encoded))
        names, sketches = fingerprints([t.encode() for t in encoded] + [t.encode() for t in new], level, bins)
        own = np.array([encoded[t] for _, t, _ in pairs], np.int64)
        following = np.array([encoded[f] for _, _, f in pairs], np.int64)
        changed = len(encoded) + np.arange(len(pairs))
        columns = ([d for d, _, _ in pairs], [len(t) for _, t, _ in pairs], new, [names[i] for i in own],
                   [names[i] for i in changed], likenesses(sketches[own], sketches[changed]),
                   likenesses(sketches[own], sketches[following]))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches):
        held, pairs, size = None, [], 0   # held: (block, doc_id, text) waiting for its next document
        for b in batches:
            for block, tail, doc, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                if held is None or held[0] != block:
                    if not tail:          # a tail without a row before it: further rows with the next block's first id
                        held = (block, doc, text)
                    continue
                pairs.append((held[1], held[2], text))
                size += len(held[2])
                held = None if tail else (block, doc, text)
                if size >= PARSE_CHARS:
                    yield flush(pairs)
                    pairs, size = [], 0
        if pairs:
            yield flush(pairs)

    return dealt.mapInArrow(run, schema)
