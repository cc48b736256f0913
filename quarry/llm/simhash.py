"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints of 64 bits over word shingles; every distinct fingerprint emits
all variants within half of the link radius, equal variants meet in one
shuffle, and the fingerprints that meet are linked after a check of their bit
distance. Two fingerprints at a distance within the radius always share a
variant half way, so no link is lost and there is no cap on candidates. A
variant is met by at most as many distinct fingerprints as its ball holds
(65 at half radius 1), so no group grows with the data; exact copies are
collapsed before (one row per distinct fingerprint).

Defined cases: null text counts as empty; a text without words has fingerprint
zero and links like any other; a text with fewer words than a shingle is one
shingle; repeated rows and ids give one result row each; component_id is null
only where no row of the component has an id; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm import common
from quarry.plans.sizing import materialize

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
#: Hashes whose bits are unpacked at once (64 bytes each).
BIT_BLOCK = 1 << 16


def shingle_hashes(text: bytes, words: int = SHINGLE_WORDS, seed: int = SEED) -> list[int]:
    """XXH64 of every shingle of the lower-cased words, repeats included."""
    toks = text.lower().split()
    if not toks:
        return []
    flat = b" ".join(toks)
    if len(toks) <= words:
        return [xxhash.xxh64_intdigest(flat, seed)]
    lens = np.fromiter(map(len, toks), dtype=np.int64, count=len(toks))
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    h = xxhash.xxh64_intdigest
    return [h(flat[s:e], seed) for s, e in zip(starts[:len(toks) - words + 1].tolist(), ends[words - 1:].tolist())]


def majority_bits(hashes: list[int]) -> int:
    """A bit is set when over half of the hashes have it."""
    if not hashes:
        return 0
    h = np.array(hashes, dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), BIT_BLOCK):
        part = h[i:i + BIT_BLOCK]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(ones * 2 > len(h)))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, row_key, fp): the fingerprint as a signed long, one row per
    input row; row_key is a 128-bit hash of id and text that finds the row again."""
    common.prepare(df.sparkSession)
    src = df.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("row_key"),
                    F.col(text_col).cast("string").alias("text"))

    def run(b: pa.RecordBatch) -> dict:
        fps = [majority_bits(shingle_hashes(t, words, seed)) for t in common.text_bytes(b.column(2))]
        return {"doc_id": b.column(0), "row_key": b.column(1), "fp": np.array(fps, dtype=np.uint64).view(np.int64)}

    kind = dict(src.dtypes)["doc_id"]
    return common.per_batch(src, run, f"doc_id {kind}, row_key binary, fp long")


def row_key(id_col: str, text_col: str) -> Column:
    parts = [c for x in (F.col(id_col).cast("string"), F.col(text_col).cast("string"))
             for c in (F.coalesce(F.char_length(x), F.lit(-1)).cast("string"), F.coalesce(x, F.lit("")))]
    return F.unhex(F.md5(F.concat_ws(" ", *parts)))


def ball_masks(radius: int, bits: int = 64) -> list[int]:
    """XOR masks of all words within ``radius`` bits, as signed longs."""
    out = []
    for k in range(radius + 1):
        for c in combinations(range(bits), k):
            m = sum(1 << i for i in c)
            out.append(m - (1 << 64) if m >= 1 << 63 else m)
    return out


def near_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Verified links (a, b) between distinct fingerprints of column ``fp``.

    All fingerprints that share a variant of an even radius are within it of
    each other, so linking each to the smallest keeps every component; for an
    odd radius the members of a variant (at most a ball) are compared.
    """
    half = (max_bits + 1) // 2
    masks = F.array(*[F.lit(m).cast("long") for m in ball_masks(half)])
    distinct = fps.select("fp").distinct()
    variants = distinct.select("fp", F.explode(masks).alias("m")) \
        .select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("variant"))
    w = Window.partitionBy("variant")
    if max_bits % 2 == 0:
        met = variants.select("fp", F.min("fp").over(w).alias("a")).filter("fp <> a")
        pairs = met.select("a", F.col("fp").alias("b"))
    else:
        met = variants.groupBy("variant").agg(F.sort_array(F.collect_set("fp")).alias("g")).filter(F.size("g") > 1)
        pairs = met.select(F.posexplode("g").alias("i", "a"), "g") \
            .select("a", F.explode(F.slice("g", F.col("i") + 2, F.size("g"))).alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return pairs.distinct().filter(close)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """(doc_id, row_key, fp, root, component_id): one row per input row; root
    names the component, component_id is the smallest id in it."""
    fps = materialize(fingerprints(df, id_col, text_col, words, seed), "simhash")
    comp = common.components(near_links(fps, max_bits))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("low")) \
        .join(comp, F.col("fp") == F.col("node"), "left") \
        .select("fp", "low", F.coalesce("root", "fp").alias("root"))
    smallest = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    named = nodes.join(smallest, "root").select("fp", "root", "component_id")
    return fps.join(named, "fp").select("doc_id", "row_key", "fp", "root", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """The rows of ``df`` that stay: of each component the one row with the
    smallest id (null ids last, ties by row key; equal rows collapse).

    The first row of each fingerprint is found by a map-side combined minimum,
    so copies never meet in one task; components join the first rows only."""
    fps = materialize(fingerprints(df, id_col, text_col, words, seed), "simhash")
    comp = common.components(near_links(fps, max_bits))
    first = fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_key")).alias("f")) \
        .join(comp, F.col("fp") == F.col("node"), "left") \
        .groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("f").alias("f"))
    key = common.fresh(df, "row_key")
    kept = materialize(first.select(F.col("f.row_key").alias(key)), "kept")
    # the semi join has dealt the rows by key already, so collapsing equal rows moves nothing
    return df.withColumn(key, row_key(id_col, text_col)).join(kept, key, "left_semi") \
        .dropDuplicates([key]).drop(key)
