"""Target-distribution importance resampling over hashed word runs.

Every text becomes a bag of word runs (1 to ``NGRAM`` consecutive words), each
hashed into one of ``BUCKETS`` buckets by the CRC-32 of its bytes. Counts over
all raw texts and over all target texts give each bucket a gain (a scaled log
ratio), and a document's weight is the sum of its runs' gains. A Gumbel number
from the document's id is added, so the highest scores are a sample without
replacement with odds by weight.

The cutoff of the draw is found by weighted median-of-medians selection: each
task reports the median of its remaining keys and how many remain; the weighted
median of these is the pivot, and one counting pass tells which side of it goes
(at least a quarter of what remains). When few keys remain they are read, which
fixes the cutoff key exactly. Only winners are sorted.

Defined cases. A null text has no words, weight 0. A null id is hashed as the
empty text and comes last among equal scores; ids may be of any type, and are
compared as numbers if they are integers, else as text. Rows of equal score and id are ordered by number
of runs; rows alike in all three are interchangeable, and only as many are
drawn as the draw has places. An empty target table counts zero in every
bucket. Empty tables give no rows. Other columns are not read.

Scans: the raw texts twice (counts, then weights), the target texts once. The
shuffle moves ``buckets`` counts a task and one narrow row a document.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import as_array, n_parts, prepare
from quarry.llm.packed import chunks
from quarry.plans.sizing import materialize

BUCKETS = 10_000
NGRAM = 3
SEED = 42
MIN_WORDS = 20
SHARE = (5, 100)
#: Keys that may be read at once to end the selection.
FEW = 10_000
#: Keys that a task compares at once.
KEY_ROWS = 65_536
#: Bytes of text that a task turns into runs at once (whole texts; one may be longer).
BLOCK_BYTES = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, bool)      # digits, letters and every byte over 0x7F
_IS_WORD[0x00:0x30] = _IS_WORD[0x3A:0x61] = _IS_WORD[0x7B:0x80] = False


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


def _zero_tables() -> np.ndarray:
    """[k, j, byte]: what byte j of a CRC becomes when 2**k zero bytes follow."""
    crc = _crc_table()
    out = np.empty((32, 4, 256), np.uint32)
    for j in range(4):
        c = np.arange(256, dtype=np.uint32) << np.uint32(8 * j)
        out[0, j] = crc[c & 255] ^ (c >> 8)
    for k in range(1, 32):
        for j in range(4):
            out[k, j] = _through(out[k - 1], out[k - 1, j])
    return out


def _through(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    return tables[0][c & 255] ^ tables[1][(c >> 8) & 255] ^ tables[2][(c >> 16) & 255] ^ tables[3][c >> 24]


CRC = _crc_table()
ZEROS = _zero_tables()


def _extend(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC's contribution after ``length`` more bytes: crc(a + b) is
    ``_extend(crc(a), len(b)) ^ crc(b)``."""
    crc = crc.copy()
    left, k = length.astype(np.int64), 0
    while left.any():
        odd = np.flatnonzero(left & 1)
        crc[odd] = _through(ZEROS[k], crc[odd])
        left, k = left >> 1, k + 1
    return crc


def _word_crcs(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of each word: bytes 0 to 63 of all words together, place by place;
    the few longer words one by one."""
    state = np.full(len(start), 0xFFFFFFFF, np.uint32)
    by = np.argsort(-np.minimum(length, 64), kind="stable")
    at, size = start[by], length[by]
    live = state[by]
    for j in range(int(min(size[0], 64)) if len(size) else 0):
        n = int(np.searchsorted(-size, -j, side="left"))    # words longer than j
        live[:n] = CRC[(live[:n] ^ data[at[:n] + j]) & 255] ^ (live[:n] >> 8)
    state[by] = live ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(length > 64):
        state[i] = zlib.crc32(data[start[i]:start[i] + length[i]].tobytes())
    return state


def runs_of(texts: list[bytes], ngram: int = NGRAM, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document of each run, its bucket, words of each document)."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    data = _LOWER[np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)]
    inside = _IS_WORD[data]
    edge = np.diff(np.concatenate([[False], inside]).astype(np.int8))
    start = np.flatnonzero(edge == 1)
    length = np.flatnonzero(edge == -1) - start     # the last byte is no word byte
    doc = np.searchsorted(np.cumsum(sizes), start, side="right")
    word = _word_crcs(data, start, length)
    spaced = _extend(np.full(len(word), zlib.crc32(b" "), np.uint32), length) ^ word     # of " " + word
    docs, hashes, run = [doc], [word], word
    for n in range(1, ngram):
        if len(word) <= n:
            break
        run = _extend(run[:len(word) - n], length[n:] + 1) ^ spaced[n:]
        same = doc[n:] == doc[:-n]
        docs.append(doc[n:][same])
        hashes.append(run[same])
    return (np.concatenate(docs), (np.concatenate(hashes) % np.uint32(buckets)).astype(np.int64),
            np.bincount(doc, minlength=len(texts)))


def _blocks(col) -> list[tuple[int, int, list[bytes]]]:
    """(first row, last row + 1, texts) in blocks of about BLOCK_BYTES."""
    texts = [b"" if x is None else x for x in col.cast(pa.binary()).to_pylist()]
    out, lo, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK_BYTES or i == len(texts) - 1:
            out.append((lo, i + 1, texts[lo:i + 1]))
            lo, size = i + 1, 0
    return out


def bucket_counts(texts: DataFrame, col: str = "text", ngram: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all texts; each task sends at most ``buckets`` rows."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, block in _blocks(b.column(0)):
                total += np.bincount(runs_of(block, ngram, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    prepare(texts.sparkSession)
    return texts.select(col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's gain; the driver reads ``buckets`` rows of either table."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, into in ((raw, s), (target, t)):
        for r in counts.collect():
            into[r["bucket"]] = r["n"]
    big_s, big_t = int(s.sum()) + buckets, int(t.sum()) + buckets
    return np.array([math.floor(1000 * math.log(float((int(b) + 1) * big_s) / float((int(a) + 1) * big_t)))
                     for a, b in zip(s, t, strict=True)], np.int64)


def gumbel(seed: int = SEED, id_col: str = "doc_id"):
    """floor(1000 x a Gumbel number) from the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM,
          seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) for every document."""
    buckets = len(gain)

    def run(batches):
        for b in batches:
            for lo, hi, block in _blocks(b.column(1)):
                doc, bucket, words = runs_of(block, ngram, buckets)
                n = np.bincount(doc, minlength=hi - lo)
                by = np.argsort(doc, kind="stable")
                ends = np.concatenate([[0], np.cumsum(gain[bucket[by]])])
                cut = np.concatenate([[0], np.cumsum(n)])
                weight = ends[cut[1:]] - ends[cut[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), as_array(words, pa.int64()), as_array(n, pa.int64()),
                     as_array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_words long, n_features long, weight long")
    return out.withColumn("score", F.col("weight") + gumbel(seed))


# ---------------------------------------------------------------- selection

#: Order of the draw: smaller keys first.
KEY = ["neg", "none", "id", "runs"]


def _sorted_keys(t: pa.Table) -> pa.Table:
    return t.take(pc.sort_indices(t, sort_keys=[(c, "ascending") for c in KEY]))


def _below(t: pa.Table, key: tuple) -> pa.Array:
    """Which rows come before the key."""
    out = tie = None
    for c, v in zip(KEY, key, strict=True):
        less, same = pc.less(t[c], v), pc.equal(t[c], v)
        out = less if out is None else pc.or_(out, pc.and_(tie, less))
        tie = same if tie is None else pc.and_(tie, same)
    return out


def _between(t: pa.Table, lo: tuple | None, hi: tuple | None) -> pa.Table:
    """Rows with lo <= key < hi."""
    if lo is not None:
        t = t.filter(pc.invert(_below(t, lo)))
    return t if hi is None else t.filter(_below(t, hi))


def _median_of_task(lo, hi):
    def run(batches):
        held = [_between(t, lo, hi) for t in chunks(batches, KEY_ROWS)]
        t = pa.concat_tables(held) if held else None
        if t is not None and t.num_rows:
            t = _sorted_keys(t)
            yield from t.slice((t.num_rows - 1) // 2, 1).append_column("n", pa.array([t.num_rows])).to_batches()
    return run


def _count_below(lo, hi, pivot):
    def run(batches):
        below = same = 0
        for t in chunks(batches, KEY_ROWS):
            t = _between(t, lo, hi)
            if t.num_rows:
                below += pc.sum(_below(t, pivot)).as_py() or 0
                same += pc.sum(_all(pc.equal(t[c], v) for c, v in zip(KEY, pivot, strict=True))).as_py() or 0
        yield pa.RecordBatch.from_arrays([pa.array([below]), pa.array([same])], names=["below", "same"])
    return run


def _all(parts):
    out = None
    for p in parts:
        out = p if out is None else pc.and_(out, p)
    return out


def cutoff(keys: DataFrame, place: int, few: int = FEW) -> tuple | None:
    """The key at ``place`` (from 1) of the ascending order; None if there is no such place.

    ``keys`` has the KEY columns, none of them null, and is read once or twice a
    round: at least a quarter of the remaining keys goes in each.
    """
    total = keys.count()
    if not 0 < place <= total:
        return None
    lo = hi = None
    left = total
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema)
    while left > few:
        meds = keys.mapInArrow(_median_of_task(lo, hi), f"{kinds}, n long").collect()    # a row a task
        meds = sorted((tuple(r[c] for c in KEY), r["n"]) for r in meds)
        seen, pivot = 0, None
        for key, n in meds:
            seen += n
            if 2 * seen >= left:
                pivot = key
                break
        row = keys.mapInArrow(_count_below(lo, hi, pivot), "below long, same long").agg(F.sum("below"), F.sum("same")).first()
        below, same = int(row[0]), int(row[1])
        if place <= below:
            hi, left = pivot, below
        elif place <= below + same:
            return pivot
        else:                       # keys up to the pivot go; equal keys are below the next bound
            lo, place, left = _after(pivot), place - below - same, left - below - same
    def remaining(batches):
        for t in chunks(batches, KEY_ROWS):
            yield from _between(t, lo, hi).to_batches()

    rest = [tuple(r[c] for c in KEY) for r in keys.mapInArrow(remaining, kinds).collect()]
    return sorted(rest)[place - 1]


def _after(key: tuple) -> tuple:
    """The least key over this one: the last part is an integer."""
    return (*key[:-1], key[-1] + 1)


def draw(weighed: DataFrame, min_words: int = MIN_WORDS, share: tuple[int, int] = SHARE, few: int = FEW) -> DataFrame:
    """``weighed`` with a rank for the drawn rows: floor(share x N) of the N with ``min_words`` words."""
    spark = weighed.sparkSession
    kind = weighed.schema["doc_id"].dataType.simpleString()
    as_key = F.col("doc_id").cast("long" if kind in ("bigint", "int", "smallint", "tinyint") else "string")
    blank = F.lit(0).cast("long") if kind in ("bigint", "int", "smallint", "tinyint") else F.lit("")
    rows = materialize(weighed.withColumns({
        "in": F.col("n_words") >= min_words, "neg": -F.col("score"), "none": F.col("doc_id").isNull().cast("int"),
        "id": F.coalesce(as_key, blank), "runs": F.col("n_features")}), "importance-rows")
    pool = rows.filter(F.col("in")).select(*KEY)
    n = pool.count()
    places = share[0] * n // share[1]
    last = cutoff(pool, places, few)
    key = F.struct(*(F.col(c) for c in KEY))
    plain = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if last is None:
        return rows.select(*plain, none)
    at = F.struct(*(F.lit(v).cast(f.dataType).alias(c) for c, v, f in zip(KEY, last, pool.schema, strict=True)))
    won = F.col("in") & (key <= at)
    ranked = materialize(rows.filter(won).repartitionByRange(n_parts(spark), *KEY).sortWithinPartitions(*KEY)
                         .withColumn("at", F.monotonically_increasing_id()), "importance-winners")
    part = F.shiftright("at", 33)
    sums = ranked.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()    # a row a task
    before, seen = {}, 0
    for r in sorted(sums):
        before[r["part"]] = seen
        seen += r["n"]
    offsets = spark.createDataFrame(list(before.items()), "part long, before long")
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    winners = ranked.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", rank)
    drawn = winners.select(*plain, F.when(F.col("rank") <= places, F.col("rank")).alias("rank"))
    return rows.filter(~won).select(*plain, none).unionByName(drawn)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of ``docs``, drawn towards ``target``'s texts."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, text_col))
    return draw(weigh(docs, gain, id_col, text_col), **how)
