"""Suffix-array dedup: remove bytes covered by a long string that starts earlier.

Every text is a byte string. A byte goes when some string of ``min_len`` bytes
that covers it also starts earlier (in a document with a smaller id, or before
in the same one). The sorted suffixes of all texts hold equal strings side by
side; they are built by merging Burrows-Wheeler transforms of shards:

1. Anchors. Each string of ``min_len`` bytes has an anchor, the place of its
   smallest window hash. Equal strings have equal anchors, so an anchor seen
   once proves that its strings occur once, and suffixes can be dealt to tasks
   by anchor. One exchange counts anchors over the whole corpus.
2. Segments. Around every anchor seen again, the run of strings that share the
   anchor occurrence (a piece of at most 2 * min_len bytes) is dealt by anchor.
   Equal segments under an anchor are one class; all but the earliest go.
3. Merge. Distinct segments are cut into shards. Each shard has a
   Burrows-Wheeler transform over an alphabet of byte grams (ranks of
   ``gram`` bytes): the sorted order of its suffixes and the gram before each.
   The shards' transforms are merged by interleave refinement: an interleave
   vector says which shard each merged suffix comes from; reading the
   transforms through it and dealing the entries stably by gram gives the
   interleave for one more gram. The round in which two neighbours part is
   their common prefix in grams; neighbours that never part within min_len
   bytes form a repeated interval. No suffix is compared or sorted again
   across shards. All entries of a repeated interval but its earliest go.
4. Spans are gathered by document (id and text) and cut out.

Exact copies of a whole text are found by digest and skip steps 2 and 3.
Anchors of hot passages (seen more than ``hot`` times) do not meet in one
task: their strings are dealt singly by their own hash, after each task has
kept only the first of those it holds (an earlier occurrence anywhere decides,
so the rest go at once).

Defined cases: null text is empty; texts shorter than min_len are whole; null
ids come last in order; rows with equal id and text are one document and get
the same result each; rows with equal ids and different texts are ordered by a
hash of the text; repeats are judged on the input; other columns are carried.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarry.llm import common

MIN_LEN = 100
#: Bytes of an anchor window and of a gram.
ANCHOR = 32
GRAM = 25
#: Occurrences from which an anchor is hot.
HOT = 2000
#: A 64th of the documents is read ahead to find anchors that would crowd one
#: task of the counting exchange; at most this many are dealt at random instead.
SAMPLE = 64
HOT_SAMPLE = 4096
#: Segment bytes merged at once, entries of one shard, strings a task remembers.
BLOCK_BYTES = 1 << 20
SHARD = 1 << 16
SEEN = 50_000
#: Text bytes hashed at once.
CHUNK = 4 << 20
LAST_ID = (1 << 63) - 1

_POS = np.uint64((1 << 24) - 1)
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_BYTES = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x2545F4914F6CDD1D)


def window_hash(raw: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every window of ``width`` bytes, by doubling."""
    if len(raw) < width:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = _BYTES[raw]
        out, size, done = None, 1, 0
        while True:
            if width & size:
                if out is None:
                    out = h
                else:
                    n = len(raw) - done - size + 1
                    out = _join(out[:n], h[done:done + n])
                done += size
                if done == width:
                    return out
            h = _join(h[:-size], h[size:])
            size *= 2


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _C[0] + (b ^ (b >> np.uint64(29))) * _C[1]
    return x ^ (x >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    if size < width:
        x = np.minimum(x[:size - width], x[width - size:])
    return x


def anchors(raw: np.ndarray, min_len: int = MIN_LEN, width: int = ANCHOR):
    """Runs of strings that share an anchor occurrence: (first start, strings
    in the run, anchor hash), in order; together they are all starts."""
    n = len(raw) - min_len + 1
    first, count, names = [], [], []
    for c in range(0, max(0, n), CHUNK):
        part = raw[c:min(c + CHUNK, n) + min_len - 1]
        h = window_hash(part, width)
        with np.errstate(over="ignore"):
            key = (h * _C[2] & ~_POS) | np.arange(len(h), dtype=np.uint64)
        at = (sliding_min(key, min_len - width + 1) & _POS).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        first.append(new + c)
        count.append(np.diff(np.append(new, len(at))))
        names.append(h[at[new]])
    if not first:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(first), np.concatenate(count), np.concatenate(names).view(np.int64)


# -- merging Burrows-Wheeler transforms ------------------------------------------------


class Shard:
    """Suffix order of a list of segments, by grams, and its transform.

    Entries are the places 0..len of each segment; an entry's next gram starts
    ``gram`` bytes on, and the last ``gram`` places of a segment are empty
    suffixes. ``order`` are the entries in suffix order and ``bwt`` the gram
    before each (0: none, the entry begins its chain)."""

    def __init__(self, grams: np.ndarray, before: np.ndarray, rounds: int, gram: int, base: int):
        # sorted by the first ``rounds`` grams, last gram first; 0 is the empty suffix
        keys = [grams]
        for _ in range(rounds - 1):
            nxt = np.zeros_like(grams)
            nxt[:-gram] = keys[-1][gram:]
            nxt[grams == 0] = 0
            keys.append(nxt)
        self.order = np.lexsort(keys[::-1]) + base
        self.bwt = before[self.order - base]


def merge_shards(shards: list[Shard], terminals: list[int], rounds: int):
    """Interleave refinement: (entries in merged order, repeated-interval number
    of each): entries share an interval when their first ``rounds`` grams agree."""
    sizes = [len(s.order) for s in shards]
    entries = np.concatenate([s.order for s in shards])
    bwt = np.concatenate([s.bwt for s in shards])
    which = np.repeat(np.arange(len(shards), dtype=np.int32), sizes)
    ends = np.repeat(np.arange(len(shards), dtype=np.int32), terminals)
    z = which.copy()                       # agrees on no gram yet: shard after shard
    interval = np.zeros(len(z), dtype=np.int64)
    slot_of = np.empty(len(z), dtype=np.int64)
    for _ in range(rounds):
        # the i-th slot of a shard in z holds its i-th suffix
        slot_of[np.argsort(z, kind="stable")] = np.arange(len(z))
        sym = bwt[slot_of]
        deal = np.argsort(sym, kind="stable")
        s, v = sym[deal], interval[deal]
        part = np.ones(len(z), dtype=bool)
        part[1:] = (s[1:] != s[:-1]) | (v[1:] != v[:-1])
        z = z[deal]
        # chain beginnings lead to the empty suffixes, which are all alike
        z[:len(ends)] = ends
        part[1:len(ends)] = False
        interval = np.cumsum(part) - 1
    slot_of[np.argsort(z, kind="stable")] = np.arange(len(z))
    return entries[slot_of], interval


def repeated_starts(segments: list[bytes], counts: list[int], min_len: int = MIN_LEN, gram: int = GRAM) -> list[np.ndarray]:
    """For each segment, which of its ``counts`` strings also start in an
    earlier segment of the list."""
    rounds = min_len // gram
    sizes = np.array([len(s) + 1 for s in segments])      # entries of each segment
    base = np.concatenate(([0], np.cumsum(sizes)))
    raw = np.zeros(int(base[-1]) + gram, dtype=np.uint8)
    joined = np.frombuffer(b"\0".join(segments) + b"\0", dtype=np.uint8)
    raw[:len(joined)] = joined
    total = int(base[-1])
    place = np.arange(total) - np.repeat(base[:-1], sizes)
    left = np.repeat(sizes - 1, sizes) - place             # bytes to the segment's end
    _, rank = np.unique(window_hash(raw, gram)[:total], return_inverse=True)
    grams = np.where(left >= gram, rank + 1, 0).astype(np.int32)
    before = np.zeros(total, dtype=np.int32)
    before[gram:] = grams[:-gram]
    before[place < gram] = 0
    shards, terminals = [], []
    i = 0
    while i < len(segments):
        j = i + 1
        while j < len(segments) and base[j + 1] - base[i] <= SHARD:
            j += 1
        a, b = int(base[i]), int(base[j])
        shards.append(Shard(grams[a:b], before[a:b], rounds, gram, a))
        terminals.append(int((grams[a:b] == 0).sum()))
        i = j
    entries, interval = merge_shards(shards, terminals, rounds)
    starts = np.flatnonzero(np.concatenate(([True], interval[1:] != interval[:-1])))
    lowest = np.minimum.reduceat(entries, starts)
    repeated = np.zeros(total, dtype=bool)
    repeated[entries] = entries != lowest[interval]
    return [repeated[base[k]:base[k] + n] for k, n in enumerate(counts)]


# -- distribution -----------------------------------------------------------------------


def runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def text_key(text: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(text)
    return h - (1 << 64) if h >= 1 << 63 else h


_INT = pa.int64()
OCCURRENCES = pa.schema([("deal", _INT), ("anchor", _INT), ("kid", _INT), ("tid", _INT)])
SEGMENTS = pa.schema([("deal", _INT), ("kid", _INT), ("rid", _INT), ("start", _INT), ("n", pa.int32()), ("seg", pa.binary()),
                      ("tid", _INT)])
SPANS = pa.schema([("kid", _INT), ("tid", _INT), ("rid", _INT), ("s", _INT), ("e", _INT)])


def ddl(schema: pa.Schema) -> str:
    names = {_INT: "long", pa.int32(): "int", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([common.as_array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def anchor_rows(texts: DataFrame, min_len: int, crowded=None) -> DataFrame:
    """(deal, anchor, kid, tid): every anchor occurrence, dealt by anchor; those
    known to be crowded are dealt by document and need no counting."""

    def run(batches):
        known = np.array(sorted(crowded.value), dtype=np.int64) if crowded is not None else np.zeros(0, np.int64)
        for b in batches:
            deals, names, kids, tids = [], [], [], []
            for kid, tid, text in zip(b.column("kid").to_pylist(), b.column("tid").to_pylist(),
                                      common.text_bytes(b.column("text"))):
                if len(text) < min_len:
                    continue
                _, _, a = anchors(np.frombuffer(text, dtype=np.uint8), min_len)
                deal = a
                if len(known):
                    deal = np.where(np.isin(a, known), np.int64(kid ^ tid << 31 ^ 0x5851F42D4C957F2D), a)
                deals.append(deal)
                names.append(a)
                kids.append(np.full(len(a), kid, dtype=np.int64))
                tids.append(np.full(len(a), tid, dtype=np.int64))
            if names:
                yield batch(OCCURRENCES, [np.concatenate(c) for c in (deals, names, kids, tids)])

    return texts.mapInArrow(run, ddl(OCCURRENCES))


def crowded_anchors(texts: DataFrame, min_len: int, hot: int) -> set[int]:
    """Anchors seen often in a 64th of the documents: surely repeated."""
    part = texts.filter(F.pmod(F.xxhash64("kid", "tid"), F.lit(SAMPLE)) == 0)
    rows = anchor_rows(part, min_len).groupBy("anchor").agg(F.count("*").alias("n")) \
        .filter(F.col("n") >= max(2, hot // SAMPLE)).orderBy(F.col("n").desc(), "anchor").limit(HOT_SAMPLE).collect()
    return {r["anchor"] for r in rows}


def segment_rows(joined: DataFrame, min_len: int, hot: int) -> DataFrame:
    """Segments (dealt by anchor) and strings of hot anchors (dealt by their
    hash) of every text; rows without bytes are spans already known to go."""

    def run(batches):
        seen: dict[bytes, tuple] = {}  # earliest place of a string among those met
        for b in batches:
            cols: list[list] = [[] for _ in SEGMENTS]

            def put(*values):
                for c, v in zip(cols, values):
                    c.append(v)

            for kid, tid, text, names, hots, copies in zip(
                    b.column("kid").to_pylist(), b.column("tid").to_pylist(), common.text_bytes(b.column("text")),
                    *(b.column(c).to_pylist() for c in ("anchors", "hots", "copies"))):
                if len(text) < min_len or not (names or hots):
                    continue
                if copies and hashlib.sha256(text).digest() in copies:
                    continue
                rid = text_key(text)
                first, count, found = anchors(np.frombuffer(text, dtype=np.uint8), min_len)
                is_hot = np.isin(found, np.array(hots, dtype=np.int64))
                cold = np.flatnonzero(np.isin(found, np.array(names, dtype=np.int64)) & ~is_hot)
                at, ns, m = first[cold].tolist(), count[cold].tolist(), len(cold)
                for c, v in zip(cols, (found[cold].tolist(), [kid] * m, [rid] * m, at, ns,
                                       [text[s:s + n + min_len - 1] for s, n in zip(at, ns)], [tid] * m)):
                    c += v
                for k in np.flatnonzero(is_hot).tolist():
                    s = int(first[k])
                    gone = np.zeros(int(count[k]), dtype=bool)
                    for i in range(int(count[k])):
                        one, here = text[s + i:s + i + min_len], (kid, rid, s + i)
                        met = seen.get(one, here)
                        if met < here:
                            gone[i] = True
                            continue
                        if met == here and one in seen:
                            continue  # a repeated row: this place is out already
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen[one] = here
                        put(text_key(one), kid, rid, s + i, 1, one, tid)
                    for i, j in runs_of(gone):
                        put(kid ^ rid, kid, rid, s + i, j - i, None, tid)
            if cols[0]:
                yield batch(SEGMENTS, cols)

    return joined.mapInArrow(run, ddl(SEGMENTS))


def repeated_spans(segments: DataFrame, min_len: int, gram: int) -> DataFrame:
    """Spans (kid, tid, rid, s, e) of bytes that go, from segments in order of (deal,
    kid, rid, start): blocks of whole deal groups are merged at a time."""

    def solve(rows: list[tuple]) -> list[tuple]:
        out, classes, where = [], {}, {}
        for deal, kid, rid, start, n, seg, tid in rows:
            if seg is None:
                out.append((kid, tid, rid, start, start + n + min_len - 1))
                continue
            same = classes.setdefault((deal, seg), (kid, rid, start, n, tid))
            if same != (kid, rid, start, n, tid):
                out.append((kid, tid, rid, start, start + n + min_len - 1))
            else:
                where.setdefault(deal, {})[seg] = same
        # an anchor with one class of segments has no other repeats
        todo = [(seg, at) for group in where.values() if len(group) > 1 for seg, at in group.items()]
        if todo:
            flags = repeated_starts([s for s, _ in todo], [at[3] for _, at in todo], min_len, gram)
            for (_, (kid, rid, start, _, tid)), f in zip(todo, flags):
                out += [(kid, tid, rid, start + i, start + j + min_len - 1) for i, j in runs_of(f)]
        return out

    def run(batches):
        rows: list[tuple] = []
        size = 0
        for b in batches:
            for row in zip(*(c.to_pylist() if pa.types.is_binary(c.type) else c.to_numpy().tolist() for c in b.columns)):
                if size >= BLOCK_BYTES and row[0] != rows[-1][0]:
                    yield batch(SPANS, list(map(list, zip(*solve(rows)))) or [[] for _ in SPANS])
                    rows, size = [], 0
                rows.append(row)
                size += len(row[5] or b"")
        if rows:
            yield batch(SPANS, list(map(list, zip(*solve(rows)))) or [[] for _ in SPANS])

    return segments.mapInArrow(run, ddl(SPANS))


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union (touching spans join)."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = MIN_LEN,
          gram: int = GRAM, hot: int = HOT, as_text: bool = False) -> DataFrame:
    """(row, n_bytes, n_removed, spans, kept): row is a struct of the input's
    columns but the text, spans the removed byte runs, kept the other bytes
    (``as_text``: as a string, without the characters that a cut has split)."""
    if min_len % gram or min_len <= ANCHOR:
        raise ValueError("min_len must be a multiple of gram and longer than an anchor")
    spark = df.sparkSession
    common.prepare(spark)
    parts = common.n_parts(spark)
    others = [F.col(f"`{c}`") for c in df.columns if c != text_col]
    text = F.col(text_col).cast("string")
    # tid, half a hash of the text, keeps the texts of one id (or of none) apart in groups and joins
    base = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("kid"), text.alias("text"),
                     F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit("")).cast("binary")), 32).alias("tid"),
                     F.struct(*others).alias("row"))
    texts = base.select("kid", "tid", "text")
    crowded = spark.sparkContext.broadcast(crowded_anchors(texts, min_len, hot))
    met = anchor_rows(texts, min_len, crowded) \
        .withColumn("c", F.count("*").over(Window.partitionBy("deal"))) \
        .withColumn("crowd", F.col("deal") != F.col("anchor")) \
        .filter((F.col("c") > 1) | F.col("crowd"))
    big = F.col("crowd") | (F.col("c") > hot)
    # whole copies: every document whose text stands under a smaller id
    ids = texts.select("kid", "tid", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("dig")) \
        .filter(F.col("text").isNotNull())
    first = ids.groupBy("dig").agg(F.min("kid").alias("low"), F.max("kid").alias("high")).filter("low < high")
    copies = ids.join(first.select("dig", "low"), "dig").filter("kid > low").select("kid", "tid", "dig")
    notes = met.select("kid", "tid", F.when(~big, F.col("anchor")).alias("anchor"), F.when(big, F.col("anchor")).alias("hot"),
                       F.lit(None).cast("binary").alias("dig")) \
        .unionByName(copies.select("kid", "tid", F.lit(None).cast("long").alias("anchor"),
                                   F.lit(None).cast("long").alias("hot"), "dig"))
    notes = notes.groupBy("kid", "tid").agg(F.collect_set("anchor").alias("anchors"), F.collect_set("hot").alias("hots"),
                                            F.collect_set("dig").alias("copies"))
    # one exchange of the texts by id and text serves both joins below
    home = base.repartition(parts, "kid", "tid")
    segments = segment_rows(home.join(notes, ["kid", "tid"]), min_len, hot) \
        .repartition(parts, "deal").sortWithinPartitions("deal", "kid", "rid", "start")
    spans = repeated_spans(segments, min_len, gram).select("kid", "tid", F.struct("rid", "s", "e").alias("span"),
                                                           F.lit(None).cast("binary").alias("dig")) \
        .unionByName(copies.select("kid", "tid", F.lit(None).cast("struct<rid:bigint,s:bigint,e:bigint>").alias("span"), "dig"))
    # a set: repeated rows find the same spans
    spans = spans.groupBy("kid", "tid").agg(F.collect_set("span").alias("found"), F.collect_set("dig").alias("copies"))
    joined = home.join(spans, ["kid", "tid"], "left")
    row_type = joined.schema["row"].dataType
    schema = T.StructType([T.StructField("row", row_type), *T._parse_datatype_string(
        "n_bytes long, n_removed long, spans array<struct<s: long, e: long>>, "
        f"kept {'string' if as_text else 'binary'}").fields])
    arrow = common.arrow_schema(schema)

    def run(batches):
        for b in batches:
            sizes, gone, cut, kept = [], [], [], []
            for text, found, copies in zip(common.text_bytes(b.column("text")), b.column("found").to_pylist(),
                                           b.column("copies").to_pylist()):
                if len(text) >= min_len and copies and hashlib.sha256(text).digest() in copies:
                    out = [(0, len(text))]
                else:
                    rid = text_key(text) if found else 0
                    out = merge_spans([(x["s"], x["e"]) for x in found or () if x["rid"] == rid])
                rest, at = [], 0
                for s, e in out:
                    rest.append(text[at:s])
                    at = e
                rest.append(text[at:])
                sizes.append(len(text))
                gone.append(sum(e - s for s, e in out))
                cut.append([{"s": s, "e": e} for s, e in out])
                kept.append(b"".join(rest).decode("utf-8", "ignore") if as_text else b"".join(rest))
            yield pa.RecordBatch.from_arrays(
                [common.as_array(b.column("row"), arrow.field(0).type),
                 *(pa.array(v, f.type) for v, f in zip((sizes, gone, cut, kept), list(arrow)[1:]))], schema=arrow)

    return joined.mapInArrow(run, schema)


def cut_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``df`` with the repeated bytes cut out of its texts, columns in their
    order; characters that a cut has split are dropped. A column n_chars
    follows the text where it is its length."""
    out = dedup(df, id_col, text_col, as_text=True, **how)
    names = df.columns
    kinds = dict(df.dtypes)
    cols = []
    for c in names:
        if c == text_col:
            cols.append(F.col("kept").alias(c))
        elif c == "n_chars":
            cols.append(F.when(F.col("n_removed") > 0, F.char_length("kept")).otherwise(F.col("row.n_chars"))
                        .cast(kinds[c]).alias(c))
        else:
            cols.append(F.col(f"row.`{c}`").alias(c))
    return out.select(*cols)
