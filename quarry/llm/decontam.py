"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are token sequences. Karp-Rabin rolling hashes
find the token windows they share (the seeds); every seed is confirmed on
tokens and seeds along a diagonal are joined into maximal matches. The longest
match is marked as a tile, matches are cut back to unmarked tokens, and this
repeats until none of the minimum length is left. The share of an item's
tokens under tiles is its coverage in the document: tiles may stand in any
order, so a passage whose sentences were reordered is still covered.

The benchmark is read in blocks of bounded size; each block is shipped to a
scan of all documents (a stated query set against all rows), so neither side
is shuffled and the benchmark may be of any size.

Defined cases: null texts are empty; an item without tokens matches nothing;
an item shorter than a seed matches only as a whole; repeated items and
documents each give their own rows; rows with null ids take part.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common

#: Shortest tile in tokens, and the covered share of an item that flags a document.
MIN_TILE = 5
MIN_COVERAGE = 0.5
#: Bytes of benchmark text in one block.
BLOCK_BYTES = 8 << 20
#: Seeds joined at once: a text that repeats a word may have many with one item.
SEED_BLOCK = 1 << 20

TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")
HASH_BASE = np.uint64(0x9E3779B97F4A7C15)


def tokens_of(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of digits, letters and characters beyond ASCII."""
    return TOKEN.findall((text or "").lower().encode())


def rolling_hash(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash modulo 2^64 of every window of ``width`` token numbers."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            h = h * HASH_BASE + ids[j:j + n].astype(np.uint64)
    return h


def diagonals(k: np.ndarray, doc: np.ndarray, pos: np.ndarray, seeds: np.ndarray):
    """Join runs of seeds (item, document start, item start, number of seeds)
    that follow each other on a diagonal of one item."""
    order = np.lexsort((doc, doc - pos, k))
    k, doc, pos, seeds = k[order], doc[order], pos[order], seeds[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (doc[1:] - pos[1:] != doc[:-1] - pos[:-1]) | (doc[1:] != doc[:-1] + seeds[:-1])
    first = np.flatnonzero(new)
    return k[first], doc[first], pos[first], np.add.reduceat(seeds, first) if len(first) else seeds


@dataclass
class Block:
    """Items of one benchmark block with their seed table."""

    vocab: dict
    names: list
    items: list[np.ndarray]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # width: sorted hashes, item, place

    @classmethod
    def build(cls, rows: list[tuple], min_tile: int) -> "Block":
        vocab: dict[bytes, int] = {}
        names, items = [], []
        for name, text in rows:
            toks = tokens_of(text)
            if toks:
                names.append(name)
                items.append(np.array([vocab.setdefault(t, len(vocab) + 1) for t in toks], dtype=np.int64))
        table: dict[int, list] = {}
        for k, ids in enumerate(items):
            width = min(min_tile, len(ids))
            h = rolling_hash(ids, width)
            table.setdefault(width, []).append((h, np.full(len(h), k), np.arange(len(h))))
        seeds = {}
        for width, parts in table.items():
            h, item, place = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h, kind="stable")
            seeds[width] = (h[order], item[order], place[order])
        return cls(vocab, names, items, seeds)

    def matches(self, ids: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """item -> maximal matches (document start, item start, tokens)."""
        found: dict[int, list] = {}
        for width, (hashes, item, place) in self.seeds.items():
            if len(ids) < width:
                continue
            known = np.convolve(ids > 0, np.ones(width, dtype=np.int64), "valid") == width
            at = np.flatnonzero(known)
            if not len(at):
                continue
            h = rolling_hash(ids, width)[at]
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            reps = hi - lo
            if not reps.any():
                continue
            # seeds of a stretch of the document at a time, then the stretches' runs
            ends = np.cumsum(reps)
            cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] + SEED_BLOCK, SEED_BLOCK), "left"))
            runs = []
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)]):
                r = reps[a:b]
                doc = np.repeat(at[a:b], r)
                pick = np.repeat(lo[a:b] - np.concatenate(([0], np.cumsum(r)[:-1])), r) + np.arange(r.sum())
                runs.append(diagonals(item[pick], doc, place[pick], np.ones(len(doc), dtype=np.int64)))
            k, doc, pos, size = diagonals(*(np.concatenate(x) for x in zip(*runs))) if len(runs) > 1 else runs[0]
            size = size + width - 1
            for name, a, p, n in zip(k.tolist(), doc.tolist(), pos.tolist(), size.tolist()):
                if np.array_equal(ids[a:a + n], self.items[name][p:p + n]):  # confirm on tokens
                    found.setdefault(name, []).append((a, p, n))
        return found

    def encode(self, toks: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocab.get, toks, (0 for _ in toks)), dtype=np.int64, count=len(toks))


def tile(matches: list[tuple[int, int, int]], item_len: int, min_tile: int) -> tuple[int, int, int]:
    """(covered item tokens, tiles, longest tile) of greedy tiling."""
    import heapq
    heap = [(-n, a, p) for a, p, n in matches]
    heapq.heapify(heap)
    in_doc: set[int] = set()
    in_item = bytearray(item_len)
    covered = tiles = longest = 0
    while heap:
        n, a, p = heapq.heappop(heap)
        n = -n
        free = [j for j in range(n) if not in_item[p + j] and a + j not in in_doc]
        if len(free) == n:
            in_item[p:p + n] = b"\1" * n
            in_doc.update(range(a, a + n))
            covered += n
            tiles += 1
            longest = max(longest, n)
            if covered == item_len:
                break  # no token of the item is left to mark
            continue
        # cut back to the unmarked stretches that are still long enough
        i = 0
        while i < len(free):
            j = i
            while j + 1 < len(free) and free[j + 1] == free[j] + 1:
                j += 1
            if j - i + 1 >= min_tile:
                heapq.heappush(heap, (-(j - i + 1), a + free[i], p + free[i]))
            i = j + 1
    return covered, tiles, longest


def item_hits(block: Block, toks: list[bytes], min_tile: int, min_coverage: float) -> list[tuple]:
    """(item, covered tokens, coverage, tiles, longest tile) over the threshold."""
    out = []
    for k, ms in sorted(block.matches(block.encode(toks)).items()):
        size = len(block.items[k])
        if sum(n for _, _, n in ms) < min_coverage * size:
            continue  # even without overlaps the matches cover too little
        covered, tiles, longest = tile(ms, size, min(min_tile, size))
        if covered >= min_coverage * size:
            out.append((k, covered, covered / size, tiles, longest))
    return out


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """Rows of the benchmark in blocks of bounded bytes, one partition at a time."""
    rows, size = [], 0
    for r in benchmark.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).toLocalIterator():
        text = r["t"] or ""
        if rows and size + len(text) > block_bytes:
            yield rows
            rows, size = [], 0
        rows.append((r["i"], text))
        size += len(text)
    if rows:
        yield rows


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text: str = "text", min_tile: int = MIN_TILE,
                       min_coverage: float = MIN_COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, n_tokens, covered_tokens, coverage, n_tiles,
    longest_tile): one row per document and item covered at least
    ``min_coverage``."""
    spark = docs.sparkSession
    common.prepare(spark)
    kinds = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    schema = (f"doc_id {kinds[0]}, item_id {kinds[1]}, n_tokens long, covered_tokens long, coverage double, "
              "n_tiles long, longest_tile long")
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for rows in benchmark_blocks(benchmark, item_col, item_text, block_bytes):
        shared = spark.sparkContext.broadcast(Block.build(rows, min_tile))

        def run(b: pa.RecordBatch, shared=shared) -> dict:
            block = shared.value
            ids = b.column(0).to_pylist()
            cols: list[list] = [[] for _ in range(7)]
            for doc, text in zip(ids, b.column(1).to_pylist()):
                for k, covered, share, tiles, longest in item_hits(block, tokens_of(text), min_tile, min_coverage):
                    for c, v in zip(cols, (doc, block.names[k], len(block.items[k]), covered, share, tiles, longest)):
                        c.append(v)
            return dict(zip(("doc_id", "item_id", "n_tokens", "covered_tokens", "coverage", "n_tiles", "longest_tile"), cols))

        part = common.per_batch(src, run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                      item_text: str = "text", min_tile: int = MIN_TILE, min_coverage: float = MIN_COVERAGE,
                      block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` without an item covered at least ``min_coverage``:
    a row-local filter per benchmark block."""
    spark = docs.sparkSession
    common.prepare(spark)
    for rows in benchmark_blocks(benchmark, item_col, item_text, block_bytes):
        shared = spark.sparkContext.broadcast(Block.build(rows, min_tile))
        docs = docs.filter(covers_none(shared, min_tile, min_coverage)(F.col(text_col).cast("string")))
    return docs


def covers_none(shared, min_tile: int, min_coverage: float):
    """Whether a text covers no item of a shipped block."""

    @F.pandas_udf("boolean")
    def clean(s):
        import pandas as pd
        return pd.Series([not item_hits(shared.value, tokens_of(t), min_tile, min_coverage)
                          for t in s], dtype="bool")

    return clean
