"""Lists packed into binary columns, and sorted streams of Arrow batches.

A list of ids or scores per row crosses Spark as one binary value: a shuffle
moves it as one field, and a task reads a whole batch of lists as one numpy
array with their lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows that a task gathers before it runs a numpy pass over them.
CHUNK_ROWS = 4096


def unpack(col, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column as one array, and the values in each row (null: none)."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.binary())
    if col.null_count:
        col = col.fill_null(b"")
    size = np.dtype(dtype).itemsize
    if not len(col):
        return np.zeros(0, dtype), np.zeros(0, np.int64)
    _, offsets, data = col.buffers()
    ends = np.frombuffer(offsets, np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), dtype), np.diff(ends) // size


def pack(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary value per row out of consecutive runs of ``values``."""
    values = np.ascontiguousarray(values)
    ends = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(np.asarray(counts, np.int64) * values.dtype.itemsize * int(np.prod(values.shape[1:], dtype=np.int64)), out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32).tobytes()),
                                                            pa.py_buffer(values.tobytes())])


def long_values(col) -> np.ndarray:
    return np.asarray(col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).astype(np.int64)


def chunks(batches: Iterator[pa.RecordBatch], rows: int = CHUNK_ROWS) -> Iterator[pa.Table]:
    """The stream again in tables of about ``rows`` rows."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = CHUNK_ROWS) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that never cut a run of equal keys. For
    groups whose size is bounded."""
    rest = None
    for t in chunks(batches, rows):
        if rest is not None:
            t = pa.concat_tables([rest, t])
        k = long_values(t[key])
        differs = np.flatnonzero(k != k[-1])
        cut = int(differs[-1] + 1) if len(differs) else 0
        if cut:
            yield t.slice(0, cut)
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def starts_of(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))


def mix(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """A 63-bit number for each pair, the same on every run (splitmix64 steps)."""
    with np.errstate(over="ignore"):
        x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) + np.uint64(seed * 0x632BE59B + 1)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(1)).astype(np.int64)


def best_lists(owner: np.ndarray, item: np.ndarray, score: np.ndarray, flag: np.ndarray, k: int
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best distinct items of each owner, best first (ties by item):
    (owners, list lengths, items, scores, flags). Of an item that comes twice,
    the lowest flag stays; equal pairs must have equal scores."""
    by = np.lexsort((flag, item, -score, owner))
    owner, item, score, flag = owner[by], item[by], score[by], flag[by]
    keep = np.ones(len(owner), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (item[1:] != item[:-1])
    owner, item, score, flag = owner[keep], item[keep], score[keep], flag[keep]
    at = starts_of(owner)
    rank = np.arange(len(owner)) - np.repeat(at, np.diff(np.append(at, len(owner))))
    keep = rank < k
    owner, item, score, flag = owner[keep], item[keep], score[keep], flag[keep]
    at = starts_of(owner)
    return owner[at], np.diff(np.append(at, len(owner))), item, score, flag
