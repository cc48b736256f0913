"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages and has one label. Every passage is encoded
(byte-class histograms through a learned layer), a gated attention network
(tanh branch times sigmoid branch) gives each passage a weight, the weights
are normalised over the bag, and the weighted passage representation is
scored by a logistic unit. All parts are learned together from document
labels.

Training uses at most ``max_train`` labelled rows (a documented bound, chosen
by a hash of the id, then of the text; a repeated row counts once) with at most
``max_passages`` passages together, and runs on the driver over their passage
histograms; scoring is row-local over all rows and whole texts.

Defined cases: null text is empty and is scored as one empty passage; rows of
labels without id or quality are ignored and repeated labels of an id count
once (the largest); without training rows, or with one class only, every
score is the class share (1.0 when there is none: nothing is known against a
text); labels, lang, source and ids never enter a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import common

#: Bytes of a passage.
PASSAGE = 512
#: Labelled rows that training takes at most.
MAX_TRAIN = 6000
#: Passages that training takes at most: labelled rows that would go over it are
#: left out whole, a text is never learned from in part.
MAX_PASSAGES = 200_000
HIDDEN, GATE, EPOCHS, BATCH, SEED = 24, 12, 30, 64, 7
#: Share of positives from which a document is kept.
THRESHOLD = 0.7


def byte_classes() -> np.ndarray:
    """Class of each byte: every ASCII punctuation mark its own, and lower,
    upper, digit, space, line end, control, lead and continuation bytes."""
    cls = np.zeros(256, dtype=np.int64)
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    for b in range(256):
        c = chr(b) if b < 128 else ""
        cls[b] = (8 + marks.index(b) if b in marks else 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else
                  2 if c.isdigit() else 3 if c == " " else 4 if c in "\n\r" and c else 5 if b < 128 else
                  6 if b >= 192 else 7)
    return cls


CLASS = byte_classes()
N_CLASS = int(CLASS.max()) + 1
# class pairs over coarse kinds: lower, upper, digit, blank, mark, high
KIND = np.array([0, 1, 2, 3, 3, 4, 5, 5] + [4] * (N_CLASS - 8))
N_FEATURES = N_CLASS + 36


def passages(text: bytes) -> np.ndarray:
    """Passage features of a whole text: square roots of class and kind-pair
    shares, one row per 512 bytes (an empty text has one row of zeros)."""
    raw = np.frombuffer(text, dtype=np.uint8)
    n = max(1, -(-len(raw) // PASSAGE))
    if not len(raw):
        return np.zeros((1, N_FEATURES), dtype=np.float32)
    c = CLASS[raw]
    at = np.arange(len(raw)) // PASSAGE
    hist = np.bincount(at * N_CLASS + c, minlength=n * N_CLASS).reshape(n, N_CLASS)
    k = KIND[c]
    pair = np.bincount(at[1:] * 36 + k[:-1] * 6 + k[1:], minlength=n * 36).reshape(n, 36)
    size = np.maximum(1, hist.sum(axis=1, keepdims=True))
    return np.sqrt(np.hstack([hist / size, pair / size])).astype(np.float32)


@dataclass
class Model:
    """Weights; ``flat`` is used when labels do not allow learning."""

    flat: float | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    w: dict | None = None

    def score(self, bag: np.ndarray) -> float:
        if self.flat is not None:
            return self.flat
        x = (bag - self.mean) / self.scale
        _, z = pooled(self.w, x, np.zeros(len(x), dtype=np.int64), 1)[-2:]
        return float(sigmoid(z @ self.w["c"] + self.w["b"])[0])

    def score_all(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.flat is not None or not bags:
            return np.full(len(bags), self.flat if self.flat is not None else 1.0)
        x = (np.vstack(bags) - self.mean) / self.scale
        doc = np.repeat(np.arange(len(bags)), [len(g) for g in bags])
        z = pooled(self.w, x, doc, len(bags))[-1]
        return sigmoid(z @ self.w["c"] + self.w["b"])


def sigmoid(v):
    return 1.0 / (1.0 + np.exp(-np.clip(v, -30, 30)))


def per_doc_sum(v: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Sum rows of v by (sorted) document number."""
    out = np.zeros((n, *v.shape[1:]))
    starts = np.searchsorted(doc, np.arange(n))
    out[:] = np.add.reduceat(v, starts, axis=0)
    return out


def pooled(w: dict, x: np.ndarray, doc: np.ndarray, n: int):
    """Encodings, gate branches, attention weights and weighted representations."""
    h = np.tanh(x @ w["E"] + w["e"])
    t, s = np.tanh(h @ w["V"]), sigmoid(h @ w["U"])
    a = (t * s) @ w["a"]
    top = np.full(n, -np.inf)
    np.maximum.at(top, doc, a)
    ex = np.exp(a - top[doc])
    att = ex / per_doc_sum(ex, doc, n)[doc]
    return h, t, s, att, per_doc_sum(att[:, None] * h, doc, n)


def train(bags: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Adam on the cross entropy of document labels through the gated attention."""
    if not len(y):
        return Model(flat=1.0)
    if y.min() == y.max():
        return Model(flat=float(y.mean()))
    rng = np.random.default_rng(seed)
    rows = np.vstack(bags).astype(np.float64)
    mean, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-2
    f = rows.shape[1]
    w = {"E": rng.normal(0, 1 / np.sqrt(f), (f, HIDDEN)), "e": np.zeros(HIDDEN),
         "V": rng.normal(0, 0.3, (HIDDEN, GATE)), "U": rng.normal(0, 0.3, (HIDDEN, GATE)),
         "a": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.3, HIDDEN), "b": np.zeros(1)}
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v2 = {k: np.zeros_like(v) for k, v in w.items()}
    norm = [(g - mean) / scale for g in bags]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), BATCH):
            pick = order[i:i + BATCH]
            x = np.vstack([norm[j] for j in pick])
            doc = np.repeat(np.arange(len(pick)), [len(norm[j]) for j in pick])
            h, t, s, att, z = pooled(w, x, doc, len(pick))
            err = (sigmoid(z @ w["c"] + w["b"]) - y[pick]) / len(pick)
            dz = err[:, None] * w["c"]
            g = {"c": z.T @ err, "b": np.array([err.sum()])}
            datt = (dz[doc] * h).sum(axis=1)
            da = att * (datt - per_doc_sum(att * datt, doc, len(pick))[doc])
            g["a"] = (t * s).T @ da
            dt, ds = da[:, None] * w["a"] * s * (1 - t * t), da[:, None] * w["a"] * t * s * (1 - s)
            g["V"], g["U"] = h.T @ dt, h.T @ ds
            dh = att[:, None] * dz[doc] + dt @ w["V"].T + ds @ w["U"].T
            dpre = dh * (1 - h * h)
            g["E"], g["e"] = x.T @ dpre + 1e-4 * w["E"], dpre.sum(axis=0)
            step += 1
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v2[k] = 0.999 * v2[k] + 0.001 * g[k] ** 2
                w[k] -= 0.005 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v2[k] / (1 - 0.999 ** step)) + 1e-8)
    return Model(mean=mean, scale=scale, w=w)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id as text modulo 4 is 2."""
    return common.crc_fold(id_col, 4) == 2


def training_rows(rows: DataFrame, max_train: int) -> DataFrame:
    """At most ``max_train`` rows, one for each id and text: an id may stand in
    any number of rows. The texts stay in their rows; only hashes are sorted."""
    rows = rows.withColumn("__h", F.xxhash64("__id")).withColumn("__t", F.xxhash64(F.coalesce("__text", F.lit(""))))
    picked = rows.groupBy("__h", "__id", "__t").agg(F.max("__y").alias("__y")) \
        .orderBy("__h", "__id", "__t").limit(max_train).select("__id", "__t")
    # at most max_train (id, text hash) rows: a bounded broadcast
    return rows.join(F.broadcast(picked), ["__id", "__t"]).dropDuplicates(["__id", "__t"]).select("__id", "__t", "__text", "__y")


def whole_rows(rows: DataFrame, max_passages: int) -> DataFrame:
    """``rows`` without those that would take the passages over ``max_passages``:
    rows are taken in order of a hash, each with all its passages or not at all,
    so a text longer than what is left is passed over."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(F.coalesce("__text", F.lit(""))) / PASSAGE))
    # at most max_train narrow rows
    sizes = rows.select("__id", "__t", n.alias("n")).orderBy(F.xxhash64("__id", "__t"), "__id", "__t").collect()
    left, gone = max_passages, []
    for r in sizes:
        if r["n"] <= left:
            left -= r["n"]
        else:
            gone.append((r["__id"], r["__t"]))
    if not gone:
        return rows
    out = rows.sparkSession.createDataFrame(gone, rows.select("__id", "__t").schema)
    return rows.join(F.broadcast(out), ["__id", "__t"], "left_anti")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", max_train: int = MAX_TRAIN, max_passages: int = MAX_PASSAGES) -> Model:
    """Model from at most ``max_train`` labelled rows outside the held-out fold,
    of at most ``max_passages`` passages together; each row is taken whole."""
    common.prepare(docs.sparkSession)
    ids = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).filter(~held_out(id_col))
           .groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__y"))
           .orderBy(F.xxhash64("__id"), "__id").limit(max_train))
    # at most max_train (id, label) rows: a bounded broadcast
    rows = training_rows(docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
                         .join(F.broadcast(ids), "__id").select("__id", "__text", "__y"), max_train)
    rows = whole_rows(rows, max_passages).select("__id", "__text", "__y")

    def run(b: pa.RecordBatch) -> dict:
        bags = [passages(t) for t in common.text_bytes(b.column(1))]
        return {"id": b.column(0).cast(pa.string()), "y": b.column(2), "n": [len(g) for g in bags],
                "x": [g.astype(np.float16).tobytes() for g in bags]}

    got = common.per_batch(rows, run, "id string, y int, n int, x binary").collect()
    got.sort(key=lambda r: (r["id"], r["x"]))
    bags = [np.frombuffer(r["x"], dtype=np.float16).reshape(r["n"], N_FEATURES).astype(np.float32) for r in got]
    return train(bags, np.array([float(r["y"] > 0) for r in got]))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the column ``out`` added (row-local; the model is some kB)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(s):
        import pandas as pd
        bags = [passages(b"" if t is None else t.encode()) for t in s]
        return pd.Series(shared.value.score_all(bags))

    return docs.withColumn(out, of(F.col(text_col).cast("string")))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 threshold: float = THRESHOLD, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of ``docs`` that score at least the threshold."""
    model = fit(docs, labels, id_col, text_col, max_train=max_train)
    name = common.fresh(docs, "score")
    return score(docs, model, text_col, name).filter(F.col(name) >= threshold).drop(name)
