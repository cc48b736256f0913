"""The pluggable-scorer contract (U1) shared by embedding, completion,
reranking, severity and judge calls.

A scorer factory is called once per task and returns ``fn(pd.DataFrame) ->
pd.DataFrame`` (same row count, output columns only). ``apply_scorer`` runs
it through ``mapInPandas``: Spark partitions the rows, Arrow batches them
(``spark.sql.execution.arrow.maxRecordsPerBatch`` sets the batch size, the
analogue of the reference's batches of 100), and the model or client is
built once per task instead of once per row.

The deterministic fakes below stand in for remote models in tests and in
the rows-only queries; they never claim to equal a hosted model.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def apply_scorer(df: DataFrame, factory, out_ddl: str, keep: list[str]) -> DataFrame:
    """Run ``factory()`` once per task over Arrow batches of ``df``; output
    is ``keep`` columns plus the scorer's columns (``out_ddl``)."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields]
                       + [out_ddl])

    def run(batches):
        fn = factory()
        for pdf in batches:
            out = fn(pdf)
            yield pd.concat([pdf[keep].reset_index(drop=True), out.reset_index(drop=True)], axis=1)

    return df.mapInPandas(run, schema)


def fake_embedder(dims: int = 64, text_col: str = "text"):
    """Factory: hashed bag-of-words embedding, L2-normalised, plus a token
    count (whitespace tokens). Deterministic across runs and executors."""
    def factory():
        def fn(pdf: pd.DataFrame) -> pd.DataFrame:
            vecs, toks = [], []
            for t in pdf[text_col].fillna(""):
                words = t.lower().split()
                v = np.zeros(dims)
                for w in words:
                    h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                    v[h % dims] += 1.0 if (h >> 32) & 1 else -1.0
                n = np.linalg.norm(v)
                vecs.append((v / n if n > 0 else v).astype(np.float32))
                toks.append(len(words))
            return pd.DataFrame({"embedding": vecs, "input_tokens": np.array(toks, dtype=np.int32)})
        return fn
    return factory


def fake_completer(model: str = "fake-chat"):
    """Client factory for ``batch_complete``: a deterministic echo model.
    Prompts containing 'FAIL' raise, to exercise retries and error rows; a
    request with tools is answered with one call of the first tool."""
    def factory():
        def client(requests):
            prompts = [r["messages"][-1].get("content", "") for r in requests]
            if any("FAIL" in p for p in prompts):
                raise RuntimeError("simulated service failure")
            out = []
            for r, p in zip(requests, prompts):
                words = p.split()
                reply = " ".join(list(reversed(words[:8]))[:r["max_tokens"]])
                calls = [{"id": "call_0", "function": t["name"], "arguments": json.dumps({"text": reply})}
                         for t in r.get("tools", [])[:1]]
                out.append({"content": reply, "model": model, "tool_calls": calls,
                            "input_tokens": sum(len(m.get("content", "").split()) for m in r["messages"]),
                            "output_tokens": len(reply.split()),
                            "finish_reason": "tool_calls" if calls else "stop"})
            return out
        return client
    return factory
