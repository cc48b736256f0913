"""Structured Streaming jobs: continuous moderation (T1), streamed-delta
assembly with per-request state (T2), windowed usage and cost (T3),
continuous upsert into the search table (T4), rolling evaluation pass rate
(T5).

Sources are file streams (parquet), sinks are parquet with a checkpoint,
both under the session's shared checkpoint folder, so a restarted query
resumes exactly where it stopped. ``run_available`` drains what is
available (Trigger.AvailableNow) and returns the sink as a batch frame.
"""

from __future__ import annotations

import sys
import uuid

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarry.functions import text as T
from quarry.operators import inference as M
from quarry.operators import safety as S
from quarry.session import checkpoint_dir
from quarry.sources import search_table as ST

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Hash buckets of a continuously upserted table.
UPSERT_BUCKETS = 256


def scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/quarry/stream-{name}-{uuid.uuid4().hex}"


def _is_folder(spark: SparkSession, path: str) -> bool:
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    return fs.exists(at) and fs.getFileStatus(at).isDirectory()


def file_stream(spark: SparkSession, directory: str, file_glob: str | None = None,
                schema=None, max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet file stream over ``directory`` (optionally one file name
    pattern, or a table in it that is a folder of files), schema taken from the
    files when not given."""
    if file_glob and _is_folder(spark, f"{directory.rstrip('/')}/{file_glob}"):
        directory, file_glob = f"{directory.rstrip('/')}/{file_glob}", None
    reader = spark.readStream.format("parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    if schema is None:
        batch = spark.read.format("parquet")
        if file_glob:
            batch = batch.option("pathGlobFilter", file_glob)
        schema = batch.load(directory).schema
    return reader.schema(schema).load(directory)


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run to completion on what is available; return the sink as a table."""
    spark = stream.sparkSession
    base = scratch(spark, name)
    q = (stream.writeStream.format("parquet").outputMode(mode)
         .option("path", f"{base}/out").option("checkpointLocation", f"{base}/chk")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def moderation(stream: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stateless per-row moderation (severities + attack flag + is_safe)."""
    staged = stream.select(key, S.attack_flag(text_col).alias("jailbreak_detected"),
                           T.words(text_col).alias("__toks"))
    out = staged.select(key, "jailbreak_detected", *S.severity_from_tokens(F.col("__toks")))
    safe = F.lit(True)
    for c in S.CATEGORIES:
        safe = safe & (F.col(c) == 0)
    return out.withColumn("is_safe", safe & ~F.col("jailbreak_detected"))


def usage_windows(usage: DataFrame, kind: str = "tumbling", delay: str = "1 hour") -> DataFrame:
    """Tokens and cost per event-time window with a watermark. In
    append mode a window is emitted once the watermark passes its end; rows
    older than the watermark in force when their micro-batch starts (Spark
    filters late rows with the previous batch's watermark) are dropped, so a
    finalised window is never emitted twice.

    kind: 'tumbling' (1 h), 'sliding' (24 h every 1 h) or 'session'
    (per user, 30 min gap). Event time must be TIMESTAMP (NTZ is cast)."""
    u = usage.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    costed = M.usage_cost(u)
    aggs = [F.count(F.lit(1)).alias("calls"), F.sum("total_tokens").alias("total_tokens"),
            F.sum("cost_usd").alias("cost_usd")]
    if kind == "tumbling":
        return costed.groupBy(F.window("ts", "1 hour").alias("w")).agg(*aggs)
    if kind == "sliding":
        return costed.groupBy(F.window("ts", "24 hours", "1 hour").alias("w")).agg(*aggs)
    if kind == "session":
        return costed.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(*aggs)
    raise ValueError(kind)


class DeltaAssembly(StatefulProcessor):
    """State of one request: the list of its deltas, appended to by every
    micro-batch and read when the request can be complete, and (deltas listed,
    latest event time, number of deltas that the final marker names, answered).
    An answered request is remembered until its timer, so that redelivered
    deltas give no second response; without a timeout it is remembered for good."""

    def __init__(self, key: str, ts_col: str, timeout_ms: int | None):
        self.key, self.ts_col, self.timeout_ms = key, ts_col, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.deltas = handle.getListState("deltas", "seq long, delta string")
        self.facts = handle.getValueState("facts", "n long, last_ms long, total long, done boolean")

    def finish(self, key, parts: dict[int, str], abandoned: bool) -> pd.DataFrame:
        self.deltas.clear()
        texts = [t for _, t in sorted(parts.items()) if t]
        return pd.DataFrame({self.key: [key[0]], "content": ["".join(texts)], "n_deltas": [len(texts)],
                             "abandoned": [abandoned]})

    def handleInputRows(self, key, rows, timerValues):
        n, last, total, done = self.facts.get() if self.facts.exists() else (0, None, None, False)
        if done:
            return    # answered already: what arrives again changes nothing
        before, new = last, {}
        for pdf in rows:
            final = pdf["is_final"].astype(bool)
            if final.any():
                total = int(pdf.loc[final, "seq"].iloc[-1])
            body = pdf.loc[~final]
            new.update((int(s), t if isinstance(t, str) else "") for s, t in zip(body["seq"], body["delta"]))
            if self.timeout_ms is not None:
                late = int(pdf[self.ts_col].max().timestamp() * 1000)
                last = late if last is None else max(last, late)
        n += len(new)
        if total is not None and n >= total:
            parts = {s: t for s, t in self.deltas.get()} | new
            if len(parts) >= total:
                self.wait(before, last)
                self.facts.update((n, last, total, True))
                yield self.finish(key, parts, False)
                return
            self.deltas.put(list(parts.items()))  # some came twice
            n = len(parts)
        elif new:
            self.deltas.appendList(list(new.items()))
        self.facts.update((n, last, total, False))
        self.wait(before, last)

    def wait(self, before: int | None, last: int | None) -> None:
        """Move the timer to ``timeout`` after the latest event time."""
        if last is not None and last != before:
            if before is not None:
                self.handle.deleteTimer(before + self.timeout_ms)
            self.handle.registerTimer(last + self.timeout_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        done = self.facts.exists() and self.facts.get()[3]
        self.facts.clear()
        if not done:
            yield self.finish(key, {s: t for s, t in self.deltas.get()}, True)

    def close(self) -> None:
        pass


def assemble_stream(deltas: DataFrame, key: str = "request_id", timeout: str | None = None,
                    ts_col: str = "ts") -> DataFrame:
    """Per-request state holding the deltas seen so far. A row with
    ``is_final`` carries, as its seq, the number of deltas of the request
    (seq 0 to that number - 1); the request is complete when all of them are
    in, whatever the order in which they and the marker arrive. Its content
    (in seq order, NULL/empty deltas skipped, repeated seqs once) is emitted
    and its deltas are dropped; that it was answered is remembered until its
    timer. A micro-batch appends its deltas to a list state;
    earlier ones are not read again until the request can be complete.

    With ``timeout`` (e.g. "10 minutes") the stream needs an event-time
    column ``ts_col``: a watermark of that delay is set and each request
    gets an event-time timer at its latest delta + timeout; a request whose
    deltas have not all arrived when the watermark passes the timer is
    emitted with what it has and ``abandoned`` = true, and its state is
    dropped. Without a timeout, unfinished requests wait in state.

    List state needs the RocksDB state store, which is set for the session.
    """
    deltas.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    # the process that plans the stream does not see files added to the session
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    out_schema = f"{key} {deltas.schema[key].dataType.simpleString()}, content string, n_deltas long, abandoned boolean"
    timeout_ms = None
    if timeout:
        amount, unit = timeout.split()
        per = {"second": 1000, "minute": 60_000, "hour": 3_600_000}[unit.rstrip("s")]
        timeout_ms = int(amount) * per
        deltas = deltas.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, timeout)
    return deltas.groupBy(key).transformWithStateInPandas(
        DeltaAssembly(key, ts_col, timeout_ms), outputStructType=out_schema, outputMode="Append",
        timeMode="None" if timeout_ms is None else "EventTime")


def upsert_stream(updates: DataFrame, base: DataFrame, name: str = "search", n_buckets: int = UPSERT_BUCKETS) -> str:
    """T4: continuous upsert into a table partitioned by a hash bucket of the
    id. A micro-batch reads and overwrites only the buckets that its valid
    rows fall into (dynamic partition overwrite). Merging a batch again
    changes nothing, since the higher version wins, so a replayed batch is
    idempotent. Overwritten buckets are swapped in when the write commits,
    one after the other: readers may see some buckets before others. Returns
    the table's path."""
    spark = updates.sparkSession
    root = scratch(spark, name)
    path = f"{root}/table"
    in_bucket = F.pmod(F.xxhash64("id"), F.lit(n_buckets)).cast("int")
    dealt = base.withColumn("bucket", in_bucket)
    dealt.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
    schema = dealt.schema

    def merge(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("bucket", in_bucket)
        touched = [r["bucket"] for r in batch.filter("valid").select("bucket").distinct().collect()]  # <= n_buckets
        if not touched:
            return
        current = spark.read.schema(schema).parquet(path).filter(F.col("bucket").isin(touched))
        new, _ = ST.upsert(current, batch)
        new.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy("bucket").parquet(path)

    q = (updates.writeStream.foreachBatch(merge).option("checkpointLocation", f"{root}/chk")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return path


def pass_rate_windows(results: DataFrame, delay: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """T5: rolling pass rate and metric averages per event-time window."""
    r = results.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return r.groupBy(F.window("ts", size).alias("w")).agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.col("passed").cast("long")).alias("passed"),
        F.avg("overall_score").alias("avg_overall"))
