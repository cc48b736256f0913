"""WARC archives with an external index merge.

Pages are written as WARC/1.1 response records, and as revisit records where
another capture has the same payload. The archives are read back by their
Content-Length fields, and each archive gives one locally sorted run of index
entries (URL key, capture time, place). The runs are merged externally: a
range exchange deals key ranges to tasks, and every task merges its slices of
the runs with a loser tree, so the result is in global order of URL key and
time, the capture histories.

Archives are written by Spark's text writer: records are text (headers, then
the UTF-8 payload) and the record end, two CRLFs, is the line separator. Each
archive file is compressed as one gzip member and holds a bounded number of
records.

Defined cases: null html is an empty payload; equal payloads are equal bytes,
the empty one included; null page ids are the smallest; every row is a
capture, and rows that share the largest page id of a payload are all
responses; a null url has an empty key; pages without rows
give an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import common
from quarry.plans.sizing import shared_path

#: Records in one archive file at most, and the smallest payload that revisits apply to.
RECORDS_PER_FILE = 1000
MIN_PAYLOAD = 0
#: Capture time of page 0; later pages follow by a second each (the table has no times).
FIRST_CAPTURE = "2024-01-01 00:00:00"
CRLF = "\r\n"


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column."""

    @F.pandas_udf("string")
    def digest(s):
        return s.map(lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode())

    return digest(data)


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then path and query, lower case."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip())
        host = (u.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    return f"{','.join(reversed(host.split('.')))}){u.path or '/'}{'?' + u.query if u.query else ''}".lower()


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
             min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Pages with their digest, record type and the capture that revisits refer to.

    The latest capture (largest id) of a payload is its response. The winner of
    a payload is found by a map-side combined maximum over digests, and only
    payloads that occur twice are joined back, so a hot payload costs one row
    per task before the shuffle.
    """
    common.prepare(pages.sparkSession)
    body = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"),
                        F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), body.alias("payload"))
    rows = rows.withColumn("payload_digest", sha1_base32(F.col("payload").cast("binary"))) \
        .withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    narrow = rows.select("page_id", "payload_digest", "payload_bytes").filter(F.col("payload_bytes") >= min_payload)
    twice = narrow.groupBy("payload_digest").agg(F.max("page_id").alias("__first"), F.count("*").alias("__n")) \
        .filter("__n > 1").select("payload_digest", "__first")
    return rows.join(twice, "payload_digest", "left") \
        .withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("__first")) & F.col("__first").isNotNull(),
                                        F.col("__first"))) \
        .withColumn("record_type", F.when(F.col("refers_to").isNotNull(), "revisit").otherwise("response")) \
        .drop("__first")


def clean_header(c: Column) -> Column:
    """Header values stand on one line."""
    return F.regexp_replace(c, r"[\r\n]+", " ")


def write_archives(caps: DataFrame, records_per_file: int = RECORDS_PER_FILE) -> str:
    """Write captures as WARC files under the shared folder; returns the folder."""
    ident = lambda page: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))
    when = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(FIRST_CAPTURE).cast("timestamp"))
                                             + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    http = F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}")
    block = F.concat(http, body)
    head = F.concat_ws(
        CRLF, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Record-ID: "), ident(F.col("page_id"))), F.concat(F.lit("WARC-Date: "), when),
        F.concat(F.lit("WARC-Target-URI: "), clean_header(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "payload_digest"),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), ident(F.col("refers_to")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    path = shared_path(caps.sparkSession, "warc")
    caps.select(F.concat(head, F.lit(CRLF + CRLF), block).alias("value")).write \
        .option("lineSep", CRLF + CRLF).option("compression", "gzip") \
        .option("maxRecordsPerFile", records_per_file).text(path)
    return path


HEADER = re.compile(rb"([A-Za-z0-9-]+): ([^\r\n]*)")


def parse_records(data: bytes) -> Iterator[tuple[int, dict[bytes, bytes], bytes]]:
    """(offset, headers, payload) of the records of an archive, by Content-Length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(HEADER.findall(data, at, end))
        size = int(head[b"Content-Length"])
        block = data[end + 4:end + 4 + size]
        if len(block) != size or data[end + 4 + size:end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"broken record at {at}")
        yield at, head, block.partition(b"\r\n\r\n")[2]
        at = end + 8 + size


def capture_key(url: str, captured: str, page: int | None) -> tuple:
    return url, captured, -1 if page is None else page


def page_number(ident: bytes | None) -> int | None:
    text = (ident or b"").removeprefix(b"<urn:page:").removesuffix(b">")
    return int(text) if text and text != b"null" else None


def read_index(spark, path: str) -> DataFrame:
    """Index entries of all records: each archive is one run, sorted by URL key,
    time and place (``seq`` is the entry's place in its run). Digests and
    lengths of responses are computed from the bytes read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    schema = ("run string, seq long, url_key string, captured string, page_id long, payload_bytes long, "
              "payload_digest string, record_type string, refers_to long, offset long")

    def run(b: pa.RecordBatch) -> dict:
        rows = []
        for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            entries = []
            for at, h, payload in parse_records(gzip.decompress(content)):
                kind = h[b"WARC-Type"].decode()
                said = h[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
                size = int(h[b"X-Payload-Length"])
                if kind == "response":
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if digest != said or len(payload) != size:
                        raise ValueError(f"payload of {h[b'WARC-Record-ID']!r} differs from its digest")
                entries.append((url_key(h[b"WARC-Target-URI"].decode()), h[b"WARC-Date"].decode(),
                                page_number(h[b"WARC-Record-ID"]), size, said, kind,
                                page_number(h.get(b"WARC-Refers-To")), at))
            entries.sort(key=lambda e: (*capture_key(*e[:3]), e[7]))
            rows += [(name.rsplit("/", 1)[-1], i, *e) for i, e in enumerate(entries)]
        names = ["run", "seq", "url_key", "captured", "page_id", "payload_bytes", "payload_digest", "record_type",
                 "refers_to", "offset"]
        return {n: [r[i] for r in rows] for i, n in enumerate(names)}

    return common.per_batch(files, run, schema)


class LoserTree:
    """k-way merge: inner nodes keep the loser of their match, so the next
    smallest head costs one climb from the winner's leaf to the root."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.k = max(1, len(runs))
        self.heads: list[tuple | None] = [r[0] if r else None for r in runs]
        self.losers = [-1] * self.k
        for leaf in range(len(runs)):
            self._climb(leaf)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _climb(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node:
            other = self.losers[node]
            if other == -1:  # first visit while building: wait here for the other side
                self.losers[node] = winner
                return
            if self._before(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.runs:
            w = self.losers[0]
            head = self.heads[w]
            if head is None:
                return
            yield head
            self.at[w] += 1
            self.heads[w] = self.runs[w][self.at[w]] if self.at[w] < len(self.runs[w]) else None
            self._climb(w)


def merge_histories(index: DataFrame) -> DataFrame:
    """Index entries in global order of (url_key, captured, page id): column
    ``part`` numbers the key ranges in order and ``pos`` the place in a range.

    The range exchange uses key, time and page id, so captures of one hot URL
    spread over tasks.
    """
    spark = index.sparkSession
    cols = index.columns
    dealt = index.repartitionByRange(common.n_parts(spark), "url_key", "captured", "page_id", "run") \
        .withColumn("part", F.spark_partition_id()).sortWithinPartitions("run", "seq")
    order = [cols.index(c) for c in ("url_key", "captured", "page_id")]
    arrow = common.arrow_schema(index.schema)

    def run(batches):
        # slices of the sorted runs, each still in its own order
        runs: dict[str, list[tuple]] = {}
        part = 0
        for b in batches:
            part = b.column(len(cols))[0].as_py() if b.num_rows else part
            data = [b.column(i).to_pylist() for i in range(len(cols))]
            for row in zip(*data):
                runs.setdefault(row[0], []).append((capture_key(*(row[i] for i in order)), row))
        out = [row for _, row in LoserTree(list(runs.values()))]
        for i in range(0, len(out), 5000):
            piece = out[i:i + 5000]
            arrays = [pa.array([r[j] for r in piece], f.type) for j, f in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(np.full(len(piece), part, dtype=np.int32)), pa.array(np.arange(i, i + len(piece)))],
                names=[*cols, "part", "pos"])

    return dealt.mapInArrow(run, T.StructType([*index.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("pos", T.LongType())]))


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  min_payload: int = MIN_PAYLOAD, records_per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """Write the archives, read them back and merge their indexes: one row per
    capture in global order (see ``merge_histories``)."""
    caps = captures(pages, id_col, url_col, html_col, min_payload)
    path = write_archives(caps, records_per_file)
    return merge_histories(read_index(pages.sparkSession, path))
