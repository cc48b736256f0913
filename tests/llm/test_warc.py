import base64
import gzip
import hashlib
import heapq
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import warc
from tests.llm.data import clash


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def rows():
    rng = random.Random(3)
    out = [(i, f"http://www.h{rng.randrange(4)}.example.com/p{rng.randrange(5)}?q={i % 3}", f"<p>page {rng.randrange(25)}</p>\r\n\r\nWARC/1.1\r\n\r\n")
           for i in range(60)]
    return out + [(60, "http://a.b/\r\nX: y", "été" * 3000), (61, None, None), (62, "", ""), (63, "http://x.y", ""),
                  (64, "not a url", "z" * 200_000), (65, "http://[bad", "<p>"), (None, "http://a.b/", "<p>page 1</p>"),
                  (66, "HTTP://A.B:80/Q", "<p>")]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_round_trip(spark):
    data = rows()
    got = warc.archive_pages(clash(pages(spark, data), "payload", "run", "seq"), records_per_file=7).collect()
    last = {}
    for i, _, h in data:
        last[digest(h)] = max(last.get(digest(h), -1), -1 if i is None else i)
    want = []
    for i, _, h in data:
        d = digest(h)
        main = (-1 if i is None else i) == last[d]
        want.append((i, len((h or "").encode()), d, "response" if main else "revisit", None if main else last[d]))
    have = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)
    ordered = sorted(got, key=lambda r: (r["part"], r["pos"]))
    keys = [(r["url_key"], r["captured"]) for r in ordered]
    assert keys == sorted(keys)


def test_archives_are_valid(spark, tmp_path):
    path = warc.write_archives(warc.captures(pages(spark, rows())))
    import glob
    records = []
    for f in glob.glob(path.removeprefix("file://") + "/*.gz"):
        with gzip.open(f) as g:
            data = g.read()
        assert data.startswith(b"WARC/1.1\r\n")
        records += [(h, p) for _, h, p in warc.parse_records(data)]
    assert len(records) == len(rows())
    for h, p in records:
        assert {b"WARC-Type", b"WARC-Record-ID", b"WARC-Date", b"Content-Length"} <= h.keys()
        if h[b"WARC-Type"] == b"response":
            assert b"sha1:" + base64.b32encode(hashlib.sha1(p).digest()) == h[b"WARC-Payload-Digest"]
        else:
            assert p == b"" and h[b"WARC-Refers-To"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9).map(lambda v: (v,)), max_size=8).map(sorted), max_size=9))
def test_loser_tree_merges(runs):
    assert list(warc.LoserTree(runs)) == list(heapq.merge(*runs))


def test_min_payload(spark):
    got = warc.captures(pages(spark, [(1, "a", "xx"), (2, "b", "xx"), (3, "c", "longer"), (4, "d", "longer")]), min_payload=3).collect()
    assert {r["page_id"]: r["record_type"] for r in got} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_empty(spark):
    assert warc.archive_pages(pages(spark, []).limit(0)).collect() == []
