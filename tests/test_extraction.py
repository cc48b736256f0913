import json

import pytest
from pyspark.sql import functions as F

from quarry.operators import extraction as D

RESPONSE = {
    "content": "Invoice 42",
    "pages": [{"page_number": 1, "selection_marks": [{"state": "selected", "confidence": 0.9}]},
              {"page_number": 2, "selection_marks": None}],
    "tables": [
        {"row_count": 2, "column_count": 2, "bounding_regions": [{"page_number": 2}],
         "cells": [{"row_index": 0, "column_index": 0, "content": "Item", "kind": "columnHeader"},
                   {"row_index": 0, "column_index": 1, "content": "Price", "kind": "columnHeader"},
                   {"row_index": 1, "column_index": 0, "content": "a|b", "kind": "content"},
                   {"row_index": 1, "column_index": 0, "content": "dup", "kind": "content"},
                   {"row_index": 5, "column_index": 0, "content": "out", "kind": "content"}]},
        {"row_count": 1, "column_count": 1, "bounding_regions": None, "cells": None}],
    "documents": [{"fields": {"InvoiceTotal": {"value": "12.5", "content": "12.50", "confidence": 0.95,
                                               "type": "number"},
                              "VendorName": {"value": None, "content": "ACME", "confidence": None, "type": None},
                              "Missing": None}},
                  {"fields": {"invoicetotal": {"value": "99", "confidence": 0.5, "type": "number"}}}],
    "paragraphs": [{"content": "p1"}, {"content": ""}, {"content": None}],
    "languages": [{"locale": "en"}, {"locale": ""}],
}


@pytest.fixture(scope="module")
def result(spark):
    raw = spark.createDataFrame([(1, json.dumps(RESPONSE)), (2, "garbage"), (3, None)], "doc_id long, raw string")
    return D.analyze_batch(raw, "raw", "prebuilt-invoice").cache()


def test_parse_response_shape(result):
    r = {x.doc_id: x for x in result.collect()}
    ok = r[1]
    assert ok.model_used == "prebuilt-invoice" and ok.page_count == 2 and ok.raw_text == "Invoice 42"
    assert [t.page for t in ok.tables] == [2, 0]
    assert ok.tables[0].cells[0].is_header and not ok.tables[0].cells[2].is_header
    assert [(f.name, f.value, f.confidence, f.value_type) for f in ok.fields] == [
        ("InvoiceTotal", "12.5", 0.95, "number"), ("VendorName", "ACME", 0.0, ""), ("invoicetotal", "99", 0.5, "number")]
    assert ok.paragraphs == ["p1"] and ok.languages == ["en"]
    assert [(m.state, m.page) for m in ok.selection_marks] == [("selected", 1)]
    # error isolation: bad rows keep their place with an empty result
    assert r[2].error and r[2].page_count == 0 and r[2].tables == [] and r[2].model_used == "prebuilt-invoice"
    assert r[3].error and r[3].raw_text == ""


def test_counts_fields_lookup(result, spark):
    c = {x.doc_id: x for x in D.doc_counts(result).collect()}
    assert (c[1].page_count, c[1].table_count, c[1].field_count) == (2, 2, 3)
    one = result.filter("doc_id = 1")
    v = one.select(D.get_field(F.col("fields"), "INVOICETOTAL").alias("v"),
                   D.get_field(F.col("fields"), "nope", F.lit("dflt")).alias("d"),
                   F.size(D.confident_fields(F.col("fields"), 0.95)).alias("n95"),
                   F.size(D.confident_fields(F.col("fields"))).alias("n80")).collect()[0]
    assert v.v == "12.5" and v.d == "dflt" and v.n95 == 1 and v.n80 == 1
    typed = D.typed_fields(D.doc_fields(one), "invoice").collect()[0]
    assert typed.InvoiceTotal == 12.5 and typed.VendorName == "ACME" and typed.InvoiceId is None
    with pytest.raises(ValueError):
        D.typed_fields(D.doc_fields(one), [])


def test_table_markdown_rules(result):
    cells = D.table_cells(result.filter("doc_id = 1"))
    tables = cells.select("doc_id", "table_no", "rows", "columns", "page").distinct()
    md = {r.table_no: r.markdown for r in D.table_markdown(cells, tables).collect()}
    assert md[0] == "| Item | Price |\n| --- | --- |\n| dup |  |"
    # table 1 has no cells: it is absent from the long form, so it has no row here
    doc = D.doc_tables_markdown(D.table_markdown(cells, tables), tables).collect()[0]
    assert doc.tables_markdown == "### Table 1 (Page 2)\n" + md[0]


def test_selection_marks_and_routes(result, spark):
    m = D.selection_marks(result.filter("doc_id = 1")).collect()
    assert [(x.state, x.confidence, x.page) for x in m] == [("selected", 0.9, 1)]
    docs = spark.createDataFrame([(1, "invoice"), (2, "memo")], "doc_id long, doc_type string")
    routes = spark.createDataFrame([("invoice", "invoice")], "doc_type string, spec string")
    got = {r.doc_id: r.spec for r in D.route_documents(docs, routes).collect()}
    assert got == {1: "invoice", 2: "layout"}


def test_page_layout(spark):
    html = ('<html lang="de"><head><title>T &amp; U</title><script>var x="<p>";</script></head>'
            '<body><nav>menu</nav><!-- c --><p>First &lt;b&gt; para</p><p>  </p><div>Second<br>Third</div>'
            '<footer>foot</footer></body></html>')
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    r = D.page_layout(df).collect()[0]
    assert r.title == "T & U" and r.lang == "de"
    assert r.paragraphs == ["First <b> para", "Second", "Third"]
    assert r.text == "First <b> para\n\nSecond\n\nThird"


def test_page_layout_drops_whole_blocks_and_decodes_all_entities(spark):
    pages = [(1, "<head><style>p {}</style><title>T</title></head><body><p>a</p></body>", "T", ["a"]),
             (2, "<nav>menu <script>x()</script> more menu</nav><p>b</p><footer>f <style>s</style> g</footer>", "", ["b"]),
             (3, "<p>it&#8217;s caf&eacute; &#x1F600; &amp;lt; &lt;b&gt; &unknown; &#0; &#xD800; &hellip;&nbsp;&apos;&#38;gt;</p>", "",
              ["it\u2019s caf\u00e9 \U0001F600 &lt; <b> &unknown; &#0; &#xD800; \u2026 '&gt;"]),
             (4, None, None, None), (5, "", "", [])]
    df = spark.createDataFrame([p[:2] for p in pages], "page_id long, html string")
    got = {r.page_id: r for r in D.page_layout(df).collect()}
    for i, _, title, paragraphs in pages:
        assert got[i].title == title and got[i].paragraphs == paragraphs
