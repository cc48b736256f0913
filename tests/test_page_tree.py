"""Page tree: dropped blocks, headings, lists, spans, nested tables, boxes."""

from quarry.operators import extraction as D
from quarry.operators import page_tree as T


def md(html):
    return T.parse_page(html)["markdown"]


def test_dropped_blocks_end_at_their_own_tag():
    assert md("<head><style>a{}</style><title>T</title></head><p>x") == "x"
    assert md("<nav>menu <script>var a='</nav>';</script> more <nav>in</nav> menu</nav><p>x</p>") == "x"
    assert md("a<footer>b<template><p>c</template>d") == "a"
    assert T.parse_page("<html lang='de'><head><title> A &amp; B </title></head>")["title"] == "A & B"
    assert T.parse_page("<html lang='de'>")["lang"] == "de"


def test_headings_lists_and_entities():
    assert md("<h1>A</h1><h3>B <b>b</b></h3><p>x<p>y<br>z") == "# A\n\n### B b\n\nx\n\ny z"
    assert md("<ul><li>a<ul><li>b</ul><li>c</ul><ol><li>d<li>e</ol>f") == "- a\n  - b\n- c\n1. d\n2. e\n\nf"
    assert md("<p>&#8217;&eacute;&amp;lt;&#x41;&nbsp;&unknown;</p>") == "’é&lt;A &unknown;"
    assert md(None) == md("") == md("   ") == ""


def cells(html, i=0):
    return [(c["row_index"], c["column_index"], c["content"], c["kind"], c["row_span"], c["column_span"])
            for c in T.parse_page(html)["tables"][i]["cells"]]


def test_spans_place_the_cells_after_them():
    html = ("<table><tr><th rowspan=2>a</th><th colspan=2>b</th></tr><tr><td>c</td><td>d</td></tr>"
            "<tr><th>e<td rowspan=9>f<td>g</table>")
    assert cells(html) == [(0, 0, "a", "columnHeader", 2, 1), (0, 1, "b", "columnHeader", 1, 2), (1, 1, "c", "content", 1, 1),
                           (1, 2, "d", "content", 1, 1), (2, 0, "e", "rowHeader", 1, 1), (2, 1, "f", "content", 1, 1),
                           (2, 2, "g", "content", 1, 1)]
    assert md(html) == "| a | b |  |\n| --- | --- | --- |\n|  | c | d |\n| e | f | g |"
    assert cells("<table><tr><td colspan=0>a<td rowspan=x colspan=5000>b</table>") == [
        (0, 0, "a", "content", 1, 1), (0, 1, "b", "content", 1, 1000)]


def test_only_the_head_has_column_headers_below_the_first_row():
    html = "<table><thead><tr><th>a<tr><th>b</thead><tr><th>c<td>d</table>"
    assert [c[3] for c in cells(html)] == ["columnHeader", "columnHeader", "rowHeader", "content"]


def test_nested_unclosed_and_empty_tables():
    page = T.parse_page("<table><tr><td>out<table><tr><td>in</table>side</td></tr></table>after<table></table><table><tr><td>z")
    assert [[c["content"] for c in t["cells"]] for t in page["tables"]] == [["in"], ["outside"], ["z"]]
    assert page["paragraphs"] == ["after"]
    assert cells("<table>stray<td>a</table>") == [(0, 0, "a", "content", 1, 1)]


def test_boxes_reach_the_marks_and_rows_keep_their_keys(spark):
    pages = spark.createDataFrame([("a", "<p>Yes <input type=checkbox checked> no <input type='radio'>"), ("b", None), (None, "<p>x")],
                                  "k string, html string")
    tree = T.page_tree(pages, key="k")
    assert {(r.k, r.markdown) for r in tree.collect()} == {("a", "Yes [x] no [ ]"), ("b", ""), (None, "x")}
    big = spark.createDataFrame([(2 ** 62 + 1, "a"), (None, "b")], "page_id long, html string").coalesce(1)
    assert {r.page_id for r in T.page_tree(big).collect()} == {2 ** 62 + 1, None}
    parsed = D.parse_response(T.tree_response(tree, "k"), "prebuilt-layout", keep=("k",))
    assert [(r.k, r.state) for r in D.selection_marks(parsed, keep=("k",)).collect()] == [("a", "selected"), ("a", "unselected")]
    assert T.page_tree(pages.filter("false"), key="k").count() == 0


def test_tables_flow_through_the_parser(spark):
    pages = spark.createDataFrame([(1, "<table><tr><th>a<th>b<tr><td>c</table>")], "page_id int, html string")
    tree = T.page_tree(pages)
    got = D.table_cells(D.parse_response(T.tree_response(tree), "prebuilt-layout", keep=("page_id",)), keep=("page_id",))
    assert [(r.row_index, r.column_index, r.content, r.is_header, r.rows, r.columns) for r in got.orderBy("ordinal").collect()] == [
        (0, 0, "a", True, 2, 2), (0, 1, "b", True, 2, 2), (1, 0, "c", False, 2, 2)]
    spans = T.tree_cells(tree).orderBy("row_index", "column_index").collect()
    assert [(r.content, r.row_span, r.column_span) for r in spans] == [("a", 1, 1), ("b", 1, 1), ("c", 1, 1)]


def test_plain_pages_are_walked_as_the_tolerant_parser_reads_them():
    """A page of plain tags takes the short way, with the same tree."""
    plain = ("<html lang=\"en\"><body><nav>menu</nav><h2>A &amp; b</h2><table><tr><th rowspan=2>x<td class=\"a b\">1<tr>"
             "<td><input type=\"checkbox\" checked></table><ul><li>c &lt;</ul></body></html>")
    assert T._PLAIN_PAGE.fullmatch(plain)
    page = T._Page()
    page.feed(plain)
    assert T.parse_page(plain) == page.finish()
    for other in ("<p>a<!-- b -->", "a < b", "<script>a<b></script>", "<P>a", "<p a='b'>c", "<br/>", "a<", "<title>t</title>"):
        assert not T._PLAIN_PAGE.fullmatch(other)
