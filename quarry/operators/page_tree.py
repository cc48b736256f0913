"""D1 on HTML as a tree: headings, lists, tables with row and column spans and
check boxes of a page, as Markdown and as an extraction response that the
parser (D2, D3, D13) reads. Pages are parsed row by row in Arrow batches; a
page never leaves its row.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.extraction import DROP_TAGS, RESPONSE_SCHEMA

# Tags that end a block of text, tags without content, and the
# language's own bounds on spans.
BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol article section header main aside blockquote pre form fieldset "
                   "dl dt dd figure figcaption hr body html address details summary caption".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534
#: Pages parsed before their trees leave as one Arrow batch.
TREE_ROWS = 1_000

CELL = "struct<row_index:int,column_index:int,content:string,kind:string,row_span:int,column_span:int>"
TREE_FIELDS = (f"title string, lang string, markdown string, paragraphs array<string>, "
               f"tables array<struct<row_count:int,column_count:int,cells:array<{CELL}>>>, "
               f"marks array<struct<state:string,confidence:double>>")

# Tags and text as most pages write them: lower-case tags, each closed, of
# elements whose content is markup, with plain attributes. A page made of
# nothing else is walked from tag to tag; any other takes the tolerant parser.
_RAW = "(?!(?:script|style|title|textarea|xmp|iframe|noembed|noframes|noscript|plaintext)\\b)"
_GIVEN = r'\s+[a-z][a-z-]*+(?:="[^"&<>]*+"|=[a-z0-9]++)?'
_PLAIN_PAGE = re.compile(rf"[^<]*+(?:<(?:{_RAW}[a-z][a-z0-9]*+(?:{_GIVEN})*+|/[a-z][a-z0-9]*+)>[^<]*+)*+")
_TOKEN = re.compile(r"([^<]+)|<([a-z][a-z0-9]*)([^>]*)>|</([^>]+)>")     # of plain pages
_ATTRIBUTE = re.compile(r'\s+([a-z][a-z-]*)(?:="([^"]*)"|=([a-z0-9]+))?')

_SPACE = re.compile(r"[ \t\n\x0b\f\r\xa0]+")


def _squeeze(parts: list[str]) -> str:
    return _SPACE.sub(" ", "".join(parts)).strip(" ")


class _Grid:
    """An open table: the cells so far, and the columns that cells of earlier
    rows still cover."""

    def __init__(self):
        self.rows, self.cells, self.covered = -1, [], {}
        self.column, self.cell, self.in_head = 0, None, False

    def row(self):
        self.rows += 1
        self.covered = {c: n - 1 for c, n in self.covered.items() if n > 1}
        self.column = 0

    def open(self, heading: bool, row_span: int, column_span: int):
        if self.rows < 0:
            self.row()
        while self.column in self.covered:
            self.column += 1
        kind = "content" if not heading else "columnHeader" if self.in_head or self.rows == 0 else "rowHeader"
        self.cell = [self.rows, self.column, "", kind, row_span, column_span]
        self.cells.append(self.cell)
        for c in range(self.column, self.column + column_span):
            self.covered[c] = max(self.covered.get(c, 0), row_span)
        self.column += column_span

    def done(self) -> dict:
        """Row spans end with the table; a table without cells has no rows."""
        n = self.rows + 1 if self.cells else 0
        cells = [{"row_index": r, "column_index": c, "content": text, "kind": kind, "row_span": min(rs, n - r), "column_span": cs}
                 for r, c, text, kind, rs, cs in self.cells]
        return {"row_count": n, "column_count": max((c["column_index"] + c["column_span"] for c in cells), default=0), "cells": cells}


def _pipes(table: dict) -> str:
    """A table's Markdown: spanned places are empty, pipes are not escaped."""
    at = {(c["row_index"], c["column_index"]): c["content"] for c in table["cells"]}
    width = range(table["column_count"])
    lines = ["| " + " | ".join(at.get((r, c), "") for c in width) + " |" for r in range(table["row_count"])]
    return "\n".join([lines[0], "| " + " | ".join("---" for _ in width) + " |", *lines[1:]]) if lines else ""


class _Page(HTMLParser):
    """Walks a page's tags. Blocks that are dropped end at their own closing tag
    (or the page's end), whatever stands inside."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title = self.lang = None
        self.blocks, self.tables, self.marks = [], [], []   # blocks: (kind, text)
        self.text, self.heading, self.lists, self.item = [], 0, [], None
        self.grids, self.dropped, self.depth, self.title_text = [], None, 0, None

    def walk(self, html: str):
        """``feed`` for a page that ``_PLAIN_PAGE`` matches."""
        for data, opened, attributes, closed in _TOKEN.findall(html):
            if data:
                self.handle_data(unescape(data) if "&" in data else data)
            elif opened:
                self.handle_starttag(opened, _attributes(attributes) if attributes else ())
            else:
                self.handle_endtag(closed)

    # -- text blocks
    def flush(self):
        words = _squeeze(self.text)
        self.text = []
        if words:
            if self.item is not None:
                level, mark = self.item
                # the first block of an item carries its mark, later ones stand under it
                self.blocks.append(("item", "  " * level + mark + words if mark else "  " * (level + 1) + words, words))
                self.item = (level, "")
            elif self.heading:
                self.blocks.append(("heading", "#" * self.heading + " " + words, words))
            else:
                self.blocks.append(("text", words, words))

    def end_cell(self):
        grid = self.grids[-1]
        if grid.cell is not None:
            grid.cell[2] = _squeeze(self.text)
            grid.cell = None
        self.text = []

    # -- parser events
    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag == "html" and self.lang is None:
            self.lang = given.get("lang") or ""
        if tag == "title" and self.title is None:
            self.title_text = []
        if self.dropped == "head" and tag == "body":
            self.dropped = None
        if self.dropped:
            self.depth += tag == self.dropped
            return
        if tag in DROP_TAGS or tag == "template":
            self.dropped, self.depth = tag, 1
        elif tag == "table":
            if not self.grids:
                self.flush()
            self.grids.append(_Grid())
            self.grids[-1].outer, self.text = self.text, []
        elif tag == "input" and (given.get("type") or "").lower() in ("checkbox", "radio"):
            on = "checked" in given
            self.marks.append({"state": "selected" if on else "unselected", "confidence": 1.0})
            self.text.append(" [x] " if on else " [ ] ")
        elif self.grids:
            self.in_table(tag, given)
        elif tag == "br":
            self.text.append("\n")
        elif tag in BLOCKS:
            self.flush()
            if tag in ("ul", "ol"):
                self.lists.append([tag, 0])
                self.item = None
            elif tag == "li":
                level = max(0, len(self.lists) - 1)
                if self.lists:
                    self.lists[-1][1] += 1
                ordered = bool(self.lists) and self.lists[-1][0] == "ol"
                self.item = (level, f"{self.lists[-1][1]}. " if ordered else "- ")
            self.heading = int(tag[1]) if len(tag) == 2 and tag[1].isdigit() else 0

    def in_table(self, tag, given):
        grid = self.grids[-1]
        if tag in ("thead", "tbody", "tfoot"):
            self.end_cell()
            grid.in_head = tag == "thead"
        elif tag == "tr":
            self.end_cell()
            grid.row()
        elif tag in ("td", "th"):
            self.end_cell()
            grid.open(tag == "th", _span(given.get("rowspan"), MAX_ROWSPAN), _span(given.get("colspan"), MAX_COLSPAN))
        elif tag == "br" or tag in BLOCKS:
            self.text.append(" ")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag == self.dropped:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "title" and self.title_text is not None:
            self.title, self.title_text = _squeeze(self.title_text), None
        if self.dropped:
            if tag == self.dropped:
                self.depth -= 1
                if self.depth <= 0:
                    self.dropped = None
            return
        if self.grids:
            if tag == "table":
                self.end_table()
            elif tag in ("td", "th", "tr"):
                self.end_cell()
            elif tag == "thead":
                self.end_cell()
                self.grids[-1].in_head = False
            elif tag in BLOCKS:
                self.text.append(" ")
        elif tag in BLOCKS:
            self.flush()
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
                self.item = (len(self.lists) - 1, "") if self.lists else None
            elif tag == "li":
                self.item = None
            self.heading = 0

    def end_table(self):
        self.end_cell()
        grid = self.grids.pop()
        table = grid.done()
        if table["cells"]:
            self.tables.append(table)
            self.blocks.append(("table", _pipes(table), None))
        self.text = grid.outer

    def handle_data(self, data):
        if self.title_text is not None:
            self.title_text.append(data)
        if not self.dropped and (not self.grids or self.grids[-1].cell is not None):
            self.text.append(data)

    def finish(self) -> dict:
        self.close()
        while self.grids:
            self.end_table()
        self.flush()
        out = []
        for i, (kind, text, _) in enumerate(self.blocks):
            if i:
                out.append("\n" if kind == "item" == self.blocks[i - 1][0] else "\n\n")
            out.append(text)
        return {"title": self.title or "", "lang": self.lang or "", "markdown": "".join(out),
                "paragraphs": [words for _, _, words in self.blocks if words], "tables": self.tables, "marks": self.marks}


@lru_cache(4096)
def _attributes(text: str) -> tuple:
    return tuple((m[1], m[3] if m[2] is None else m[2]) for m in _ATTRIBUTE.finditer(text))


def _span(given: str | None, most: int) -> int:
    """A span attribute: 1 for none, bad ones and zero."""
    if given is None:
        return 1
    digits = re.match(r"\s*(\d{1,9})", given or "")
    return min(most, max(1, int(digits[1]))) if digits else 1


def parse_page(html: str | None) -> dict:
    page = _Page()
    if _PLAIN_PAGE.fullmatch(html or ""):
        page.walk(html or "")
    else:
        page.feed(html)
    return page.finish()


def page_tree(pages: DataFrame, html_col: str = "html", key: str = "page_id") -> DataFrame:
    """One row a page: title, lang, markdown, paragraphs (text blocks in order),
    tables (each cell with its place, kind and spans) and marks (check boxes and
    radio buttons). A NULL or empty page gives '' and empty lists.

    Markdown: ``#`` headings, ``-`` or numbered items indented two spaces a
    level, pipe tables, [x] and [ ] for boxes, blocks parted by a blank line
    (items of one list by a line end). Scripts, styles, navigation, footers,
    heads and templates are dropped whole, to their own closing tag. A cell's
    place takes account of the spans before it, as browsers lay tables out; a
    row span ends with the table. A nested table is a table of its own, and its
    text is not in the outer cell. Unclosed tables and cells end with the page."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(TREE_FIELDS))

    def parse(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TREE_ROWS):
                part = batch.slice(at, TREE_ROWS)
                found = [parse_page(h.as_py()) for h in part.column("__html")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("__key"), *[pa.array([p[f.name] for p in found], f.type) for f in fields]],
                    names=["__key", *fields.names])

    # keys go as text, whatever their type
    tree = pages.select(F.col(key).cast("string").alias("__key"), F.col(html_col).alias("__html")) \
        .mapInArrow(parse, f"__key string, {TREE_FIELDS}")
    return tree.select(F.col("__key").cast(pages.schema[key].dataType).alias(key), *[c for c in tree.columns if c != "__key"])


def tree_cells(tree: DataFrame, key: str = "page_id") -> DataFrame:
    """D3 with spans: one row a cell."""
    t = tree.select(key, F.posexplode("tables").alias("table_no", "t"))
    return t.select(key, "table_no", F.col("t.row_count").alias("rows"), F.col("t.column_count").alias("columns"),
                    F.inline("t.cells"))


def tree_response(tree: DataFrame, key: str = "page_id") -> DataFrame:
    """The tree as an extraction response of one page, for ``parse_response``."""
    kinds = dict(zip(("pages", "tables", "documents", "paragraphs", "languages"), _types()))
    return tree.select(key, F.struct(
        F.col("markdown").alias("content"),
        F.array(F.struct(F.lit(1).alias("page_number"), F.col("marks").alias("selection_marks"))).cast(kinds["pages"]).alias("pages"),
        F.transform("tables", lambda t: F.struct(
            t["row_count"].alias("row_count"), t["column_count"].alias("column_count"),
            F.array(F.struct(F.lit(1).alias("page_number"))).alias("bounding_regions"),
            F.transform(t["cells"], lambda c: F.struct(*[c[n].alias(n) for n in ("row_index", "column_index", "content", "kind")]))
            .alias("cells"))).cast(kinds["tables"]).alias("tables"),
        F.array().cast(kinds["documents"]).alias("documents"),
        F.transform("paragraphs", lambda p: F.struct(p.alias("content"))).cast(kinds["paragraphs"]).alias("paragraphs"),
        F.filter(F.array(F.struct(F.col("lang").alias("locale"))), lambda x: x["locale"] != "").cast(kinds["languages"])
        .alias("languages")).alias("response"))


def _types():
    from pyspark.sql.types import StructType
    schema = StructType.fromDDL(RESPONSE_SCHEMA)
    return [schema[n].dataType for n in ("pages", "tables", "documents", "paragraphs", "languages")]
