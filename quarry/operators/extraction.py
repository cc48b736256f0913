"""Document extraction: page layout from HTML, parsing of extraction
responses into result rows, table cells and Markdown, fields (lookup,
confidence, typed wide rows), routing, marks, languages, counts, and batch
parsing with error isolation.

An extraction response is a nested row (``RESPONSE_SCHEMA``), one per
document; long forms (one row per cell / field) are the scalable shape and
every operator that aggregates works on them.
"""

from __future__ import annotations

from functools import reduce
from html.entities import name2codepoint
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import json_object, posexplode_once
from quarry.plans.sizing import broadcast_if_bounded

RESPONSE_SCHEMA = (
    "content STRING, "
    "pages ARRAY<STRUCT<page_number: INT, selection_marks: ARRAY<STRUCT<state: STRING, confidence: DOUBLE>>>>, "
    "tables ARRAY<STRUCT<row_count: INT, column_count: INT, bounding_regions: ARRAY<STRUCT<page_number: INT>>, "
    "cells: ARRAY<STRUCT<row_index: INT, column_index: INT, content: STRING, kind: STRING>>>>, "
    "documents ARRAY<STRUCT<fields: MAP<STRING, STRUCT<value: STRING, content: STRING, confidence: DOUBLE, type: STRING>>>>, "
    "paragraphs ARRAY<STRUCT<content: STRING>>, "
    "languages ARRAY<STRUCT<locale: STRING>>")

FIELD = "struct<name:string,value:string,confidence:double,value_type:string>"
CONFIDENCE_THRESHOLD = 0.8

# Prebuilt field sets (name -> Spark type for try_cast).
PREBUILT_FIELDS = {
    "invoice": [("VendorName", "string"), ("VendorAddress", "string"), ("CustomerName", "string"),
                ("InvoiceId", "string"), ("InvoiceDate", "date"), ("DueDate", "date"),
                ("InvoiceTotal", "double"), ("SubTotal", "double"), ("TotalTax", "double"),
                ("Items", "string")],
    "receipt": [("MerchantName", "string"), ("TransactionDate", "date"), ("TransactionTime", "string"),
                ("Total", "double"), ("Subtotal", "double"), ("Tax", "double"), ("Items", "string")],
    "id": [("FirstName", "string"), ("LastName", "string"), ("DocumentNumber", "string"),
           ("DateOfBirth", "date"), ("DateOfExpiration", "date"), ("Country", "string")],
    "contract": [("Parties", "string"), ("Dates", "string"), ("PaymentTerms", "string"),
                 ("Jurisdiction", "string"), ("Clauses", "string")],
}

# HTML clean-up rules for page layout (RE2-compatible).
DROP_TAGS = ("script", "style", "nav", "footer", "head")
DROP_BLOCK = r"(?is)<{tag}(\s[^>]*)?>.*?</{tag}\s*>"
COMMENTS = r"(?s)<!--.*?-->"
BLOCK_TAGS = r"(?i)</?(p|div|h[1-6]|li|ul|ol|br|article|section|header|main|table|tr|td|th)(\s[^>]*)?/?>"
ANY_TAG = r"<[^>]*>"
#: Named entities of HTML 4 (from the language's own table) and &apos;.
ENTITIES = {**name2codepoint, "apos": 39, "nbsp": 32}
BLOCK_MARK = "\u0001"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def decode_entities(c: Column) -> Column:
    """Named, decimal and hexadecimal entities, each decoded once: what stands
    for ``&`` comes last, so ``&amp;lt;`` becomes ``&lt;``. Unknown names and
    numbers that are no character stay as they are."""
    known = F.create_map(*[x for n, code in sorted(ENTITIES.items()) for x in (F.lit(n), F.lit(chr(code)))])

    def char(code: Column) -> Column:
        good = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        return F.when(good, F.decode(F.unhex(F.lpad(F.hex(F.when(good, code).otherwise(F.lit(32))), 8, "0")), "UTF-32"))

    def swap(text: Column, pattern: str, value) -> Column:
        def swapped(whole: Column) -> Column:
            found = F.filter(F.array_distinct(F.regexp_extract_all(whole, F.lit(pattern), F.lit(0))), lambda e: ~e.isin(*_AMPERSANDS))
            return F.aggregate(found, whole, lambda t, e: F.replace(t, e, F.coalesce(value(e), e)))
        return _let(text, swapped)

    def decoded(c: Column) -> Column:
        c = swap(c, "&[A-Za-z][A-Za-z0-9]*;", lambda e: F.try_element_at(known, F.substring(e, F.lit(2), F.length(e) - 2)))
        c = swap(c, "&#[0-9]{1,7};", lambda e: char(F.substring(e, F.lit(3), F.length(e) - 3).cast("long")))
        c = swap(c, "&#[xX][0-9A-Fa-f]{1,6};", lambda e: char(F.conv(F.substring(e, F.lit(4), F.length(e) - 4), 16, 10).cast("long")))
        for e in _AMPERSANDS:
            c = F.replace(c, F.lit(e), F.lit("&"))
        return c

    return _let(c, lambda t: F.when(F.contains(t, F.lit("&")), decoded(t)).otherwise(t))


#: Entities that stand for the ampersand.
_AMPERSANDS = ("&#38;", "&#x26;", "&#X26;", "&amp;")


def count_of(array) -> Column:
    """Elements of an array, 0 for NULL (whatever size(NULL) is set to give)."""
    a = F.col(array) if isinstance(array, str) else array
    return F.when(a.isNull(), F.lit(0)).otherwise(F.size(a))


def _clean_text(c: Column) -> Column:
    c = F.regexp_replace(c, ANY_TAG, "")
    c = decode_entities(c)
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def page_layout(pages: DataFrame, html_col: str = "html", key: str = "page_id") -> DataFrame:
    """D1 on HTML pages: title, paragraphs (text between block tags, tags
    stripped, entities decoded, whitespace collapsed, empties dropped), text
    (paragraphs joined by a blank line) and the page language. Row-local."""
    h = F.col(html_col)
    title = _clean_text(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1))
    lang = F.regexp_extract(h, r"(?i)<html[^>]*\slang=\"([^\"]*)\"", 1)
    body = F.regexp_replace(h, COMMENTS, "")
    for tag in DROP_TAGS:   # each to its own closing tag, inner kinds first
        body = F.regexp_replace(body, DROP_BLOCK.format(tag=tag), "")
    chunks = F.split(F.regexp_replace(body, BLOCK_TAGS, BLOCK_MARK), BLOCK_MARK)
    paras = F.filter(F.transform(chunks, _clean_text), lambda p: F.length(p) > 0)
    staged = pages.select(key, title.alias("title"), lang.alias("lang"), paras.alias("paragraphs"))
    return staged.select(key, "title", "lang", "paragraphs",
                         F.array_join("paragraphs", "\n\n").alias("text"))


def layout_response(layout: DataFrame, key: str = "page_id") -> DataFrame:
    """Layout rows as an extraction response (one page, paragraphs, the
    language), so pages flow through the same parser as service output."""
    resp = F.struct(
        F.col("text").alias("content"),
        F.array(F.struct(F.lit(1).alias("page_number"),
                         F.array().cast("array<struct<state:string,confidence:double>>").alias("selection_marks"))
                ).alias("pages"),
        F.array().cast("array<struct<row_count:int,column_count:int,bounding_regions:array<struct<page_number:int>>,"
                       "cells:array<struct<row_index:int,column_index:int,content:string,kind:string>>>>").alias("tables"),
        F.array().cast("array<struct<fields:map<string,struct<value:string,content:string,"
                       "confidence:double,type:string>>>>").alias("documents"),
        F.transform("paragraphs", lambda p: F.struct(p.alias("content"))).alias("paragraphs"),
        F.when(F.col("lang") != "", F.array(F.struct(F.col("lang").alias("locale"))))
        .otherwise(F.array().cast("array<struct<locale:string>>")).alias("languages"))
    return layout.select(key, resp.alias("response"))


def parse_response(df: DataFrame, model_id: str, resp: str = "response", keep=("doc_id",)) -> DataFrame:
    """D2 (+D3, D6, D12-D14 shapes): one nested result row per document.

    raw_text ('' when NULL), page_count (0 when no pages), tables (page of the
    first bounding region or 0, rows, columns, cells with is_header =
    kind == 'columnHeader'), fields over all sub-documents (NULL fields
    skipped; value else content; confidence 0.0 and type '' defaults),
    non-empty paragraphs, selection marks with their page, non-empty locales.
    """
    r = F.col(resp)
    tables = F.transform(F.coalesce(r["tables"], F.array()), lambda t: F.struct(
        F.coalesce(F.get(t["bounding_regions"], 0)["page_number"], F.lit(0)).alias("page"),
        t["row_count"].alias("rows"), t["column_count"].alias("columns"),
        F.transform(F.coalesce(t["cells"], F.array()), lambda c: F.struct(
            c["row_index"].alias("row_index"), c["column_index"].alias("column_index"),
            c["content"].alias("content"),
            (F.coalesce(c["kind"], F.lit("")) == "columnHeader").alias("is_header"))).alias("cells")))
    fields = F.flatten(F.transform(F.coalesce(r["documents"], F.array()), lambda d: F.transform(
        F.filter(F.map_entries(F.coalesce(d["fields"], F.create_map().cast(
            "map<string,struct<value:string,content:string,confidence:double,type:string>>"))),
            lambda e: e["value"].isNotNull()),
        lambda e: F.struct(e["key"].alias("name"),
                           F.coalesce(e["value"]["value"], e["value"]["content"]).alias("value"),
                           F.coalesce(e["value"]["confidence"], F.lit(0.0)).alias("confidence"),
                           F.coalesce(e["value"]["type"], F.lit("")).alias("value_type")))))
    paragraphs = F.filter(F.transform(F.coalesce(r["paragraphs"], F.array()), lambda p: p["content"]),
                          lambda s: s.isNotNull() & (s != ""))
    marks = F.flatten(F.transform(F.coalesce(r["pages"], F.array()), lambda p: F.transform(
        F.coalesce(p["selection_marks"], F.array()), lambda m: F.struct(
            m["state"].alias("state"), m["confidence"].alias("confidence"),
            p["page_number"].alias("page")))))
    langs = F.filter(F.transform(F.coalesce(r["languages"], F.array()), lambda x: x["locale"]),
                     lambda s: s.isNotNull() & (s != ""))
    return df.select(*keep, F.lit(model_id).alias("model_used"),
                     count_of(r["pages"]).alias("page_count"),
                     F.coalesce(r["content"], F.lit("")).alias("raw_text"),
                     tables.alias("tables"), fields.alias("fields"), paragraphs.alias("paragraphs"),
                     marks.alias("selection_marks"), langs.alias("languages"))


def doc_counts(result: DataFrame, keep=("doc_id",)) -> DataFrame:
    """Page, table and field counts (NULL -> 0)."""
    return result.select(*keep, "page_count",
                         count_of("tables").alias("table_count"),
                         count_of("fields").alias("field_count"))


def table_cells(result: DataFrame, keep=("doc_id",)) -> DataFrame:
    """D3: one row per cell: table_no, page, rows, columns, cell ordinal,
    row_index, column_index, content, is_header."""
    t = posexplode_once(result, [*keep], "tables", "table_no", "t")
    return posexplode_once(t, [*keep, "table_no", F.col("t.page").alias("page"), F.col("t.rows").alias("rows"),
                               F.col("t.columns").alias("columns")], "t.cells", "ordinal", "c").select(
        *keep, "table_no", "page", "rows", "columns", "ordinal", "c.row_index", "c.column_index",
        "c.content", "c.is_header")


def up_to(n: Column | str) -> Column:
    """0 .. n - 1, empty for n <= 0 (a bare sequence(0, -1) counts down)."""
    n = F.col(n) if isinstance(n, str) else n
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def table_markdown(cells: DataFrame, tables: DataFrame, keys=("doc_id", "table_no")) -> DataFrame:
    """D4 on long forms. ``tables``: keys + rows, columns; ``cells``: keys +
    ordinal, row_index, column_index, content, or, where the cells of a row come
    together, keys + row_index and an array ``cells`` of those other three.

    Grid rows x columns; a missing cell renders ""; of duplicate cells the
    last (highest ordinal; equal ordinals by content) wins; cells outside the grid are ignored; a
    '---' separator row always follows row 0; pipes are not escaped.
    One shuffle by table and no join: a table's grid and cells are gathered (map-side
    first), sorted into the grid's order, and each run of ``columns`` is a line.
    """
    keys = list(keys)
    known = reduce(and_, (F.col(k).isNotNull() for k in keys))

    def cell(row, column, ordinal, content) -> Column:
        return F.struct(row.cast("int").alias("row"), column.cast("int").alias("column"), ordinal.cast("long").alias("ordinal"),
                        F.coalesce(content, F.lit("")).alias("content"))

    if "cells" in cells.columns:
        of_row = F.transform("cells", lambda x: cell(F.col("row_index"), x["column_index"], x["ordinal"], x["content"]))
        gathered = F.flatten(F.collect_list("part"))
    else:
        of_row = cell(*(F.col(c) for c in ("row_index", "column_index", "ordinal", "content")))
        gathered = F.collect_list("part")
    grid = F.struct(F.col("rows").cast("int").alias("rows"), F.coalesce(F.col("columns").cast("int"), F.lit(0)).alias("columns"))
    both = tables.select(*keys, grid.alias("grid")).unionByName(
        cells.filter(known).select(*keys, of_row.alias("part")), allowMissingColumns=True)
    t = both.groupBy(*keys).agg(F.collect_list("grid").alias("grids"), gathered.alias("cells")).filter(F.size("grids") > 0)

    def last(sorted_cells: Column) -> Column:
        """Of the cells at one place the last."""
        return F.filter(sorted_cells, lambda x, i: F.coalesce(
            (F.get(sorted_cells, i + 1)["row"] != x["row"]) | (F.get(sorted_cells, i + 1)["column"] != x["column"]), F.lit(True)))

    def lines(g: Column) -> Column:
        """(row, line) of a grid."""
        n, wide = g["rows"], F.greatest(g["columns"], F.lit(0))
        inside = F.filter("cells", lambda x: (x["row"] >= 0) & (x["row"] < n) & (x["column"] >= 0) & (x["column"] < wide))
        blank = F.flatten(F.transform(up_to(n), lambda r: F.transform(up_to(wide), lambda c: cell(r, c, F.lit(None), F.lit("")))))

        def filled(found: Column) -> Column:    # blanks come before any cell of their place
            return F.when(F.size(found) == n.cast("long") * wide, found).otherwise(
                _let(F.sort_array(F.concat(blank, found)), last))

        sep = F.concat(F.lit("\n| "), F.array_join(F.array_repeat(F.lit("---"), wide), " | "), F.lit(" |"))
        return _let(_let(_let(F.sort_array(inside), last), filled), lambda full: F.transform(up_to(n), lambda r: F.struct(
            r.alias("row"), F.concat(F.lit("| "), F.array_join(F.transform(
                F.slice(full, r * wide + 1, wide), lambda x: x["content"]), " | "), F.lit(" |"),
                F.when(r == 0, sep).otherwise(F.lit(""))).alias("line"))))

    # One row for each table row; tables that share a key share their lines.
    all_lines = F.sort_array(F.flatten(F.transform("grids", lines)))
    text = F.when(known, F.array_join(F.transform(all_lines, lambda x: x["line"]), "\n")).otherwise(F.lit(""))
    return posexplode_once(t, keys, F.array_repeat(text, F.size("grids")), "i", "markdown").select(*keys, "markdown")


def doc_tables_markdown(md: DataFrame, tables: DataFrame, key: str = "doc_id", docs: DataFrame | None = None) -> DataFrame:
    """D5: '### Table i (Page p)' + newline + markdown per table (i from 1
    in table order), blank line between tables, one row per document; with
    ``docs``, a document without tables gives ''."""
    j = md.join(tables.select(key, "table_no", "page"), [key, "table_no"])
    part = F.concat(F.lit("### Table "), (F.col("table_no") + 1).cast("string"), F.lit(" (Page "),
                    F.col("page").cast("string"), F.lit(")\n"), F.col("markdown"))
    g = j.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("table_no", part.alias("p")))).alias("ps"))
    out = g.select(key, F.array_join(F.transform("ps", lambda x: x["p"]), "\n\n").alias("tables_markdown"))
    if docs is not None:
        out = docs.select(key).join(out, key, "left").select(key, F.coalesce("tables_markdown", F.lit("")).alias("tables_markdown"))
    return out


def doc_fields(result: DataFrame, keep=("doc_id",)) -> DataFrame:
    """One row per extracted field, in order."""
    return posexplode_once(result, [*keep], "fields", "field_no", "f").select(
        *keep, "field_no", "f.name", "f.value", "f.confidence", "f.value_type")


def get_field(fields: Column, name: str, default: Column | None = None) -> Column:
    """First field whose name matches case-insensitively, else default."""
    hit = F.get(F.filter(fields, lambda f: F.lower(f["name"]) == F.lit(name.lower())), 0)
    return F.coalesce(hit["value"], default) if default is not None else hit["value"]


def confident_fields(fields: Column, threshold: float = CONFIDENCE_THRESHOLD) -> Column:
    """Fields with confidence >= threshold (inclusive)."""
    return F.filter(fields, lambda f: f["confidence"] >= F.lit(threshold))


def typed_fields(fields_long: DataFrame, spec: list[tuple[str, str]] | str, key: str = "doc_id") -> DataFrame:
    """Long fields -> one typed wide row per document for a field
    spec (prebuilt name or a custom [(name, type)] list). First value per
    name (by field_no) wins; names match case-insensitively; values are
    try_cast to the spec type (bad values become NULL)."""
    if isinstance(spec, str):
        if spec not in PREBUILT_FIELDS:
            raise ValueError(f"unknown prebuilt model {spec!r}")
        spec = PREBUILT_FIELDS[spec]
    if not spec:
        raise ValueError("No custom field list provided.")
    names = [n for n, _ in spec]
    low = {n.lower(): n for n in names}
    f = fields_long.select(key, "field_no", F.lower("name").alias("lname"), "value") \
        .filter(F.col("lname").isin(list(low)))
    wide = f.groupBy(key).pivot("lname", list(low)).agg(F.min_by("value", "field_no"))
    return wide.select(key, *[F.col(n.lower()).try_cast(t).alias(n) for n, t in spec])


def route_documents(docs: DataFrame, routes: DataFrame, type_col: str = "doc_type") -> DataFrame:
    """Attach the extraction spec of each document's type (size-checked
    broadcast of the routes table); unknown types route to 'layout'."""
    r = broadcast_if_bounded(routes.select(F.col("doc_type").alias(type_col), "spec"))
    return docs.join(r, type_col, "left").withColumn("spec", F.coalesce("spec", F.lit("layout")))


def selection_marks(result: DataFrame, keep=("doc_id",)) -> DataFrame:
    """One row per selection mark (state, confidence, page)."""
    return posexplode_once(result, [*keep], "selection_marks", "n", "m").select(*keep, "m.state", "m.confidence", "m.page")


def analyze_batch(df: DataFrame, json_col: str, model_id: str, keep=("doc_id",)) -> DataFrame:
    """Parse a batch of raw responses; a response that is not a JSON
    object yields an empty result carrying model_used and ``error``; row
    order and count are preserved (no filter, no shuffle)."""
    j = F.col(json_col)
    ok = json_object(j)
    parsed = df.select(*keep, F.when(ok, F.from_json(j, RESPONSE_SCHEMA)).alias("response"),
                       F.when(~ok, F.lit("invalid or empty response")).alias("error"))
    res = parse_response(parsed, model_id, keep=(*keep, "error"))
    return res
