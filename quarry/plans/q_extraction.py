"""Document-extraction queries: HTML pages through layout and the response
parser; orders/lineitem as invoice-like documents (line-item tables and
header fields) through the cell, Markdown and field operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import posexplode_once
from quarry.operators import extraction as D
from quarry.plans.catalog import register
from quarry.plans.sizing import spread
from quarry.sources.tables import table

# ---------------------------------------------------------------- pages

_LAYOUT_SQL = r"""
lay AS (
  SELECT page_id,
         trim(regexp_replace({dec_title}, '\s+', ' ', 'g')) AS title,
         regexp_extract(html, '(?i)<html[^>]*\slang="([^"]*)"', 1) AS lang,
         list_filter(list_transform(
             string_split(regexp_replace({body},
                 '(?i)</?(p|div|h[1-6]|li|ul|ol|br|article|section|header|main|table|tr|td|th)(\s[^>]*)?/?>',
                 chr(1), 'g'), chr(1)),
             lambda s: trim(regexp_replace({dec_s}, '\s+', ' ', 'g'))),
           lambda p: length(p) > 0) AS paragraphs
  FROM pages)
"""


def _body() -> str:
    c = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    for tag in D.DROP_TAGS:
        c = f"regexp_replace({c}, '{D.DROP_BLOCK.format(tag=tag)}', '', 'g')"
    return c


_NAMES = "MAP {" + ", ".join(f"'&{n};': chr({c})" for n, c in sorted(D.ENTITIES.items()) if n != "amp") + "}"
_LAST = "('&#38;', '&#x26;', '&#X26;', '&amp;')"


def _swap(text: str, pattern: str, value: str) -> str:
    return (f"list_reduce(list_prepend({text}, list_filter(list_distinct(regexp_extract_all({text}, '{pattern}')), lambda e: e NOT IN {_LAST})), "
            f"lambda t, e: replace(t, e, coalesce({value}, e)))")


def _char(code: str) -> str:
    return f"CASE WHEN {code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111 THEN chr(CAST({code} AS INTEGER)) END"


def _dec(x: str) -> str:
    c = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    c = _swap(c, "&[A-Za-z][A-Za-z0-9]*;", f"{_NAMES}[e]")
    c = _swap(c, "&#[0-9]{1,7};", _char("TRY_CAST(substr(e, 3, length(e) - 3) AS BIGINT)"))
    c = _swap(c, "&#[xX][0-9A-Fa-f]{1,6};", _char("TRY_CAST('0x' || substr(e, 4, length(e) - 4) AS BIGINT)"))
    for e in ("&#38;", "&#x26;", "&#X26;", "&amp;"):
        c = f"replace({c}, '{e}', '&')"
    return c


LAYOUT_SQL = _LAYOUT_SQL.replace("{body}", _body()).replace(
    "{dec_title}", _dec(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")).replace("{dec_s}", _dec("s"))


def _layout(spark, sf_dir):
    return D.page_layout(spread(table(spark, sf_dir, "pages").select("page_id", "html")))


def _page_results(spark, sf_dir):
    return D.parse_response(D.layout_response(_layout(spark, sf_dir)), "prebuilt-layout", keep=("page_id",))


@register("page_layout", sql=f"""
WITH {LAYOUT_SQL}
SELECT page_id, title, lang, len(paragraphs) AS n_paragraphs,
       md5(array_to_string(paragraphs, chr(10) || chr(10))) AS text_md5 FROM lay
""")
def page_layout(spark, sf_dir):
    lay = _layout(spark, sf_dir)
    return lay.select("page_id", "title", "lang", F.size("paragraphs").cast("long").alias("n_paragraphs"),
                      F.md5("text").alias("text_md5"))


@register("paragraphs", sql=f"""
WITH {LAYOUT_SQL}
SELECT page_id, CAST(generate_subscripts(paragraphs, 1) - 1 AS INTEGER) AS para_no, UNNEST(paragraphs) AS paragraph
FROM lay
""")
def paragraphs(spark, sf_dir):
    r = _page_results(spark, sf_dir)
    return posexplode_once(r, ["page_id"], "paragraphs", "para_no", "paragraph")


@register("languages", sql=f"""
WITH {LAYOUT_SQL}
SELECT page_id, lang AS locale FROM lay WHERE lang <> ''
""")
def languages(spark, sf_dir):
    r = _page_results(spark, sf_dir)
    return posexplode_once(r, ["page_id"], "languages", "n", "locale").select("page_id", "locale")


@register("doc_counts", sql=f"""
WITH {LAYOUT_SQL}
SELECT page_id, 'prebuilt-layout' AS model_used, 1 AS page_count, 0 AS table_count, 0 AS field_count,
       md5(array_to_string(paragraphs, chr(10) || chr(10))) AS raw_text_md5 FROM lay
""")
def doc_counts(spark, sf_dir):
    """D2 + D15: parsed layout results with their counts."""
    r = _page_results(spark, sf_dir)
    c = D.doc_counts(r, keep=("page_id", "model_used", "raw_text"))
    return c.select("page_id", "model_used", "page_count", "table_count", "field_count",
                    F.md5("raw_text").alias("raw_text_md5"))


@register("analyze_batch")
def analyze_batch(spark, sf_dir):
    """D16 (rows-only): layout responses serialised to JSON and parsed back
    as a batch with per-row error isolation."""
    resp = D.layout_response(_layout(spark, sf_dir)).select("page_id", F.to_json("response").alias("raw"))
    out = D.analyze_batch(resp, "raw", "prebuilt-layout", keep=("page_id",))
    return D.doc_counts(out, keep=("page_id", "model_used", "error"))


# ------------------------------------------------------------- invoices

HEADER = ["Line", "Part", "Quantity", "Amount"]


def invoice_tables(spark, sf_dir) -> DataFrame:
    """One line-item table per order: rows = max line number + 1 (header
    row 0), 4 columns, on page 1."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(
        (F.max("l_linenumber") + 1).cast("int").alias("rows")).select(
        "doc_id", F.lit(0).alias("table_no"), F.lit(1).alias("page"), "rows", F.lit(4).alias("columns"))


def _line_values(c) -> list:
    """The four cell texts of a line item, its columns given by ``c(name)``."""
    return [c("l_linenumber").cast("string"), c("l_partkey").cast("string"),
            c("l_quantity").cast("int").cast("string"), F.format_string("%.2f", c("l_extendedprice"))]


def invoice_rows(spark, sf_dir) -> DataFrame:
    """Table rows straight from line items (no per-order gathering), each with its
    cells: a header row per order and a row per line item; ordinal = row * 4 + column."""
    li = table(spark, sf_dir, "lineitem")

    def cells(row, contents):
        return F.array(*[F.struct(F.lit(j).alias("column_index"), (row * 4 + j).alias("ordinal"), v.alias("content"))
                         for j, v in enumerate(contents)]).alias("cells")

    row = F.col("l_linenumber").cast("int")
    body = li.select(F.col("l_orderkey").alias("doc_id"), row.alias("row_index"), cells(row, _line_values(F.col)))
    heads = invoice_tables(spark, sf_dir).select("doc_id", F.lit(0).alias("row_index"), cells(F.lit(0), [F.lit(h) for h in HEADER]))
    return body.unionByName(heads).select("doc_id", F.lit(0).alias("table_no"), "row_index", "cells")


_CELLS_SQL = """
tabs AS (SELECT l_orderkey AS doc_id, 0 AS table_no, 1 AS page, CAST(max(l_linenumber) + 1 AS INTEGER) AS rows,
                4 AS columns FROM lineitem GROUP BY l_orderkey),
cells AS (
  SELECT l_orderkey AS doc_id, 0 AS table_no, CAST(l_linenumber AS INTEGER) AS row_index,
         CAST(c AS INTEGER) AS column_index,
         CASE c WHEN 0 THEN CAST(l_linenumber AS VARCHAR) WHEN 1 THEN CAST(l_partkey AS VARCHAR)
                WHEN 2 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) ELSE printf('%.2f', l_extendedprice) END
           AS content
  FROM lineitem CROSS JOIN range(4) t(c)
  UNION ALL
  SELECT doc_id, 0, 0, CAST(c AS INTEGER), CASE c WHEN 0 THEN 'Line' WHEN 1 THEN 'Part' WHEN 2 THEN 'Quantity' ELSE 'Amount' END
  FROM tabs CROSS JOIN range(4) t(c)),
grid AS (SELECT doc_id, table_no, CAST(r AS INTEGER) AS row_index, columns FROM tabs CROSS JOIN LATERAL range(rows) t(r)),
gc AS (SELECT g.doc_id, g.table_no, g.row_index, CAST(cc AS INTEGER) AS column_index
       FROM grid g CROSS JOIN LATERAL range(g.columns) t(cc)),
rowl AS (
  SELECT gc.doc_id, gc.table_no, gc.row_index,
         '| ' || string_agg(coalesce(c.content, ''), ' | ' ORDER BY gc.column_index) || ' |' AS line0
  FROM gc LEFT JOIN (SELECT doc_id, row_index, column_index, max(content) AS content FROM cells
                     GROUP BY ALL) c ON c.doc_id = gc.doc_id AND c.row_index = gc.row_index
                          AND c.column_index = gc.column_index
  GROUP BY gc.doc_id, gc.table_no, gc.row_index),
md AS (
  SELECT doc_id, table_no,
         string_agg(CASE WHEN row_index = 0 THEN line0 || chr(10) || '| --- | --- | --- | --- |' ELSE line0 END,
                    chr(10) ORDER BY row_index) AS markdown
  FROM rowl GROUP BY doc_id, table_no)
"""


def invoice_responses(spark, sf_dir) -> DataFrame:
    """One nested extraction response per order: a line-item table (none for
    an order without lines), six fields, and order key modulo 3 selection
    marks. An order's cells and fields are bounded by its few lines. Lines and
    orders are shuffled as they stand, once each: cells and fields are made from
    them where the order's rows are together."""
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_orderkey").isNotNull()).groupBy(F.col("l_orderkey").alias("doc_id")).agg(
        F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")).alias("ls"),
        (F.max("l_linenumber") + 1).cast("int").alias("rows"))

    def cell(row, j, content, kind):
        return F.struct((row * 4 + j).alias("ordinal"), row.alias("row_index"), F.lit(j).alias("column_index"),
                        content.alias("content"), F.lit(kind).alias("kind"))

    heads = F.array(*[cell(F.lit(0), j, F.lit(h), "columnHeader") for j, h in enumerate(HEADER)])
    body = F.transform("ls", lambda x: F.array(*[
        F.struct(c["ordinal"], c["row_index"], c["column_index"], c["content"],
                 F.when(c["row_index"] == 0, F.lit("columnHeader")).otherwise(F.lit("content")).alias("kind"))
        for c in (cell(x["l_linenumber"].cast("int"), j, v, "content") for j, v in enumerate(_line_values(lambda n: x[n])))]))
    cells = li.select("doc_id", "rows", F.array_sort(F.concat(heads, F.flatten(body))).alias("cells"))
    tabs = cells.select("doc_id", F.array(F.struct(
        F.col("rows").alias("row_count"), F.lit(4).alias("column_count"),
        F.array(F.struct(F.lit(1).alias("page_number"))).alias("bounding_regions"),
        F.transform("cells", lambda c: F.struct(c["row_index"].alias("row_index"), c["column_index"].alias("column_index"),
                                                c["content"].alias("content"), c["kind"].alias("kind"))).alias("cells"))).alias("tables"))
    o = posexplode_once(_orders_by_key(spark, sf_dir), ["doc_id", "fs"], "os", "i", "o").select(
        "doc_id", "o.o_orderstatus", F.when(F.col("doc_id").isNotNull(), F.col("fs")).alias("fs"))
    doc = F.struct(F.map_from_entries(F.transform("fs", lambda x: F.struct(x["name"], F.struct(
        x["value"].alias("value"), x["value"].alias("content"), x["confidence"].alias("confidence"),
        x["value_type"].alias("type"))))).alias("fields"))
    n = (F.col("doc_id") % 3).cast("int")
    marks = F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(
        F.when((F.col("o_orderstatus") == "F") & (i == 1), F.lit("selected")).otherwise(F.lit("unselected")).alias("state"),
        F.round(F.lit(0.5) + i / 10, 2).cast("double").alias("confidence")))
    j = o.join(tabs, "doc_id", "left")
    return j.select("doc_id", F.struct(
        F.concat(F.lit("Order "), F.col("doc_id").cast("string")).alias("content"),
        F.array(F.struct(F.lit(1).alias("page_number"), marks.alias("selection_marks"))).alias("pages"), "tables",
        F.array(doc).alias("documents"),
        F.array(F.struct(F.lit("Order").alias("content"))).alias("paragraphs"),
        F.array(F.struct(F.lit("en").alias("locale"))).alias("languages")).alias("response"))


def _invoice_results(spark, sf_dir) -> DataFrame:
    return D.parse_response(invoice_responses(spark, sf_dir), "prebuilt-invoice")


@register("table_cells", sql=f"""
WITH {_CELLS_SQL}
SELECT c.doc_id, c.table_no, t.page, c.row_index, c.column_index, c.content, c.row_index = 0 AS is_header
FROM cells c JOIN tabs t USING (doc_id, table_no) JOIN orders o ON o.o_orderkey = c.doc_id
""")
def table_cells(spark, sf_dir):
    return D.table_cells(_invoice_results(spark, sf_dir)).select(
        "doc_id", "table_no", "page", "row_index", "column_index", "content", "is_header")


@register("doc_result", sql="""
WITH l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS doc_id, 'prebuilt-invoice' AS model_used, 'Order ' || CAST(o_orderkey AS VARCHAR) AS raw_text,
       1 AS page_count, CAST(l.n IS NOT NULL AS INTEGER) AS table_count, 6 AS field_count,
       CAST(o_orderkey % 3 AS INTEGER) AS mark_count, coalesce(4 * (l.n + 1), 0) AS cell_count
FROM orders LEFT JOIN l ON l.l_orderkey = o_orderkey
""")
def doc_result(spark, sf_dir):
    r = _invoice_results(spark, sf_dir)
    counts = D.doc_counts(r, keep=("doc_id", "model_used", "raw_text", "selection_marks", "tables"))
    return counts.select("doc_id", "model_used", "raw_text", "page_count", "table_count", "field_count",
                         D.count_of("selection_marks").alias("mark_count"),
                         F.aggregate("tables", F.lit(0).cast("long"), lambda n, t: n + F.size(t["cells"])).alias("cell_count"))


@register("selection_marks", sql="""
SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus = 'F' AND i = 1 THEN 'selected' ELSE 'unselected' END AS state,
       round(0.5 + i / 10.0, 2)::DOUBLE AS confidence, 1 AS page
FROM orders CROSS JOIN LATERAL range(1, o_orderkey % 3 + 1) t(i)
""")
def selection_marks(spark, sf_dir):
    return D.selection_marks(_invoice_results(spark, sf_dir))


def _markdown(spark, sf_dir):
    return D.table_markdown(invoice_rows(spark, sf_dir), invoice_tables(spark, sf_dir))


@register("table_markdown", sql=f"""
WITH {_CELLS_SQL}
SELECT doc_id, table_no, md5(markdown) AS markdown_md5, length(markdown) AS markdown_chars FROM md
""")
def table_markdown(spark, sf_dir):
    md = _markdown(spark, sf_dir)
    return md.select("doc_id", "table_no", F.md5("markdown").alias("markdown_md5"),
                     F.length("markdown").cast("long").alias("markdown_chars"))


@register("doc_tables_markdown", sql=f"""
WITH {_CELLS_SQL}
SELECT doc_id, md5(string_agg('### Table ' || CAST(md.table_no + 1 AS VARCHAR) || ' (Page '
                              || CAST(t.page AS VARCHAR) || ')' || chr(10) || markdown,
                              chr(10) || chr(10) ORDER BY md.table_no)) AS tables_markdown_md5
FROM md JOIN tabs t USING (doc_id, table_no) GROUP BY doc_id
UNION ALL
SELECT o_orderkey, md5('') FROM orders WHERE o_orderkey NOT IN (SELECT doc_id FROM tabs)
""")
def doc_tables_markdown(spark, sf_dir):
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    out = D.doc_tables_markdown(_markdown(spark, sf_dir), invoice_tables(spark, sf_dir), docs=docs)
    return out.select("doc_id", F.md5("tables_markdown").alias("tables_markdown_md5"))


# Header fields of the invoice-like orders (name, type).
INVOICE_FIELDS = [("InvoiceId", "string"), ("CustomerId", "string"), ("InvoiceDate", "date"),
                  ("InvoiceTotal", "number"), ("OrderStatus", "string"), ("Priority", "string")]


def invoice_fields(spark, sf_dir) -> DataFrame:
    """Fields of each order as extraction output, one row per field, with a
    deterministic confidence in [0.50, 0.99]."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("doc_id"), F.inline(_order_fields(F.col("o_orderkey"), F.col)))


_ORDER_COLUMNS = ("o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus", "o_orderpriority")


def _order_fields(key, c):
    """The fields of an order as an array, its columns given by ``c(name)``."""
    vals = [key.cast("string"), c("o_custkey").cast("string"), F.date_format(c("o_orderdate"), "yyyy-MM-dd"),
            F.format_string("%.2f", c("o_totalprice")), c("o_orderstatus"), c("o_orderpriority")]
    conf = [F.lit(0.5) + F.pmod(key * 7 + F.lit(i) * 13, F.lit(50)) / 100.0 for i in range(len(vals))]
    return F.array(*[F.struct(F.lit(i).alias("field_no"), F.lit(n).alias("name"), v.alias("value"),
                              F.round(conf[i], 2).alias("confidence"), F.lit(t).alias("value_type"))
                     for i, ((n, t), v) in enumerate(zip(INVOICE_FIELDS, vals))])


def _orders_by_key(spark, sf_dir) -> DataFrame:
    """(doc_id, os, fs): the orders of a key as they stand, and all their fields in
    order. Fields are made after the shuffle, which an order passes once."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("doc_id")).agg(
        F.collect_list(F.struct(*_ORDER_COLUMNS)).alias("os"))
    fs = F.flatten(F.transform("os", lambda x: _order_fields(F.col("doc_id"), lambda n: x[n])))
    return o.select("doc_id", "os", F.array_sort(fs).alias("fs"))


_FIELDS_SQL = f"""
f AS (
  SELECT o_orderkey AS doc_id, n AS field_no,
         CASE n WHEN 0 THEN 'InvoiceId' WHEN 1 THEN 'CustomerId' WHEN 2 THEN 'InvoiceDate'
                WHEN 3 THEN 'InvoiceTotal' WHEN 4 THEN 'OrderStatus' ELSE 'Priority' END AS name,
         CASE n WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN CAST(o_custkey AS VARCHAR)
                WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN printf('%.2f', o_totalprice)
                WHEN 4 THEN o_orderstatus ELSE o_orderpriority END AS value,
         round(0.5 + ((o_orderkey * 7 + n * 13) % 50) / 100.0, 2) AS confidence,
         CASE n WHEN 2 THEN 'date' WHEN 3 THEN 'number' ELSE 'string' END AS value_type
  FROM orders CROSS JOIN range(6) t(n))
"""


@register("doc_fields", sql=f"""
WITH {_FIELDS_SQL}
SELECT doc_id, CAST(field_no AS INTEGER) AS field_no, name, value, confidence, value_type FROM f
""")
def doc_fields(spark, sf_dir):
    return D.doc_fields(_invoice_results(spark, sf_dir))


@register("get_field", sql=f"""
WITH {_FIELDS_SQL}
SELECT o_orderkey AS doc_id, coalesce(v.value, 'n/a') AS invoice_total
FROM orders LEFT JOIN (SELECT doc_id, arg_min(value, field_no) AS value FROM f
                       WHERE lower(name) = 'invoicetotal' GROUP BY doc_id) v ON v.doc_id = o_orderkey
""")
def get_field(spark, sf_dir):
    """D7 per order: the first field named 'invoicetotal' (any case), else
    'n/a'. The order's fields are one bounded array per document."""
    arr = _orders_by_key(spark, sf_dir).select("doc_id", F.col("fs").alias("fields"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    j = o.join(arr, "doc_id", "left")
    return j.select("doc_id", D.get_field(F.coalesce("fields", F.array()), "invoicetotal",
                                          F.lit("n/a")).alias("invoice_total"))


@register("confident_fields", sql=f"""
WITH {_FIELDS_SQL}
SELECT doc_id, name, value, confidence FROM f WHERE confidence >= 0.8
""")
def confident_fields(spark, sf_dir):
    r = _invoice_results(spark, sf_dir)
    return r.select("doc_id", F.explode(D.confident_fields(F.col("fields"))).alias("f")).select(
        "doc_id", "f.name", "f.value", "f.confidence")


@register("typed_fields", sql=f"""
WITH {_FIELDS_SQL},
p AS (SELECT doc_id, lower(name) AS lname, arg_min(value, field_no) AS value FROM f GROUP BY doc_id, lower(name))
SELECT doc_id,
       {', '.join(
           f"TRY_CAST(max(value) FILTER (WHERE lname = '{n.lower()}') AS "
           f"{ {'string': 'VARCHAR', 'date': 'DATE', 'double': 'DOUBLE'}[t] }) AS {n}"
           for n, t in D.PREBUILT_FIELDS['invoice'])}
FROM p GROUP BY doc_id
""")
def typed_fields(spark, sf_dir):
    return D.typed_fields(D.doc_fields(_invoice_results(spark, sf_dir)), "invoice")


# Order status -> document type; document type -> spec.
STATUS_TYPE = {"F": "invoice", "O": "receipt", "P": "contract"}
ROUTES = [("invoice", "invoice"), ("receipt", "receipt"), ("contract", "contract")]


@register("route_documents", sql="""
SELECT o_orderkey AS doc_id,
       CASE o_orderstatus WHEN 'F' THEN 'invoice' WHEN 'O' THEN 'receipt' WHEN 'P' THEN 'contract'
            ELSE 'other' END AS doc_type,
       CASE o_orderstatus WHEN 'F' THEN 'invoice' WHEN 'O' THEN 'receipt' WHEN 'P' THEN 'contract'
            ELSE 'layout' END AS spec
FROM orders
""")
def route_documents(spark, sf_dir):
    m = F.create_map(*[x for k, v in STATUS_TYPE.items() for x in (F.lit(k), F.lit(v))])
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        F.coalesce(F.try_element_at(m, F.col("o_orderstatus")), F.lit("other")).alias("doc_type"))
    routes = spark.createDataFrame(ROUTES, "doc_type string, spec string")
    return D.route_documents(o, routes)


@register("doc_to_index_rows", sql=f"""
WITH {_CELLS_SQL}, {_FIELDS_SQL}, {LAYOUT_SQL},
fl AS (SELECT doc_id, string_agg(name || ': ' || value, chr(10) ORDER BY field_no) AS content FROM f GROUP BY doc_id)
SELECT CAST(doc_id AS VARCHAR) || '#table#' || CAST(table_no AS VARCHAR) AS id, 'table' AS category,
       'invoice' AS source, md5(markdown) AS content_md5 FROM md
UNION ALL
SELECT CAST(doc_id AS VARCHAR) || '#fields#0', 'fields', 'invoice', md5(content) FROM fl
UNION ALL
SELECT CAST(page_id AS VARCHAR) || '#para#' || CAST(generate_subscripts(paragraphs, 1) - 1 AS VARCHAR), 'para',
       'page', md5(UNNEST(paragraphs)) FROM lay
""")
def doc_to_index_rows(spark, sf_dir):
    """Extracted tables (Markdown), fields ('name: value' lines) and
    paragraphs routed into search-table rows with deterministic ids."""
    from quarry.sources import search_table as ST
    md = _markdown(spark, sf_dir)
    t = md.select(*ST.index_rows("table", F.col("doc_id"), F.col("table_no"), F.col("markdown"), F.lit("invoice")))
    lines = _orders_by_key(spark, sf_dir).select("doc_id", F.array_sort(F.transform("fs", lambda x: F.struct(
        x["field_no"].alias("field_no"), F.concat(x["name"], F.lit(": "), x["value"]).alias("line")))).alias("ls"))
    fl = lines.select(*ST.index_rows("fields", F.col("doc_id"), F.lit(0),
                                     F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), F.lit("invoice")))
    p = posexplode_once(_page_results(spark, sf_dir), ["page_id"], "paragraphs", "n", "p")
    pr = p.select(*ST.index_rows("para", F.col("page_id"), F.col("n"), F.col("p"), F.lit("page")))
    rows = t.unionByName(fl).unionByName(pr)
    return rows.select("id", "category", "source", F.md5("content").alias("content_md5"))
