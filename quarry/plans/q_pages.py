"""Queries of the page tree: pages as Markdown, and tables of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import extraction as D
from quarry.operators import page_tree as T
from quarry.plans import q_extraction as QX
from quarry.plans.catalog import register
from quarry.sources.tables import table

_TAGS = r"(?i)</?(p|div|h[1-6]|li|ul|ol|br|article|section|header|main|body|html)(\s[^>]*)?/?>"


@register("page_markdown", sql=f"""
WITH b AS (SELECT page_id, regexp_replace({QX._body()}, '(?i)<h1(\\s[^>]*)?>', chr(1) || '# ', 'g') AS body FROM pages),
p AS (SELECT page_id, list_filter(list_transform(
        string_split(regexp_replace(body, '{_TAGS}', chr(1), 'g'), chr(1)),
        lambda s: trim(regexp_replace({QX._dec('s')}, '\\s+', ' ', 'g'))), lambda x: length(x) > 0 AND x <> '#') AS blocks FROM b)
SELECT page_id, len(blocks) AS n_paragraphs, md5(array_to_string(blocks, chr(10) || chr(10))) AS markdown_md5 FROM p
""")
def page_markdown(spark, sf_dir):
    """Every page as Markdown."""
    tree = T.page_tree(table(spark, sf_dir, "pages"))
    return tree.select("page_id", F.size("paragraphs").cast("long").alias("n_paragraphs"), F.md5("markdown").alias("markdown_md5"))


def order_pages(spark, sf_dir):
    """Stand-in pages with tables: an order's lines as HTML rows, its date as a
    heading cell beside all of them, a check box a line, and a total."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("q"),
                                                "l_returnflag")
    row = F.concat(F.lit("<td>"), F.col("l_partkey").cast("string"), F.lit("<td>"), F.col("q").cast("string"),
                   F.lit("</td><td><input type=\"checkbox\""), F.when(F.col("l_returnflag") == "R", " checked").otherwise(""),
                   F.lit("></td></tr>"))
    rows = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", row.alias("r")))).alias("rs"),
                                        F.sum("q").alias("total"))   # the lines of one order
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    j = o.join(rows, o.o_orderkey == rows.l_orderkey)
    return j.select(F.col("o_orderkey").alias("page_id"), F.concat(
        F.lit("<html lang=\"en\"><body><nav>menu<table><tr><td>no</td></tr></table></nav><h2>Order</h2><table>"
              "<thead><tr><th>Date</th><th>Part</th><th>Quantity</th><th>Returned</th></tr></thead><tr><th rowspan=\""),
        F.size("rs").cast("string"), F.lit("\">"), F.col("d"), F.lit("</th>"),
        F.array_join(F.transform("rs", lambda x: x["r"]), "<tr>"),
        F.lit("<tr><th colspan=2>Total</th><td colspan=\"2\">"), F.col("total").cast("string"),
        F.lit("</td></table></body></html>")).alias("html"))


_ORDER_CELLS = """
l AS (SELECT l_orderkey AS page_id, l_partkey, CAST(l_quantity AS INTEGER) AS q, l_returnflag,
             CAST(row_number() OVER w AS INTEGER) AS r, CAST(count(*) OVER (PARTITION BY l_orderkey) AS INTEGER) AS n
      FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, '<td>' || l_partkey || '<td>' || CAST(l_quantity AS INTEGER))),
t AS (SELECT page_id, max(n) AS n, CAST(sum(q) AS VARCHAR) AS total, strftime(any_value(o_orderdate), '%Y-%m-%d') AS d
      FROM l JOIN orders ON o_orderkey = page_id GROUP BY page_id)
"""


@register("page_cells", sql=f"""
WITH {_ORDER_CELLS},
c AS (
  SELECT page_id, 0 AS row_index, c AS column_index, CASE c WHEN 0 THEN 'Date' WHEN 1 THEN 'Part' WHEN 2 THEN 'Quantity' ELSE 'Returned' END AS content,
         'columnHeader' AS kind, 1 AS row_span, 1 AS column_span FROM t CROSS JOIN range(4) x(c)
  UNION ALL SELECT page_id, 1, 0, d, 'rowHeader', n, 1 FROM t
  UNION ALL SELECT l.page_id, r, c, CASE c WHEN 1 THEN CAST(l_partkey AS VARCHAR) WHEN 2 THEN CAST(q AS VARCHAR)
                                         ELSE CASE WHEN l_returnflag = 'R' THEN '[x]' ELSE '[ ]' END END, 'content', 1, 1
            FROM l JOIN t USING (page_id) CROSS JOIN range(1, 4) x(c)
  UNION ALL SELECT page_id, n + 1, 0, 'Total', 'rowHeader', 1, 2 FROM t
  UNION ALL SELECT page_id, n + 1, 2, total, 'content', 1, 2 FROM t)
SELECT page_id, 0 AS table_no, n + 2 AS rows, 4 AS columns, CAST(row_index AS INTEGER) AS row_index,
       CAST(column_index AS INTEGER) AS column_index, content, kind, CAST(row_span AS INTEGER) AS row_span, column_span
FROM c JOIN (SELECT page_id, n FROM t) USING (page_id)
""")
def page_cells(spark, sf_dir):
    """Cells of HTML tables with their spans."""
    return T.tree_cells(T.page_tree(order_pages(spark, sf_dir)))


@register("page_marks", sql=f"""
WITH {_ORDER_CELLS}
SELECT l.page_id, count(*) AS marks, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS selected
FROM l JOIN t USING (page_id) GROUP BY l.page_id
""")
def page_marks(spark, sf_dir):
    """D13 on pages: check boxes through the response parser, counted a page."""
    parsed = D.parse_response(T.tree_response(T.page_tree(order_pages(spark, sf_dir))), "prebuilt-layout", keep=("page_id",))
    return D.selection_marks(parsed, keep=("page_id",)).groupBy("page_id").agg(
        F.count(F.lit(1)).alias("marks"), F.sum((F.col("state") == "selected").cast("long")).alias("selected"))
