"""Prompt templates with ``{{$name}}`` placeholders rendered as columns.

The template is split once on the driver into literal and placeholder
pieces and becomes a single ``concat``; values are inserted in one pass, so
braces inside values are never substituted again, and a placeholder naming
a missing column fails at analysis time.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACEHOLDER = re.compile(r"\{\{\$([A-Za-z_][A-Za-z0-9_]*)\}\}")


def pieces(template: str) -> list[tuple[str, str]]:
    """[('lit', text) | ('var', name), ...] in template order."""
    out, pos = [], 0
    for m in PLACEHOLDER.finditer(template):
        if m.start() > pos:
            out.append(("lit", template[pos:m.start()]))
        out.append(("var", m.group(1)))
        pos = m.end()
    if pos < len(template):
        out.append(("lit", template[pos:]))
    return out


def render(template: str, null_as: str = "") -> Column:
    """Column rendering ``template`` per row; NULL values render as ``null_as``."""
    parts = []
    for kind, v in pieces(template):
        if kind == "lit":
            parts.append(F.lit(v))
        else:
            parts.append(F.coalesce(F.col(v).cast("string"), F.lit(null_as)))
    return F.concat(*parts) if parts else F.lit("")


def render_sql(template: str, null_as: str = "") -> str:
    """The same rendering as a SQL expression (for SQL UDFs and oracles)."""
    parts = []
    for kind, v in pieces(template):
        if kind == "lit":
            parts.append("'" + v.replace("'", "''") + "'")
        else:
            parts.append(f"coalesce(CAST({v} AS VARCHAR), '{null_as}')")
    return "concat(" + ", ".join(parts) + ")" if parts else "''"


def register_sql_function(spark, name: str, template: str, null_as: str = "") -> list[str]:
    """Register ``template`` as a temporary SQL function whose
    parameters are the template's placeholders, in first-use order, all
    STRING. It is a SQL UDF (an expression, not Python), so it stays
    JVM-side. Returns the parameter names."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"bad function name {name!r}")
    params: list[str] = []
    for kind, v in pieces(template):
        if kind == "var" and v not in params:
            params.append(v)
    body = []
    for kind, v in pieces(template):
        if kind == "lit":
            # Literal text as UTF-8 hex: no quoting or escape rules to get
            # wrong, and Catalyst folds it to a constant.
            body.append(f"decode(unhex('{v.encode('utf-8').hex()}'), 'UTF-8')")
        else:
            body.append(f"coalesce({v}, decode(unhex('{null_as.encode('utf-8').hex()}'), 'UTF-8'))")
    expr = "concat(" + ", ".join(body) + ")" if body else "''"
    sig = ", ".join(f"{p} STRING" for p in params)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({sig}) RETURNS STRING RETURN {expr}")
    return params
