"""DuckDB SQL fragments mirroring quarry's column builders (oracle side)."""

from __future__ import annotations


def words(x: str) -> str:
    """Twin of quarry.functions.text.words."""
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+', 0)".replace("{{", "{").replace("}}", "}")


def space_tokens(x: str) -> str:
    """Twin of quarry.functions.text.space_tokens."""
    return f"regexp_extract_all(lower({x}), '(\\S+)', 1)"


def sentences(x: str) -> str:
    """Twin of quarry.functions.text.sentences."""
    return (f"list_filter(list_transform(regexp_extract_all({x}, '[^.!?\\n]+[.!?]*', 0), "
            f"lambda s: trim(s)), lambda s: length(s) > 0)")


def ratio(num: str, den: str) -> str:
    """coalesce(num / den, 0) with a zero denominator giving 0."""
    return f"coalesce(CAST({num} AS DOUBLE) / NULLIF({den}, 0), 0.0)"


def in_list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"
