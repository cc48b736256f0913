"""Column builders for tokens, sentences and shingles.

All of these are built-in Spark expressions (JVM side, no Python), and each
has a one-line DuckDB twin so results can be checked against SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token patterns shared with the SQL oracle.
#   WORD_PATTERN  - letters and digits; the search/lexicon tokenizer.
#   SPACE_PATTERN - maximal runs of non-space characters, i.e. Python's
#                   str.split() on Unicode whitespace (the (?U) flag makes
#                   Java's \S Unicode-aware).
#   SENTENCE_PATTERN - a run of characters up to and including . ! or ?
#                   (or a line end); RE2-compatible, no look-around.
WORD_PATTERN = r"[\p{L}\p{N}]+"
SPACE_PATTERN = r"(?U)(\S+)"
SENTENCE_PATTERN = r"[^.!?\n]+[.!?]*"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(text) -> Column:
    """Lower-cased letter/digit tokens, in order (ARRAY<STRING>)."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(WORD_PATTERN), 0)


def space_tokens(text) -> Column:
    """Lower-cased whitespace-separated tokens (Python ``lower().split()``)."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(SPACE_PATTERN), 1)


def sentences(text) -> Column:
    """Trimmed, non-empty sentences in order (ARRAY<STRING>)."""
    raw = F.regexp_extract_all(_c(text), F.lit(SENTENCE_PATTERN), 0)
    return F.filter(F.transform(raw, lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def shingles(tokens, n: int) -> Column:
    """Consecutive n-token windows joined by a space; empty when fewer tokens."""
    toks = _c(tokens)
    last = F.size(toks) - F.lit(n - 1)
    idx = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(idx, lambda i: F.array_join(F.slice(toks, i, n), " "))


def coverage(needle_tokens, hay_tokens) -> Column:
    """Share of distinct needle tokens present in the hay tokens; 0 when empty."""
    nd = F.array_distinct(_c(needle_tokens))
    hit = F.size(F.array_intersect(nd, F.array_distinct(_c(hay_tokens))))
    return F.coalesce(F.try_divide(hit.cast("double"), F.size(nd).cast("double")), F.lit(0.0))


def explode_tokens(df, keep: list[str], tokens: Column, with_len: str | None = None,
                   with_pos: str | None = None, term: str = "term"):
    """One row per token: ``keep`` columns, optional token count and position.

    The token array is computed once in its own projection and only the
    columns needed downstream travel through the generator; the count is
    taken before exploding. (Written naively, Catalyst moves ``size(...)``
    above the generator and re-runs the tokenizer, or copies the whole array,
    once per output token, which is quadratic in document length.)
    ``explode_outer`` + a null filter avoids the inferred pre-filter that
    would evaluate the tokenizer twice more.
    """
    staged = df.select(*keep, tokens.alias("__toks"))
    extra = [F.size("__toks").alias(with_len)] if with_len else []
    staged = staged.select(*keep, *extra, "__toks")
    names = [*keep, *([with_len] if with_len else [])]
    if with_pos:
        out = staged.select(*names, F.posexplode_outer("__toks").alias(with_pos, term))
    else:
        out = staged.select(*names, F.explode_outer("__toks").alias(term))
    return out.filter(F.col(term).isNotNull())


def term_counts(df, keep: list[str], tokens: Column, with_len: str = "dl", marker: bool = False, term: str = "term"):
    """One row per distinct token of a row: ``keep`` columns, the row's token
    count, the token and its ``tf``; with ``marker`` one more row with a NULL
    token. Tokens are counted where they stand: a row's tokens are sorted, and a
    run of equal ones is one term, so neither occurrences nor a shuffle are
    needed. Each step is a projection of its own, computed once a row."""
    none = F.array().cast("array<string>")
    s = df.select(*keep, F.sort_array(F.coalesce(tokens, none)).alias("__t"))
    at = F.when(F.size("__t") > 0, F.sequence(F.lit(0), F.size("__t") - 1)).otherwise(F.array().cast("array<int>"))
    begins = F.filter(at, lambda i: (i == 0) | (F.get("__t", i) != F.get("__t", i - 1)))
    s = s.select(*keep, F.size("__t").alias(with_len), "__t", begins.alias("__b"))
    runs = F.transform("__b", lambda i, j: F.struct(F.get("__t", i).alias(term), (
        F.coalesce(F.get("__b", j + 1), F.size("__t")) - i).cast("long").alias("tf")))
    if marker:
        runs = F.concat(runs, F.array(F.struct(F.lit(None).cast("string").alias(term), F.lit(1).cast("long").alias("tf"))))
    out = s.select(*keep, with_len, F.explode_outer(runs).alias("__r")).filter(F.col("__r").isNotNull())
    return out.select(*keep, with_len, F.col(f"__r.{term}").alias(term), F.col("__r.tf").alias("tf"))


def posexplode_once(df, keep: list, array, pos: str, value: str):
    """``posexplode`` whose array is computed once a row. (For the plain one Spark
    infers a filter on the array's size, pushes it down to the scan, before any
    join, and computes the array there once or twice more.)"""
    return df.select(*keep, F.posexplode_outer(array).alias(pos, value)).filter(F.col(pos).isNotNull())


def json_object(text: Column | str) -> Column:
    """Whether the whole trimmed text is one JSON object (false for NULL).
    Read as the only element of an array, so a second value or any text
    after the first makes it invalid."""
    t = F.trim(F.col(text) if isinstance(text, str) else text)
    one = F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>", {"mode": "PERMISSIVE"})
    return F.coalesce(t.startswith("{") & t.endswith("}") & (F.size(one) == 1) & F.get_json_object(t, "$").isNotNull(), F.lit(False))
