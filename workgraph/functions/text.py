"""Texts as column expressions: line ranges, names, step patterns, model output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from workgraph.functions.ids import START, col, quote_regex
from workgraph.functions.paths import basename

_ENCLOSING = START + r"(?:func|function|def|class|interface|type)\s+\*?(?:\([^)]*\)\s*)?([A-Za-z_][A-Za-z0-9_]*)"
SYMBOL_TOKEN = r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*(?:\(\)?)?"
WORD_TOKEN = r"[_\p{L}\p{Nd}]+|[ \t]+|(?s)."
# Step keywords, and what each parameter of a step expression matches.
STEP_KEYWORDS = ["Given ", "When ", "Then ", "And ", "But ", "* "]
STEP_PARAMETERS = {"int": r"(-?\d+)", "float": r"(-?\d+(?:\.\d+)?)", "string": r'"([^"]*)"', "word": r"(\S+)"}


def text_of_range(text, start, end) -> Column:
    """Lines start..end of a text, '' when out of bounds."""
    lines, start, end = F.split(col(text), "\n"), col(start), col(end)
    inside = (start >= 1) & (end >= start) & (start <= F.size(lines))
    return F.when(inside, F.array_join(F.slice(lines, F.greatest(start, F.lit(1)),
                                               F.greatest(end - start + 1, F.lit(0))), "\n")).otherwise(F.lit(""))


def enclosing_name(text) -> Column:
    return F.regexp_extract(F.coalesce(col(text), F.lit("")), _ENCLOSING, 1)


def fallback_summary(path, enclosing, hunk_body) -> Column:
    """``name: +a/-b lines`` from the enclosing declaration or the file name."""
    lines = F.split(col(hunk_body), "\n")
    count = lambda mark: F.size(F.filter(lines, lambda l: F.startswith(l, F.lit(mark))))
    name = enclosing_name(enclosing)
    return F.format_string("%s: +%d/-%d lines", F.when(name != "", name).otherwise(basename(path)), count("+"), count("-"))


def word_tokens(text) -> Column:
    """Identifier runs, blank runs, and any other single character."""
    return F.regexp_extract_all(col(text), F.lit(WORD_TOKEN), 0)


def html_escape(text) -> Column:
    out = F.coalesce(col(text), F.lit(""))
    # The characters that are escaped, ampersand first.
    for raw, safe in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]:
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def clean_json(text) -> Column:
    """Model output without a code fence around it."""
    out = F.regexp_replace(F.trim(col(text)), r"(?s)^\s*(?:```json)?(?:```)?", "")
    return F.regexp_replace(F.regexp_replace(out, r"(?s)```$", ""), r"(?s)^\s+|\s+$", "")


def bare_token(token) -> Column:
    """A token without a trailing call bracket."""
    return F.regexp_replace(F.regexp_replace(col(token), r"\)$", ""), r"\($", "")


def looks_like_symbol(token) -> Column:
    """Underscored, dotted, called, or with a capital past its first letter."""
    token = col(token)
    return (bare_token(token) != "") & (bare_token(token).rlike(r"[_.]|^.+\p{Lu}") | token.rlike(r"\(\)?$"))


def strip_keyword(text) -> Column:
    return F.regexp_replace(col(text), r"^(?:Given |When |Then |And |But |\* )", "")


def cucumber_to_regex(expression) -> Column:
    """An anchored pattern for a step expression; everything but its parameters is literal."""
    out = quote_regex(expression)
    for name, pattern in STEP_PARAMETERS.items():
        out = F.replace(out, F.lit("\\{" + name + "\\}"), F.lit(pattern))
    return F.concat(F.lit("^"), out, F.lit("$"))


def wildcard(text) -> Column:
    """Outline placeholders replaced by a plain word."""
    return F.regexp_replace(col(text), r"<[^>]+>", "x")


def substitute_example(text, header, row) -> Column:
    """Placeholders filled from an example row; NULL when one has no value."""
    cells = F.map_from_arrays(F.slice(col(header), F.lit(1), F.least(F.size(col(header)), F.size(col(row)))),
                              F.slice(col(row), F.lit(1), F.least(F.size(col(header)), F.size(col(row)))))
    names = F.regexp_extract_all(col(text), F.lit("<([^>]+)>"), 1)
    known = F.forall(names, lambda n: F.map_contains_key(cells, n))
    filled = F.aggregate(F.map_entries(cells), col(text),
                         lambda acc, e: F.replace(acc, F.concat(F.lit("<"), e["key"], F.lit(">")), e["value"]))
    return F.when(known, filled)
