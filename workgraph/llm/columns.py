"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space between words: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANK = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def whole(text: str | Column) -> Column:
    """The text as a string, null as empty."""
    return F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def blanks_alike(text: Column) -> Column:
    """Every white space character as a blank, so that a text splits on one character."""
    for char in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(char), F.lit(" "))
    return text


def words(text: Column) -> Column:
    """Words between white space, in order."""
    return F.array_remove(F.split(blanks_alike(text), " "), "")


def count_chars(text: Column, chars: str) -> Column:
    """How many code points of ``text`` are among ``chars``."""
    return F.regexp_count(text, F.lit("[" + "".join("\\" + c for c in chars) + "]"))


def ratio(part: Column, total: Column) -> Column:
    """``part / total`` as a double, 0 where the total is 0."""
    return F.when(total > 0, part.cast("double") / total.cast("double")).otherwise(F.lit(0.0))
