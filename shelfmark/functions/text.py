"""Text expressions: matching, splitting, trimming, words and character grams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a request trims from both ends of a string.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

WORD = r"[\p{L}\p{N}]+"


def icontains(column: Column, needle: Column) -> Column:
    """Case-blind literal substring: ``%`` and ``_`` have no special meaning."""
    return F.contains(F.upper(column), F.upper(needle))


def strip(column: Column) -> Column:
    return F.trim(column, F.lit(WHITESPACE))


def split_list(column: Column) -> Column:
    """Items of a comma list, kept exactly as written: not trimmed, blanks included."""
    return F.split(column, ",", -1)


def parse_int(column: Column) -> Column:
    """A whole number written as text, or null; ``12.0`` is whole, ``12.5`` is not."""
    text = strip(column)
    whole = text.rlike(r"^[+-]?[0-9]+(\.0*)?$")
    return F.when(whole, F.regexp_replace(text, r"\.0*$", "").try_cast("bigint"))


def words(column: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(column), F.lit(WORD), F.lit(0))


def grams(column: Column, length: int) -> Column:
    """Every run of ``length`` characters, overlapping, in one pass over the text."""
    return F.regexp_extract_all(column, F.lit(f"(?s)(?=(.{{{length}}}))"), F.lit(1))
