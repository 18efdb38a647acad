"""Column expressions for text: white space, words, lines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: White space in any script, with the four information separators that Java leaves out.
SPACE = r"(?U)[\s\x1c-\x1f]"
WORD = r"[\p{L}\p{N}]+"


def squeeze(text: Column) -> Column:
    """Runs of any white space become one blank; the ends are trimmed."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def strip(text: Column) -> Column:
    """Trim white space of any script at both ends."""
    return F.regexp_replace(text, rf"{SPACE}+$|^{SPACE}+", "")


def blank_to_null(text: Column) -> Column:
    return F.when(F.length(strip(text)) > 0, strip(text))


def words(text: Column) -> Column:
    """Longest runs of letters or digits, in lower case, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
