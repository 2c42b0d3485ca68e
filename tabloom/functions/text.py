"""Cell-level text cleaning expressions and column naming."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Cells that mean "missing" once trimmed and lower-cased.
PLACEHOLDERS = ["n/a", "na", "null", "none", "-", "--", "?"]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def is_placeholder(c: Column) -> Column:
    return F.lower(strip(c)).isin(PLACEHOLDERS)


def placeholder_to_null(c: Column) -> Column:
    return F.when(~is_placeholder(c), c)


def truncate(c: Column, length: int = 40) -> Column:
    return F.substring(c, 1, length)


def snake_case(name: str) -> str:
    """Lower-case words of letters and digits joined by single underscores."""
    return "_".join(word for word in re.split("[^a-z0-9]+", name.strip().lower()) if word)
