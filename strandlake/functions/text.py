"""String expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character that counts as white space at the ends of a key.
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(col: Column) -> Column:
    """``col`` without white space of any kind at both ends; null stays null."""
    return F.btrim(col, F.lit(WHITESPACE))


def sql_stripped(expr: str) -> str:
    """The same for DuckDB."""
    chars = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)
    return f"trim({expr}, {chars})"
