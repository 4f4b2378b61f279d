"""Scalar text helpers as native Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip()/str.split() treat as
# whitespace, written as one regex character class that Java regex and RE2
# (the oracle's engine) read the same way.
WS_CLASS = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
NON_WS = WS_CLASS.replace("[", "[^", 1)
# The same characters as a plain string (for ``btrim``).
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000")


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends
    (``btrim`` with the character set: no regex, linear)."""
    return F.btrim(c, F.lit(WS_CHARS))


def word_count(c: Column) -> Column:
    """``len(text.split())``: whitespace-separated words (0 for empty text).

    A regex split on whitespace runs, dropping the empty edge pieces (about
    twice as fast as extracting every word with ``regexp_extract_all``)."""
    return F.size(F.filter(F.split(c, WS_CLASS + "+", -1), lambda x: x != ""))


def is_blank(c: Column) -> Column:
    return py_strip(F.coalesce(c, F.lit(""))) == ""


def cut(c: Column, n: int) -> Column:
    """``s[:n]``."""
    return F.substring(c, 1, n)


def ellipsize(c: Column, n: int, suffix: str = "...") -> Column:
    """``s[:n] + suffix`` only when ``s`` is longer than ``n``."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(suffix))).otherwise(c)
