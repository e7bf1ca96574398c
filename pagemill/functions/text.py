"""Text Column helpers with Python ``str`` semantics, all JVM-side.

Python's ``str.strip()`` and ``re``'s ``\\s`` use the Unicode whitespace set,
which is wider than Spark's ``trim`` (spaces only) and Java's ``\\s`` (ASCII).
The set below is written out once and used by Spark and the SQL oracle alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters for which Python's str.isspace() is true.
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003"
                 "\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")

# The same set as a regex character class (Java and RE2 syntax agree here).
WS_CLASS = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def py_strip(c: Column) -> Column:
    """``str.strip()``."""
    return F.btrim(c, F.lit(PY_WHITESPACE))


def squeeze_ws(c: Column, repl: str = " ") -> Column:
    """``re.sub(r'\\s+', repl, s)``."""
    return F.regexp_replace(c, WS_CLASS + "+", repl)


def left(c: Column, n: int) -> Column:
    """``s[:n]`` in code points."""
    return F.substring(c, 1, n)


def contains_any(c: Column, words) -> Column:
    """``any(w in s for w in words)``; substring semantics, no word boundaries."""
    out = None
    for w in words:
        t = c.contains(w)
        out = t if out is None else (out | t)
    return out


def py_int(c: Column) -> Column:
    """``int(s)`` for decimal strings with optional sign and surrounding spaces, else NULL."""
    return F.when(c.rlike(r"^" + WS_CLASS + r"*[+-]?[0-9]+" + WS_CLASS + r"*$"),
                  py_strip(c).try_cast("bigint"))


def nullif_empty(c: Column) -> Column:
    return F.when(c != F.lit(""), c)


def sql_str(s: str) -> str:
    """Quote a Python string as a SQL literal (both Spark and DuckDB syntax)."""
    return "'" + s.replace("'", "''") + "'"
