"""Spark SQL text builders for large keyword expressions.

A scorer with dozens of ``contains`` terms is much cheaper to *build* as one SQL
string (one ``F.expr`` call) than as a tree of Python ``Column`` objects, each
node a JVM round trip. The evaluated expression is the same and runs in
whole-stage codegen. Inputs are SQL expressions over column names.
"""

from __future__ import annotations

from .text import PY_WHITESPACE, WS_CLASS


def lit(s: str) -> str:
    """A Spark SQL string literal for any text (escapes quote, backslash, non-ASCII)."""
    out = []
    for ch in s:
        o = ord(ch)
        if ch == "\\":
            out.append("\\\\")
        elif ch == "'":
            out.append("\\'")
        elif 32 <= o < 127:
            out.append(ch)
        elif o <= 0xFFFF:
            out.append("\\u%04x" % o)
        else:
            out.append("\\U%08x" % o)
    return "'" + "".join(out) + "'"


def contains_any(x: str, words) -> str:
    """A chain of tests: compiled, and best outside of lambdas."""
    return "(" + " OR ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


def _array(words) -> str:
    return "array(" + ", ".join(lit(w) for w in words) + ")"


def any_of(x: str, words) -> str:
    """``contains_any`` over a constant array: inside lambdas, where nothing is
    compiled, it does the same work with an expression of a few nodes."""
    return f"exists({_array(words)}, kw -> contains({x}, kw))"


def hits(x: str, words, points: int) -> str:
    """``points`` for each word that ``x`` contains."""
    return f"(size(filter({_array(words)}, kw -> contains({x}, kw))) * {points})"


def weighted(x: str, pairs) -> str:
    """The points of each (word, points) whose word ``x`` contains."""
    table = "array(" + ", ".join(f"named_struct('w', {lit(w)}, 'p', {p})" for w, p in pairs) + ")"
    return f"aggregate({table}, 0, (total, kw) -> total + CASE WHEN contains({x}, kw.w) THEN kw.p ELSE 0 END)"


def py_strip(x: str) -> str:
    return f"btrim({x}, {lit(PY_WHITESPACE)})"


def py_int(x: str) -> str:
    pat = lit("^" + WS_CLASS + "*[+-]?[0-9]+" + WS_CLASS + "*$")
    return f"(CASE WHEN {x} RLIKE {pat} THEN try_cast({py_strip(x)} AS BIGINT) END)"


def file_name(lower_url: str) -> str:
    return f"substring_index(element_at(split({lower_url}, '/'), -1), '?', 1)"
