"""Regex-level markup functions: H1 clean_html, D10 article_key, A7 utm_links.

All are chains of built-in ``regexp_replace`` / ``translate`` so they stay in
whole-stage codegen. Replacement strings use Java's ``$n`` group syntax.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words as W
from .text import WS_CLASS, left, py_strip

# ---- FIXED VALUES: clean-up rules applied in this order (H1) ----
CLEAN_RULES = [
    (r"(?s)<h2[^>]*>(.*?)</h2>", "\n\n【{1}】\n"),
    (r"(?s)<h3[^>]*>(.*?)</h3>", "\n■ {1}\n"),
    (r"(?s)<p[^>]*>(.*?)</p>", "{1}\n\n"),
    (r"(?s)<div[^>]*>(.*?)</div>", "{1}\n"),
    (r'(?s)<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>', "{2} ({1})"),
    (r"<[^>]+>", ""),
    (rf"\n{WS_CLASS}*\n{WS_CLASS}*\n", "\n\n"),
]


def _java_repl(t: str) -> str:
    return t.replace("{1}", "$1").replace("{2}", "$2")


def clean_html(c: Column) -> Column:
    """H1: markup to plain text with section marks; entities stay encoded."""
    x = c
    for pat, repl in CLEAN_RULES:
        x = F.regexp_replace(x, pat, _java_repl(repl))
    return py_strip(x)


def article_key(title: Column, stamp: Column) -> Column:
    """``yyyyMMdd_HHmm_`` + cleaned title (first 50 characters)."""
    t = F.translate(title, W.KEY_DROP_CHARS, "")
    t = F.replace(t, F.lit("　"), F.lit(" "))
    t = F.regexp_replace(t, WS_CLASS + "+", "_")
    return F.concat(F.date_format(stamp, W.KEY_STAMP_FORMAT), F.lit("_"), left(t, W.KEY_MAX_CHARS))


def utm_link(url: Column) -> Column:
    """Official link with the fixed tracking parameters appended."""
    return F.concat(url, F.lit(W.UTM_PARAMS))
