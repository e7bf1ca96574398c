"""SQL building blocks for the DuckDB oracle queries.

The oracle never parses HTML: it derives the expected values from the raw
markup with regular expressions (valid for the driver's pages, whose shape is
fixed) or from the constructed fixtures' source columns. The fixed word lists
are the same Python constants the Spark side uses.
"""

from __future__ import annotations

from ..functions.text import PY_WHITESPACE, WS_CLASS, sql_str

ENTITIES = [("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")]


def q(s: str) -> str:
    return sql_str(s)


def strip(x: str) -> str:
    return f"trim({x}, {q(PY_WHITESPACE)})"


def squeeze(x: str, repl: str = " ") -> str:
    return f"regexp_replace({x}, {q(WS_CLASS + '+')}, {q(repl)}, 'g')"


def visible_text(x: str) -> str:
    """Tag-stripping text of a markup fragment (script/style/comments dropped)."""
    x = f"regexp_replace({x}, '(?s)<script[^>]*>.*?</script>', '', 'g')"
    x = f"regexp_replace({x}, '(?s)<style[^>]*>.*?</style>', '', 'g')"
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"
    x = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for ent, ch in ENTITIES:
        x = f"replace({x}, {q(ent)}, {q(ch)})"
    return x


def contains_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def hits(x: str, words, points: int) -> str:
    return "(" + " + ".join(f"(CASE WHEN contains({x}, {q(w)}) THEN {points} ELSE 0 END)" for w in words) + ")"


def weighted(x: str, pairs) -> str:
    return "(" + " + ".join(f"(CASE WHEN contains({x}, {q(w)}) THEN {p} ELSE 0 END)" for w, p in pairs) + ")"


def content_type(x: str) -> str:
    from ..functions import words as W
    t = f"lower(coalesce({x}, ''))"
    parts = " ".join(f"WHEN {contains_any(t, kws)} THEN {q(name)}" for name, kws in W.CONTENT_TYPES)
    return f"(CASE {parts} ELSE {q(W.DEFAULT_CONTENT_TYPE)} END)"


# ---------------------------------------------------------------- images

def py_int(x: str) -> str:
    return (f"(CASE WHEN regexp_matches({x}, {q('^' + WS_CLASS + '*[+-]?[0-9]+' + WS_CLASS + '*$')}) "
            f"THEN TRY_CAST({strip(x)} AS BIGINT) END)")


def file_name(lower_url: str) -> str:
    return f"split_part(string_split({lower_url}, '/')[-1], '?', 1)"


def valid_image(url: str) -> str:
    from ..functions import words as W
    u = f"lower({url})"
    return (f"coalesce(length({url}) >= {W.MIN_IMAGE_URL_LENGTH} AND NOT {contains_any(u, W.INVALID_URL_PARTS)} "
            f"AND NOT {contains_any(file_name(u), W.INVALID_FILE_PARTS)} "
            f"AND ({contains_any(u, W.IMAGE_EXTENSIONS)} OR {contains_any(u, W.IMAGE_PATH_WORDS)}), false)")


def importance(alt: str, cls: str, pcls: str, pid: str, w: str, h: str) -> str:
    from ..functions import words as W
    a, c, pc, pi = (f"lower(coalesce({x}, ''))" for x in (alt, cls, pcls, pid))
    alt_t = f"(CASE WHEN {a} <> '' AND {contains_any(a, W.ALT_WORDS)} THEN {W.ALT_POINTS} ELSE 0 END)"
    cls_t = (f"(CASE WHEN {c} <> '' THEN {hits(c, W.CLASS_GOOD_WORDS, W.CLASS_GOOD_POINTS)} + "
             f"{hits(c, W.CLASS_BAD_WORDS, W.CLASS_BAD_POINTS)} ELSE 0 END)")
    par_t = (f"(CASE WHEN {contains_any(pc, W.PARENT_WORDS)} OR {contains_any(pi, W.PARENT_WORDS)} "
             f"THEN {W.PARENT_POINTS} ELSE 0 END)")
    wi, hi = py_int(w), py_int(h)
    size_t = (f"(CASE WHEN NOT coalesce({w} <> '' AND {h} <> '', false) OR {wi} IS NULL OR {hi} IS NULL THEN 0 "
              f"WHEN {wi} >= 400 OR {hi} >= 300 THEN 2 WHEN {wi} >= 200 OR {hi} >= 150 THEN 1 "
              f"WHEN {wi} < 100 AND {hi} < 100 THEN -2 ELSE 0 END)")
    return f"CAST({alt_t} + {cls_t} + {par_t} + {size_t} AS INTEGER)"


def quality(url: str) -> str:
    from ..functions import words as W
    u = f"lower({url})"
    d = r"(\p{Nd}{3,4})"
    parts = [str(W.QUALITY_BASE), weighted(u, W.QUALITY_WORDS), weighted(u, W.QUALITY_LOW_WORDS),
             f"(CASE WHEN len(string_split({u}, '/')) > 5 THEN 2 ELSE 0 END)",
             f"(CASE WHEN {contains_any(u, W.QUALITY_HOST_WORDS)} THEN 2 ELSE 0 END)",
             f"(CASE WHEN len(regexp_extract_all({file_name(u)}, '\\p{{Nd}}')) >= 3 THEN 1 ELSE 0 END)",
             f"(CASE WHEN length({url}) > 100 THEN 1 ELSE 0 END)"]
    mw = f"TRY_CAST(regexp_extract({u}, {q(d + 'x' + d)}, 1) AS INTEGER)"
    mh = f"TRY_CAST(regexp_extract({u}, {q(d + 'x' + d)}, 2) AS INTEGER)"
    parts.append(f"(CASE WHEN {mw} >= 800 OR {mh} >= 600 THEN 3 WHEN {mw} >= 400 OR {mh} >= 300 THEN 1 ELSE 0 END)")
    for letter in ("w", "h"):
        v = f"TRY_CAST(regexp_extract({u}, {q(letter + d)}, 1) AS INTEGER)"
        parts.append(f"(CASE WHEN {v} >= 800 THEN 3 WHEN {v} >= 400 THEN 1 ELSE 0 END)")
    return f"CAST(greatest({W.QUALITY_FLOOR}, {' + '.join(parts)}) AS INTEGER)"
