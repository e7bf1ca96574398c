"""Info tables: H2 rows, H3 text replacement, H4 summary.

Tables are found the way the original finds them: a regex for a ``table``
whose class attribute is exactly ``event-info-table``; each matched snippet is
parsed on its own (N1), and per ``tr`` the first ``th`` and the first ``td``
make a row when both exist. Snippets, their parse and their rows stay in the
document's row: one scan, no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import words as W
from ..functions.text import py_strip
from .dom import first_node, node_text, parse_snippets, subtree

TABLE_PATTERN = r'(?s)<table[^>]*class="' + W.INFO_TABLE_CLASS + r'"[^>]*>.*?</table>'


def _table_rows(parsed: Column) -> Column:
    """H2 of one parsed snippet: an array of (key, value); none if it could not be parsed."""
    nodes, text = parsed["nodes"], parsed["page_text"]

    def cell(tr, tag):
        return F.get(F.filter(subtree(nodes, tr), lambda n: n["tag"] == tag), 0)

    rows = F.transform(
        F.filter(subtree(nodes, first_node(nodes, lambda n: n["tag"] == "table")), lambda n: n["tag"] == "tr"),
        lambda tr: F.struct(py_strip(node_text(text, cell(tr, "th"))).alias("key"),
                            py_strip(node_text(text, cell(tr, "td"))).alias("value")))
    both = F.filter(rows, lambda r: r["key"].isNotNull() & r["value"].isNotNull())
    return F.coalesce(both, F.array().cast("array<struct<key:string,value:string>>"))


def with_tables(docs: DataFrame, html_col: str = "content") -> DataFrame:
    """Add ``tables``: for each matched table its ``snippet`` and ``rows`` (key, value)."""
    found = F.coalesce(F.regexp_extract_all(F.col(html_col), F.lit(TABLE_PATTERN), 0), F.array().cast("array<string>"))
    parsed = docs.withColumn("_found", found).withColumn("_parsed", parse_snippets("_found"))
    return parsed.withColumn("tables", F.zip_with("_found", "_parsed", lambda s, p: F.struct(
        s.alias("snippet"), _table_rows(p).alias("rows")))).drop("_found", "_parsed")


def info_table_rows(docs: DataFrame, html_col: str = "content") -> DataFrame:
    """H2: ``(page_id, t_idx, row_no, key, value)``."""
    each = with_tables(docs.select("page_id", html_col), html_col).select(
        "page_id", F.posexplode("tables").alias("t_idx", "t"))
    return each.select("page_id", "t_idx", F.posexplode("t.rows").alias("row_no", "r")).select(
        "page_id", "t_idx", "row_no", "r.key", "r.value")


def info_table_text(docs: DataFrame, html_col: str = "content") -> DataFrame:
    """H3: the document text with every info table replaced by its text, tables in order.

    A table's text is a header, one ``■ key: value`` line per row, and a blank line.
    """
    lines = with_tables(docs.select("page_id", html_col), html_col)
    texts = F.transform("tables", lambda t: F.struct(t["snippet"].alias("snippet"), F.concat(
        F.lit(W.INFO_TABLE_HEADER), F.array_join(F.transform(t["rows"], lambda r: F.concat(
            F.lit("■ "), r["key"], F.lit(": "), r["value"], F.lit("\n"))), ""), F.lit("\n")).alias("text")))
    folded = F.aggregate("_texts", F.col(html_col), lambda acc, t: F.replace(acc, t["snippet"], t["text"]))
    return lines.withColumn("_texts", texts).select("page_id", folded.alias("text"))


def info_summary(rows: DataFrame) -> DataFrame:
    """H4: the five known keys in fixed order, each taken from the first row whose
    header starts with its label; missing or empty ones left out."""
    key = None
    for k, label in W.INFO_SUMMARY_KEYS:
        c = F.col("key").startswith(label)
        key = F.when(c, F.lit(k)) if key is None else key.when(c, F.lit(k))
    keyed = rows.withColumn("k", key).filter(F.col("k").isNotNull())
    wide = (keyed.groupBy("page_id")
            .pivot("k", [k for k, _ in W.INFO_SUMMARY_KEYS])
            .agg(F.min_by("value", F.struct("t_idx", "row_no"))))
    parts = [F.when(F.coalesce(F.col(k), F.lit("")) != "", F.concat(F.lit(f"■ {label}: "), F.col(k), F.lit("\n")))
             for k, label in W.INFO_SUMMARY_KEYS]
    return wide.select("page_id", *[k for k, _ in W.INFO_SUMMARY_KEYS],
                       F.concat(F.lit(W.INFO_SUMMARY_HEADER), F.concat_ws("", *parts)).alias("summary"))
