"""Page-field projections: N2, N4, P1-P9, C1, A1.

Everything is a Column expression over one dom row (``page_id, url,
page_text, nodes``): lookups are in-row higher-order functions, so this stage
is a narrow projection with no shuffle. Text of an element is a substring of
``page_text``; removing elements (P3) is cutting their text intervals out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sqlexpr as X
from ..functions import words as W
from ..functions.columns import BLOCK, built_once, let, prefix_scan
from ..functions.images import base_url_sql, uri_parts_sql
from ..functions.text import left, nullif_empty, py_strip, squeeze_ws
from .dom import first_node, node_text, subtree


def alive_pred(removed: Column):
    """Predicate: node not inside (or equal to) a removed element."""
    def pred(n):
        return ~F.coalesce(F.exists(removed, lambda r: (n["node_id"] >= r["node_id"]) &
                                    (n["node_id"] <= r["last_id"])), F.lit(False))
    return pred


def cut_text(page_text: Column, lo: Column, hi: Column, removed: Column) -> Column:
    """Text of ``[lo, hi)`` with the text intervals of ``removed`` cut out.

    ``removed`` is in document order. Before each removed element the text is
    kept from the furthest end of those before it, so an element inside another
    cuts nothing more.
    """
    gone = F.coalesce(removed, F.array())
    ends = prefix_scan(F.transform(gone, lambda r: r["txt_end"]), lo.cast("int"), F.lit(0), F.greatest)

    # a substring walks to its place from the text's beginning, so each block of elements has its own part of the text
    def kept(past):
        def block(b):
            base = F.get(past, b * BLOCK)
            end = F.get(past, F.least((b + 1) * BLOCK, F.size(gone)))
            return let(page_text.substr(base + 1, end - base), lambda t: F.transform(
                F.slice(gone, b * BLOCK + 1, F.lit(BLOCK)), lambda r, j: cut(t, r, F.get(past, b * BLOCK + j), base)))

        def cut(t, r, at, base):
            return t.substr(at - base + 1, F.greatest(F.least(r["txt_start"], hi) - at, F.lit(0)).cast("int"))

        blocks = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(gone) / BLOCK).cast("int") - 1, F.lit(0)))
        last = F.element_at(past, -1)
        return F.concat(F.array_join(F.flatten(F.transform(blocks, block)), ""),
                        page_text.substr(last + 1, F.greatest(hi - last, F.lit(0))))

    return let(ends, kept)


def first_ids(nodes: Column, preds: dict) -> Column:
    """N2 for many lookups in one pass: ``struct(name -> node_id of the first
    node matching preds[name])``. One ``aggregate`` over the node array instead
    of one ``filter`` (and one array copy) per lookup."""
    names = list(preds)
    init = F.struct(*[F.lit(None).cast("int").alias(k) for k in names])

    def step(acc, n):
        return F.struct(*[F.coalesce(acc[k], F.when(preds[k](n), n["node_id"])).alias(k) for k in names])

    return F.aggregate(nodes, init, step)


def _lookups() -> dict:
    pat = "(?i)" + W.TEXT_AREA_PATTERN

    def meta(key, value):
        return lambda n: (n["tag"] == "meta") & F.coalesce(n["attrs"][key] == F.lit(value), F.lit(False))

    return {
        "h1": lambda n: n["tag"] == "h1",
        "title": lambda n: n["tag"] == "title",
        "og_title": meta("property", "og:title"),
        "og_desc": meta("property", "og:description"),
        "meta_desc": meta("name", "description"),
        "p": lambda n: n["tag"] == "p",
        "main": lambda n: n["tag"] == "main",
        "article": lambda n: n["tag"] == "article",
        "div_cls": lambda n: (n["tag"] == "div") & F.exists(n["classes"], lambda c: c.rlike(pat)),
        "div_id": lambda n: (n["tag"] == "div") & F.coalesce(n["attrs"]["id"].rlike(pat), F.lit(False)),
    }


@built_once
def _lookup_column() -> Column:
    """Pass 1: first-match ids of every lookup, one aggregate over the nodes."""
    return first_ids(F.col("nodes"), _lookups()).alias("_i")


@built_once
def _node_columns() -> tuple[Column, ...]:
    """Pass 2: the looked-up nodes and the text area."""
    nodes, i = F.col("nodes"), F.col("_i")

    def at(k):
        return F.get(nodes, i[k])

    area = F.get(nodes, F.coalesce(i["main"], i["article"], i["div_cls"], i["div_id"]))
    return (at("h1").alias("_h1"), at("title").alias("_tt"), at("og_title").alias("_ogt"), at("og_desc").alias("_ogd"),
            at("meta_desc").alias("_md"), at("p").alias("_p"), area.alias("_area"))


@built_once
def _removed_column() -> Column:
    """The removed elements of the text area."""
    a = F.col("_area")
    return F.when(a.isNotNull(), F.filter(subtree(F.col("nodes"), a), lambda n: n["tag"].isin(*W.REMOVED_TEXT_TAGS)))


@built_once
def _text_columns() -> tuple[Column, ...]:
    """Pass 3: the texts."""
    nodes, text, a = F.col("nodes"), F.col("page_text"), F.col("_area")
    ok = nodes.isNotNull()
    removed = F.col("_removed")
    alive = alive_pred(removed)

    h1, tt, ogt, ogd, md, fp = (F.col(c) for c in ("_h1", "_tt", "_ogt", "_ogd", "_md", "_p"))
    # the first title / meta description that survived the removal (usually the first one)
    tt_alive = F.when(tt.isNull() | alive(tt), tt).otherwise(
        first_node(nodes, lambda n: (n["tag"] == "title") & alive(n)))
    md_alive = F.when(md.isNull() | alive(md), md).otherwise(
        first_node(nodes, lambda n: (n["tag"] == "meta") & F.coalesce(n["attrs"]["name"] == "description",
                                                                      F.lit(False)) & alive(n)))

    def content_attr(n):
        return py_strip(F.coalesce(n["attrs"]["content"], F.lit("")))

    return (
        F.when(h1.isNotNull(), py_strip(node_text(text, h1)))
         .when(tt.isNotNull(), py_strip(node_text(text, tt)))
         .when(ogt.isNotNull(), content_attr(ogt)).alias("_title"),
        F.when(ogd.isNotNull(), content_attr(ogd))
         .when(md.isNotNull(), content_attr(md))
         .when(fp.isNotNull(), F.concat(left(py_strip(node_text(text, fp)), W.DESCRIPTION_CHARS),
                                        F.lit(W.DESCRIPTION_SUFFIX))).alias("_desc"),
        py_strip(node_text(text, h1)).alias("h1_text"),
        py_strip(node_text(text, fp)).alias("first_p_text"),
        a["tag"].alias("text_area_tag"),
        F.when(a.isNotNull(), py_strip(cut_text(text, a["txt_start"], a["txt_end"], removed))).alias("main_text"),
        F.when(ok, py_strip(squeeze_ws(cut_text(text, F.lit(0), F.length(text), removed)))).alias("full_text"),
        F.when(tt_alive.isNotNull(), py_strip(node_text(text, tt_alive))).alias("page_title"),
        F.when(md_alive.isNotNull(), content_attr(md_alive)).alias("meta_description"),
        ok.alias("_ok"),
    )


@built_once
def _record_columns(with_url: bool) -> tuple[Column, ...]:
    base = base_url() if with_url else F.lit(None).cast("string")
    return (
        F.when(F.col("_ok"), F.coalesce(nullif_empty(F.col("_title")), F.col("page_title"), F.lit("")))
         .alias("title"),
        F.when(F.col("_ok"), F.coalesce(nullif_empty(F.col("_desc")), F.col("meta_description"), F.lit("")))
         .alias("description"),
        F.col("main_text"), F.col("full_text"),
        F.when(F.col("_ok"), F.coalesce(F.col("full_text"), F.col("main_text"), F.lit("")))
         .alias("text_content"),
        F.col("page_title"), F.col("meta_description"), F.col("text_area_tag"), F.col("h1_text"), F.col("first_p_text"),
        F.when(F.col("_ok"), base).alias("base_url"),
    )


def page_fields(dom: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """All scalar page fields, one row per page.

    Output: ids, title, description, main_text, full_text, text_content,
    page_title, meta_description, base_url, content_type, text_area_tag, plus
    ``h1_text`` and ``first_p_text`` (N2 lookups) for inspection.
    """
    keep = keep if keep is not None else [c for c in dom.columns if c not in ("page_text", "nodes")]
    s1 = dom.select(*keep, "page_text", "nodes", _lookup_column())
    s2 = s1.select(*keep, "page_text", "nodes", *_node_columns())
    s4 = s2.withColumn("_removed", _removed_column()).select(*keep, *_text_columns())
    return add_content_type(s4.select(*keep, *_record_columns("url" in keep)), "text_content")


def base_url(url: str = "url") -> Column:
    """Scheme + '://' + netloc of a SQL expression, by the URI syntax alone."""
    return F.expr(f"transform(array({uri_parts_sql(url)}), p -> {base_url_sql('p')})[0]")


def add_content_type(df: DataFrame, text_col: str, out_col: str = "content_type") -> DataFrame:
    """C1 as a DataFrame step: the text is lower-cased once into its own column
    (kept as a separate projection because it is used by every keyword test),
    then the keyword classes are tested on it."""
    lt = "_lower_text"
    parts = " ".join(f"WHEN {X.contains_any(lt, kws)} THEN {X.lit(name)}" for name, kws in W.CONTENT_TYPES)
    expr = F.expr(f"CASE {parts} ELSE {X.lit(W.DEFAULT_CONTENT_TYPE)} END")
    return (df.withColumn(lt, F.lower(F.coalesce(F.col(text_col), F.lit(""))))
            .withColumn(out_col, expr).drop(lt))


def page_metadata(fields: DataFrame) -> Column:
    """The metadata map; a key is absent when its source is absent. A failed
    page has its content type only. ``full_content`` is the whole-page text,
    which is also the record text."""
    return _metadata_column("full_text" if "full_text" in fields.columns else "text_content")


@built_once
def _metadata_column(text: str) -> Column:
    full = F.col(text)
    m = F.create_map(
        F.lit("source_url"), F.when(full.isNotNull(), F.col("url")),
        F.lit("page_title"), F.col("page_title"),
        F.lit("meta_description"), F.col("meta_description"),
        F.lit("full_content"), full,
        F.lit("base_url"), F.col("base_url"),
        F.lit("content_type"), F.col("content_type"),
    )
    return F.map_filter(m, lambda k, v: v.isNotNull())


def source_url(url: Column, metadata: Column | None = None) -> Column:
    """A1: url, else metadata['source_url'], else ''; empty counts as missing."""
    parts = [nullif_empty(url)]
    if metadata is not None:
        parts.append(nullif_empty(metadata["source_url"]))
    return F.coalesce(*parts, F.lit(""))
