"""Image candidates and zones of a page: N3, N5, N6, I6, I7, I9, I10.

All of it happens inside the dom row: the main area, the article areas with
their selector rank, every ``img`` with its parent's class and id, the meta
tags and the inline-style backgrounds become one array of candidate structs.
Containment is an interval test on pre-order ids. ``rank_inrow`` turns the
array into the ranked list; nothing leaves the row before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sqlexpr as X
from ..functions import words as W
from ..functions.columns import built_once
from ..functions.images import background_urls, chosen_src_sql, uri_parts_sql, bad_authority_sql, needs_join_sql
from .dom import inside, settle, subtree

# A descendant selector "A B" can never win: its last part B is tried on its
# own earlier in the list and matches the same element first.
_LAST_PARTS = [s.split()[-1] for s in W.MAIN_AREA_SELECTORS]
for _i, _s in enumerate(W.MAIN_AREA_SELECTORS):
    if " " in _s:
        assert _LAST_PARTS[_i] in W.MAIN_AREA_SELECTORS[:_i], _s


def _selector_sql(n: str, sel: str) -> str:
    if sel.startswith("."):
        return f"array_contains({n}.classes, {X.lit(sel[1:])})"
    if sel.startswith("#"):
        return f"coalesce({n}.attrs['id'] = {X.lit(sel[1:])}, false)"
    return f"{n}.tag = {X.lit(sel)}"


def _rank_sql(conds) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {i}" for i, c in enumerate(conds)) + " END"


def main_area_rank_sql(n: str = "n") -> str:
    """Index of the first main-area selector that matches node ``n``."""
    return _rank_sql([_selector_sql(n, s) for s in W.MAIN_AREA_SELECTORS if " " not in s])


def main_area(nodes: str = "nodes") -> Column:
    """The first node of the first selector that has a hit, as (rank, node_id, last_id)."""
    return F.expr(
        f"array_min(filter(transform({nodes}, n -> named_struct('rank', {main_area_rank_sql('n')}, "
        f"'node_id', n.node_id, 'last_id', n.last_id)), x -> x.rank IS NOT NULL))")


def article_areas(nodes: str = "nodes") -> Column:
    """I7 areas: nodes carrying one of the article classes, with the best selector rank."""
    rank = _rank_sql([f"array_contains(n.classes, {X.lit(c)})" for c in W.ARTICLE_AREA_CLASSES])
    return F.expr(
        f"filter(transform({nodes}, n -> named_struct('rank', {rank}, 'node_id', n.node_id, "
        f"'last_id', n.last_id)), x -> x.rank IS NOT NULL)")


@built_once
def area_keys(nodes: str = "nodes") -> Column:
    """``(node_id, a_rank, a_node)`` of each image inside an article area, a_rank and a_node being
    the best area around it.

    One fold over areas and images in document order. Areas are nested or
    apart, so a stack holds those around the current node, each with the best
    key from itself outwards, and every node is looked at once.
    """
    areas = article_areas(nodes)
    events = F.array_sort(F.concat(
        F.transform(areas, lambda a: F.struct(a["node_id"].alias("id"), F.lit(0).alias("img"), a["last_id"].alias("last"),
                                              a["rank"].alias("rank"))),
        F.transform(F.filter(F.col(nodes), lambda n: n["tag"] == "img"),
                    lambda n: F.struct(n["node_id"].alias("id"), F.lit(1).alias("img"), n["last_id"].alias("last"),
                                       F.lit(0).alias("rank")))))
    open_t, out_t = "array<struct<last:int,rank:int,id:int>>", "array<struct<node_id:int,a_rank:int,a_node:int>>"

    def step(acc, e):
        around = F.filter(acc["open"], lambda o: o["last"] >= e["id"])
        inner = F.get(around, F.size(around) - 1)
        outer = inner["rank"].isNotNull() & ((inner["rank"] < e["rank"])
                                             | ((inner["rank"] == e["rank"]) & (inner["id"] < e["id"])))
        best = F.when(outer, F.struct(e["last"].alias("last"), inner["rank"].alias("rank"), inner["id"].alias("id"))
                      ).otherwise(F.struct(e["last"].alias("last"), e["rank"].alias("rank"), e["id"].alias("id")))
        hit = F.struct(e["id"].alias("node_id"), inner["rank"].alias("a_rank"), inner["id"].alias("a_node"))
        return F.struct(
            F.when(e["img"] == 1, around).otherwise(F.array_append(around, best)).cast(open_t).alias("open"),
            F.when((e["img"] == 1) & (F.size(around) > 0), F.array_append(acc["out"], hit)).otherwise(acc["out"])
             .cast(out_t).alias("out"))

    start = F.struct(F.array().cast(open_t).alias("open"), F.array().cast(out_t).alias("out"))
    return F.aggregate(events, start, step, lambda acc: acc["out"])


def _cand(kind, node_id, idx, raw, attrs=None, cls=None, p_cls=None, p_id=None, in_main=None) -> Column:
    """One candidate struct; every kind has the same fields so they concatenate."""
    def v(x, t):
        return (F.lit(None) if x is None else x).cast(t)
    return F.struct(
        F.lit(kind).alias("kind"), v(node_id, "int").alias("node_id"), v(idx, "int").alias("idx"),
        raw.cast("string").alias("raw"), v(attrs, "map<string,string>").alias("attrs"),
        v(cls, "string").alias("cls"), v(p_cls, "string").alias("p_cls"), v(p_id, "string").alias("p_id"),
        v(in_main, "boolean").alias("in_main"))


@built_once
def _first_metas() -> Column:
    """The first meta element of each kind that may name an image."""
    from .fields import first_ids
    preds = {f"m{i}": (lambda key, value: lambda n: (n["tag"] == "meta") & F.coalesce(
        n["attrs"][key] == F.lit(value), F.lit(False)))(key, value)
        for i, (key, value) in enumerate(W.META_IMAGE_TAGS)}
    return first_ids(F.col("nodes"), preds)


@built_once
def _candidates() -> Column:
    """The candidate structs of a page: images, meta elements, backgrounds."""
    nodes, main, meta_ids = F.col("nodes"), F.col("_main"), F.col("_meta")

    def img_cand(n):
        parent = F.get(nodes, n["parent_id"])
        return _cand("img", n["node_id"], F.lit(0), F.lit(None), attrs=n["attrs"],
                     cls=F.array_join(n["classes"], " "), p_cls=F.array_join(parent["classes"], " "),
                     p_id=parent["attrs"]["id"],
                     in_main=F.coalesce(main.isNotNull() & inside(n, main), F.lit(False)))

    imgs = F.transform(F.filter(nodes, lambda n: n["tag"] == "img"), img_cand)
    metas = F.filter(F.array(*[
        F.when(meta_ids[f"m{i}"].isNotNull(), _cand(
            "meta", meta_ids[f"m{i}"], F.lit(i),
            F.coalesce(F.get(nodes, meta_ids[f"m{i}"])["attrs"]["content"], F.lit(""))))
        for i in range(len(W.META_IMAGE_TAGS))]), lambda x: x.isNotNull())
    styled = F.filter(nodes, lambda n: n["attrs"]["style"].isNotNull())
    bgs = F.flatten(F.transform(styled, lambda n: F.transform(
        F.coalesce(background_urls(n["attrs"]["style"]), F.array().cast("array<string>")),
        lambda u, i: _cand("bg", n["node_id"], i, u))))
    return F.concat(imgs, metas, bgs)


def with_candidates(dom: DataFrame) -> DataFrame:
    """Add ``main_rank``, ``areas`` (best article area by image) and ``cands`` (candidate structs) to dom rows.

    Only structural facts are taken here, and each image's source (I1). Other
    columns pass through, so page fields can be computed in the same pass.
    """
    staged = dom.withColumns({"_main": main_area(), "areas": area_keys(), "_meta": _first_metas()})
    found = staged.withColumns({"main_rank": F.col("_main")["rank"], "cands": _candidates()}).drop("_main", "_meta")
    return found.withColumn("cands", F.expr(
        "transform(cands, c -> named_struct('kind', c.kind, 'node_id', c.node_id, 'idx', c.idx, 'raw', "
        f"CASE WHEN c.kind = 'img' THEN {chosen_src_sql('c.attrs')} ELSE c.raw END, 'attrs', c.attrs, "
        "'cls', c.cls, 'p_cls', c.p_cls, 'p_id', c.p_id, 'in_main', c.in_main))"))


def without_failed(df: DataFrame) -> DataFrame:
    """Make a page whose urls no parser takes a failed one: null ``nodes``, ``page_text`` and ``cands``, and a
    ``parse_error``. A page's own url is parsed, and every source that is joined to it (I2, P6)."""
    df = settle(df.withColumn("base", F.expr(uri_parts_sql("url"))), "base", "cands", "areas")
    bad_src = (f"exists(cands, c -> c.kind = 'img' AND {needs_join_sql('c.raw')} AND contains(c.raw, '[') "
               f"<> contains(c.raw, ']') AND {bad_authority_sql('(' + uri_parts_sql('c.raw') + ')')})")
    error = F.when(F.expr("nodes IS NOT NULL AND " + bad_authority_sql("base")), F.lit("invalid page url")).when(
        F.expr(f"coalesce({bad_src}, false)"), F.lit("invalid image url"))
    df = settle(df.withColumn("parse_error", F.coalesce(F.col("parse_error"), error)), "parse_error")
    ok = F.col("parse_error").isNull()
    there = [name for name in ("nodes", "page_text", "cands") if name in df.columns]
    return df.withColumns({name: F.when(ok, F.col(name)) for name in there})


def area_images(df: DataFrame) -> DataFrame:
    """One row for each area and image inside it: ``page_id, area, url``.

    ``area`` is ``main`` or the article class that made the area; ``df`` has
    ``nodes`` and the ``candidates`` of the ranking steps, which give the urls.
    """
    main = F.when(F.col("_main").isNotNull(), F.array(F.struct(
        F.lit("main").alias("area"), F.col("_main.node_id").alias("node_id"), F.col("_main.last_id").alias("last_id"))))
    names = F.array(*map(F.lit, W.ARTICLE_AREA_CLASSES))
    areas = F.transform(article_areas(), lambda a: F.struct(
        F.get(names, a["rank"]).alias("area"), a["node_id"].alias("node_id"), a["last_id"].alias("last_id")))
    every = F.concat(F.coalesce(main, F.array().cast("array<struct<area:string,node_id:int,last_id:int>>")), areas)
    urls = F.map_from_entries(F.transform(F.filter("candidates", lambda c: c["kind"] == "img"),
                                          lambda c: F.struct(c["node_id"], c["url"])))
    pairs = F.flatten(F.transform("_every", lambda a: F.transform(
        F.filter(subtree(F.col("nodes"), a), lambda n: n["tag"] == "img"),
        lambda n: F.struct(a["area"].alias("area"), F.element_at(F.col("_urls"), n["node_id"]).alias("url")))))
    return (df.withColumn("_main", main_area()).withColumn("_every", every).withColumn("_urls", urls)
            .select("page_id", F.inline(pairs)))
