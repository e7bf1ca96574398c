"""I2-I15 inside one page row: from the candidate array to the ranked image list.

Every candidate of a page sits in its row's ``cands`` array, so the rules run
as array functions on it: resolution and validity, the zones, first sighting
per URL (sort by URL and scan order, keep the first), per-zone caps (sort by
zone order, rank from zone offsets), the fallback zones, then quality and the
top 10. All steps are sorts and linear scans of one page's candidates; nothing
leaves the row, so there is no shuffle. Each step is a named array column, and
the per-step queries read those columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sqlexpr as X
from ..functions import words as W
from ..functions.images import importance_sql, quality_sql, resolve_sql, uri_parts_sql, valid_image_sql
from .dom import settle

#: The arrays that the steps make, in order.
STEPS = ["candidates", "zones", "seen", "capped", "merged", "ranked"]


def _zone(zone, k1, k2, k3) -> str:
    return (f"named_struct('url', x.url, 'zone', {zone}, 'k1', CAST({k1} AS INT), 'k2', CAST({k2} AS INT), "
            f"'k3', CAST({k3} AS INT), 'importance', x.importance)")


def with_image_steps(df: DataFrame) -> DataFrame:
    """Add the arrays of STEPS to rows with ``cands``, ``areas`` and ``base`` (parts of the page's url).

    ``candidates``: kind, node_id, idx, raw, url, valid, in_main, a_rank, a_node, importance;
    ``zones``, ``seen``: url, zone, k1, k2, k3 (scan order), importance;
    ``capped``: zone, url, zone_rank; ``merged`` the same, in list order;
    ``ranked``: pos, url, quality.
    """
    caps = "CASE y.zone " + " ".join(f"WHEN {z} THEN {c}" for z, c in W.ZONE_CAPS.items()) + " END"
    size = {s: X.py_int(f"c.attrs['{s}']") for s in ("width", "height")}
    low = {"alt": "c.attrs['alt']", "cls": "c.cls", "p_cls": "c.p_cls", "p_id": "c.p_id"}
    lowered = ", ".join(f"'{k}', lower(coalesce({v}, ''))" for k, v in low.items())
    steps = [
        ("_area_of", "map_from_entries(transform(areas, a -> struct(a.node_id, a)))"),
        # I2 for images; every text that is tested more than once is lower-cased here, once
        ("_url", "transform(cands, c -> named_struct('c', c, 'url', CASE WHEN c.kind <> 'img' OR startswith(c.raw, 'http') "
                 f"THEN c.raw ELSE transform(array({uri_parts_sql('c.raw')}), r -> {resolve_sql('base', 'r', 'c.raw')})[0] "
                 f"END, 'w', {size['width']}, 'h', {size['height']}, {lowered}))"),
        ("_low", "transform(_url, x -> named_struct('x', x, 'lu', lower(x.url), 'area', _area_of[x.c.node_id]))"),
        # I3 validity and I4 importance
        ("candidates", "transform(_low, y -> named_struct('kind', y.x.c.kind, 'node_id', y.x.c.node_id, "
                       "'idx', y.x.c.idx, 'raw', y.x.c.raw, 'url', y.x.url, 'valid', "
                       + valid_image_sql("y.x.url", "y.lu") + ", 'in_main', y.x.c.in_main, 'a_rank', y.area.a_rank, "
                       "'a_node', y.area.a_node, 'importance', CASE WHEN y.x.c.kind = 'img' THEN "
                       + importance_sql("y.x.alt", "y.x.cls", "y.x.p_cls", "y.x.p_id", "y.x.w", "y.x.h", lowered=True)
                       + " ELSE 0 END))"),
        # I6-I11 zone rows with their scan-order keys
        ("zones", "flatten(transform(candidates, x -> filter(array("
                  f"CASE WHEN x.kind = 'img' AND x.valid AND x.in_main THEN {_zone(1, 0, 0, 'x.node_id')} END, "
                  f"CASE WHEN x.kind = 'img' AND x.valid AND x.a_rank IS NOT NULL "
                  f"THEN {_zone(2, 'x.a_rank', 'x.a_node', 'x.node_id')} END, "
                  f"CASE WHEN x.kind = 'img' AND x.valid AND NOT x.in_main AND x.importance > 0 "
                  f"THEN {_zone(3, 0, 0, 'x.node_id')} END, "
                  f"CASE WHEN x.kind = 'meta' AND x.valid AND x.url <> '' THEN {_zone(4, 'x.idx', 0, 0)} END, "
                  f"CASE WHEN x.kind = 'bg' AND x.valid THEN {_zone(5, 0, 'x.node_id', 'x.idx')} END"
                  "), y -> y IS NOT NULL)))"),
        # I12 first sighting: sorted by url then scan order, keep each url's first entry
        ("_sorted", "array_sort(zones)"),
        ("seen", "filter(_sorted, (x, i) -> i = 0 OR element_at(_sorted, i).url <> x.url)"),
        # I13 caps: zone order (zone 3 by importance, stable), rank = position - rows of lower zones
        ("_ordered", "array_sort(transform(seen, x -> named_struct('zone', x.zone, 'o', CASE WHEN x.zone = 3 "
                     "THEN -x.importance ELSE 0 END, 'k1', x.k1, 'k2', x.k2, 'k3', x.k3, 'url', x.url)))"),
        ("_before", "transform(array(1, 2, 3, 4, 5), z -> size(filter(_ordered, y -> y.zone < z)))"),
        ("capped", "filter(transform(_ordered, (x, i) -> named_struct('zone', x.zone, 'url', x.url, "
                   "'zone_rank', i + 1 - element_at(_before, x.zone))), y -> y.zone_rank <= " + caps + ")"),
        # I14 fallback zones; the array stays in merged-list order
        ("_n", "transform(array(1, 2, 3, 4), z -> size(filter(capped, y -> y.zone = z)))"),
        ("merged", "filter(capped, y -> y.zone <= 3 "
                   f"OR (y.zone = 4 AND _n[0] + _n[1] + _n[2] < {W.META_FALLBACK_BELOW}) "
                   f"OR (y.zone = 5 AND _n[0] + _n[1] + _n[2] + CASE WHEN _n[0] + _n[1] + _n[2] < "
                   f"{W.META_FALLBACK_BELOW} THEN _n[3] ELSE 0 END < {W.BACKGROUND_FALLBACK_BELOW}))"),
        # I15 quality, stable sort descending, first 10
        ("_lower", "transform(merged, (x, i) -> named_struct('url', x.url, 'lu', lower(x.url), 'lp', i))"),
        ("_scored", "array_sort(transform(_lower, x -> named_struct('nq', -" + quality_sql("x.url", "x.lu")
                    + ", 'lp', x.lp, 'url', x.url)))"),
        ("ranked", f"transform(slice(_scored, 1, {W.FINAL_IMAGE_CAP}), (y, i) -> named_struct('pos', i + 1, "
                   "'url', y.url, 'quality', -y.nq))"),
    ]
    for name, sql in steps:
        df = df.selectExpr("*", f"{sql} AS `{name}`")
        if name in ("_url", "candidates", "zones", "_sorted", "_ordered", "capped", "merged", "_scored"):
            df = settle(df, name)
    return df.drop(*[n for n, _ in steps if n.startswith("_")])


def with_ranked_images(df: DataFrame, out: str = "images") -> DataFrame:
    """Add ``out``: the page's ranked image urls (at most 10), none for a failed page."""
    ranked = with_image_steps(df).withColumn(out, F.coalesce(
        F.transform("ranked", lambda x: x["url"]), F.array().cast("array<string>")))
    return ranked.drop(*STEPS)


def merged_with_rendered(images, rendered):
    """Fewer than 3 static images and a non-empty rendered list: static first, then rendered,
    duplicates removed, no cap."""
    use = (F.size(images) < W.RENDER_BELOW) & (F.size(F.coalesce(rendered, F.array())) > 0)
    return F.when(use, F.array_distinct(F.concat(images, rendered))).otherwise(images)
