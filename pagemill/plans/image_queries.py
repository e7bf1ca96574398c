"""Image queries over the gallery fixture (checks "G") and page records.

Spark builds the gallery html from ``part`` and runs the real stage: parse,
in-row candidates, zones and ranking; each query reads the array of its step.
The oracle starts from the expected ``(zone, src, alt, class, width, height)``
rows computed from the same ``part`` columns and applies the rules in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import words as W
from ..functions.images import asset_checks, quality_sql
from ..operators import images as IM
from ..operators import rank_inrow as RK
from ..operators import records as RC
from ..sources.fixtures import broken_pages, gallery_assets, gallery_pages
from ..sources.tables import read_pages
from . import sqltext as S


def gallery_steps(spark, sf_dir):
    return RK.with_image_steps(RC.image_dom(gallery_pages(spark, sf_dir)))


def _step(spark, sf_dir, step):
    return gallery_steps(spark, sf_dir).select("page_id", F.inline(step))


def _images(spark, sf_dir):
    return _step(spark, sf_dir, "candidates").filter(F.col("kind") == "img")


def _zone_seq(spark, sf_dir, zone):
    rows = gallery_steps(spark, sf_dir).select("page_id", F.array_sort(F.transform(
        F.filter("zones", lambda z: z["zone"] == zone),
        lambda z: F.struct(z["k1"], z["k2"], z["k3"], z["url"].alias("url"), z["importance"].alias("importance")))).alias("z"))
    return rows.select("page_id", F.posexplode("z").alias("n", "z")).select(
        "page_id", (F.col("n") + 1).alias("seq"), "z.url", "z.importance")


def q_main_area(spark, sf_dir):
    names = F.array(*[F.lit(s) for s in W.MAIN_AREA_SELECTORS if " " not in s])  # descendant selectors never win
    return RC.image_dom(gallery_pages(spark, sf_dir)).select("page_id", F.get(names, F.col("main_rank")).alias("main_selector"))


def q_zone_images(spark, sf_dir):
    return IM.area_images(gallery_steps(spark, sf_dir))


def q_non_main_images(spark, sf_dir):
    return _images(spark, sf_dir).filter(~F.col("in_main")).select("page_id", "url")


def q_image_src(spark, sf_dir):
    return _images(spark, sf_dir).select("page_id", F.col("raw").alias("src"))


def q_resolve_url(spark, sf_dir):
    return _images(spark, sf_dir).select("page_id", "url")


def q_valid_image_url(spark, sf_dir):
    return _images(spark, sf_dir).select("page_id", "url", "valid")


def q_image_importance(spark, sf_dir):
    return _images(spark, sf_dir).select("page_id", "url", "importance")


def q_image_quality(spark, sf_dir):
    c = _images(spark, sf_dir).filter("valid")
    return c.select("page_id", "url", F.expr(quality_sql("url")).alias("quality"))


def q_main_images(spark, sf_dir):
    return _zone_seq(spark, sf_dir, 1).drop("importance")


def q_article_images(spark, sf_dir):
    return _zone_seq(spark, sf_dir, 2).drop("importance")


def q_general_images(spark, sf_dir):
    return _zone_seq(spark, sf_dir, 3)


def q_meta_images(spark, sf_dir):
    z = _step(spark, sf_dir, "zones").filter(F.col("zone") == 4)
    return z.select("page_id", F.col("k1").alias("meta_idx"), "url")


def q_background_images(spark, sf_dir):
    z = _step(spark, sf_dir, "zones").filter(F.col("zone") == 5)
    return z.select("page_id", "url")


def q_union_zones(spark, sf_dir):
    return _step(spark, sf_dir, "zones").select("page_id", "zone", "url")


def q_dedup_seen(spark, sf_dir):
    return _step(spark, sf_dir, "seen").select("page_id", "zone", "url")


def q_cap_per_zone(spark, sf_dir):
    return _step(spark, sf_dir, "capped").select("page_id", "zone", "zone_rank", "url")


def q_fallback_zones(spark, sf_dir):
    rows = gallery_steps(spark, sf_dir).select("page_id", F.posexplode("merged").alias("n", "m"))
    return rows.select("page_id", (F.col("n") + 1).alias("list_pos"), "m.zone", "m.url")


def q_rank_images(spark, sf_dir):
    return _step(spark, sf_dir, "ranked")


def q_asset_admission(spark, sf_dir):
    a = gallery_assets(spark, sf_dir).select("url", "content_type", "content_length").distinct()
    ok, suffix, mime = asset_checks(F.col("content_type"), F.col("content_length"))
    return a.select("url", ok.alias("admitted"), suffix.alias("suffix"), mime.alias("mime"))


def q_rendered_merge(spark, sf_dir):
    r = RC.page_records(gallery_pages(spark, sf_dir), gallery_pages(spark, sf_dir, rendered=True))
    return r.select("page_id", F.posexplode("images").alias("n", "url")).select(
        "page_id", (F.col("n") + 1).alias("pos"), "url")


def page_records(spark, sf_dir, pages=None):
    """P8 over the driver's pages (or the given pages)."""
    pages = pages if pages is not None else read_pages(spark, sf_dir)
    return RC.page_records(pages)


def q_page_records(spark, sf_dir):
    r = page_records(spark, sf_dir)
    return r.select("page_id", "url", "title", "description", "text_content",
                    F.size("images").alias("n_images"), "content_type")


def q_gallery_records(spark, sf_dir):
    r = page_records(spark, sf_dir, gallery_pages(spark, sf_dir))
    return r.select("page_id", "title", F.array_join("images", " ").alias("images"), "content_type")


def q_broken_pages(spark, sf_dir):
    r = page_records(spark, sf_dir, broken_pages(spark, sf_dir))
    return r.select("page_id", "url", F.col("error").isNotNull().alias("failed"), "title", "text_content", "base_url",
                    "content_type", F.size("images").alias("n_images"), F.size("metadata").alias("n_metadata"))


QUERIES = {
    "main_area": q_main_area,
    "zone_images": q_zone_images,
    "non_main_images": q_non_main_images,
    "image_src": q_image_src,
    "resolve_url": q_resolve_url,
    "valid_image_url": q_valid_image_url,
    "image_importance": q_image_importance,
    "image_quality": q_image_quality,
    "main_images": q_main_images,
    "article_images": q_article_images,
    "general_images": q_general_images,
    "meta_images": q_meta_images,
    "background_images": q_background_images,
    "union_zones": q_union_zones,
    "dedup_seen": q_dedup_seen,
    "cap_per_zone": q_cap_per_zone,
    "fallback_zones": q_fallback_zones,
    "rank_images": q_rank_images,
    "asset_admission": q_asset_admission,
    "rendered_merge": q_rendered_merge,
    "page_records": q_page_records,
    "gallery_records": q_gallery_records,
    "broken_pages": q_broken_pages,
}

# ---------------------------------------------------------------- oracle side


def gallery_cte(rendered: bool = False, p: str = "") -> str:
    """The gallery oracle chain; ``p`` prefixes every CTE name."""
    keep = "page_id % 5 = 4" if rendered else "true"
    thin = "false" if rendered else "page_id % 5 = 4 AND pos < 15"
    v = "CASE WHEN page_id % 6 = 1 THEN 0 ELSE k % 8 END"
    box_class = " ".join(f"WHEN {i} THEN '{c}'" for i, c in (
        (2, "content"), (3, "main-content"), (4, "article-content"), (5, "post-content"), (6, "entry-content")))
    goods_class = " ".join(f"WHEN {i} THEN {S.q(c)}" for i, c in enumerate(W.ARTICLE_AREA_CLASSES))
    return f"""{p}g AS (
  SELECT p_partkey AS k, CAST(floor(p_partkey / 20) AS BIGINT) AS page_id, CAST(p_partkey % 20 AS INTEGER) AS pos,
         replace(p_name, ' ', '-') AS slug
  FROM part),
{p}gk AS (SELECT *, 'https://shop' || CAST(page_id % 7 AS VARCHAR) || '.example.com' AS host FROM {p}g WHERE {keep}),
{p}img AS (
  SELECT page_id, pos, k,
    CASE WHEN pos <= 10 AND page_id % 12 < 10 THEN 1 WHEN pos BETWEEN 11 AND 14 THEN 2 ELSE 3 END AS area_zone,
    CASE WHEN {thin} THEN host || '/wait/spinner-' || CAST(k AS VARCHAR) || '.gif' ELSE CASE {v}
      WHEN 0 THEN 'https://cdn.example.net/large/' || slug || '-' || CAST(k AS VARCHAR) || '.jpg'
      WHEN 1 THEN host || '/media/' || slug || '_' || CAST(k AS VARCHAR) || '_800x600.png'
      WHEN 2 THEN host || '/goods/' || CAST(page_id AS VARCHAR) || '/photo/' || slug || '.webp'
      WHEN 3 THEN 'https://img.example.org/thumb/' || CAST(k AS VARCHAR) || '.gif'
      WHEN 4 THEN 'data:image/png;base64'
      WHEN 5 THEN host || '/icons/logo-' || CAST(k AS VARCHAR) || '.svg'
      WHEN 6 THEN host || '/gallery/' || CAST(k AS VARCHAR) || '-400.jpg'
      ELSE 'https://cdn.example.net/banner/new.jpg' END END AS url,
    CASE WHEN {thin} THEN '/wait/spinner-' || CAST(k AS VARCHAR) || '.gif' ELSE CASE {v}
      WHEN 0 THEN 'https://cdn.example.net/large/' || slug || '-' || CAST(k AS VARCHAR) || '.jpg'
      WHEN 1 THEN '/media/' || slug || '_' || CAST(k AS VARCHAR) || '_800x600.png'
      WHEN 2 THEN 'photo/' || slug || '.webp'
      WHEN 3 THEN '//img.example.org/thumb/' || CAST(k AS VARCHAR) || '.gif'
      WHEN 4 THEN 'data:image/png;base64'
      WHEN 5 THEN '/icons/logo-' || CAST(k AS VARCHAR) || '.svg'
      WHEN 6 THEN '/gallery/' || CAST(k AS VARCHAR) || '-400.jpg'
      ELSE 'https://cdn.example.net/banner/new.jpg' END END AS src,
    CASE WHEN k % 3 = 0 OR page_id % 6 = 1 THEN 'New goods' ELSE '' END AS alt,
    CASE k % 4 WHEN 0 THEN 'hero' WHEN 1 THEN 'thumb' WHEN 2 THEN 'header-logo' ELSE '' END AS cls,
    CASE k % 5 WHEN 0 THEN '600' WHEN 1 THEN '250' WHEN 2 THEN '80' WHEN 3 THEN '100%' END AS w,
    CASE k % 5 WHEN 0 THEN '400' WHEN 1 THEN '100' WHEN 2 THEN '80' WHEN 3 THEN '50' END AS h,
    CASE WHEN pos BETWEEN 11 AND 14 THEN CASE page_id % 18 {goods_class} END
         WHEN pos <= 10 THEN CASE page_id % 12 {box_class} ELSE '' END ELSE '' END AS p_cls,
    CASE WHEN pos <= 10 THEN CASE page_id % 12 WHEN 7 THEN 'content' WHEN 8 THEN 'main' WHEN 9 THEN 'article' ELSE '' END
         ELSE '' END AS p_id
  FROM {p}gk),
{p}v AS (
  SELECT *, {S.valid_image('url')} AS valid,
         {S.importance('alt', 'cls', 'p_cls', 'p_id', 'w', 'h')} AS importance
  FROM {p}img),
{p}gp AS (SELECT DISTINCT page_id FROM {p}img),
{p}meta AS (
  SELECT page_id, 0 AS idx, 'https://cdn.example.net/image/og-' || CAST(page_id AS VARCHAR) || '.jpg' AS url
  FROM {p}gp WHERE page_id % 2 = 0
  UNION ALL
  SELECT page_id, 1 AS idx, 'https://cdn.example.net/image/tw-' || CAST(page_id AS VARCHAR) || '.png' AS url
  FROM {p}gp WHERE page_id % 4 = 0),
{p}bg AS (SELECT page_id, 'https://cdn.example.net/media/bg-' || CAST(page_id AS VARCHAR) || '.jpg' AS url FROM {p}gp),
{p}zones AS (
  SELECT page_id, 1 AS zone, 0 AS k1, pos AS k3, url, importance FROM {p}v WHERE valid AND area_zone = 1
  UNION ALL SELECT page_id, 2, 0, pos, url, importance FROM {p}v WHERE valid AND area_zone = 2
  UNION ALL SELECT page_id, 3, 0, pos, url, importance FROM {p}v WHERE valid AND area_zone <> 1 AND importance > 0
  UNION ALL SELECT page_id, 4, idx, 0, url, 0 FROM {p}meta WHERE {S.valid_image('url')}
  UNION ALL SELECT page_id, 5, 0, 0, url, 0 FROM {p}bg WHERE {S.valid_image('url')}),
{p}seen AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY zone, k1, k3) AS rn FROM {p}zones)
  WHERE rn = 1),
{p}capped AS (
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY page_id, zone
                                 ORDER BY CASE WHEN zone = 3 THEN -importance ELSE 0 END, k1, k3) AS INTEGER) AS zone_rank
    FROM {p}seen)
  WHERE zone_rank <= CASE zone WHEN 1 THEN {W.ZONE_CAPS[1]} WHEN 2 THEN {W.ZONE_CAPS[2]} WHEN 3 THEN {W.ZONE_CAPS[3]}
                               WHEN 4 THEN {W.ZONE_CAPS[4]} ELSE {W.ZONE_CAPS[5]} END),
{p}counted AS (
  SELECT *, sum(CASE WHEN zone <= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id) AS n123,
            sum(CASE WHEN zone = 4 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id) AS n4
  FROM {p}capped),
{p}merged AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY zone, zone_rank) AS INTEGER) AS list_pos
  FROM {p}counted
  WHERE zone <= 3
     OR (zone = 4 AND n123 < {W.META_FALLBACK_BELOW})
     OR (zone = 5 AND n123 + CASE WHEN n123 < {W.META_FALLBACK_BELOW} THEN n4 ELSE 0 END < {W.BACKGROUND_FALLBACK_BELOW})),
{p}ranked AS (
  SELECT * FROM (
    SELECT page_id, url, quality,
           CAST(row_number() OVER (PARTITION BY page_id ORDER BY quality DESC, list_pos) AS INTEGER) AS pos
    FROM (SELECT *, {S.quality('url')} AS quality FROM {p}merged))
  WHERE pos <= {W.FINAL_IMAGE_CAP})"""


def _g(select: str) -> str:
    return f"WITH {gallery_cte()}\n{select}"


def _rendered_merge_sql() -> str:
    return f"""WITH {gallery_cte()},
{gallery_cte(rendered=True, p="r_")},
needy AS (
  SELECT gp.page_id FROM gp LEFT JOIN (SELECT page_id, count(*) AS n FROM ranked GROUP BY page_id) c USING (page_id)
  WHERE coalesce(c.n, 0) < {W.RENDER_BELOW}),
both_ AS (
  SELECT page_id, 0 AS src, pos, url FROM ranked
  UNION ALL
  SELECT page_id, 1 AS src, pos, url FROM r_ranked WHERE page_id IN (SELECT page_id FROM needy)),
firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY src, pos) AS rn FROM both_)
  WHERE rn = 1)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY src, pos) AS INTEGER) AS pos, url FROM firsts"""


def assets_cte() -> str:
    """``tries``: one row for each download tried."""
    return """once AS (
  SELECT url, k, CASE k % 6 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/webp'
               WHEN 4 THEN 'text/html' ELSE '' END AS content_type,
    CASE WHEN k % 7 <> 0 THEN CAST(k * 100000 AS BIGINT) END AS content_length, k % 13 <> 0 AS ok
  FROM (SELECT url, min(k) AS k FROM img GROUP BY url) WHERE k % 11 <> 0),
tries AS (SELECT url, content_type, content_length, ok FROM once
          UNION ALL SELECT url, content_type, content_length, false FROM once WHERE k % 17 = 0)"""


#: By hand from the admission rule: an image type or none, and at most 15 MiB; an unknown size counts as 0.
ADMITTED = "(content_type IN ('', 'image/jpeg', 'image/png', 'image/gif', 'image/webp') AND coalesce(content_length, 0) <= 15728640)"


def _assets_sql() -> str:
    return f"""WITH {gallery_cte()},
{assets_cte()}
SELECT DISTINCT url, {ADMITTED} AS admitted,
  CASE content_type WHEN 'image/png' THEN '.png' WHEN 'image/gif' THEN '.gif' WHEN 'image/webp' THEN '.webp' ELSE '.jpg' END
    AS suffix,
  CASE content_type WHEN 'image/png' THEN 'image/png' WHEN 'image/gif' THEN 'image/gif' WHEN 'image/webp' THEN 'image/webp'
       ELSE 'image/jpeg' END AS mime
FROM tries"""


ORACLE = {
    "main_area": _g("SELECT page_id, CASE page_id % 12 WHEN 0 THEN 'main' WHEN 1 THEN 'article' WHEN 2 THEN '.content' "
                    "WHEN 3 THEN '.main-content' WHEN 4 THEN '.article-content' WHEN 5 THEN '.post-content' "
                    "WHEN 6 THEN '.entry-content' WHEN 7 THEN '#content' WHEN 8 THEN '#main' WHEN 9 THEN '#article' END "
                    "AS main_selector FROM gp"),
    "zone_images": _g("SELECT page_id, 'main' AS area, url FROM img WHERE area_zone = 1 "
                      "UNION ALL SELECT page_id, p_cls, url FROM img WHERE area_zone = 2 "
                      "UNION ALL SELECT page_id, 'gallery', url FROM img WHERE area_zone = 2 AND page_id % 2 = 1"),
    "non_main_images": _g("SELECT page_id, url FROM img WHERE area_zone <> 1"),
    "image_src": _g("SELECT page_id, src FROM img"),
    "resolve_url": _g("SELECT page_id, url FROM img"),
    "valid_image_url": _g("SELECT page_id, url, valid FROM v"),
    "image_importance": _g("SELECT page_id, url, importance FROM v"),
    "image_quality": _g(f"SELECT page_id, url, {S.quality('url')} AS quality FROM v WHERE valid"),
    "main_images": _g("SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k1, k3) AS INTEGER) AS seq, url "
                      "FROM zones WHERE zone = 1"),
    "article_images": _g("SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k1, k3) AS INTEGER) AS seq, url "
                         "FROM zones WHERE zone = 2"),
    "general_images": _g("SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k3) AS INTEGER) AS seq, url, "
                         "importance FROM zones WHERE zone = 3"),
    "meta_images": _g("SELECT page_id, k1 AS meta_idx, url FROM zones WHERE zone = 4"),
    "background_images": _g("SELECT page_id, url FROM zones WHERE zone = 5"),
    "union_zones": _g("SELECT page_id, zone, url FROM zones"),
    "dedup_seen": _g("SELECT page_id, zone, url FROM seen"),
    "cap_per_zone": _g("SELECT page_id, zone, zone_rank, url FROM capped"),
    "fallback_zones": _g("SELECT page_id, list_pos, zone, url FROM merged"),
    "rank_images": _g("SELECT page_id, pos, url, quality FROM ranked"),
    "asset_admission": _assets_sql(),
    "rendered_merge": _rendered_merge_sql(),
}


def _records_sql() -> str:
    from .page_queries import _page_sql
    return _page_sql(f"page_id, url, h1_text AS title, concat(left(first_p_text, {W.DESCRIPTION_CHARS}), '...') "
                     f"AS description, full_text AS text_content, 0 AS n_images, {S.content_type('full_text')} "
                     "AS content_type")


ORACLE["page_records"] = _records_sql()
ORACLE["gallery_records"] = _g(
    "SELECT gp.page_id, 'Goods ' || CAST(gp.page_id AS VARCHAR) AS title, coalesce(r.images, '') AS images, "
    "'general' AS content_type FROM gp LEFT JOIN (SELECT page_id, string_agg(url, ' ' ORDER BY pos) AS images "
    "FROM ranked GROUP BY page_id) r ON r.page_id = gp.page_id")


def _broken_sql() -> str:
    from .page_queries import _page_sql
    broken = "page_id % 10 = 0"
    return _page_sql(
        f"page_id, CASE WHEN page_id % 30 = 20 THEN 'https://[bad/y' ELSE url END AS url, {broken} AS failed, "
        f"CASE WHEN NOT ({broken}) THEN h1_text END AS title, CASE WHEN NOT ({broken}) THEN full_text END AS text_content, "
        f"CASE WHEN NOT ({broken}) THEN base_url END AS base_url, "
        f"CASE WHEN {broken} THEN 'general' ELSE {S.content_type('full_text')} END AS content_type, "
        f"CAST(0 AS INTEGER) AS n_images, CAST(CASE WHEN {broken} THEN 1 ELSE 5 END AS INTEGER) AS n_metadata")


ORACLE["broken_pages"] = _broken_sql()
