"""Article and block queries over the articles fixture (checks "G").

Spark: gallery records -> merge with generations and assets (A3-A5, D5) ->
parse the article content (N1) -> elements, marks, images, blocks and offsets
in the article's row (D1-D7) -> edits (D8). The oracle lists the expected
elements of each article kind and applies the rules in SQL, with the images
from the gallery oracle chain.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import templates as TPL
from ..functions import words as W
from ..operators import articles as AR
from ..operators import blocks as BL
from ..operators.dom import parse_html
from ..operators.records import ranked_pages
from ..session import reliable_checkpoint
from ..sources.fixtures import (
    gallery_assets, gallery_pages, generations, list_articles, requests_table, write_outcomes)
from ..sources.tables import read_table
from . import sqltext as S
from .image_queries import ADMITTED, assets_cte, gallery_cte

STAMP = "2025-01-01 00:00:00"


def articles(spark, sf_dir, with_assets=False):
    """Articles of the gallery pages: url and ranked images (no other record
    fields are needed) merged with the generations."""
    recs = ranked_pages(gallery_pages(spark, sf_dir))
    if not with_assets:
        return AR.merge_generations(recs, generations(spark, sf_dir))
    recs = reliable_checkpoint(recs)  # read twice: for the articles, and for the admissions of their images
    return AR.merge_generations(recs, generations(spark, sf_dir), gallery_assets(spark, sf_dir))


def article_dom(spark, sf_dir, with_assets=False):
    a = articles(spark, sf_dir, with_assets)
    return parse_html(a.select("page_id", "images", "admitted", "content"), html_col="content")


def _numbered(df, array):
    """Rows of an array column with their number in it, from 1."""
    return df.select("page_id", F.posexplode(array).alias("n", "x")).select("page_id", (F.col("n") + 1).alias("ord"), "x.*")


def _elements(spark, sf_dir):
    return _numbered(BL.with_elements(article_dom(spark, sf_dir)), "elements")


def _blocks(spark, sf_dir):
    return _numbered(BL.with_blocks(article_dom(spark, sf_dir, with_assets=True)), "blocks")


def q_request_pages(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages", ["page_id", "url"])
    return AR.request_pages(requests_table(spark, sf_dir), pages).select(
        "url", "format_type", "category", "page_id", "has_page")


def q_merge_generations(spark, sf_dir):
    return articles(spark, sf_dir).select("page_id", "content")


def q_structure_articles(spark, sf_dir):
    a = articles(spark, sf_dir)
    return a.select("page_id", "title", "source_url", "generated_at", F.size("images").alias("n_images"), "error")


def q_error_articles(spark, sf_dir):
    a = articles(spark, sf_dir)
    return a.filter("error").select("page_id", "title", "content")


def q_article_responses(spark, sf_dir):
    a = articles(spark, sf_dir)
    return AR.article_responses(a, F.to_timestamp(F.lit(STAMP)), write_outcomes(spark, sf_dir))


def q_article_elements(spark, sf_dir):
    d = article_dom(spark, sf_dir).withColumn("els", BL.element_structs())
    return _numbered(d, "els").select("page_id", "ord", "tag", "text")


def q_element_filter(spark, sf_dir):
    return _elements(spark, sf_dir).select("page_id", "ord", "tag", "text")


def q_is_placeholder(spark, sf_dir):
    return _elements(spark, sf_dir).select("page_id", "ord", "is_mark")


def q_assign_images(spark, sf_dir):
    e = _elements(spark, sf_dir)
    return e.filter(F.col("image_url").isNotNull()).select("page_id", "mark_no", "image_url")


def q_image_fallback_text(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    return b.filter(F.col("image_url").isNotNull() & (F.col("kind") == "paragraph")).select(
        "page_id", "image_url", "text")


def q_block_style(spark, sf_dir):
    return _blocks(spark, sf_dir).select("page_id", "ord", "kind", "style", "text", "image_url")


def q_block_offsets(spark, sf_dir):
    return _blocks(spark, sf_dir).select("page_id", "ord", "kind", "start_index", "end_index")


def q_document_edits(spark, sf_dir):
    return BL.document_edits(_blocks(spark, sf_dir), carry=["ord"]).select(
        "page_id", "ord", "op_no", "op", "start_index", "end_index", "text", "style")


def q_article_stats(spark, sf_dir):
    return BL.article_stats(articles(spark, sf_dir), write_outcomes(spark, sf_dir))


def q_list_blocks(spark, sf_dir):
    d = parse_html(list_articles(spark, sf_dir), html_col="content")
    return BL.list_blocks(d).select("page_id", "line_no", "text", "style", "start_index", "end_index")


def q_fill_marks(spark, sf_dir):
    return BL.fill_marks(articles(spark, sf_dir)).select("page_id", "filled")


QUERIES = {
    "request_pages": q_request_pages,
    "merge_generations": q_merge_generations,
    "structure_articles": q_structure_articles,
    "error_articles": q_error_articles,
    "article_responses": q_article_responses,
    "article_elements": q_article_elements,
    "element_filter": q_element_filter,
    "is_placeholder": q_is_placeholder,
    "assign_images": q_assign_images,
    "image_fallback_text": q_image_fallback_text,
    "block_style": q_block_style,
    "block_offsets": q_block_offsets,
    "document_edits": q_document_edits,
    "article_stats": q_article_stats,
    "list_blocks": q_list_blocks,
    "fill_marks": q_fill_marks,
}

# ---------------------------------------------------------------- oracle side

_EL_RE = "<(h[1-6]|p|div)>(.*?)</(?:h[1-6]|p|div)>"


def _fill_sql(template: str, value: str) -> str:
    parts = template.split("{source_url}")
    out = []
    for i, p in enumerate(parts):
        if i:
            out.append(value)
        out.append(S.q(p))
    return "concat(" + ", ".join(out) + ")"


def _articles_cte() -> str:
    url = ("'https://shop' || CAST(page_id % 7 AS VARCHAR) || '.example.com/goods/' || CAST(page_id AS VARCHAR) "
           "|| '/index.html'")
    marks = " ".join(f"WHEN {i} THEN {S.q(m)}" for i, m in enumerate(W.PLACEHOLDER_MARKS))
    used = f"(CASE p.page_id % {len(W.PLACEHOLDER_MARKS)} {marks} END)"
    resp = ("'<h2>Title ' || CAST(page_id AS VARCHAR) || '</h2><div class=\"loads\">Text that goes</div><div><p>Body text for page ' "
            f"|| CAST(page_id AS VARCHAR) || '.</p></div><div>' || {used.replace('p.page_id', 'page_id')} "
            "|| '</div><p>short</p><p>ab</p>'")
    err = _fill_sql(TPL.ERROR_ARTICLE_HTML, "source_url")
    fb = S.q(TPL.FALLBACK_ARTICLE_HTML)
    mark = S.contains_any("text", W.PLACEHOLDER_MARKS)
    heads = ", ".join(S.q(f"h{i}") for i in range(1, 7))
    return f"""{gallery_cte()},
gpages AS (SELECT page_id, {url} AS source_url FROM gp),
gen AS (SELECT page_id, CASE WHEN page_id % 4 = 1 THEN NULL ELSE {resp} END AS response,
               page_id % 4 = 1 AS error FROM gp WHERE page_id % 4 <> 0),
nimg AS (SELECT page_id, count(*) AS n FROM ranked GROUP BY page_id),
arts AS (
  SELECT p.page_id, p.source_url, {S.q(W.ARTICLE_TITLE_PREFIX)} || p.source_url AS title,
         CASE WHEN coalesce(g.error, false) THEN {err} ELSE coalesce(g.response, {fb}) END AS content,
         coalesce(g.error, false) AS error,
         CASE WHEN coalesce(g.error, false) THEN 'error' WHEN g.response IS NULL THEN 'fallback' ELSE 'generated' END
           AS akind,
         CAST(coalesce(n.n, 0) AS INTEGER) AS n_images
  FROM gpages p LEFT JOIN gen g ON g.page_id = p.page_id LEFT JOIN nimg n ON n.page_id = p.page_id),
fb_el AS (
  SELECT unnest(range(1, len(t) + 1)) AS ord, unnest(t) AS tag, unnest(x) AS text
  FROM (SELECT regexp_extract_all({fb}, {S.q(_EL_RE)}, 1) AS t, regexp_extract_all({fb}, {S.q(_EL_RE)}, 2) AS x)),
el AS (
  SELECT a.page_id, f.ord, f.tag, {S.strip('f.text')} AS text FROM arts a CROSS JOIN fb_el f WHERE a.akind = 'fallback'
  UNION ALL
  SELECT page_id, 1, 'p', {S.strip(S.visible_text("regexp_extract(content, '(?s)<p>(.*)</p>', 1)"))} FROM arts
  WHERE akind = 'error'
  UNION ALL
  SELECT p.page_id, e.ord, e.tag, CASE e.kind WHEN 'title' THEN 'Title ' || CAST(p.page_id AS VARCHAR)
         WHEN 'body' THEN 'Body text for page ' || CAST(p.page_id AS VARCHAR) || '.' WHEN 'mark' THEN {used} ELSE e.kind END
  FROM arts p JOIN (VALUES (1, 'h2', 'title'), (2, 'div', 'Text that goes'), (3, 'div', 'body'), (4, 'p', 'body'),
                           (5, 'div', 'mark'), (6, 'p', 'short'), (7, 'p', 'ab')) e(ord, tag, kind) ON p.akind = 'generated'),
kept AS (SELECT *, {mark} AS is_mark FROM el WHERE length(text) >= {W.BLOCK_MIN_CHARS} AND text <> 'Text that goes'),
kord AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS kord FROM kept),
mk AS (
  SELECT *, CASE WHEN is_mark THEN row_number() OVER (PARTITION BY page_id, is_mark ORDER BY ord) END AS mark_no
  FROM kord),
wimg AS (SELECT m.*, r.url AS image_url FROM mk m LEFT JOIN ranked r ON r.page_id = m.page_id AND r.pos = m.mark_no),
{assets_cte()},
assets AS (SELECT url, max({ADMITTED} AND ok) AS admitted FROM tries GROUP BY url),
adm AS (
  SELECT w.*, coalesce(a.admitted, false) AS admitted
  FROM wimg w LEFT JOIN assets a ON a.url = w.image_url
  WHERE NOT w.is_mark OR w.image_url IS NOT NULL),
blk0 AS (
  SELECT page_id, ord, tag, image_url,
    CASE WHEN is_mark AND admitted THEN 'image' WHEN is_mark THEN 'paragraph' WHEN tag IN ({heads}) THEN 'heading'
         WHEN length(text) > {W.PARAGRAPH_MIN_CHARS} THEN 'paragraph' END AS kind,
    CASE WHEN is_mark AND admitted THEN NULL WHEN is_mark THEN 'NORMAL_TEXT'
         WHEN tag IN ({heads}) THEN 'HEADING_' || substr(tag, 2, 1) ELSE 'NORMAL_TEXT' END AS style,
    CASE WHEN is_mark AND admitted THEN NULL WHEN is_mark THEN '[画像: ' || image_url || ']' || chr(10)
         ELSE text END AS text
  FROM adm),
blk AS (
  SELECT page_id, kind, style, text, image_url,
         CAST(row_number() OVER (PARTITION BY page_id ORDER BY ord) AS INTEGER) AS ord
  FROM blk0 WHERE kind IS NOT NULL),
offs AS (
  SELECT *, CAST({W.DOC_START_INDEX} + coalesce(sum(CASE WHEN kind = 'image' THEN 2 ELSE length(text) + 2 END)
              OVER (PARTITION BY page_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
              AS INTEGER) AS start_index
  FROM blk),
offs2 AS (SELECT *, CAST(CASE WHEN kind = 'image' THEN NULL ELSE start_index + length(text) END AS INTEGER) AS end_index
          FROM offs)"""


def _a(select: str) -> str:
    return f"WITH {_articles_cte()}\n{select}"


def _edits_sql() -> str:
    return _a(f"""SELECT page_id, ord, 0 AS op_no, 'insertText' AS op, start_index, CAST(NULL AS INTEGER) AS end_index,
       text || chr(10) || chr(10) AS text, CAST(NULL AS VARCHAR) AS style FROM offs2 WHERE kind <> 'image'
UNION ALL
SELECT page_id, ord, 1, 'updateParagraphStyle', start_index, end_index, NULL, style FROM offs2 WHERE kind <> 'image'
UNION ALL
SELECT page_id, ord, 0, 'insertInlineImage', start_index, NULL, image_url, '{W.IMAGE_WIDTH_PT}x{W.IMAGE_HEIGHT_PT}pt'
FROM offs2 WHERE kind = 'image'
UNION ALL
SELECT page_id, ord, 1, 'insertText', start_index + 1, NULL, chr(10), NULL FROM offs2 WHERE kind = 'image'""")


def _requests_sql() -> str:
    return f"""WITH req AS (
  SELECT url FROM pages
  UNION ALL
  SELECT 'https://unknown.example.com/missing/' || CAST(page_id AS VARCHAR) FROM pages WHERE page_id % 10 = 0)
SELECT r.url, 'popup' AS format_type, {S.q(W.DEFAULT_CATEGORY)} AS category, p.page_id, p.page_id IS NOT NULL AS has_page
FROM req r LEFT JOIN pages p ON p.url = r.url"""


def _key_sql(title: str) -> str:
    from .page_queries import _key_sql as k
    return k(title)


def _list_sql() -> str:
    k = "CAST(s_suppkey AS VARCHAR)"
    nl = "chr(10)"
    return f"""WITH l AS (
  SELECT s_suppkey AS page_id, 0 AS n, 'Goods of ' || s_name || {nl} || {nl} AS text, 'HEADING_2' AS style FROM supplier
  UNION ALL SELECT s_suppkey, 1, '• Item ' || {k} || '-1' || {nl}, 'NORMAL_TEXT' FROM supplier
  UNION ALL SELECT s_suppkey, 2, '• Item ' || {k} || '-2' || {nl}, 'NORMAL_TEXT' FROM supplier
  UNION ALL SELECT s_suppkey, 3, {nl}, 'NORMAL_TEXT' FROM supplier
  UNION ALL SELECT s_suppkey, 4, '• Step one' || {nl}, 'NORMAL_TEXT' FROM supplier
  UNION ALL SELECT s_suppkey, 5, {nl}, 'NORMAL_TEXT' FROM supplier
  UNION ALL SELECT s_suppkey, 6, 'Contact ' || s_name || ' for details.' || {nl} || {nl}, 'NORMAL_TEXT' FROM supplier
  UNION ALL SELECT s_suppkey, 7, 'Limited edition' || {nl} || {nl}, 'NORMAL_TEXT' FROM supplier
  UNION ALL SELECT s_suppkey, 8, '• Loose item' || {nl}, 'NORMAL_TEXT' FROM supplier WHERE s_suppkey % 2 = 0)
SELECT page_id, CAST(n AS INTEGER) AS line_no, text, style, CAST(start AS INTEGER) AS start_index,
       CASE WHEN style <> 'NORMAL_TEXT' THEN CAST(start + length(text) AS INTEGER) END AS end_index
FROM (SELECT *, 1 + coalesce(sum(length(text)) OVER (PARTITION BY page_id ORDER BY n
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l)"""


_OUTCOME = ("CASE WHEN page_id % 18 = 0 THEN 'a document is locked' WHEN page_id % 9 = 0 THEN 'quota exceeded' END")

_FILLED = "'[画像1: ' || r.url || ']'"

ORACLE = {
    "request_pages": _requests_sql(),
    "merge_generations": _a("SELECT page_id, content FROM arts"),
    "structure_articles": _a(f"SELECT page_id, title, source_url, {S.q(W.GENERATED_AT)} AS generated_at, n_images, "
                             "error FROM arts"),
    "error_articles": _a("SELECT page_id, title, content FROM arts WHERE error"),
    "article_responses": _a(f"SELECT page_id, page_id % 9 <> 0 AS success, CASE WHEN page_id % 9 <> 0 THEN "
                            f"{_key_sql('title')} END AS docs_url, CASE WHEN page_id % 9 <> 0 THEN "
                            f"{S.q(W.SUCCESS_MESSAGE)} END AS message, {_OUTCOME} AS error FROM arts"),
    "article_elements": _a("SELECT page_id, CAST(ord AS INTEGER) AS ord, tag, text FROM el"),
    "element_filter": _a("SELECT page_id, CAST(kord AS INTEGER) AS ord, tag, text FROM kord"),
    "is_placeholder": _a("SELECT page_id, CAST(kord AS INTEGER) AS ord, is_mark FROM kord"),
    "assign_images": _a("SELECT page_id, CAST(mark_no AS INTEGER) AS mark_no, image_url FROM wimg "
                        "WHERE image_url IS NOT NULL"),
    "image_fallback_text": _a("SELECT page_id, image_url, text FROM blk WHERE image_url IS NOT NULL "
                              "AND kind = 'paragraph'"),
    "block_style": _a("SELECT page_id, ord, kind, style, text, image_url FROM blk"),
    "block_offsets": _a("SELECT page_id, ord, kind, start_index, end_index FROM offs2"),
    "document_edits": _edits_sql(),
    "article_stats": _a("SELECT page_id, page_id % 9 <> 0 AS success, CASE WHEN page_id % 9 <> 0 THEN "
                        "CAST(length(content) AS INTEGER) END AS content_length, CASE WHEN page_id % 9 <> 0 THEN "
                        f"n_images END AS images_processed, {_OUTCOME} AS error FROM arts"),
    "list_blocks": _list_sql(),
    # by hand: of the marks of these articles, only the first four are patterns; the counters only matter past the first
    "fill_marks": _a(f"""SELECT a.page_id, CASE WHEN r.url IS NULL THEN content ELSE replace(replace(replace(content,
  {S.q(W.PLACEHOLDER_MARKS[0])}, {_FILLED}), {S.q(W.PLACEHOLDER_MARKS[1])}, {_FILLED}),
  {S.q(W.PLACEHOLDER_MARKS[2])}, {_FILLED}) END AS filled
FROM arts a LEFT JOIN ranked r ON r.page_id = a.page_id AND r.pos = 1"""),
}
