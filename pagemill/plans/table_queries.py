"""Info-table queries (H2-H4) and the popup renderer (A6), over supplier fixtures."""

from __future__ import annotations

from ..functions import words as W
from ..operators import render as RD
from ..operators import tables as TB
from ..sources.fixtures import event_facts, info_table_pages
from . import sqltext as S


def q_info_table_rows(spark, sf_dir):
    return TB.info_table_rows(info_table_pages(spark, sf_dir))


def q_info_table_text(spark, sf_dir):
    return TB.info_table_text(info_table_pages(spark, sf_dir))


def q_info_summary(spark, sf_dir):
    return TB.info_summary(TB.info_table_rows(info_table_pages(spark, sf_dir)))


def q_render_popup_article(spark, sf_dir):
    return RD.popup_articles(event_facts(spark, sf_dir))


QUERIES = {
    "info_table_rows": q_info_table_rows,
    "info_table_text": q_info_table_text,
    "info_summary": q_info_summary,
    "render_popup_article": q_render_popup_article,
}

# ---------------------------------------------------------------- oracle side

_K = "CAST(s_suppkey AS VARCHAR)"


def _row(th: str, td: str) -> str:
    return f"'<tr><th>' || {th} || '</th><td>' || {td} || '</td></tr>'"


_SITE = f"'https://s' || {_K} || '.example.com'"
_DESK = f"'窓口' || {_K}"
_TABLE = (f"'<table class=\"event-info-table\">' || {_row(S.q('公式サイト'), _SITE)} || {_row(S.q('開催場所'), 's_name')} "
          f"|| {_row(S.q('開催期間'), S.q('2025'))} || CASE s_suppkey % 3 WHEN 0 THEN '<tr><th>アクセス</th></tr>' "
          f"WHEN 1 THEN {_row(S.q('アクセス・地図'), S.q('駅前'))} ELSE '' END || CASE WHEN s_suppkey % 2 = 0 THEN "
          f"{_row(S.q('お問い合わせ'), _DESK)} ELSE '' END || '</table>'")
_CONTENT = (f"'<h2>Event ' || {_K} || '</h2><p>Intro text.</p>' || {_TABLE} || '<p>Outro.</p>' || "
            f"'<table class=\"event-info-table wide\">' || {_row(S.q('お問い合わせ'), 's_name')} || '</table>'")
_NL = "chr(10)"
_TEXT = (f"{S.q(W.INFO_TABLE_HEADER)} || '■ 公式サイト: ' || {_SITE} || {_NL} || '■ 開催場所: ' || s_name || {_NL} "
         f"|| '■ 開催期間: 2025' || {_NL} || CASE WHEN s_suppkey % 3 = 1 THEN '■ アクセス・地図: 駅前' || {_NL} ELSE '' END "
         f"|| CASE WHEN s_suppkey % 2 = 0 THEN '■ お問い合わせ: ' || {_DESK} || {_NL} ELSE '' END || {_NL}")

_ROWS_SQL = f"""SELECT s_suppkey AS page_id, 0 AS t_idx, 0 AS row_no, '公式サイト' AS key, {_SITE} AS value FROM supplier
UNION ALL SELECT s_suppkey, 0, 1, '開催場所', s_name FROM supplier
UNION ALL SELECT s_suppkey, 0, 2, '開催期間', '2025' FROM supplier
UNION ALL SELECT s_suppkey, 0, 3, 'アクセス・地図', '駅前' FROM supplier WHERE s_suppkey % 3 = 1
UNION ALL SELECT s_suppkey, 0, CASE WHEN s_suppkey % 3 = 1 THEN 4 ELSE 3 END, 'お問い合わせ', {_DESK} FROM supplier
  WHERE s_suppkey % 2 = 0"""

_SUMMARY_SQL = (f"SELECT s_suppkey AS page_id, {_SITE} AS official_site, s_name AS location, '2025' AS period, "
                f"CASE WHEN s_suppkey % 3 = 1 THEN '駅前' END AS access, CASE WHEN s_suppkey % 2 = 0 THEN {_DESK} END AS contact, "
                f"{S.q(W.INFO_SUMMARY_HEADER)} || '■ 公式サイト: ' || {_SITE} || {_NL} || '■ 開催場所: ' || s_name || {_NL} "
                f"|| '■ 開催期間: 2025' || {_NL} || CASE WHEN s_suppkey % 3 = 1 THEN '■ アクセス: 駅前' || {_NL} ELSE '' END "
                f"|| CASE WHEN s_suppkey % 2 = 0 THEN '■ お問い合わせ: ' || {_DESK} || {_NL} ELSE '' END AS summary FROM supplier")


def _render_sql(t: str, slots: dict) -> str:
    out = []
    for i, piece in enumerate(RD.template_pieces(t)):
        if i % 2:
            out.append(slots[piece])
        elif piece:
            out.append(S.q(piece))
    return "concat(" + ", ".join(out) + ")"


def _popup_sql() -> str:
    start = "strftime(start_date, '%Y年%-m月%-d日')"
    slots = {
        "author": "author", "work": "work", "maker": "maker", "venue": "venue", "event": "work",
        "characters": "characters", "novelty": "novelty", "kinds": "CAST(kinds AS VARCHAR)",
        "price": "format('{:,}', price)", "start": start, "start_md": "strftime(start_date, '%-m月%-d日')",
        "period": f"{start} || '〜' || strftime(end_date, '%-m月%-d日')",
        "official_link": f"official_url || {S.q(W.UTM_PARAMS)}", "map_url": "map_url", "twitter_url": "twitter_url",
    }
    special = "maker IN (" + ", ".join(S.q(m) for m in RD.SPECIAL_MAKERS) + ")"
    slots["meta"] = (f"(CASE WHEN has_illustration THEN {_render_sql(RD.META_ILLUST, slots)} "
                     f"ELSE {_render_sql(RD.META_PLAIN, slots)} END)")
    slots["lead"] = (f"(CASE WHEN {special} THEN {_render_sql(RD.LEAD_SPECIAL, slots)} WHEN has_illustration THEN "
                     f"{_render_sql(RD.LEAD_ILLUST, slots)} ELSE {_render_sql(RD.LEAD_PLAIN, slots)} END)")
    slots["goods"] = (f"(CASE WHEN has_illustration THEN {_render_sql(RD.GOODS_ILLUST, slots)} "
                      f"ELSE {_render_sql(RD.GOODS_PLAIN, slots)} END)")
    slots["novelty_text"] = (f"(CASE WHEN {special} THEN {_render_sql(RD.NOVELTY_SPECIAL, slots)} "
                             f"ELSE {_render_sql(RD.NOVELTY_NORMAL, slots)} END)")
    return f"""WITH facts AS (
  SELECT s_suppkey AS event_id, '作者' || {_K} AS author, '作品' || {_K} AS work,
         CASE s_suppkey % 5 WHEN 0 THEN '株式会社A3' WHEN 1 THEN 'TSUTAYA' ELSE s_name END AS maker,
         '店舗' || CAST(s_suppkey % 17 AS VARCHAR) AS venue,
         DATE '2025-01-01' + CAST(s_suppkey % 300 AS INTEGER) AS start_date,
         DATE '2025-01-01' + CAST(s_suppkey % 300 AS INTEGER) + 14 AS end_date,
         CAST((s_suppkey % 4 + 1) * 1100 AS INTEGER) AS price, '特典カード' || CAST(s_suppkey % 9 AS VARCHAR) AS novelty,
         CAST(s_suppkey % 6 + 2 AS INTEGER) AS kinds, s_suppkey % 2 = 0 AS has_illustration,
         'キャラA' || {_K} || '・キャラB' || {_K} || '・キャラC' || {_K} AS characters,
         'https://s' || {_K} || '.example.com/event' AS official_url, 'https://goo.gl/maps/' || {_K} AS map_url,
         'https://twitter.com/s' || {_K} || '/status/' || CAST(s_suppkey * 7 AS VARCHAR) AS twitter_url
  FROM supplier)
SELECT event_id, {_render_sql(RD.TITLE, slots)} AS title, {_render_sql(RD.ARTICLE, slots)} AS html FROM facts"""


ORACLE = {
    "info_table_rows": _ROWS_SQL,
    "info_table_text": f"SELECT s_suppkey AS page_id, replace({_CONTENT}, {_TABLE}, {_TEXT}) AS text FROM supplier",
    "info_summary": _SUMMARY_SQL,
    "render_popup_article": _popup_sql(),
}
