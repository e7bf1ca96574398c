"""Structured event facts to popup-article HTML (a written specification).

The article is fixed text with slots; three parts vary: the meta text and the
lead change with "has new illustration", and the gift wording changes when the
maker is one of two named companies. The sheet gives the gift sentence of those
makers without an opening; it takes the place of the lead's second sentence. Templates use ``{slot}`` names; the same
template list renders to a Spark ``concat`` and to SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import words as W

# ---- FIXED VALUES: popup article templates (from the written format sheet) ----
SPECIAL_MAKERS = ["株式会社A3", "TSUTAYA"]
IMAGE_DIV = '<div class="l-center l-padding-t-1em l-margin-b-1em">\n-適切な画像を挿入ー\n</div>\n'
AD_DIV = ('<div class="l-center l-padding-t-1em l-margin-b-1em">\n'
          '<span class="f-size12px">以下広告のあとに記事が続きます</span>\n</div>\n<moreads>広告表示</moreads>\n')
BANNER = '[sc name="oshibuta-banner"][/sc]\n'
TITLE = "{event}、{start_md}より、{venue}にて開催！"
OPENING = "{author}先生による人気漫画を原作としたアニメ「{work}」× {maker}のポップアップストアが、{venue}にて{period}まで開催される。"
META_ILLUST = OPENING + "アニメ「{work}」ポップアップストアでは、描き下ろしイラストを使用した新作グッズが多数ラインナップ!"
META_PLAIN = OPENING + "アニメ「{work}」ポップアップストアでは、{characters}らの描き下ろしイラストを使用した新作グッズが多数ラインナップ！"
LEAD_ILLUST = (OPENING + "\nアニメ「{work}」ポップアップストアでは、イベント限定の描き下ろしイラストを使用した新作グッズが多数販売される他、"
               "グッズをお買い上げ{price}円(税込)ごとに特典として描き下ろしノベルティ「{novelty} 全{kinds}種」をランダムに1枚プレゼント!")
LEAD_PLAIN = (OPENING + "\n「{event}」ポップアップストアでは、作品に登場する人気キャラクターたちのアニメビジュアルを使用したグッズが多数販売される他、"
              "「{work}」関連商品を含めて、{price}円(税込)お買い上げ毎に特典として「{novelty} (全{kinds}種)」をランダムに1枚プレゼント!")
LEAD_SPECIAL = (OPENING + "\nアニメ「{work}」新商品を含めて関連商品を{price}円(税込)以上お買い上げの方に、"
                "特典として描き下ろしノベルティ「{novelty} 全{kinds}種」を1会計につき1枚プレゼント!")
GOODS_ILLUST = "{start}より「{venue}」にて、アニメ「{work}」の描き下ろしグッズを販売するポップアップストアを開催!"
GOODS_PLAIN = "{start}より「{venue}」にて、「{work}」のポップアップストアを開催!"
NOVELTY_NORMAL = "「{work}」ポップアップストアにて、グッズをお買い上げ{price}円毎に特典として「{novelty} 全{kinds}種」がランダムに1枚プレゼントされる。"
NOVELTY_SPECIAL = ("「{work}」ポップアップストアにて新商品を含めて関連商品を{price}円(税込)以上お買い上げの方に、"
                   "特典として描き下ろしノベルティ「{novelty} 全{kinds}種」が1会計につき1枚ランダムにプレゼントされる。")
ARTICLE = (
    "<h2>メタディスクリプション</h2>\n<p>{meta}</p>\n"
    "<h2>リード文</h2>\n<p>{lead}</p>\n" + BANNER +
    "<h2>{event} ポップアップストア in {venue}のグッズ</h2>\n<p>{goods}</p>\n"
    "<h3>グッズラインナップ</h3>\n" + IMAGE_DIV + AD_DIV +
    "<h2>{work} ポップアップストア in {venue}のノベルティー</h2>\n<p>{novelty_text}</p>\n"
    "<h3>お買い上げ特典 - {novelty} 全{kinds}種/ランダム</h3>\n" + IMAGE_DIV +
    '<h2 id="pop-up-summary">{work} ポップアップストア in {venue} {start_md}より開催!</h2>\n' + IMAGE_DIV +
    '<div class="table__container">\n <table class="cc-table l-margin-b-2em">\n'
    '  <tr>\n   <th class="l-width-30percent">公式サイト</th>\n'
    '   <td><a href="{official_link}" target="_blank" class="cc__officiallink" rel="noopener noreferrer">特設ページ</a></td>\n  </tr>\n'
    "  <tr>\n   <th>開催場所</th>\n   <td>{venue}</td>\n  </tr>\n"
    "  <tr>\n   <th>開催期間</th>\n   <td>{period}</td>\n  </tr>\n"
    '  <tr>\n   <th>アクセス・地図</th>\n   <td><a href="{map_url}" target="_blank" rel="noopener noreferrer">'
    "Googleマップ</a>で見る</td>\n  </tr>\n"
    '  <tr>\n   <th>お問い合わせ</th>\n   <td><a href="{official_link}" target="_blank" class="cc__officiallink" '
    'rel="noopener noreferrer">{maker}</a>にお問い合わせください。</td>\n  </tr>\n </table>\n</div>\n' + AD_DIV +
    '<div class="l-center l-padding-t-1em l-width-80percent l-margin-b-1em">\n{twitter_url}\n</div>\n'
    "詳細は公式サイトをご確認ください。\n"
    '<span class="f-size12px">※記事の情報が古い場合がありますのでお手数ですが公式サイトの情報をご確認下さい。</span>\n'
    '<p class="f-size12px"><small>&copy; {work}</small></p>'
)
DATE_FORMAT = "yyyy年M月d日"
MONTH_DAY_FORMAT = "M月d日"

_SLOT = re.compile(r"\{(\w+)\}")


def template_pieces(t: str):
    """Split a template into literal strings (even positions) and slot names (odd)."""
    return _SLOT.split(t)


def render(t: str, slots: dict) -> Column:
    cols = []
    for i, piece in enumerate(template_pieces(t)):
        if i % 2:
            cols.append(slots[piece])
        elif piece:
            cols.append(F.lit(piece))
    return F.concat(*cols)


def popup_articles(facts: DataFrame) -> DataFrame:
    """``event_facts`` rows to ``(event_id, title, html)``."""
    c = F.col
    start = F.date_format(c("start_date"), DATE_FORMAT)
    slots = {
        "author": c("author"), "work": c("work"), "maker": c("maker"), "venue": c("venue"),
        "event": c("work"), "characters": c("characters"), "novelty": c("novelty"),
        "kinds": c("kinds").cast("string"), "price": F.format_number(c("price"), 0),
        "start": start, "start_md": F.date_format(c("start_date"), MONTH_DAY_FORMAT),
        "period": F.concat(start, F.lit("〜"), F.date_format(c("end_date"), MONTH_DAY_FORMAT)),
        "official_link": F.concat(c("official_url"), F.lit(W.UTM_PARAMS)),
        "map_url": c("map_url"), "twitter_url": c("twitter_url"),
    }
    special = c("maker").isin(*SPECIAL_MAKERS)
    illust = F.coalesce(c("has_illustration"), F.lit(False))
    slots["meta"] = F.when(illust, render(META_ILLUST, slots)).otherwise(render(META_PLAIN, slots))
    slots["lead"] = (F.when(special, render(LEAD_SPECIAL, slots))
                      .when(illust, render(LEAD_ILLUST, slots)).otherwise(render(LEAD_PLAIN, slots)))
    slots["goods"] = F.when(illust, render(GOODS_ILLUST, slots)).otherwise(render(GOODS_PLAIN, slots))
    slots["novelty_text"] = F.when(special, render(NOVELTY_SPECIAL, slots)).otherwise(render(NOVELTY_NORMAL, slots))
    return facts.select("event_id", render(TITLE, slots).alias("title"), render(ARTICLE, slots).alias("html"))
