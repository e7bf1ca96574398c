"""Constructed inputs derived from the driver's tables (FIXTURES.md section 3).

The driver's pages carry no images, tables or generated articles, so these
builders derive such inputs from ``part`` and ``supplier`` with Spark
expressions. The oracle SQL derives the *expected* rows from the same source
columns without any HTML, so the check covers parse + operators end to end.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import words as W
from .tables import read_table


def _s(c) -> Column:
    return c.cast("string")


# ---------------------------------------------------------------- gallery

#: Opening tag of the main box by page_id % 12, one for each selector that can win; the other pages have none.
MAIN_BOXES = ["<main>", "<article>", '<div class="content">', '<div class="main-content">', '<div class="article-content">',
              '<div class="post-content">', '<div class="entry-content">', '<div id="content">', '<div id="main">',
              '<div id="article">']


def gallery_rows(spark: SparkSession, sf_dir: str, rendered: bool = False) -> DataFrame:
    """One row per image: page_id, pos, k, zone of its container, markup."""
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_name"])
    k = F.col("p_partkey")
    page_id = F.floor(k / 20).cast("bigint")
    df = p.select(k.alias("k"), page_id.alias("page_id"), (k % 20).cast("int").alias("pos"),
                  F.replace(F.col("p_name"), F.lit(" "), F.lit("-")).alias("slug"))
    if rendered:
        df = df.filter(F.col("page_id") % 5 == 4)
    k, pid, slug = F.col("k"), F.col("page_id"), F.col("slug")
    rich = pid % 6 == 1  # pages with many good images, where the final cap bites
    v = F.when(rich, F.lit(0)).otherwise(k % 8)
    # pages that come out thin before they are rendered: these images are placeholders that I3 rejects
    thin = F.lit(False) if rendered else (pid % 5 == 4) & (F.col("pos") < 15)
    zone = (F.when((F.col("pos") <= 10) & (pid % 12 < len(MAIN_BOXES)), F.lit(1))
             .when(F.col("pos").between(11, 14), F.lit(2))
             .when(F.col("pos") <= 10, F.lit(3))
             .otherwise(F.lit(4)))  # 3: plain div before goods, 4: plain div after goods
    src = (F.when(thin, F.concat(F.lit('src="/wait/spinner-'), _s(k), F.lit('.gif"')))
            .when(v == 0, F.concat(F.lit('src="https://cdn.example.net/large/'), slug, F.lit("-"), _s(k), F.lit('.jpg"')))
            .when(v == 1, F.concat(F.lit('src="/media/'), slug, F.lit("_"), _s(k), F.lit('_800x600.png"')))
            .when(v == 2, F.concat(F.lit('src="photo/'), slug, F.lit('.webp"')))
            .when(v == 3, F.concat(F.lit('src="//img.example.org/thumb/'), _s(k), F.lit('.gif"')))
            .when(v == 4, F.concat(F.lit('src="data:image/png;base64,AAAA" data-src="https://cdn.example.net/full/'),
                                       _s(k), F.lit('.jpg"')))
            .when(v == 5, F.concat(F.lit('src="/icons/logo-'), _s(k), F.lit('.svg"')))
            .when(v == 6, F.concat(F.lit('srcset="/gallery/'), _s(k), F.lit("-400.jpg 400w, /gallery/"), _s(k),
                                       F.lit('-800.jpg 800w"')))
            .otherwise(F.lit('src="https://cdn.example.net/banner/new.jpg"')))
    alt = F.when(rich | (k % 3 == 0), F.lit(' alt="New goods"')).otherwise(F.lit(' alt=""'))
    cls = (F.when(k % 4 == 0, F.lit(' class="hero"')).when(k % 4 == 1, F.lit(' class="thumb"'))
            .when(k % 4 == 2, F.lit(' class="header-logo"')).otherwise(F.lit("")))
    size = (F.when(k % 5 == 0, F.lit(' width="600" height="400"')).when(k % 5 == 1, F.lit(' width="250" height="100"'))
             .when(k % 5 == 2, F.lit(' width="80" height="80"')).when(k % 5 == 3, F.lit(' width="100%" height="50"'))
             .otherwise(F.lit("")))
    markup = F.concat(F.lit("<img "), src, alt, cls, size, F.lit(">"))
    host = F.concat(F.lit("https://shop"), _s(pid % 7), F.lit(".example.com"))
    expected = (F.when(thin, F.concat(host, F.lit("/wait/spinner-"), _s(k), F.lit(".gif")))
                 .when(v == 0, F.concat(F.lit("https://cdn.example.net/large/"), slug, F.lit("-"), _s(k), F.lit(".jpg")))
                 .when(v == 1, F.concat(host, F.lit("/media/"), slug, F.lit("_"), _s(k), F.lit("_800x600.png")))
                 .when(v == 2, F.concat(host, F.lit("/goods/"), _s(pid), F.lit("/photo/"), slug, F.lit(".webp")))
                 .when(v == 3, F.concat(F.lit("https://img.example.org/thumb/"), _s(k), F.lit(".gif")))
                 .when(v == 4, F.lit("data:image/png;base64"))
                 .when(v == 5, F.concat(host, F.lit("/icons/logo-"), _s(k), F.lit(".svg")))
                 .when(v == 6, F.concat(host, F.lit("/gallery/"), _s(k), F.lit("-400.jpg")))
                 .otherwise(F.lit("https://cdn.example.net/banner/new.jpg")))
    return df.select("page_id", "pos", "k", zone.alias("box"), markup.alias("markup"),
                     expected.alias("expected_src"))


def page_url(page_id: Column) -> Column:
    return F.concat(F.lit("https://shop"), _s(page_id % 7), F.lit(".example.com/goods/"), _s(page_id),
                    F.lit("/index.html"))


def gallery_pages(spark: SparkSession, sf_dir: str, rendered: bool = False) -> DataFrame:
    """Gallery pages ``(page_id, url, html)``: images in pos order, in main / goods / plain boxes."""
    rows = gallery_rows(spark, sf_dir, rendered)
    g = rows.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("pos", "box", "markup"))).alias("imgs"))
    pid = F.col("page_id")

    def box(n):
        return F.array_join(F.transform(F.filter(F.col("imgs"), lambda x: x["box"] == n), lambda x: x["markup"]), "")

    og = F.when(pid % 2 == 0, F.concat(F.lit('<meta property="og:image" content="https://cdn.example.net/image/og-'),
                                       _s(pid), F.lit('.jpg">'))).otherwise(F.lit(""))
    tw = F.when(pid % 4 == 0, F.concat(F.lit('<meta name="twitter:image" content="https://cdn.example.net/image/tw-'),
                                       _s(pid), F.lit('.png">'))).otherwise(F.lit(""))
    tags = F.array(*[F.lit(t) for t in MAIN_BOXES])
    tag = F.get(tags, (pid % 12).cast("int"))
    main = F.when(tag.isNotNull(), F.concat(tag, box(1), F.lit("</"), F.regexp_extract(tag, "^<([a-z]+)", 1), F.lit(">"))
                  ).otherwise(F.concat(F.lit("<div>"), box(3), F.lit("</div>")))
    # every article class has its turn; on odd pages the box stands in another area
    goods = F.concat(F.lit('<div class="'), F.get(F.array(*map(F.lit, W.ARTICLE_AREA_CLASSES)), (pid % 18).cast("int")),
                     F.lit('">'), box(2), F.lit("</div>"))
    goods = F.when(pid % 2 == 1, F.concat(F.lit('<section class="gallery">'), goods, F.lit("</section>"))).otherwise(goods)
    html = F.concat(
        F.lit("<!DOCTYPE html><html><head><title>Gallery "), _s(pid), F.lit("</title>"), og, tw,
        F.lit("</head><body><h1>Goods "), _s(pid), F.lit("</h1>"), main,
        goods,
        F.lit("<div>"), box(4), F.lit("</div>"),
        F.lit("<div style=\"background-image: url('https://cdn.example.net/media/bg-"), _s(pid),
        F.lit(".jpg')\"><p>Visit us</p></div></body></html>"))
    return g.select("page_id", page_url(pid).alias("url"), html.alias("html"))


def gallery_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downloads tried, ``(url, content_type, content_length, ok)``: none for every 11th src, a failed one for
    every 13th, and a failed try before a good one for every 17th."""
    rows = gallery_rows(spark, sf_dir)
    first = rows.groupBy(F.col("expected_src").alias("url")).agg(F.min("k").alias("k"))
    k = F.col("k")
    ctype = (F.when(k % 6 == 0, F.lit("image/jpeg")).when(k % 6 == 1, F.lit("image/png"))
              .when(k % 6 == 2, F.lit("image/gif")).when(k % 6 == 3, F.lit("image/webp"))
              .when(k % 6 == 4, F.lit("text/html")).otherwise(F.lit("")))
    size = F.when(k % 7 != 0, k * 100000)
    once = first.filter(k % 11 != 0).select("k", "url", ctype.alias("content_type"), size.cast("bigint").alias("content_length"),
                                            (k % 13 != 0).alias("ok"))
    failed = once.filter(k % 17 == 0).withColumn("ok", F.lit(False))
    return once.unionByName(failed).drop("k")


# ---------------------------------------------------------------- articles

def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated responses for gallery pages: none when page_id % 4 = 0, an error when = 1, else a short article
    with a class to skip, a nested paragraph, one of the image marks, and texts that are too short."""
    pages = gallery_pages(spark, sf_dir).select("page_id")
    pid = F.col("page_id")
    mark = F.get(F.array(*map(F.lit, W.PLACEHOLDER_MARKS)), (pid % len(W.PLACEHOLDER_MARKS)).cast("int"))
    resp = F.concat(F.lit("<h2>Title "), _s(pid), F.lit('</h2><div class="loads">Text that goes</div><div><p>Body text for page '),
                    _s(pid), F.lit(".</p></div><div>"), mark, F.lit("</div><p>short</p><p>ab</p>"))
    return (pages.filter(pid % 4 != 0)
            .select("page_id", F.when(pid % 4 == 1, F.lit(None)).otherwise(resp).cast("string").alias("response"),
                    (pid % 4 == 1).alias("error")))


def requests_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests: every page's url, plus one unknown url per ten pages (no page)."""
    p = read_table(spark, sf_dir, "pages", ["page_id", "url"])
    known = p.select("url")
    unknown = p.filter(F.col("page_id") % 10 == 0).select(
        F.concat(F.lit("https://unknown.example.com/missing/"), _s(F.col("page_id"))).alias("url"))
    return known.unionByName(unknown).withColumn("format_type", F.lit("popup"))


def write_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What came of writing the gallery pages' documents: every ninth failed, and some of those twice."""
    pages = gallery_pages(spark, sf_dir).select("page_id")
    pid = F.col("page_id")
    first = pages.filter(pid % 3 == 0).select("page_id", F.when(pid % 9 == 0, F.lit("quota exceeded")).alias("error"))
    again = pages.filter(pid % 18 == 0).select("page_id", F.lit("a document is locked").alias("error"))
    return first.unionByName(again)


def timed(pages: DataFrame, delay: int = 0) -> DataFrame:
    """The pages with an event time: a second apart by page_id, and ``delay`` seconds later."""
    return pages.withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000 + delay) + F.col("page_id")))


#: Words that put a page in another class each.
CLASS_WORDS = ["", "カフェ", "game", "anime"]


def changed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gallery pages as changes ``(page_id, url, html, at, deleted, part)``: all of them in part 0; in part 1 every
    fifth in another class, and every seventh deleted; in part 2 an older record of every fourth, and every other
    deleted one back."""
    p = timed(gallery_pages(spark, sf_dir))
    k = F.col("page_id")

    def change(of, part, later, shift=0, deleted=False):
        word = F.get(F.array(*map(F.lit, CLASS_WORDS)), ((k + shift) % len(CLASS_WORDS)).cast("int"))
        html = F.concat("html", F.lit("<p>"), word, F.lit("</p>"))
        return p.filter(of).select("page_id", "url", (F.lit(None).cast("string") if deleted else html).alias("html"),
                                   F.timestamp_seconds(F.unix_timestamp("at") + later).alias("at"),
                                   F.lit(deleted).alias("deleted"), F.lit(part).alias("part"))

    out = change(F.lit(True), 0, 0)
    for other in (change(k % 5 == 0, 1, 1000, 1), change(k % 7 == 0, 1, 1500, deleted=True),
                  change(k % 4 == 0, 2, -10, 2), change(k % 14 == 0, 2, 2000, 3)):
        out = out.unionByName(other)
    return out


def stream_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests ``(request_id, url, format_type, at, part)``: one for each page, every fourth twice in its part, every
    fifth again in the next part; urls that have no page, and some that are none."""
    p = read_table(spark, sf_dir, "pages", ["page_id", "url"])
    k = F.col("page_id")
    url = F.when(k % 7 == 3, F.concat(F.lit("https://unknown.example.com/"), _s(k))).when(
        k % 7 == 5, F.lit("no url")).otherwise(F.col("url"))
    one = timed(p).select(_s(k).alias("request_id"), url.alias("url"), F.lit("popup").alias("format_type"), "at",
                          (k % 2).alias("part"), k.alias("k"))
    again = one.filter(k % 4 == 0).unionByName(one.filter(F.col("k") % 5 == 0).withColumn("part", F.col("part") + 1))
    return one.unionByName(again).drop("k")


def list_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with lists and inline tags, one per supplier (for D11)."""
    s = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_name"])
    k = _s(F.col("s_suppkey"))
    html = F.concat(
        F.lit("<h2>Goods of "), F.col("s_name"), F.lit("</h2><ul><li>Item "), k, F.lit("-1</li><li> </li><li>Item "), k,
        F.lit("-2</li></ul><ol><li>Step one</li></ol><p>Contact "), F.col("s_name"),
        F.lit(" for details.</p><span>abc</span><em>Limited edition</em>"),
        F.when(F.col("s_suppkey") % 2 == 0, F.lit("<li>Loose item</li>")).otherwise(F.lit("")))
    return s.select(F.col("s_suppkey").alias("page_id"), html.alias("content"))


def info_table_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per supplier a page with an exact-class info table and a wider one to ignore."""
    s = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_name"])
    k = F.col("s_suppkey")

    def row(th, td):
        return F.concat(F.lit("<tr><th>"), th, F.lit("</th><td>"), td, F.lit("</td></tr>"))

    table = F.concat(
        F.lit('<table class="event-info-table">'),
        row(F.lit("公式サイト"), F.concat(F.lit("https://s"), _s(k), F.lit(".example.com"))),
        row(F.lit("開催場所"), F.col("s_name")),
        row(F.lit("開催期間"), F.lit("2025")),
        F.when(k % 3 == 0, F.lit("<tr><th>アクセス</th></tr>")).when(k % 3 == 1, row(F.lit("アクセス・地図"), F.lit("駅前")))
         .otherwise(F.lit("")),
        F.when(k % 2 == 0, row(F.lit("お問い合わせ"), F.concat(F.lit("窓口"), _s(k)))).otherwise(F.lit("")),
        F.lit("</table>"))
    wide = F.concat(F.lit('<table class="event-info-table wide">'), row(F.lit("お問い合わせ"), F.col("s_name")),
                    F.lit("</table>"))
    html = F.concat(F.lit("<h2>Event "), _s(k), F.lit("</h2><p>Intro text.</p>"), table, F.lit("<p>Outro.</p>"), wide)
    return s.select(k.alias("page_id"), html.alias("content"))


def event_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured event facts per supplier."""
    s = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_name"])
    k = F.col("s_suppkey")
    maker = F.when(k % 5 == 0, F.lit("株式会社A3")).when(k % 5 == 1, F.lit("TSUTAYA")).otherwise(F.col("s_name"))
    start = F.date_add(F.to_date(F.lit("2025-01-01")), (k % 300).cast("int"))
    return s.select(
        k.alias("event_id"),
        F.concat(F.lit("作者"), _s(k)).alias("author"),
        F.concat(F.lit("作品"), _s(k)).alias("work"),
        maker.alias("maker"),
        F.concat(F.lit("店舗"), _s(k % 17)).alias("venue"),
        start.alias("start_date"),
        F.date_add(start, 14).alias("end_date"),
        ((k % 4 + 1) * 1100).cast("int").alias("price"),
        F.concat(F.lit("特典カード"), _s(k % 9)).alias("novelty"),
        (k % 6 + 2).cast("int").alias("kinds"),
        (k % 2 == 0).alias("has_illustration"),
        F.concat(F.lit("キャラA"), _s(k), F.lit("・キャラB"), _s(k), F.lit("・キャラC"), _s(k)).alias("characters"),
        F.concat(F.lit("https://s"), _s(k), F.lit(".example.com/event")).alias("official_url"),
        F.concat(F.lit("https://goo.gl/maps/"), _s(k)).alias("map_url"),
        F.concat(F.lit("https://twitter.com/s"), _s(k), F.lit("/status/"), _s(k * 7)).alias("twitter_url"),
    )


# ---------------------------------------------------------------- broken and odd pages

def broken_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with every 10th broken, by page_id modulo 30: markup that no tokenizer takes (0), an image url
    with one bracket (10), a page url with one bracket (20)."""
    p = read_table(spark, sf_dir, "pages", ["page_id", "url", "html"])
    part = F.col("page_id") % 30
    html = (F.when(part == 0, F.concat(F.col("html"), F.lit("<![foo[x]]>")))
             .when(part == 10, F.concat(F.lit('<img src="ftp://[x">'), F.col("html"))).otherwise(F.col("html")))
    return p.select("page_id", F.when(part == 20, F.lit("https://[bad/y")).otherwise(F.col("url")).alias("url"),
                    html.alias("html"))


#: Ends the Japanese pages; kana and kanji as they are mixed in prose.
JAPANESE = "<p>これは日本語のページです。カフェで新しいグッズを紹介します。</p>"


@F.arrow_udf(T.BinaryType())
def _encoded(text: pa.Array, charset: pa.Array) -> pa.Array:
    return pa.array([None if t is None else t.encode(c) for t, c in zip(text.to_pylist(), charset.to_pylist())], pa.binary())


def byte_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as bytes, by page_id modulo 8: UTF-8 without (0) and with a mark (1), UTF-16 with a mark (2),
    declared Latin-1 (3), Shift_JIS in a meta element (4), EUC-JP in an XML prolog (5) and undeclared (6),
    Shift_JIS undeclared or, on every other page, bytes of no charset (7)."""
    p = read_table(spark, sf_dir, "pages", ["page_id", "url", "html"])
    part, html = F.col("page_id") % 8, F.col("html")
    plain = F.regexp_replace(html, "[^\\x00-\\x7F]", "")
    western = F.regexp_replace(html, "[^\\x00-\\x7F\\xA0-\\xFF]", "")
    japanese = F.concat(plain, F.lit(JAPANESE))
    body = lambda x: F.encode(x, "UTF-8")
    out = (F.when(part == 1, F.concat(F.unhex(F.lit("EFBBBF")), body(html)))
            .when(part == 2, F.encode(html, "UTF-16"))
            .when(part == 3, F.concat(body(F.lit('<meta charset="ISO-8859-1">')), _encoded(western, F.lit("latin-1"))))
            .when(part == 4, F.concat(body(F.lit('<META http-equiv="Content-Type" content="text/html; charset=Shift_JIS">')),
                                      _encoded(japanese, F.lit("cp932"))))
            .when(part == 5, F.concat(body(F.lit('<?xml version="1.0" encoding="EUC-JP"?>')),
                                      _encoded(japanese, F.lit("euc_jp"))))
            .when(part == 6, _encoded(japanese, F.lit("euc_jp")))
            .when(F.col("page_id") % 16 == 7, _encoded(japanese, F.lit("cp932")))
            .when(part == 7, F.concat(body(plain), F.unhex(F.lit("8D819D")))).otherwise(body(html)))
    return p.select("page_id", "url", out.alias("html"))


def odd_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' urls with unusual but valid, and invalid, endings and beginnings, by page_id modulo 8."""
    p = read_table(spark, sf_dir, "pages", ["page_id", "url"])
    part, u = F.col("page_id") % 8, F.col("url")
    odd = (F.when(part == 1, F.concat(u, F.lit("/a b"))).when(part == 2, F.concat(u, F.lit("/x|y")))
            .when(part == 3, F.concat(u, F.lit("/100%"))).when(part == 4, F.concat(F.lit("no scheme "), u))
            .when(part == 5, F.lit("")).when(part == 6, F.concat(F.lit("https://a b.example/"), _s(F.col("page_id"))))
            .when(part == 7, F.concat(F.lit("https://h:9x/"), _s(F.col("page_id")))).otherwise(u))
    return p.select("page_id", odd.alias("url"))


def field_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per supplier whose title, description and text area come from another place for each s_suppkey % 8."""
    s = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_name"])
    k, name = F.col("s_suppkey"), F.col("s_name")
    part = k % 8
    heads = ["<title> Page {n} </title>", '<meta property="og:title" content=" Graph {n} ">', "<title>Page {n}</title>",
             '<title>Page {n}</title><meta property="og:description" content="Graph text {n}">',
             '<title>Page {n}</title><meta name="description" content=" Meta text {n} ">', "", "<title>Page {n}</title>", ""]
    bodies = ["<main>Main {n}<nav>menu</nav></main><p>First {n}</p>", "<article>Article {n}</article>",
              '<h1></h1><div class="My-CONTENT-box">Box {n}<script>x</script></div>', '<h1>Head {n}</h1><div id="mainpart">Part {n}</div>',
              "<h1>Head {n}</h1><p>First {n}</p>", "<h1>Head {n}</h1><p>" + "long {n} " * 40 + "</p>",
              "<div class='other'>Other {n}</div>", "plain {n}"]
    def text(parts):
        out = None
        for i, t in enumerate(parts):
            c = F.replace(F.lit(t), F.lit("{n}"), name)
            out = F.when(part == i, c) if out is None else out.when(part == i, c)
        return out
    return s.select(k.alias("page_id"), F.concat(F.lit("https://s.example.com/"), _s(k)).alias("url"),
                    F.concat(text(heads), text(bodies)).alias("html"))
