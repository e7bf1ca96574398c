"""Unit goldens worked by hand from the original rules (FIXTURES.md section 4)."""

import pytest
from pyspark.sql import functions as F

from pagemill.functions.images import (background_urls, base_url_sql, chosen_src, image_importance, image_quality,
                                       resolve_url, uri_parts_sql, valid_image_url, valid_url)
from pagemill.functions.markup import article_key, clean_html
from pagemill.operators import blocks as BL
from pagemill.operators.dom import parse_html
from pagemill.operators.fields import add_content_type, page_fields


def one(spark, expr, **cols):
    schema = ", ".join(f"{k} string" for k in cols)
    row = spark.createDataFrame([tuple(cols.values())], schema) if cols else spark.range(1)
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("url,ok", [
    ("a.jpg", False),
    ("https://a.co/x.jpg", True),
    ("https://a.example/uploading/x.png", False),
    ("https://a.example/btn_ok.png", False),
    ("https://a.example/media/123", True),
    ("https://a.example/page.html", False),
])
def test_valid_image_url(spark, url, ok):
    assert one(spark, valid_image_url("u"), u=url) is ok


@pytest.mark.parametrize("url,score", [
    ("https://cdn.example.net/large/ring-10.jpg", 16),
    ("https://shop1.example.com/media/blue-bolt_1002_800x600.png", 16),
    ("https://a.example/thumbnail/tiny-small.jpg", 5),
    ("https://a.example/g/p/q/r/w640.jpg", 14),
    ("https://domain.example/News/x.png", 16),
])
def test_image_quality(spark, url, score):
    assert one(spark, image_quality("u"), u=url) == score


def test_image_importance(spark):
    from pagemill.functions import sqlexpr as X
    e = image_importance("alt", "cls", "pc", "pid", X.py_int("w"), X.py_int("h"))
    assert one(spark, e, alt="New goods", cls="hero featured", pc="", pid="", w="400", h="100") == 9
    assert one(spark, e, alt="", cls="header-logo", pc="", pid="", w=None, h=None) == -9
    assert one(spark, e, alt="", cls="", pc="", pid="", w="100%", h="50") == 0
    assert one(spark, e, alt="", cls="", pc="gallery main", pid="", w="80", h="80") == 0  # +2 parent, -2 size


def test_image_src_choice_and_resolution(spark):
    df = spark.createDataFrame(
        [({"src": "", "data-src": "/a,b.jpg"},), ({"srcset": "/a.jpg 2x"},),
         ({"src": "data:image/png;base64,AAAA", "data-src": "https://x/y.jpg"},), ({"src": "//img.e.org/t.gif"},)],
        "attrs map<string,string>")
    out = df.select(chosen_src("attrs").alias("raw")).select(
        "raw", resolve_url("'https://a.example/x/index.html'", "raw").alias("url")).collect()
    assert [r["raw"] for r in out] == ["/a", "/a.jpg 2x", "data:image/png;base64", "//img.e.org/t.gif"]
    assert [r["url"] for r in out] == ["https://a.example/a", "https://a.example/a.jpg 2x",
                                       "data:image/png;base64", "https://img.e.org/t.gif"]


def test_background_regex_runs_on(spark):
    got = one(spark, background_urls(F.col("s")), s="background-image:url(a.jpg); b:url(c.jpg)")
    assert got == ["a.jpg); b:url(c.jpg"]


def test_title_and_description(spark):
    df = spark.createDataFrame([(1, "https://a.example/", "<h1></h1><title>T</title><p>Hi</p>")],
                               "page_id long, url string, html string")
    r = page_fields(parse_html(df)).first()
    assert r["title"] == "T"
    assert r["description"] == "Hi..."


def test_content_type_order(spark):
    df = spark.createDataFrame([("アニメ game",), ("Cafe anime",), (None,)], "t string")
    got = [r["content_type"] for r in add_content_type(df, "t").collect()]
    assert got == ["novel_game", "cafe", "general"]


def test_block_class_filter_and_offsets(spark):
    df = spark.createDataFrame(
        [(1, ["u1"], [True], '<p class="loads">some long text here</p><h2>abc</h2><div>IMAGE_PLACEHOLDER</div>'
                             "<p>xyz, and some more</p><p>[画像</p>")],
        "page_id long, images array<string>, admitted array<boolean>, content string")
    dom = parse_html(df, html_col="content")
    assert [r["text"] for r in BL.article_elements(dom).orderBy("seq").collect()] == [
        "abc", "IMAGE_PLACEHOLDER", "xyz, and some more", "[画像"]
    o = BL.article_blocks(dom).orderBy("seq").collect()
    assert [r["kind"] for r in o] == ["heading", "image", "paragraph"]  # the second mark has no image left
    assert [r["start_index"] for r in o] == [1, 6, 8]
    assert [r["end_index"] for r in o] == [4, None, 26]


def test_resolution_equals_the_standard_join(spark):
    from urllib.parse import urljoin, urlparse
    bases = ["https://a.example/x/index.html", "http://a.example", "https://a.example/d/e/?q=1#f", "https://u@h:80/p;x?y",
             "", "page.html", "/only/path", "mailto:x@y", "ftp://f.example/a/b/../c", "HTTPS://A.example/b//c/d"]
    urls = ["//c.example/z.gif", "http:x", "?q=2", "#frag", "?", "#", "g?y#s", "data:image/png;base64", "ftp://x/y",
            "ftp:rel", " /lead.png", "a\tb\n.png", "/", "/..", "../../../g", "./", "..", "g;x=1/../y", "x:y/z", "/a//b/../c",
            "a//b", "..//..//g", "é ü.jpg", "./.", "a/./b/../../c?d/../e#f/../g"]
    rows = [(b, u) for b in bases for u in urls]
    got = spark.createDataFrame(rows, "b string, u string").select("b", "u", resolve_url("b", "u").alias("x")).collect()
    for r in got:
        b, u = r["b"], r["u"]
        want = u if u.startswith("http") else f"{urlparse(b).scheme}:{u}" if u.startswith("//") else urljoin(b, u)
        assert r["x"] == want, (b, u, r["x"], want)


def test_base_url_and_url_check_by_syntax(spark):
    rows = {"https://a.example/a b": (True, "https://a.example"), "https://a.example/x|y": (True, "https://a.example"),
            "https://a.example/100%": (True, "https://a.example"), "HTTP://A.example:8/": (True, "http://A.example:8"),
            "": (False, "://"), "no scheme": (False, "://"), "https://": (False, "https://"), "mailto:a@b": (True, "mailto://"),
            "http://[bad/y": (False, "http://[bad"), "http://[::1]/y": (True, "http://[::1]"), "https://h:9x/": (False, "https://h:9x")}
    df = spark.createDataFrame([(u,) for u in rows], "u string")
    parts = f"transform(array({uri_parts_sql('u')}), p -> {base_url_sql('p')})[0]"
    got = {r["u"]: (r["v"], r["b"]) for r in df.select("u", valid_url(F.col("u")).alias("v"), F.expr(parts).alias("b")).collect()}
    assert got == rows


def test_article_key(spark):
    got = one(spark, article_key(F.col("t"), F.to_timestamp(F.lit("2025-01-01 00:00:00"))), t="A: B/C　D")
    assert got == "20250101_0000_A_BC_D"


@pytest.mark.parametrize("content,images,filled", [
    ("<p>-適切な画像を挿入ー</p><p>-適切な画像を挿入ー</p>", ["u1", "u2"], "<p>[画像1: u1]</p><p>[画像1: u1]</p>"),
    # the second equal mark used up the second image, so the later mark has none left
    ("-適切な画像を挿入ー -適切な画像を挿入ー [IMAGE_PLACEHOLDER_1]", ["u1", "u2"], "[画像1: u1] [画像1: u1] "),
    # the last pattern reaches from the first bracket on, so it takes the filled mark in
    ("a [image_placeholder_2] [x\nPLACEHOLDER] b", ["u1", "u2"], "a [画像2: u2] b"),
    ("[single_photoswipe]a\nb[/single_photoswipe] 適切な画像を挿入", ["u1"], "[画像1: u1] "),
    ("-適切な画像を挿入-", [], "-適切な画像を挿入-"), (None, ["u"], None),
])
def test_fill_marks(spark, content, images, filled):
    df = spark.createDataFrame([(content, images)], "content string, images array<string>")
    assert BL.fill_marks(df).first()["filled"] == filled


def test_popup_article_has_every_part_of_the_sheet(spark):
    from pagemill.operators.render import popup_articles
    df = spark.sql("""SELECT 1L AS event_id, '作者' AS author, '作品' AS work, 'TSUTAYA' AS maker, '店' AS venue,
        DATE'2025-03-04' AS start_date, DATE'2025-04-05' AS end_date, 1100 AS price, 'カード' AS novelty, 6 AS kinds,
        true AS has_illustration, 'A・B・C' AS characters, 'https://o.example/e' AS official_url,
        'https://goo.gl/maps/1' AS map_url, 'https://twitter.com/x/status/1' AS twitter_url""")
    r = popup_articles(df).first()
    assert r["title"] == "作品、3月4日より、店にて開催！"
    html = r["html"]
    assert html.count("<moreads>広告表示</moreads>") == 2
    assert '[sc name="oshibuta-banner"][/sc]' in html
    assert html.count("-適切な画像を挿入ー") == 3
    assert ('<th>アクセス・地図</th>\n   <td><a href="https://goo.gl/maps/1" target="_blank" rel="noopener noreferrer">'
            "Googleマップ</a>で見る</td>") in html
    assert "l-width-80percent l-margin-b-1em\">\nhttps://twitter.com/x/status/1\n</div>" in html
    link = ('https://o.example/e?utm_source=collabo_cafe_dot_com&amp;utm_medium=collabo_cafe_dot_com&amp;'
            'utm_campaign=collabo_cafe_dot_com&amp;utm_id=collabo_cafe_dot_com"')
    assert html.count(link) == 2
    assert "1,100円(税込)以上お買い上げの方に" in html and "2025年3月4日〜4月5日" in html
    assert html.endswith('<p class="f-size12px"><small>&copy; 作品</small></p>')


def test_list_lines_have_positions(spark):
    df = spark.createDataFrame([(1, "<h2>Heads</h2><ul><li>abc</li><li>bcd</li></ul><p>Some text</p>")], "page_id long, content string")
    rows = BL.list_blocks(parse_html(df, html_col="content")).orderBy("line_no").collect()
    # widths: 'Heads' + 2, '• abc' + 1, '• bcd' + 1, 1
    assert [r["start_index"] for r in rows] == [1, 8, 14, 20, 21]
    assert [r["end_index"] for r in rows] == [8, None, None, None, None]


def test_clean_html(spark):
    assert one(spark, clean_html(F.col("h")), h='<h2 id="x">A</h2><p>B</p>') == "【A】\nB"


def test_info_tables_mixed_documents(spark):
    from pagemill.operators import tables as TB
    t = ('<table class="event-info-table"><tr><th>開催場所</th><td> 店 </td></tr>'
         '<tr><th>アクセス</th></tr><tr><td>x</td><th>公式サイト</th></tr></table>')
    df = spark.createDataFrame(
        [(1, f"<p>a</p>{t}<p>b</p>{t}"), (2, "<p>no table</p>"), (3, None),
         (4, '<table class="event-info-table wide"><tr><th>k</th><td>v</td></tr></table>')],
        "page_id long, content string")
    got = {r["page_id"]: r["text"] for r in TB.info_table_text(df).collect()}
    block = "\n【開催情報】\n■ 開催場所: 店\n■ 公式サイト: x\n\n"
    assert got == {1: f"<p>a</p>{block}<p>b</p>{block}", 2: "<p>no table</p>", 3: None,
                   4: df.filter("page_id = 4").first()["content"]}
    rows = TB.info_table_rows(df).filter("page_id = 1 AND t_idx = 0").orderBy("row_no").collect()
    assert [(r["key"], r["value"]) for r in rows] == [("開催場所", "店"), ("公式サイト", "x")]
    summ = TB.info_summary(TB.info_table_rows(df)).collect()
    assert len(summ) == 1 and summ[0]["summary"] == "【開催情報】\n■ 公式サイト: x\n■ 開催場所: 店\n"


def test_main_text_removal_nested_and_outside(spark):
    html = ('<article>a<nav>N<nav>M</nav>n</nav>b<script>x</script>c<footer>F</footer>d</article>'
            '<nav>out</nav>e')
    df = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    r = page_fields(parse_html(df)).first()
    assert r["main_text"] == "abcd"
    assert r["full_text"] == "abcdoute"   # nav outside the text area stays
