"""Properties of results and shape of physical plans."""

import re
import time

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from oracle_harness import SMALL
from pagemill.operators import articles as AR
from pagemill.operators import blocks as BL
from pagemill.operators import images as IM
from pagemill.operators import rank_inrow as RK
from pagemill.operators import records as RC
from pagemill.operators.dom import parse_html
from pagemill.operators.fields import page_fields
from pagemill.plans import block_queries as BQ
from pagemill.plans import image_queries as IQ
from pagemill.plans import page_queries as PQ
from pagemill.session import reliable_checkpoint
from pagemill.sources.tables import read_pages

PAGES = "page_id long, url string, html string"


def plan_of(df):
    df.write.format("noop").mode("overwrite").save()  # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_prunes_columns(spark):
    plan = plan_of(PQ.q_valid_url_filter(spark, SMALL))
    m = re.search(r"ReadSchema: (struct<[^>]*>)", plan)
    assert m and "html" not in m.group(1), plan


def test_rank_properties(spark):
    r = IQ.q_rank_images(spark, SMALL)
    per = r.groupBy("page_id").agg(F.count("*").alias("n"), F.countDistinct("url").alias("d"),
                                   F.min("quality").alias("q")).collect()
    assert per and all(x["n"] <= 10 and x["n"] == x["d"] and x["q"] >= 5 for x in per)


def test_final_cap_bites(spark):
    # a page with 6 main, 3 article and 4 other images: 5 + 3 + 3 = 11 reach the
    # final list and the cap of 10 drops the lowest quality one
    main = "".join(f'<img src="/m/{i}.jpg">' for i in range(6))
    goods = "".join(f'<img src="/g/{i}.jpg">' for i in range(3))
    other = "".join(f'<img src="/o/{i}.jpg" class="hero">' for i in range(4))
    html = f'<main>{main}</main><div class="goods">{goods}</div><div>{other}</div>'
    df = spark.createDataFrame([(1, "https://a.example/p/x.html", html)], PAGES)
    r = RK.with_image_steps(RC.image_dom(df)).select(F.size("merged").alias("m"), F.size("ranked").alias("r")).first()
    assert (r["m"], r["r"]) == (11, 10)


def test_final_cap_bites_in_the_gallery(spark):
    r = IQ.gallery_steps(spark, "/root/testdata/sf0.01").select(F.size("merged").alias("n"))
    assert r.filter("n > 10").count() > 0


def test_area_key_is_that_of_the_best_area_around(spark):
    import random
    rng = random.Random(1)
    classes = ["goods", "gallery", "store", "plain", "special"]

    def box(depth):
        inner = "".join(rng.choice(["<img>", box(depth - 1) if depth else "<img>", "text"]) for _ in range(4))
        return f'<div class="{rng.choice(classes)} {rng.choice(classes)}">{inner}</div>'

    df = spark.createDataFrame([(i, "u", box(4) + "<img>" + box(3)) for i in range(6)], PAGES)
    rows = parse_html(df).select("nodes", IM.article_areas().alias("areas"), IM.area_keys().alias("keys")).collect()
    for r in rows:
        want = {}
        for n in r["nodes"]:
            if n["tag"] == "img":
                around = [(a["rank"], a["node_id"]) for a in r["areas"] if a["node_id"] < n["node_id"] <= a["last_id"]]
                if around:
                    want[n["node_id"]] = min(around)
        assert {k["node_id"]: (k["a_rank"], k["a_node"]) for k in r["keys"]} == want


def test_many_areas_images_and_removed_nodes_take_seconds(spark):
    areas = '<div class="goods"><img src="/a.jpg"></div>' * 10_000
    nested = "<article>" + "a<nav>b</nav>" * 10_000 + "</article>"
    df = reliable_checkpoint(spark.createDataFrame([(1, "https://a.example/", areas), (2, "https://a.example/", nested)], PAGES))
    start = time.time()
    dom = parse_html(df).filter("page_id = 1").select("page_id", F.size(IM.area_keys()).alias("n"))
    assert dom.first()["n"] == 10_000
    texts = page_fields(parse_html(df).filter("page_id = 2")).first()
    assert texts["main_text"] == "a" * 10_000
    assert time.time() - start < 60


def test_images_without_a_source_have_no_url(spark):
    html = '<main><img><img alt="x"><img src=""><img src="" data-src="/media/a.jpg"></main>'
    df = spark.createDataFrame([(1, "https://a.example/media/index.html", html)], PAGES)
    r = RK.with_image_steps(RC.image_dom(df)).first()
    assert [c["url"] for c in r["candidates"]] == [None, None, None, "https://a.example/media/a.jpg"]
    assert [x["url"] for x in r["ranked"]] == ["https://a.example/media/a.jpg"]


def test_a_bad_page_leaves_its_neighbours_alone(spark):
    good = "<h1>T</h1><p>text</p><main><img src='/media/x.jpg'></main>"
    rows = [(1, "https://a.example/1", good), (2, "https://a.example/2", "<p>x<![foo[x]]>"), (3, "https://[bad/y", good),
            (4, "https://a.example/4", good + '<img src="ftp://[x">'), (5, "https://a.example/5", good), (6, None, None)]
    recs = {r["page_id"]: r for r in RC.page_records(spark.createDataFrame(rows, PAGES).coalesce(1)).collect()}
    assert len(recs) == 6
    for i in (1, 5):
        assert recs[i]["title"] == "T" and recs[i]["images"] == ["https://a.example/media/x.jpg"] and recs[i]["error"] is None
    for i in (2, 3, 4):
        r = recs[i]
        assert r["error"] and r["title"] is None and r["images"] == [] and r["url"] == rows[i - 1][1]
        assert r["metadata"] == {"content_type": "general"}
    assert recs[6]["error"] is None and recs[6]["metadata"] == {"content_type": "general"}


def test_offsets_do_not_overlap(spark):
    o = BQ.q_block_offsets(spark, SMALL)
    w = Window.partitionBy("page_id").orderBy("ord")
    width = F.when(F.col("kind") == "image", 2).otherwise(F.col("end_index") - F.col("start_index") + 2)
    chk = o.withColumn("next", F.lead("start_index").over(w)).withColumn("w", width)
    bad = chk.filter(F.col("next").isNotNull() & (F.col("start_index") + F.col("w") != F.col("next"))).count()
    assert bad == 0


def test_each_image_used_once_per_article(spark):
    a = BQ.q_assign_images(spark, SMALL)
    dup = a.groupBy("page_id", "image_url").count().filter("count > 1").count()
    assert dup == 0


def test_requests_without_url_or_page_stay(spark):
    req = spark.createDataFrame([("u1", "popup")] * 3 + [("gone", "news"), (None, "event")], "url string, format_type string")
    pages = spark.createDataFrame([(1, "u1"), (2, "u2"), (3, None)], "page_id long, url string")
    got = sorted((r["url"] or "", r["page_id"], r["has_page"]) for r in AR.request_pages(req, pages).collect())
    assert got == [("", None, False), ("gone", None, False)] + [("u1", 1, True)] * 3


def test_absent_failed_and_repeated_downloads(spark):
    art = spark.createDataFrame([(1, "https://a/", ["ok", "absent", "failed", "twice", "big", "page"])],
                                "page_id long, url string, images array<string>")
    gens = spark.createDataFrame([(1, "<p>[画像</p>" * 6, False)], "page_id long, response string, error boolean")
    assets = spark.createDataFrame(
        [("ok", "image/png", 5, True), ("failed", "image/png", 5, False), ("twice", None, None, False),
         ("twice", "image/gif", None, True), ("big", "image/png", 15 * 2**20 + 1, True), ("page", "text/html", 5, True)],
        "url string, content_type string, content_length long, ok boolean")
    merged = AR.merge_generations(art, gens, assets)
    assert merged.first()["admitted"] == [True, False, False, True, False, False]
    dom = parse_html(merged.select("page_id", "images", "admitted", "content"), html_col="content")
    rows = BL.article_blocks(dom).orderBy("seq").collect()
    assert [r["kind"] for r in rows] == ["image", "paragraph", "paragraph", "image", "paragraph", "paragraph"]
    assert rows[1]["text"] == "[画像: absent]\n"
    assert AR.merge_generations(art, gens).first()["admitted"] == [True] * 6


def test_an_article_that_fails_to_parse_is_its_plain_text(spark):
    df = spark.createDataFrame([(1, [], [], "<h2>A</h2><p>B</p><![foo[x]]>"), (2, [], [], "<h2>ok</h2><h2>head</h2>")],
                               "page_id long, images array<string>, admitted array<boolean>, content string")
    dom = parse_html(df.withColumn("h", F.col("content")), html_col="h")
    blocks = BL.article_blocks(dom)
    r = blocks.filter("page_id = 1").collect()
    assert [(x["kind"], x["text"], x["start_index"]) for x in r] == [("text", "【A】\nB", 1)]
    assert blocks.filter("page_id = 2").count() == 1  # 'ok' is too short
    assert [x["op"] for x in BL.document_edits(blocks.filter("page_id = 1")).collect()] == ["insertText"]


def test_blocks_and_edits_move_no_text(spark):
    arts = reliable_checkpoint(BQ.articles(spark, SMALL, with_assets=True))
    dom = parse_html(arts.select("page_id", "images", "admitted", "content"), html_col="content")
    plan = plan_of(BL.document_edits(BL.article_blocks(dom)))
    assert "Exchange" not in plan and "Join" not in plan and "Window" not in plan, plan


def test_info_table_text_is_one_scan(spark):
    from pagemill.plans import table_queries as TQ
    plan = plan_of(TQ.q_info_table_text(spark, SMALL))
    assert "Exchange" not in plan and "Join" not in plan
    assert len(re.findall(r"\(\d+\) Scan parquet|FileScan parquet", plan)) <= 1 or plan.count("FileScan parquet") == 1


def test_stream_equals_batch(spark):
    from pagemill.plans import sink_queries as SQ
    cols = ["page_id", "url", "title", "description", "text_content", "n_images", "content_type"]
    stream = sorted(tuple(r) for r in SQ.q_page_stream(spark, SMALL).select(*cols).collect())
    batch = sorted(tuple(r) for r in IQ.q_page_records(spark, SMALL).select(*cols).collect())
    assert stream == batch and len(batch) > 0


def test_metadata_map_keys(spark):
    df = spark.createDataFrame(
        [(1, "https://a.example/x", '<title> T </title><meta name="description" content=" D "><p>text</p>'),
         (2, "https://a.example/y", "<p>no title here</p>"),
         (3, "https://a.example/z", None)], "page_id long, url string, html string")
    r = {x["page_id"]: x for x in IQ.page_records(spark, SMALL, df).collect()}
    m1 = r[1]["metadata"]
    assert m1["page_title"] == "T" and m1["meta_description"] == "D" and m1["base_url"] == "https://a.example"
    assert set(m1) == {"source_url", "page_title", "meta_description", "full_content", "base_url", "content_type"}
    assert r[1]["description"] == "D"
    assert set(r[2]["metadata"]) == {"source_url", "full_content", "base_url", "content_type"}
    assert r[3]["metadata"] == {"content_type": "general"} and r[3]["title"] is None and r[3]["images"] == []


def test_page_records_has_no_shuffle(spark):
    from pagemill.operators.records import page_records
    plan = plan_of(page_records(read_pages(spark, SMALL)))
    assert "Exchange" not in plan, plan


def test_parse_bounds_the_rows_of_a_batch(spark):
    """A session that says nothing gets the library's batches for the parse."""
    session = spark.newSession()
    pages = session.range(1500).selectExpr("id AS page_id", "'<p>a</p>' AS html").coalesce(1)
    parse_html(pages)
    sizes = pages.mapInArrow(lambda batches: (b.slice(0, 1).set_column(0, "page_id", pa.array([b.num_rows], pa.int64()))
                                              for b in batches), pages.schema)
    assert max(r["page_id"] for r in sizes.collect()) == 500
