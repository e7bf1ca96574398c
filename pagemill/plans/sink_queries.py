"""Sink and stream queries: R5, R6, T1. Each writes under the shared folder
and reads the written data back, so the check covers the round trip."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.records import page_records as records_of
from ..session import child_names, shared_path
from ..sources.fixtures import broken_pages, changed_pages, gallery_pages, stream_requests, timed
from ..sources.sinks import write_articles, write_records
from ..sources.tables import table_files
from ..streaming.page_stream import CHANGE_SCHEMA, TIMED_SCHEMA, page_stream, start_page_stream
from ..streaming.request_stream import answered_once, request_responses, request_stream
from ..streaming.snapshot_stream import records_with_snapshots
from ..streaming.stats_stream import page_changes, read_totals, start_totals
from .block_queries import _blocks
from .image_queries import page_records


def _records_cols(r):
    return r.select("page_id", "url", "title", "description", "text_content",
                    F.size("images").alias("n_images"), "content_type")


def q_write_records(spark, sf_dir):
    path = shared_path(spark, f"records-{uuid.uuid4().hex}")
    write_records(page_records(spark, sf_dir), path)
    return _records_cols(spark.read.parquet(path))


def q_write_articles(spark, sf_dir):
    path = shared_path(spark, f"articles-{uuid.uuid4().hex}")
    write_articles(_blocks(spark, sf_dir).withColumn("content_type", F.lit("general")), path)
    back = spark.read.parquet(path)
    return back.select("page_id", "ord", "kind", "style", "text", "image_url", "content_type")


def q_page_stream(spark, sf_dir):
    run = uuid.uuid4().hex
    out = shared_path(spark, f"stream-out-{run}")
    folder, names = table_files(spark, sf_dir, "pages")
    pages = page_stream(spark, folder, file_glob=names)
    start_page_stream(records_of(pages), out, shared_path(spark, f"stream-ckpt-{run}")).awaitTermination()
    return _records_cols(spark.read.parquet(out))


def _dealt(spark, rows, path, part, parts):
    """Write the parts of ``rows`` in their order, each as the same number of files, so that triggers can take a part
    each and read it with all cores; returns the path and that number."""
    files = spark.sparkContext.defaultParallelism
    for i in range(parts):
        rows.filter(part == i).repartition(files).write.mode("append").parquet(path)
        # fewer rows than files: files without rows stand in for the others
        for _ in range((i + 1) * files - len([n for n in child_names(spark, path) if n.endswith(".parquet")])):
            rows.limit(0).coalesce(1).write.mode("append").parquet(path)
    return path, files


def q_rendered_stream(spark, sf_dir):
    run = uuid.uuid4().hex
    out, k = shared_path(spark, f"rendered-out-{run}"), F.col("page_id")
    # two last rows, of much later, let the watermark pass all that wait
    end = spark.range(1).select(F.lit(-1).cast("long").alias("page_id"), F.lit("https://end.example/").alias("url"),
                                F.lit("").alias("html"), F.lit("2033-01-01").cast("timestamp").alias("at"))
    part = F.when(k < 0, 2).otherwise(k % 2)
    streams = []
    for name, rendered in (("pages", False), ("snapshots", True)):
        rows = timed(gallery_pages(spark, sf_dir, rendered), 60 * rendered).select("page_id", "url", "html", "at")
        path, files = _dealt(spark, rows.unionByName(end), shared_path(spark, f"rendered-{name}-{run}"), part, 3)
        streams.append(page_stream(spark, path, max_files_per_trigger=files, schema=TIMED_SCHEMA))
    records = records_with_snapshots(*streams, late="30 days")
    start_page_stream(records, out, shared_path(spark, f"rendered-ckpt-{run}")).awaitTermination()
    back = spark.read.parquet(out).filter("page_id >= 0")
    return back.select("page_id", F.posexplode("images").alias("n", "url")).select(
        "page_id", (F.col("n") + 1).alias("pos"), "url")


def q_request_stream(spark, sf_dir):
    run = uuid.uuid4().hex
    out = shared_path(spark, f"responses-out-{run}")
    path, files = _dealt(spark, stream_requests(spark, sf_dir), shared_path(spark, f"requests-{run}"), F.col("part"), 3)
    records = records_of(broken_pages(spark, sf_dir)).select("page_id", "url", "error")
    requests = answered_once(request_stream(spark, path, max_files_per_trigger=files))
    responses = request_responses(requests, records, F.to_timestamp(F.lit("2025-01-01 00:00:00")))
    start_page_stream(responses, out, shared_path(spark, f"responses-ckpt-{run}")).awaitTermination()
    return spark.read.parquet(out).select("request_id", "page_id", "success", "docs_url", "message",
                                          F.split_part("error", F.lit(":"), F.lit(1)).alias("error"))


def q_stats_stream(spark, sf_dir):
    run = uuid.uuid4().hex
    path, files = _dealt(spark, changed_pages(spark, sf_dir), shared_path(spark, f"changes-{run}"), F.col("part"), 3)
    pages = page_stream(spark, path, max_files_per_trigger=files, schema=CHANGE_SCHEMA)
    out = shared_path(spark, f"totals-{run}")
    start_totals(page_changes(pages), out, shared_path(spark, f"totals-ckpt-{run}")).awaitTermination()
    return read_totals(spark, out).select("content_type", F.col("pages").alias("n_pages"),
                                          F.col("chars").alias("total_chars"), F.col("images").alias("total_images"))


QUERIES = {
    "stats_stream": q_stats_stream,
    "rendered_stream": q_rendered_stream,
    "request_stream": q_request_stream,
    "write_records": q_write_records,
    "write_articles": q_write_articles,
    "page_stream": q_page_stream,
}


def _oracle():
    from .block_queries import _a
    from ..functions import words as W
    from . import sqltext as S
    from ..sources.fixtures import CLASS_WORDS
    from .image_queries import _g, _records_sql, _rendered_merge_sql
    from .page_queries import _key_sql
    key = _key_sql(f"concat({S.q(W.ARTICLE_TITLE_PREFIX)}, url)")
    # a request for a page that broken_pages gives another url has no page
    requests = f"""SELECT CAST(page_id AS VARCHAR) AS request_id, CASE WHEN why = '' OR why = 'page failed' THEN page_id END AS page_id,
  why = '' AS success, CASE WHEN why = '' THEN {key} END AS docs_url,
  CASE WHEN why = '' THEN {S.q(W.SUCCESS_MESSAGE)} END AS message, nullif(why, '') AS error
FROM (SELECT page_id, url, CASE WHEN page_id % 7 = 5 THEN 'not a url' WHEN page_id % 7 = 3 OR page_id % 30 = 20
  THEN 'no page for the url' WHEN page_id % 30 IN (0, 10) THEN 'page failed' ELSE '' END AS why FROM pages)"""
    # by hand: what holds in the end, and the text that a page with that class word has
    words = " ".join(f"WHEN {i} THEN {S.q(w)}" for i, w in enumerate(CLASS_WORDS))
    totals = _g(f"""SELECT {S.content_type('word')} AS content_type, count(*) AS n_pages,
  CAST(sum(length('Gallery ' || page_id || 'Goods ' || page_id || 'Visit us' || word)) AS BIGINT) AS total_chars,
  CAST(sum(n) AS BIGINT) AS total_images
FROM (SELECT gp.page_id, coalesce(c.n, 0) AS n, CASE (gp.page_id + CASE WHEN gp.page_id % 14 = 0 THEN 3
        WHEN gp.page_id % 5 = 0 THEN 1 ELSE 0 END) % 4 {words} END AS word
      FROM gp LEFT JOIN (SELECT page_id, count(*) AS n FROM ranked GROUP BY page_id) c ON c.page_id = gp.page_id
      WHERE gp.page_id % 7 <> 0 OR gp.page_id % 14 = 0)
GROUP BY 1""")
    return {
        "stats_stream": totals,
        "rendered_stream": _rendered_merge_sql(),
        "request_stream": requests,
        "write_records": _records_sql(),
        "write_articles": _a("SELECT page_id, ord, kind, style, text, image_url, 'general' AS content_type FROM blk"),
        "page_stream": _records_sql(),
    }


ORACLE = _oracle()
