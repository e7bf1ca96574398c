"""End-to-end jobs: what a crawl run executes, as composed DataFrame operators.

Stage 1, ``scrape``: pages -> page records (fields, ranked images with the
rendered-snapshot fallback, content type, metadata) and generation prompts.
Stage 2, ``assemble``: records + generated responses (+ downloads tried) ->
articles, document blocks, edit requests, responses and per-article stats.
Every table is written once, and what follows from it reads it back, so each
input is parsed once.

Between the stages the prompts leave for an external generator and its
responses come back as a table ``generations(page_id, response, error)``.

Run with ``spark-submit -m``-style entry: ``python -m pagemill.plans.jobs
scrape --pages <parquet> --out <dir>`` (and ``assemble``); outputs are Parquet.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import articles as AR
from ..operators import blocks as BL
from ..operators.dom import parse_html
from ..operators.fields import source_url
from ..operators.records import page_records
from ..session import get_session
from ..sources.sinks import write_articles, write_records
from .page_queries import build_prompts


def _written(df: DataFrame, out: str, name: str) -> DataFrame:
    path = os.path.join(out, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def scrape(pages: DataFrame, out: str, rendered: DataFrame | None = None) -> dict[str, DataFrame]:
    """Pages ``(page_id, url, html)`` to the tables ``records`` and ``prompts`` under ``out``.

    ``rendered`` (same shape) holds rendered snapshots; they matter for pages
    with fewer than three static images (R4).
    """
    path = os.path.join(out, "records")
    write_records(page_records(pages, rendered), path)
    recs = pages.sparkSession.read.parquet(path)
    source = source_url(F.col("url"), F.col("metadata")).alias("source_url")
    prompts = _written(build_prompts(recs.select("page_id", source, "text_content")), out, "prompts")
    return {"records": recs, "prompts": prompts}


def assemble(records: DataFrame, generations: DataFrame, out: str, assets: DataFrame | None = None,
             stamp: Column | None = None, outcomes: DataFrame | None = None) -> dict[str, DataFrame]:
    """Records + generated responses to the tables articles, blocks, edits, responses and stats under ``out``.

    ``outcomes(page_id, error)`` says which documents could not be written.
    """
    stamp = stamp if stamp is not None else F.current_timestamp()
    arts = _written(AR.merge_generations(records, generations, assets), out, "articles")
    columns = ["page_id", "images", "admitted", "content_type"]
    # the markup goes to the parser under another name, so that it is still there for an article that fails to parse
    dom = parse_html(arts.select(*columns, "content", F.col("content").alias("_html")), html_col="_html")
    path = os.path.join(out, "blocks")
    write_articles(BL.article_blocks(dom, carry=["content_type"]), path)
    blocks = records.sparkSession.read.parquet(path)
    return {
        "articles": arts,
        "blocks": blocks,
        "edits": _written(BL.document_edits(blocks), out, "edits"),
        "responses": _written(AR.article_responses(arts, stamp, outcomes), out, "responses"),
        "stats": _written(BL.article_stats(arts, outcomes), out, "stats"),
    }


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="pagemill")
    sub = ap.add_subparsers(dest="stage", required=True)
    s1 = sub.add_parser("scrape")
    s1.add_argument("--pages", required=True)
    s1.add_argument("--rendered")
    s1.add_argument("--out", required=True)
    s1.add_argument("--partitions", type=int, help="deal the pages out to so many tasks first (a shuffle of the html)")
    s2 = sub.add_parser("assemble")
    s2.add_argument("--records", required=True)
    s2.add_argument("--generations", required=True)
    s2.add_argument("--assets")
    s2.add_argument("--out", required=True)
    args = ap.parse_args(argv)
    spark = get_session(app=f"pagemill-{args.stage}")
    if args.stage == "scrape":
        columns = ["page_id", "url", "html"]
        pages = spark.read.parquet(args.pages).select(*columns)
        if args.partitions:
            pages = pages.repartition(args.partitions)
        rendered = spark.read.parquet(args.rendered).select(*columns) if args.rendered else None
        scrape(pages, args.out, rendered)
    else:
        assets = spark.read.parquet(args.assets) if args.assets else None
        assemble(spark.read.parquet(args.records), spark.read.parquet(args.generations), args.out, assets)


if __name__ == "__main__":
    main()
