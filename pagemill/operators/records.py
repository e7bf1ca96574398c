"""P8 page records: fields and ranked images of every page, with the R4 fallback.

One narrow pass: the parse, then a projection that computes the page fields
and each page's array of image candidates, then the in-row ranking of that
array (``rank_inrow``). No join, no shuffle, and the parse output has a single
consumer. With rendered snapshots, the image lists of the snapshots (narrow
rows) are joined to the records by ``page_id``.

A page that fails (no html, markup or urls that no parser takes) has an empty
record: null fields, no images, the general content type, and the reason in
``error`` if there was html.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import images as IM
from .dom import parse_html
from .fields import page_fields, page_metadata
from .rank_inrow import merged_with_rendered, with_ranked_images

RECORD_FIELDS = ["page_id", "url", "title", "description", "text_content", "page_title", "meta_description",
                 "base_url", "content_type"]


def image_dom(pages: DataFrame) -> DataFrame:
    """Parsed pages with their image candidates; failed pages have null nodes and an error."""
    return IM.without_failed(IM.with_candidates(parse_html(pages)))


def ranked_pages(pages: DataFrame, with_fields: bool = False, carry: list[str] | None = None) -> DataFrame:
    """``(page_id, url, images, error)`` (plus the record fields when asked), one narrow pass.

    ``carry`` names further columns of the pages that are kept.
    """
    dom = image_dom(pages)
    image_cols = ["cands", "areas", "base", "parse_error", *(carry or [])]
    if with_fields:
        base = page_fields(dom, keep=["page_id", "url", *image_cols]).select(*RECORD_FIELDS, *image_cols)
    else:
        base = dom.select("page_id", "url", *image_cols)
    return with_ranked_images(base).withColumnRenamed("parse_error", "error").drop("cands", "areas", "base")


def page_records(pages: DataFrame, rendered: DataFrame | None = None, carry: list[str] | None = None) -> DataFrame:
    """Pages ``(page_id, url, html)`` to records ``(page_id, url, title,
    description, text_content, page_title, meta_description, base_url,
    content_type, error, images, metadata)``.

    ``rendered`` (same shape) holds rendered snapshots of some pages (R4).
    ``carry`` names further columns of the pages that are kept.
    """
    recs = ranked_pages(pages, with_fields=True, carry=carry)
    if rendered is not None:
        extra = ranked_pages(rendered).groupBy("page_id").agg(F.first("images").alias("_rendered"))
        recs = (recs.join(extra, "page_id", "left")
                .withColumn("images", merged_with_rendered(F.col("images"), F.col("_rendered"))).drop("_rendered"))
    return recs.withColumn("metadata", page_metadata(recs))
