"""Requests, prompts, generated-article merge and responses: R2, A2-A5, R7.

Generation itself is an external service; here prompts go out as a table and
responses come back as a table ``generations(page_id, response, error)``,
joined on ``page_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import templates as TPL
from ..functions import words as W
from ..functions.markup import article_key
from ..functions.images import asset_checks
from .fields import source_url
from .skew import lookup


def request_pages(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """R2: every request row, joined to its page when there is one (left join on url).

    Requests without a url have no page and take no part in the join. Both
    sides are narrow; a url that very many requests name is split by AQE.
    """
    p = pages.select("url", "page_id").filter(F.col("url").isNotNull())
    r = requests.withColumn("category", F.lit(W.DEFAULT_CATEGORY))
    named = r.filter(F.col("url").isNotNull()).join(p, "url", "left")
    unnamed = r.filter(F.col("url").isNull()).withColumn("page_id", F.lit(None).cast(pages.schema["page_id"].dataType))
    return named.unionByName(unnamed).withColumn("has_page", F.col("page_id").isNotNull())


def admitted_assets(assets: DataFrame) -> DataFrame:
    """``(url, admitted)``, one row per url.

    ``assets`` has a row for each download tried: ``url, content_type,
    content_length`` and optionally ``ok`` (false: the request failed). A url
    with several rows is admitted if any of them is.
    """
    ok, _, _ = asset_checks(F.col("content_type"), F.col("content_length"))
    if "ok" in assets.columns:
        ok = ok & F.coalesce(F.col("ok"), F.lit(False))
    return assets.groupBy("url").agg(F.max(ok).alias("admitted"))


def image_admissions(records: DataFrame, assets: DataFrame) -> DataFrame:
    """``(page_id, admitted)``: for each of a record's images whether its asset is admitted.

    Only (page, position, url) rows move, and a url that very many pages show
    (a logo, a banner) is looked up by broadcast. A url without an asset row was
    never downloaded and is not admitted.
    """
    each = records.select("page_id", F.posexplode("images").alias("pos", "url"))
    met = lookup(each, admitted_assets(assets), "url").select(
        "page_id", F.struct("pos", F.coalesce("admitted", F.lit(False)).alias("ok")).alias("x"))
    return met.groupBy("page_id").agg(
        F.transform(F.array_sort(F.collect_list("x")), lambda x: x["ok"]).alias("admitted"))


def _fill(template: str, value: Column) -> Column:
    parts = template.split("{source_url}")
    cols = []
    for i, p in enumerate(parts):
        if i:
            cols.append(value)
        cols.append(F.lit(p))
    return F.concat(*cols)


def error_article_html(src: Column) -> Column:
    """A5 content: one paragraph that links the source."""
    return _fill(TPL.ERROR_ARTICLE_HTML, src)


def merge_generations(records: DataFrame, gens: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """A3-A5: records left-join generations; no row or no response gives the
    fallback article, an error row gives the error article.

    With ``assets``, ``admitted`` says for each image whether it can be placed
    (D5); it is joined by page_id like the generations, so the blocks need no
    lookup later. Without, all images can be.

    ``records`` needs ``page_id, url`` and optionally ``images`` (NULL or
    missing: no images) and ``metadata``.
    Output ``articles(page_id, title, content, images, admitted, source_url, generated_at, error)``
    plus ``content_type`` if the records have it.
    """
    meta = F.col("metadata") if "metadata" in records.columns else None
    imgs = F.col("images") if "images" in records.columns else F.lit(None).cast("array<string>")
    carry = [c for c in ("content_type",) if c in records.columns]
    r = records.select("page_id", source_url(F.col("url"), meta).alias("source_url"), imgs.alias("images"), *carry)
    j = r.join(gens.select("page_id", "response", "error"), "page_id", "left")
    yes = F.transform("images", lambda x: F.lit(True))
    if assets is not None:
        j = j.join(image_admissions(r, assets), "page_id", "left")
        yes = F.coalesce("admitted", F.array().cast("array<boolean>"))
    is_err = F.coalesce(F.col("error"), F.lit(False))
    content = F.when(is_err, error_article_html(F.col("source_url"))).otherwise(
        F.coalesce(F.col("response"), F.lit(TPL.FALLBACK_ARTICLE_HTML)))
    return j.select(
        "page_id",
        F.concat(F.lit(W.ARTICLE_TITLE_PREFIX), F.col("source_url")).alias("title"),
        content.alias("content"),
        F.coalesce(F.col("images"), F.array().cast("array<string>")).alias("images"),
        F.coalesce(yes, F.array().cast("array<boolean>")).alias("admitted"),
        "source_url",
        F.lit(W.GENERATED_AT).alias("generated_at"),
        is_err.alias("error"),
        *carry,
    )


def with_outcomes(rows: DataFrame, outcomes: DataFrame | None) -> DataFrame:
    """``rows`` with ``failure``: why the document of the page could not be written, or null.

    ``outcomes(page_id, error)`` says what came of writing the documents; a
    page with several has failed if any of them did, with the first reason in
    order, and a page without any has not.
    """
    if outcomes is None:
        return rows.withColumn("failure", F.lit(None).cast("string"))
    failed = outcomes.filter(F.col("error").isNotNull()).groupBy("page_id").agg(F.min("error").alias("failure"))
    return rows.join(failed, "page_id", "left")


def article_responses(articles: DataFrame, stamp: Column, outcomes: DataFrame | None = None) -> DataFrame:
    """One outcome row per article; the article key stands in for the link.

    An article whose document could not be written (``outcomes``) has no link
    and no message, but the error.
    """
    told = with_outcomes(articles, outcomes)
    fine = F.col("failure").isNull()
    return told.select(
        "page_id",
        fine.alias("success"),
        F.when(fine, article_key(F.col("title"), stamp)).alias("docs_url"),
        F.when(fine, F.lit(W.SUCCESS_MESSAGE)).alias("message"),
        F.col("failure").alias("error"),
    )
