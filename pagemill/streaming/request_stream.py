"""T1 + R2 + R7: a stream of article requests to one response for each request.

The ids of answered requests are kept in streaming state for ``keep`` of event
time, so an id that is sent again, in the same trigger or a later one, gets no
second response. The pages are an ordinary table that each trigger reads anew.

Defined results: a request with a null or invalid url, without a page, or for
a page that failed has ``success`` false, no link and the reason in ``error``;
of several pages of one url the smallest page_id that did not fail answers, or
else the smallest; requests without an id are one request. A request older than
the watermark (``keep`` behind the latest) is what Spark drops as late.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import words as W
from ..functions.images import valid_url
from ..functions.markup import article_key

REQUEST_SCHEMA = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("format_type", T.StringType()),
    T.StructField("at", T.TimestampType()),
])
NO_URL, NO_PAGE, FAILED = "not a url", "no page for the url", "page failed"


def request_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The request files under ``source_dir`` as a stream."""
    reader = spark.readStream.schema(REQUEST_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(source_dir)


def answered_once(requests: DataFrame, keep: str = "30 days") -> DataFrame:
    """The first request of each id."""
    return requests.withWatermark("at", keep).dropDuplicatesWithinWatermark(["request_id"])


def request_responses(requests: DataFrame, records: DataFrame, stamp: Column) -> DataFrame:
    """``request_id, page_id, success, docs_url, message, error`` for each of ``requests``, a stream or a table.

    ``records`` is a table with ``page_id, url, error``; the error is null for a page that was read.
    """
    best = F.min(F.struct(F.col("error").isNotNull().alias("failed"), "page_id", "error"))
    pages = records.filter(F.col("url").isNotNull()).groupBy(F.col("url").alias("page_url")).agg(best.alias("page"))
    met = requests.join(pages, F.col("url") == F.col("page_url"), "left")
    error = (F.when(~F.coalesce(valid_url(F.col("url")), F.lit(False)), F.lit(NO_URL))
              .when(F.col("page").isNull(), F.lit(NO_PAGE))
              .when(F.col("page.failed"), F.concat(F.lit(f"{FAILED}: "), F.coalesce("page.error", F.lit("")))))
    told = met.select("request_id", F.col("page.page_id").alias("page_id"), "url", error.alias("error"))
    fine = F.col("error").isNull()
    title = F.concat(F.lit(W.ARTICLE_TITLE_PREFIX), F.col("url"))
    return told.select("request_id", "page_id", fine.alias("success"),
                       F.when(fine, article_key(title, stamp)).alias("docs_url"),
                       F.when(fine, F.lit(W.SUCCESS_MESSAGE)).alias("message"), "error")
