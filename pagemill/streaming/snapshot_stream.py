"""T1 + R4: rendered snapshots as a stream beside the page stream.

A page with fewer than three images waits for its snapshot in the state of a
left outer stream-stream join; all other pages fail the join's own condition on
their side and pass at once. A waiting page is written when its snapshot comes,
or without one when the watermark has passed the time it may wait. Snapshots
may come before their page. The watermark follows the slower of the two
streams, so neither can run the other out.

Both streams need an event time in ``at``. Defined results: of several
snapshots of a page the first to come within the time counts; a snapshot for
no page, for a page with enough images, or later than the wait changes nothing;
a null page_id has no snapshot. Rows older than the watermark are what Spark
drops as late; ``late`` is how far the event times of one stream may lag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import words as W
from ..operators.rank_inrow import merged_with_rendered
from ..operators.records import page_records, ranked_pages


def snapshot_images(rendered: DataFrame, late: str) -> DataFrame:
    """``snapshot_of, rendered_images, rendered_at``: the images of each page's first snapshot."""
    return (ranked_pages(rendered, carry=["at"])
            .select(F.col("page_id").alias("snapshot_of"), F.col("images").alias("rendered_images"),
                    F.col("at").alias("rendered_at"))
            .withWatermark("rendered_at", late).dropDuplicatesWithinWatermark(["snapshot_of"]))


def records_with_snapshots(pages: DataFrame, rendered: DataFrame, wait: str = "10 minutes",
                           late: str = "1 hour") -> DataFrame:
    """Streams of pages and snapshots ``(page_id, url, html, at)`` to a stream of page records (P8, with ``at``)."""
    records = page_records(pages, carry=["at"]).withWatermark("at", late)
    met = F.expr(f"""page_id = snapshot_of AND size(images) < {W.RENDER_BELOW}
                     AND rendered_at >= at - INTERVAL {wait} AND rendered_at <= at + INTERVAL {wait}""")
    joined = records.join(snapshot_images(rendered, late), met, "left_outer")
    return (joined.withColumn("images", merged_with_rendered(F.col("images"), F.col("rendered_images")))
            .drop("snapshot_of", "rendered_images", "rendered_at"))
