"""R5/R6 sinks: records and document blocks as Parquet.

Writes go to a path the caller names (on a cluster: under the shared folder in
``spark.checkpoint.dir`` or a table location); nothing is written to a
machine-local folder by the library itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_records(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One row per page record (metadata map and image list kept nested)."""
    records.write.mode(mode).parquet(path)


def write_articles(blocks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Document blocks, partitioned by content type.

    The blocks of an article come from one row and so from one task: they need
    no shuffle to stand together in a file, only their order there.
    """
    (blocks.sortWithinPartitions("content_type", "page_id", "seq")
     .write.mode(mode).partitionBy("content_type").parquet(path))
