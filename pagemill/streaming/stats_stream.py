"""P9 as totals that follow a stream of page changes.

A page's last record is kept in streaming state. A newer record gives signed
rows, the old one taken off its class and the new one added to its class, and
a deletion only the first; so every trigger changes the totals by what its
pages changed, however many pages there are. The rows of a trigger are summed
and folded into a small table of totals, one generation for each trigger. A
trigger that is run again starts from the generation before its own and writes
the same one.

Defined results: of several changes of a page the one with the latest ``at``
holds, and of equal times the first that came; a change as old as the one held
or older changes nothing; the deletion of an unknown page is remembered, so that
an older record of it does not bring it back. A class whose pages have all gone
leaves the totals.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.records import page_records
from ..session import child_names, plain_files, remove_path

SIGNED = "content_type string, pages long, chars long, images long"
HELD = "at timestamp, deleted boolean, content_type string, chars long, images long"
SUMS = ("pages", "chars", "images")


def page_changes(pages: DataFrame) -> DataFrame:
    """``page_id, at, deleted, content_type, chars, images`` of pages ``(page_id, url, html, at, deleted)``."""
    records = page_records(pages, carry=["at", "deleted"])
    return records.select("page_id", "at", F.coalesce("deleted", F.lit(False)).alias("deleted"), "content_type",
                          F.coalesce(F.length("text_content"), F.lit(0)).cast("long").alias("chars"),
                          F.size("images").cast("long").alias("images"))


def _follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = state.get if state.exists else None
    new = held
    for rows in batches:
        for row in rows.itertuples(index=False):
            if new is None or row.at.to_pydatetime() > new[0]:
                new = (row.at.to_pydatetime(), bool(row.deleted), row.content_type, int(row.chars), int(row.images))
    if new is held:
        return
    state.update(new)
    signed = [(kind, sign, sign * chars, sign * images) for sign, record in ((-1, held), (1, new)) if record
              for _, deleted, kind, chars, images in [record] if not deleted]
    if signed:
        yield pd.DataFrame(signed, columns=["content_type", *SUMS])


def signed_changes(changes: DataFrame) -> DataFrame:
    """A stream of page changes to the signed rows ``content_type, pages, chars, images`` that they make."""
    return changes.groupBy("page_id").applyInPandasWithState(_follow, SIGNED, HELD, "append", GroupStateTimeout.NoTimeout)


def _generation(number: int) -> str:
    return f"generation-{number:09d}"


def _complete(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.rpartition("-")[2]) for n in child_names(spark, path)
                  if "_SUCCESS" in child_names(spark, f"{path}/{n}"))


def read_totals(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The totals ``content_type, pages, chars, images`` of the latest generation (earlier than ``before``)."""
    there = [n for n in _complete(spark, path) if before is None or n < before]
    if not there:
        return spark.createDataFrame([], SIGNED)
    return spark.read.schema(SIGNED).parquet(f"{path}/{_generation(there[-1])}")


def start_totals(changes: DataFrame, path: str, checkpoint_dir: str) -> StreamingQuery:
    """Keep the totals under ``path`` up to date with a stream of page changes; processes what is there, then stops."""
    def fold(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        both = read_totals(spark, path, before=number).unionByName(rows)
        sums = both.groupBy("content_type").agg(*[F.sum(c).alias(c) for c in SUMS]).filter("pages <> 0")
        # a row for each class
        sums.coalesce(1).write.mode("overwrite").parquet(f"{path}/{_generation(number)}")
        for old in [n for n in _complete(spark, path) if n < number - 1]:
            remove_path(spark, f"{path}/{_generation(old)}")

    writer = (signed_changes(changes).writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint_dir)
              .trigger(availableNow=True))
    with plain_files(changes.sparkSession, checkpoint_dir):
        return writer.start()
