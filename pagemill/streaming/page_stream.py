"""New page files as a stream, run through the same page records job.

The job is narrow (no window, no join), so it is an ordinary streaming query:
read files, parse, project, append to a Parquet sink. The sink's own log makes
the output exactly-once when a trigger is replayed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..session import plain_files

PAGE_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])
#: Pages with the event time that joins of streams need.
TIMED_SCHEMA = T.StructType([*PAGE_SCHEMA.fields, T.StructField("at", T.TimestampType())])

#: Changes of pages: a record of its time, or a deletion.
CHANGE_SCHEMA = T.StructType([*TIMED_SCHEMA.fields, T.StructField("deleted", T.BooleanType())])


def page_stream(spark: SparkSession, source_dir: str, file_glob: str = "*.parquet",
                max_files_per_trigger: int | None = None, schema: T.StructType = PAGE_SCHEMA) -> DataFrame:
    """The page files under ``source_dir`` as a stream; a caller may bound the files of one trigger."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(source_dir)


def start_page_stream(records: DataFrame, out_dir: str, checkpoint_dir: str) -> StreamingQuery:
    """Append a stream of records to Parquet; processes every file not seen before, then stops."""
    writer = (records.writeStream.format("parquet").outputMode("append").option("path", out_dir)
              .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True))
    with plain_files(records.sparkSession, checkpoint_dir):
        return writer.start()
