"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.session import bound_batches, ensure_checkpoint_dir, reliable_checkpoint, shared_path

__all__ = ["read_table", "checkpoint", "work_path", "fresh", "text_or_empty", "lower_ascii", "small_side",
           "held_out", "keep_rows", "text_key", "slices", "remove_path", "passage", "bound_batches"]

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A side of a join is broadcast only when its measured size is at most this.
BROADCAST_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` under the cluster's shared checkpoint folder and read it back."""
    return reliable_checkpoint(df)


def work_path(spark: SparkSession, name: str) -> str:
    """A new path for a written table under the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return shared_path(spark, f"{name}-{uuid.uuid4().hex}")


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, in whatever store it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have yet (compared as Spark does, ignoring case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` does the same for a text that is all ASCII, and is much faster
    than ``translate``, which looks every character up.
    """
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, ASCII_UPPER, ASCII_UPPER.lower()))


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast of ``df`` if its measured size allows one, else leave the join to Spark.

    ``df`` should be written or checkpointed, since measuring reads it once.
    The size is the sum of the bytes of the rows as JSON text, an upper
    estimate for narrow rows.
    """
    size = df.select(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))) + 32).alias("b")).first()["b"]
    return F.broadcast(df) if (size or 0) <= limit else df


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 2 modulo 4; a null id counts as empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def text_key(text: Column) -> Column:
    """A 64-bit hash that, beside the doc_id, tells rows of one id apart."""
    return F.xxhash64(text)


def passage(text: Column, doc_id: Column, longest: int) -> Column:
    """The text, or of one longer than ``longest`` code points a part of that size at a place chosen by the doc_id."""
    room = F.length(text) - longest
    start = F.pmod(F.xxhash64(doc_id, F.lit("passage")), room.cast("long") + 1).cast("int")
    return F.when(room > 0, F.substring(text, start + 1, F.lit(longest))).otherwise(text)


def keep_rows(docs: DataFrame, rows: DataFrame, key: Column) -> DataFrame:
    """Whole rows of ``docs`` that are keepers by ``rows(doc_id, key, copies, keeper)``, one row for each keeper.

    ``rows`` names all rows of ``docs``; ``key`` tells those of one doc_id
    apart, and ``copies`` is the number of rows alike in both, of which any one
    is the keeper. The rows that go are taken out by an anti-join, as they are
    fewer: while their names fit a broadcast, no text moves.
    """
    (k, r_id, r_key) = fresh(docs, "row_key", "gone_id", "gone_key")
    cols = docs.columns
    changed = checkpoint(rows.filter(~F.col("keeper") | (F.col("copies") > 1))
                         .select(F.col("doc_id").alias(r_id), F.col("key").alias(r_key), "keeper"))
    keyed = docs.withColumn(k, key)
    on = F.col("doc_id").eqNullSafe(F.col(r_id)) & (F.col(k) == F.col(r_key))
    once = keyed.join(small_side(changed.select(r_id, r_key)), on, "left_anti").select(*cols)
    many = changed.filter("keeper").select(r_id, r_key)
    if many.isEmpty():
        return once
    repeated = keyed.join(small_side(many), on, "left_semi")
    first = repeated.groupBy("doc_id", k).agg(F.first(F.struct(*cols)).alias(r_key)).select(f"{r_key}.*")
    return once.unionByName(first)


def slices(batch: pa.RecordBatch, column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose rows hold about ``limit`` bytes (or list elements) of a column, at least one row each.

    Spark bounds a batch by its bytes; what Python makes of it may be many
    times as large, so it is made and sent back part by part.
    """
    col = batch.column(column)
    size = pc.list_value_length if pa.types.is_list(col.type) else pc.binary_length
    start = total = 0
    for i, n in enumerate(size(col).fill_null(0).to_pylist()):
        total += n
        if total >= limit:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)
