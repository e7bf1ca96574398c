"""Exact de-duplication against a persistent digest index (operator 5).

The index is a Parquet table bucketed and sorted by the digest of the
normalised text, one row for each distinct text ever accepted, with the batch
that brought it. A batch of new documents is reduced to one candidate row per
digest; those that the index lacks are found by a sort-merge anti-join (the
index side needs no shuffle, since it is bucketed by the join key) and
appended. A text is new to a batch if the index has it from that batch, so a
batch that is run again under its id, whenever its first run was broken off,
decides the same and adds nothing twice. After some appends the buckets are
merged into one sorted file each, which the next joins read without a sort.
Only digests move: texts are hashed where they are read.

Defined results: a null text counts as empty; empty texts are equal to each
other; rows alike in doc_id, length and text are copies of which one row
stays; a null doc_id loses every tie. An empty batch leaves the index as it is.
Columns other than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import checkpoint, keep_rows, read_table, remove_path, text_or_empty, work_path

WHITE = "[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    """The text without ASCII white space."""
    return F.regexp_replace(text_or_empty(text), WHITE, "")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


class DigestIndex:
    """A digest table under ``path``: ``digest binary, keep_id long, n_chars long, batch string``.

    ``buckets`` is fixed when the index is made and must be the same whenever
    it is opened again. The folder holds generations; a merge writes the next
    one, and the latest that was written to its end is the index.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets
        # lets a scan of one file a bucket count as sorted; with several files Spark sorts
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        self.generation = max(self._generations(), default=0)
        self._open()

    def _folder(self, generation: int) -> str:
        return f"{self.path}/generation-{generation:06d}"

    def _files(self, folder: str) -> list:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        store = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return list(store.listStatus(place)) if store.exists(place) else []

    def _generations(self) -> list[int]:
        """Those that are complete: merges leave a mark at their end, and the first grows by appends."""
        found = [int(f.getPath().getName().rpartition("-")[2]) for f in self._files(self.path)]
        return [g for g in found if g == 0 or any(
            f.getPath().getName() == "_SUCCESS" for f in self._files(self._folder(g)))]

    def _open(self) -> None:
        folder = self._folder(self.generation)
        self.name = "digest_index_" + hashlib.md5(folder.encode()).hexdigest()
        self.spark.sql(f"""CREATE TABLE IF NOT EXISTS {self.name}
                           (digest BINARY, keep_id BIGINT, n_chars BIGINT, batch STRING) USING parquet
                           CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{folder}'""")

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, candidates: DataFrame) -> DataFrame:
        """The candidates whose digest the index lacks, by sort-merge anti-join."""
        return candidates.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, rows: DataFrame) -> None:
        """Add rows for new digests. One task holds one bucket, so each append adds one file a bucket."""
        (rows.select("digest", "keep_id", "n_chars", "batch").repartition(self.buckets, "digest")
             .write.insertInto(self.name))

    def files_a_bucket(self) -> float:
        """Data files of the index for each of its buckets."""
        names = [f.getPath().getName() for f in self._files(self._folder(self.generation))]
        return sum(n.startswith("part-") for n in names) / self.buckets

    def merge(self) -> None:
        """Write the next generation, with one sorted file for each bucket, and drop this one."""
        old, folder = self.name, self._folder(self.generation + 1)
        remove_path(self.spark, folder)  # of a merge that was broken off
        name = "digest_index_" + hashlib.md5(folder.encode()).hexdigest()
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        # the files are read as plain ones: read as buckets, they would not be dealt out again
        rows = self.spark.read.schema(self.read().schema).parquet(self._folder(self.generation))
        (rows.repartition(self.buckets, "digest").write.format("parquet").option("path", folder)
             .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(name))
        self.generation, self.name = self.generation + 1, name
        self.spark.sql(f"DROP TABLE IF EXISTS {old}")
        remove_path(self.spark, self._folder(self.generation - 1))

    def close(self, delete: bool = False) -> None:
        """Take the index out of the catalogue; with ``delete`` its files go too."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if delete:
            remove_path(self.spark, self.path)


def read_digests(docs: DataFrame) -> DataFrame:
    """``digest, doc_id, n_chars, copies``: one row for each different (text, id, length)."""
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.length(text_or_empty("text")).cast("long").alias("n_chars"),
                        digest(F.col("text")).alias("digest"))
            .groupBy("digest", "doc_id", "n_chars").agg(F.count(F.lit(1)).alias("copies")))


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str | None = None, most_files: float = 8) -> DataFrame:
    """Decide a batch against the index, and add its new texts to the index.

    Returns one row for each different (digest, doc_id, n_chars) of the batch:
    ``digest, doc_id, n_chars, copies, keep_id, group_size, keeper``. Of equal
    texts the row with the most code points, then the smallest doc_id, is the
    keeper, unless another batch already holds the text. ``group_size``
    counts the batch's rows with the text. Without a name the batch is one of
    its own, which cannot be repeated. Over ``most_files`` files a bucket the
    index is merged.
    """
    batch = batch or uuid.uuid4().hex
    rows = checkpoint(read_digests(docs))
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"),
                          F.col("doc_id").alias("doc_id")))
    groups = checkpoint(rows.groupBy("digest")
                        .agg(best.alias("best"), F.sum("copies").alias("group_size"))
                        .select("digest", F.col("best.doc_id").alias("keep_id"),
                                (-F.col("best.less")).alias("n_chars"), "group_size", F.lit(batch).alias("batch")))
    index.append(checkpoint(index.unseen(groups)))
    held = index.read().select("digest", F.col("keep_id").alias("held_id"), F.col("batch").alias("of_batch"))
    decided = checkpoint(
        groups.join(held.hint("merge"), "digest")
        .select("digest", F.col("held_id").alias("keep_id"), "group_size", F.col("n_chars").alias("keep_chars"),
                (F.col("of_batch") == batch).alias("new")))
    if index.files_a_bucket() > most_files:
        index.merge()
    # both sides are written tables of their own, so that a text with very many rows is split by AQE
    return rows.join(decided, "digest").select(
        "digest", "doc_id", "n_chars", "copies", "keep_id", "group_size",
        (F.col("new") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
         & (F.col("n_chars") == F.col("keep_chars"))).alias("keeper"))


def new_index(spark: SparkSession, buckets: int | None = None) -> DigestIndex:
    """An empty index in the shared folder; by default as many buckets as shuffle partitions."""
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return DigestIndex(spark, work_path(spark, "digest_index"), n)


def decide_alone(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``deduplicate`` against an empty index that is deleted again."""
    index = new_index(spark)
    decided = deduplicate(docs, index)
    index.close(delete=True)
    return decided


def survivors(spark: SparkSession, docs: DataFrame, index: DigestIndex | None = None,
              batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    decided = deduplicate(docs, index, batch) if index else decide_alone(spark, docs)
    rows = decided.select("doc_id", F.struct("digest", "n_chars").alias("key"), "copies", "keeper")
    key = F.struct(digest(F.col("text")).alias("digest"),
                   F.length(text_or_empty("text")).cast("long").alias("n_chars"))
    return keep_rows(docs, checkpoint(rows), key)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = decide_alone(spark, read_table(spark, sf_dir, "documents"))
    return (decided.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select("doc_id", "keep_id", "group_size", (F.col("keeper") & (F.col("copy") == 1)).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))


OP5_SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS h
  FROM documents),
r AS (
  SELECT *, row_number() OVER (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST) AS rn,
         first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY h) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, h AS text_sha256 FROM r
"""
