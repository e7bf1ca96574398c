"""Token counts as delta-maintained rollups (operator 1).

A ledger keeps a signed log and the totals that follow from it. A batch of
changes becomes signed rows: an inserted document adds its counts, a deleted
one takes its present counts away, a revised one does both. The totals by
source, language and tokenizer version are additive, so a batch only adds its
own sums to them; no document is ever counted again for another one's sake.

Commits are idempotent. A batch has an id; its log rows and the new totals are
written first, under names that a repeated attempt overwrites, and one small
table, written last, makes them valid. A batch whose id is committed is not
applied again. One writer at a time is assumed.

Defined results: a null text has no tokens but counts as a document; null
sources and languages are groups of their own; several rows of one doc_id add
up, and deleting or revising it takes all of them away; deleting an unknown
document changes nothing, and revising one inserts it; within a batch,
deletions and revisions refer to the state before it. Groups whose documents
are all gone are not returned. Other columns are not looked at.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.bpe import default_vocabulary, encoder
from pagemill.llm.common import checkpoint, read_table, small_side, text_or_empty, work_path

GROUP = ["source", "lang", "version"]
LOG = "doc_id long, source string, lang string, version string, d_docs long, d_tokens long"
Counter = Callable[[Column], Column]


def count_words(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.size(F.array_remove(F.split(text_or_empty(text), "[\\x20\\x09-\\x0D]+"), "")).cast("long")


def bpe_counter(path: str, pattern: str) -> Counter:
    """Counts byte-level BPE tokens by the rank file at ``path``, which every executor must have."""
    @F.arrow_udf("long")
    def count(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(path, pattern)
        for batch in texts:
            yield pa.array([enc.count(t) for t in batch.to_pylist()], pa.int64())

    return lambda text: count(text_or_empty(text))


class Ledger:
    """Signed log and totals under ``path``."""

    def __init__(self, spark: SparkSession, path: str, counters: dict[str, Counter]):
        self.spark, self.path, self.counters = spark, path, counters
        self._state = 0
        self._done: set[str] = set()

    def _at(self, *parts: str) -> str:
        return os.path.join(self.path, *parts)

    def _write(self, df: DataFrame, *parts: str) -> None:
        df.write.mode("overwrite").parquet(self._at(*parts))

    def _refresh(self) -> None:
        """Read which batches are committed: the one of each state, up to the first state without."""
        while True:
            where = self._at("commits", f"{self._state + 1:08d}")
            if not _exists(self.spark, os.path.join(where, "_SUCCESS")):
                return
            self._done.add(self.spark.read.parquet(where).first()["batch"])
            self._state += 1

    def log(self) -> DataFrame:
        """The signed rows of all committed batches."""
        self._refresh()
        if not self._state:
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(*[self._at("log", f"{i:08d}") for i in range(1, self._state + 1)])

    def totals(self) -> DataFrame:
        """``source, lang, version, n_docs, n_tokens``."""
        self._refresh()
        if not self._state:
            return self.spark.createDataFrame([], "source string, lang string, version string, n_docs long, n_tokens long")
        return self.spark.read.parquet(self._at("totals", f"{self._state:08d}"))

    def _signed(self, changes: DataFrame) -> DataFrame:
        """Signed log rows of ``changes(doc_id, op, text, source, lang)``."""
        counts = F.array(*[F.struct(F.lit(v).alias("version"), c(F.col("text")).alias("n"))
                           for v, c in self.counters.items()])
        added = (changes.filter(F.col("op").isin("insert", "revise"))
                 .select("doc_id", "source", "lang", F.explode(counts).alias("c"))
                 .select("doc_id", "source", "lang", "c.version", F.lit(1).cast("long").alias("d_docs"),
                         F.col("c.n").alias("d_tokens")))
        if not self._state:
            return added
        gone = checkpoint(changes.filter(F.col("op").isin("delete", "revise"))
                          .select(F.col("doc_id").alias("gone_id")).distinct())
        known = self.log().filter(F.col("version").isin(list(self.counters)))
        taken = (known.join(small_side(gone), F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_semi")
                 .groupBy("doc_id", *GROUP).agg(F.sum("d_docs").alias("d"), F.sum("d_tokens").alias("t"))
                 .filter("d <> 0 OR t <> 0")
                 .select("doc_id", *GROUP, (-F.col("d")).alias("d_docs"), (-F.col("t")).alias("d_tokens")))
        return added.unionByName(taken)

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Apply and commit a batch; False if it was committed before."""
        self._refresh()
        if batch in self._done:
            return False
        state = f"{self._state + 1:08d}"
        rows = changes.select(F.col("doc_id").cast("long").alias("doc_id"), "op", "text", "source", "lang")
        self._write(self._signed(rows), "log", state)
        delta = (self.spark.read.schema(LOG).parquet(self._at("log", state)).groupBy(*GROUP)
                 .agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens")))
        sums = (self.totals().unionByName(delta).groupBy(*GROUP)
                .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
                .filter("n_docs <> 0 OR n_tokens <> 0"))
        self._write(sums, "totals", state)
        self._write(self.spark.createDataFrame([(batch,)], "batch string").coalesce(1), "commits", state)
        self._refresh()
        return True


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a file is there, by Spark's own file systems."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


def production_counters() -> dict[str, Counter]:
    return {"words": count_words, "byte_bpe_multi_50k": bpe_counter(*default_vocabulary())}


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted; those labelled toxic are then deleted, and the others
    labelled low in quality revised to texts with single spaces; a repeated batch changes nothing."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    marks = (read_table(spark, sf_dir, "labels").filter("doc_id IS NOT NULL").groupBy("doc_id")
             .agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality")))
    toxic = marks.filter("toxic = 1").select("doc_id", F.lit("delete").alias("op"), *[
        F.lit(None).cast("string").alias(c) for c in ("text", "source", "lang")])
    low = checkpoint(marks.filter("quality = 0 AND coalesce(toxic, 0) <> 1").select("doc_id"))
    revised = docs.join(small_side(low), "doc_id", "left_semi").select(
        "doc_id", F.lit("revise").alias("op"), F.regexp_replace("text", "[\\x20\\x09-\\x0D]+", " ").alias("text"),
        "source", "lang")
    ledger = Ledger(spark, work_path(spark, "token_ledger"), production_counters())
    ledger.apply("load", docs.withColumn("op", F.lit("insert")))
    ledger.apply("toxic", toxic)
    ledger.apply("revision", revised)
    ledger.apply("toxic", toxic)
    return ledger.totals()
