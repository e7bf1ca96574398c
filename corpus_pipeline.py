"""Corpus pipeline: five training-data operators run one after another over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the
stage before it kept. All stages but the last return whole rows of the
documents table. ``run`` writes each stage's rows as Parquet in the shared
folder and reads them again for the next stage, so a lost executor never
reaches back over a stage.

Defined results: a null text counts as empty everywhere; tables without rows
pass through as tables without rows; other columns, whatever their names, are
kept by the filtering stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import bpe, decontam, exact_dedup, simhash, toxicity
from pagemill.llm.common import fresh, read_table, work_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents that score 0.3 or more go. The model learns from ``documents`` and ``labels``."""
    model = toxicity.fit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    (score,) = fresh(docs, "toxicity_score")
    return toxicity.score_documents(docs, model, score).filter(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the longest row stays, then that of the smallest doc_id."""
    return exact_dedup.survivors(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: the document with the smallest doc_id of each group stays."""
    return simhash.survivors(docs, size=3, radius=2)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with 5 % of their words inside benchmark windows go."""
    return decontam.survivors(docs, read_table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: ids of each text, and whether they decode to its bytes again."""
    done = bpe.round_trip(docs)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       bpe.digest_ids(F.col("ids")).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_bpe", tokenize),
]

#: SQL cannot express the trained classifier and the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
