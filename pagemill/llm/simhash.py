"""SimHash near-duplicates by tiled exact comparison (operator 3).

Fingerprints are grouped in *cells* of equal population counts, taken over
each of ``blocks`` parts of the 64 bits. Two fingerprints that differ in at
most ``radius`` bits have counts whose differences sum to at most ``radius``,
so a cell is compared only with the cells in that reach and all other pairs
are skipped without loss. Cells are cut into tiles of a bounded number of
fingerprints; a task compares two tiles with numpy exclusive-or and bit
counts. Within a pair of tiles only the edges of a spanning star leave the
task, never all pairs, which is all that the components need.

``blocks`` trades copies of tiles against comparisons: the number of cells in
reach is 41 for 4 blocks and 145 for 8, while the share of all pairs that is
compared falls from about 1 in 70 to about 1 in 4,000. The result is the same.

Defined results: a null text has no words, as an empty one; a text without
words has fingerprint zero and links like any other; copies and repeated rows
share their fingerprint and so their component; a null doc_id is never the
name of a component unless all ids in it are null.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import bound_batches, checkpoint, keep_rows, read_table, text_key, text_or_empty
from pagemill.llm.components import components

SEED = 42
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16


def fingerprint(text: bytes, size: int) -> int:
    """SimHash of the ``size``-word shingles of a UTF-8 text, words split at ASCII white space."""
    words = text.lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    width = min(size, len(words))
    first, last = starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist()
    count, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(first), CHUNK):
        part = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at:at + CHUNK], last[at:at + CHUNK])],
                        np.uint64)
        for bit in range(64):
            count[bit] += int((part >> np.uint64(bit) & np.uint64(1)).sum())
    return sum(1 << bit for bit in range(64) if 2 * int(count[bit]) > len(first))


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """``doc_id, key, fp``: the fingerprint of each row's whole text; ``key`` is a hash of the text."""
    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        values = np.array([fingerprint(t, size) for t in texts], np.uint64)
        return pd.Series(values.view(np.int64))

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"),
                       simhash(text_or_empty("text").cast("binary")).alias("fp"))


def _reach(blocks: int, radius: int) -> list[list[int]]:
    """Differences between a cell and those in reach, one of each pair of opposite ones, itself first."""
    steps = product(range(-radius, radius + 1), repeat=blocks)
    near = [s for s in steps if sum(map(abs, s)) <= radius and s >= (0,) * blocks]
    return [list(s) for s in sorted(near)]


def _cell(fp, blocks: int):
    """One population count per block, as one number in base 128."""
    width = 64 // blocks
    mask = (1 << width) - 1
    cell = F.lit(0).cast("long")
    for b in range(blocks):
        part = F.shiftrightunsigned(fp, b * width).bitwiseAND(F.lit(mask).cast("long"))
        cell = cell * 128 + F.bit_count(part).cast("long")
    return cell


def _compare(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star for each component that the links between two tiles make."""
    rows, cols = [], []
    step = max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, len(a), step):
        r, c = np.nonzero(np.bitwise_count(a[at:at + step, None] ^ b[None, :]) <= radius)
        rows.append(r + at)
        cols.append(c)
    nodes, index = np.unique(np.concatenate([a[np.concatenate(rows)], b[np.concatenate(cols)]]),
                             return_inverse=True)
    left, right = np.split(index, 2)
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            break
    away = label != np.arange(len(nodes))
    return nodes[away], nodes[label[away]]


def links(points: DataFrame, radius: int = 2, blocks: int = 4, tile: int = 1024) -> DataFrame:
    """Edges ``a, b`` that connect all of ``points(fp)`` within ``radius`` bits of each other.

    ``points`` holds each fingerprint once, in a written table. Tiles hold
    about ``tile`` fingerprints, so a cell of any size is spread over many
    tasks, and the work of a task stays bounded.
    """
    reach = _reach(blocks, radius)
    base = 128 ** np.arange(blocks - 1, -1, -1)
    shifts = [int((np.array(s) * base).sum()) for s in reach]
    cells = points.withColumn("cell", _cell(F.col("fp"), blocks))
    sizes = checkpoint(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
                       .select("cell", F.ceil(F.col("n") / tile).cast("int").alias("cuts")))
    tiles = checkpoint(cells.join(sizes, "cell")
                       .withColumn("cut", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int"))
                       .groupBy("cell", "cut").agg(F.collect_list("fp").alias("fps")))
    near = sizes.select("cell", "cuts", F.explode(F.array(*[F.lit(s).cast("long") for s in shifts])).alias("shift"))
    other = sizes.select(F.col("cell").alias("cell2"), F.col("cuts").alias("cuts2"))
    pairs = (near.withColumn("cell2", F.col("cell") + F.col("shift")).join(other, "cell2")
             .withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
             .withColumn("cut2", F.explode(F.sequence(F.when(F.col("shift") == 0, F.col("cut")).otherwise(F.lit(0)),
                                                      F.col("cuts2") - 1)))
             .select("cell", "cut", "cell2", "cut2"))
    pairs = checkpoint(pairs)
    second = tiles.select(F.col("cell").alias("cell2"), F.col("cut").alias("cut2"), F.col("fps").alias("fps2"))
    both = pairs.join(tiles, ["cell", "cut"]).join(second, ["cell2", "cut2"]).select("fps", "fps2")

    def compare(batches):
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1)):
                a, b = (v.values.to_numpy().view(np.uint64) for v in (x, y))
                u, v = _compare(a, b, radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))],
                                                     names=["a", "b"])

    return both.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 2, blocks: int = 4) -> DataFrame:
    """``doc_id, key, fp, component_id, n_fingerprints`` for every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable by links of at most
    ``radius`` differing bits; ``n_fingerprints`` counts the different
    fingerprints of the component.
    """
    rows = checkpoint(fingerprints(docs, size))
    points = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    found = checkpoint(components(links(points.select("fp"), radius, blocks)))
    rooted = checkpoint(points.join(found, points["fp"] == found["node"], "left")
                        .select("fp", "least_id", F.coalesce("root", "fp").alias("root")))
    named = checkpoint(rooted.groupBy("root").agg(F.min("least_id").alias("component_id"),
                                                  F.count(F.lit(1)).alias("n_fingerprints")))
    classes = checkpoint(rooted.join(named, "root").select("fp", "component_id", "n_fingerprints", "root"))
    return rows.join(classes, "fp").select("doc_id", "key", "fp", "component_id", "n_fingerprints", "root")


def survivors(docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """One row of each component, with all columns: that of the smallest doc_id (a null one last)."""
    found = near_duplicates(docs, size, radius)
    same = checkpoint(found.groupBy("root", "doc_id", "fp", "key").agg(F.count(F.lit(1)).alias("copies")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp", "key"))
    best = checkpoint(same.groupBy("root").agg(first.alias("r")))
    keeper = (F.col("doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("fp") == F.col("r.fp"))
              & (F.col("key") == F.col("r.key")))
    rows = same.join(best, "root").select("doc_id", "key", "copies", keeper.alias("keeper"))
    return keep_rows(docs, checkpoint(rows), text_key(F.col("text")))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"), size=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
                        "n_fingerprints")
