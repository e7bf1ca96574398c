"""Substring de-duplication by prefix-partitioned sparse suffix trees (operator 12).

A passage repeats if a window of ``WINDOW`` consecutive words also starts
elsewhere. Suffixes are taken at anchors: each window's anchor is the place of
the least hash of ``PREFIX`` words in it, so equal windows have their anchors
at equal places, and one suffix in some ten stands for all windows around it.

1. Suffixes are split by prefix. A prefix of ``PREFIX`` words that occurs once
   is a leaf and falls away; one that occurs up to ``GROUP`` times is a group;
   one that occurs more often is cut into parts of that size, whose windows are
   matched across parts by their longest prefix, the whole window.
2. Groups are packed into bins of about ``BIN`` suffixes. Each bin sorts its
   suffixes, and, from the anchor backwards, what precedes them; the lengths
   that neighbours share are the trees' internal nodes. A window repeats if
   its suffix has company at a node so deep, and its left part at one so deep
   in the mirrored tree, that both together span the window.
3. The repeated windows of a text, merged, are its maximal repeats. What they
   cover goes.

Only text hashes, anchors and the surroundings of repeated anchors are
gathered; the texts themselves are shuffled once, by their hash, for the two
joins that need them. Equal texts are represented by one of them: with two or
more, all their windows repeat.

Defined results: a null text has no words; a text of fewer words than the window
keeps them all; windows reach over no text's end; rows alike in doc_id and text
are copies of each other; doc_id may be null or repeat. No rows give no rows.
Columns other than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import checkpoint, read_table, slices, text_or_empty, work_path
from pagemill.llm.word_windows import Words, anchors, classes, grams, mix

#: Words of a window, and of the prefix that suffixes are split by.
WINDOW, PREFIX = 35, 8
#: Suffixes of one group, and of one bin.
GROUP, BIN = 1024, 16384
#: Bytes of text that a worker has as arrays at a time.
PART = 1 << 20
#: Surroundings with more bytes a word than this travel as hashes of their words.
WIDE = 16


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def sample(window: int, size: int):
    """The anchors of each text: their prefixes' hashes and word numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2, PART):
                words = Words(_texts(batch.column(2)))
                g = grams(words.hashes(), size)
                at, _, _ = anchors(words, g, window, size)
                ends = np.searchsorted(at, words.first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), _lists(g[at].view(np.int64), ends, pa.int64()),
                     _lists(at - words.first[words.doc[at]], ends, pa.int64())],
                    ["doc_id", "key", "hashes", "places"])
    return run


def surround(window: int, size: int):
    """The surroundings of each text's repeated anchors, with the bin key of the part of the group that they belong to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, whole.schema.get_field_index("text"), PART):
                words = Words(_texts(batch.column("text")))
                h = words.hashes()
                g = grams(h, size)
                at, lo, hi = anchors(words, g, window, size)
                found = batch.column("found")
                flat = found.flatten()
                place = np.asarray(flat.field("place")) + np.repeat(words.first[:-1], np.asarray(found.value_lengths()))
                parts = np.asarray(flat.field("parts"))
                order = np.argsort(place)
                where = np.searchsorted(place[order], at)
                where[where == len(place)] = 0
                hit = (place[order][where] == at) if len(place) else np.zeros(len(at), bool)
                at, lo, hi, parts = at[hit], lo[hit], hi[hit], parts[order][where][hit] if len(place) else parts
                if not len(at):
                    continue
                doc = words.doc[at]
                rid = np.asarray(batch.column("rid"))[doc]
                own = lo - words.first[doc]
                part = mix(rid.astype(np.uint64) * np.uint64(31) + own.astype(np.uint64)) % parts.astype(np.uint64)
                a, b = words.start[lo], words.end[hi + window - 1]
                wide = (b - a) > WIDE * (hi - lo + window)
                data = words.data.tobytes()
                around = [h[lo[i]:hi[i] + window].tobytes() if wide[i] else data[a[i]:b[i]] for i in range(len(at))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mix(g[at] + part).view(np.int64)), pa.array(parts > 1), pa.array(rid), pa.array(own),
                     pa.array(hi - lo + 1), pa.array(at - lo), pa.array(wide), pa.array(around, pa.binary())],
                    ["bin", "cut", "rid", "first", "n", "at", "wide", "around"])
    return run


SURROUND = "bin long, cut boolean, rid long, first long, n long, at long, wide boolean, around binary"


def word_hashes(wide: np.ndarray, around: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """The word hashes of all surroundings, one after another."""
    out = np.zeros(int(sizes.sum()), np.uint64)
    is_wide = np.repeat(wide, sizes)
    if wide.any():
        out[is_wide] = np.frombuffer(b"".join(a for a, w in zip(around, wide) if w), np.uint64)
    if not wide.all():
        out[~is_wide] = Words([a for a, w in zip(around, wide) if not w]).hashes()
    return out


def repeated(h: np.ndarray, sizes: np.ndarray, n: np.ndarray, at: np.ndarray, cut: np.ndarray, window: int, size: int):
    """Which windows around the bin's suffixes repeat, and one of each kind of window that may repeat in another part.

    Suffix ``i`` has the word hashes ``h[start[i]:start[i] + sizes[i]]``, its
    anchor is word ``at[i]`` of them and it stands for the windows that start
    at the first ``n[i]``. Returns a table of flags by suffix and anchor place
    in the window, and the pairs (suffix, place) that stand for the cut groups' kinds.
    """
    of, m = window - size + 1, len(n)
    start = np.cumsum(sizes) - sizes
    h = np.concatenate((h, np.zeros(1, np.uint64)))
    forward = at[:, None] + np.arange(window)
    right = h[np.where(forward < sizes[:, None], start[:, None] + forward, len(h) - 1)]
    back = at[:, None] - 1 - np.arange(max(1, of - 1))
    left = h[np.where(back >= 0, start[:, None] + back, len(h) - 1)]
    r_order, r_shared = classes(right)
    l_order, l_shared = classes(left)
    flags = np.zeros((m, of), bool)
    pairs = []
    for place in range(of):
        s = at - place
        some = np.flatnonzero((s >= 0) & (s < n))
        if not len(some):
            continue
        r_node, l_node = np.zeros(m, np.int64), np.zeros(m, np.int64)
        r_node[r_order] = np.cumsum(r_shared < window - place)
        l_node[l_order] = np.cumsum(l_shared < place)
        _, first, kind, count = np.unique(r_node[some] * (m + 1) + l_node[some], return_index=True,
                                          return_inverse=True, return_counts=True)
        flags[some, place] = count[kind] > 1
        open_kinds = np.zeros(len(first), bool)
        open_kinds[kind[cut[some]]] = True
        chosen = some[first[open_kinds]]
        pairs.append(np.stack((chosen, np.full(len(chosen), place)), 1))
    return flags, np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)


def window_digests(h: np.ndarray, begin: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each window of word hashes."""
    one, two = np.zeros(len(begin), np.uint64), np.zeros(len(begin), np.uint64)
    for j in range(window):
        w = h[begin + j]
        one = one * np.uint64(0x9E3779B97F4A7C15) + w
        two = mix(two ^ w) + np.uint64(j)
    return mix(one).view(np.int64), two.view(np.int64)


def subtrees(window: int, size: int):
    """Repeated runs of windows ``rid, first, last``, and open kinds with their digests ``one, two``, of one bin."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        rows = sum(b.num_rows for b in got)
        if not rows:
            return
        column = lambda c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in got])
        n, at, rid, first, cut, wide = (column(c) for c in ("n", "at", "rid", "first", "cut", "wide"))
        sizes = n + window - 1
        h = word_hashes(wide.astype(bool), [a for b in got for a in b.column("around").to_pylist()], sizes)
        flags, pairs = repeated(h, sizes, n, at, cut.astype(bool), window, size)
        # places run against the windows: the window at place k starts k words before the anchor
        table = np.zeros((rows, window - size + 3), np.int8)
        table[:, 1:-1] = flags[:, ::-1]
        edge = np.diff(table, axis=1)
        (i, a), (_, b) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        base = first + at - (window - size)
        none = pa.nulls(len(i), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(rid[i]), pa.array(base[i] + a), pa.array(base[i] + b - 1), none, none],
            ["rid", "first", "last", "one", "two"])
        if len(pairs):
            i, begin = pairs[:, 0], at[pairs[:, 0]] - pairs[:, 1]
            one, two = window_digests(h, (np.cumsum(sizes) - sizes)[i] + begin, window)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid[i]), pa.array(first[i] + begin), pa.array(first[i] + begin), pa.array(one), pa.array(two)],
                ["rid", "first", "last", "one", "two"])
    return run


def strip(window: int):
    """``doc_id, n_words, n_removed, kept_sha256`` of each text without the words that its repeated windows cover."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, whole.schema.get_field_index("text"), PART):
                words = Words(_texts(batch.column("text")))
                size = np.diff(words.first)
                runs = batch.column("runs")
                of = np.repeat(np.arange(len(size)), runs.value_lengths().fill_null(0).to_numpy())
                first, last = (runs.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("first", "last"))
                first, end = np.where(first < 0, 0, first), np.where(first < 0, size[of], last + window)
                real = size[of] >= window
                edge = np.zeros(len(words.start) + 1, np.int64)
                np.add.at(edge, (words.first[of] + first)[real], 1)
                np.add.at(edge, (words.first[of] + end)[real], -1)
                keep = np.cumsum(edge[:-1]) == 0
                text, begin = words.joined(keep)
                kept = np.concatenate(([0], np.cumsum(keep)))[words.first]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(size), pa.array(size - np.diff(kept)),
                     pa.array([hashlib.sha256(text[a:max(a, b - 1)]).hexdigest() for a, b in zip(begin[:-1], begin[1:])],
                              pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_sha256"])
    return run


def repeats(texts: DataFrame, window: int = WINDOW, size: int = PREFIX) -> DataFrame:
    """``key, runs``: the repeated windows ``runs(first, last)`` of each text, for ``texts(doc_id, key, text)``.

    A text that occurs more than once has the run ``(-1, -1)``: all its windows repeat.
    """
    spark = texts.sparkSession
    path = work_path(spark, "anchors")
    (texts.mapInArrow(sample(window, size), "doc_id long, key string, hashes array<long>, places array<long>")
     .withColumn("rid", F.monotonically_increasing_id()).write.parquet(path))
    sampled = spark.read.parquet(path)
    least = checkpoint(sampled.groupBy("key").agg(F.min(F.struct("rid", "doc_id")).alias("least"),
                                                  F.count(F.lit(1)).alias("copies")))
    prefixes = checkpoint(sampled.select(F.explode("hashes").alias("hash")).groupBy("hash")
                          .agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                          .select("hash", F.ceil(F.col("n") / GROUP).cast("long").alias("parts"), "n"))
    bins = max(1, -(-int(prefixes.agg(F.sum("n")).first()[0] or 0) // BIN))
    found = (sampled.select("rid", F.explode(F.arrays_zip("hashes", "places")).alias("at"))
             .select("rid", F.col("at.hashes").alias("hash"), F.col("at.places").alias("place"))
             .join(prefixes.select("hash", "parts"), "hash")
             .groupBy("rid").agg(F.collect_list(F.struct("place", "parts")).alias("found")))
    marked = checkpoint(found.join(least.select(F.col("least.rid").alias("rid"), "key",
                                                F.col("least.doc_id").alias("least")), "rid"))
    # one of equal texts will do; ids are compared in a form that is no second key of the join
    chosen = F.xxhash64("doc_id").bitwiseXOR(F.xxhash64("least")) == 0
    around = (texts.join(marked, "key").filter(chosen).select("rid", "found", "text")
              .mapInArrow(surround(window, size), SURROUND).repartition(bins, "bin"))
    runs = around.mapInArrow(subtrees(window, size), "rid long, first long, last long, one long, two long")
    # an open kind has one row a bin at most; it repeats if it has two
    across = (runs.filter("one IS NOT NULL").groupBy("one", "two")
              .agg(F.collect_list(F.struct("rid", "first", "last")).alias("each")).filter("size(each) > 1")
              .select(F.explode("each").alias("run")).select("run.*"))
    each = runs.filter("one IS NULL").select("rid", "first", "last").unionByName(across)
    once = least.filter("copies = 1").select(F.col("least.rid").alias("rid"), "key")
    by_key = each.join(once, "rid").select("key", "first", "last")
    copied = least.filter("copies > 1").select("key", F.lit(-1).cast("long").alias("first"),
                                               F.lit(-1).cast("long").alias("last"))
    return by_key.unionByName(copied).groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("runs"))


def deduplicate(docs: DataFrame, window: int = WINDOW, size: int = PREFIX) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for each row of ``docs``."""
    text = text_or_empty("text")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text.cast("binary")).alias("key"),
                        text.alias("text"))
    runs = repeats(texts, window, size)
    return texts.join(runs, "key", "left").select("doc_id", "text", "runs").mapInArrow(
        strip(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(read_table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
w AS (
  SELECT r, i, sha256(array_to_string(words[i:i + 34], ' ')) AS h
  FROM (SELECT r, words, unnest(range(1, len(words) - 33)) AS i FROM d)),
hit AS (SELECT r, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
runs AS (
  SELECT r, i, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i), 1000) AS gap FROM hit),
gone AS (SELECT r, unnest(range(i + 35 - least(gap, 35), i + 35)) AS k FROM runs),
word AS (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM d),
kept AS (
  SELECT word.r, string_agg(word, ' ' ORDER BY word.k) AS text, count(*) AS n
  FROM word ANTI JOIN gone ON gone.r = word.r AND gone.k = word.k GROUP BY word.r)
SELECT d.doc_id, len(words)::BIGINT AS n_words, len(words) - coalesce(kept.n, 0) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.r = d.r
"""
