"""Merkle manifest of a dataset by bitmap ranks and keyed slot arrays (operator 11).

Each row becomes a leaf digest where it is read; from then on only digests
move. A leaf's coordinate in its source is its rank: compressed bitmaps of the
doc_ids are merged over all tasks, a popcount directory holds what precedes
each word, and a rank query gives the position without sorting
(``ranks.positions``). Leaves are then keyed by position into slot arrays of
``3 ** DEPTH`` slots, one row each, and one pass reduces ``DEPTH`` levels of the
tree at once; the next pass takes the arrays' roots as its nodes. Paths go down
the same arrays. So no task holds more than an array, a source with a third of
all rows is spread over its arrays, and there are ``log(rows) / log(243)``
passes.

Defined results: a null column is ``-``; a null source is a source of its own,
before all others; a null doc_id precedes all ids and is never tampered with;
rows with the same doc_id are ordered by leaf digest, and rows alike in all
five columns are leaves of their own beside each other. A source of one row has
its leaf as subroot. No rows give no rows. Columns other than the five are not
looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.common import checkpoint, read_table, small_side
from pagemill.llm.ranks import positions, same

ARITY = 3
#: Levels that one slot array reduces; an array has ARITY ** DEPTH slots.
DEPTH = 5
SLOTS = ARITY ** DEPTH
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def part(value: Column) -> Column:
    """``-`` for null, else the byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """The digest (32 bytes) of a row with ``text`` as its text."""
    return F.unhex(F.sha2(F.concat(*[part(F.col(c)) for c in COLUMNS[:-1]], part(text)).cast("binary"), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """``grp, doc_id, digest, tampered``: the leaf of each row, and what tampering makes of it (null: the same)."""
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    changed = chosen & F.coalesce(F.contains("text", F.lit("\n")), F.lit(False))
    return docs.select(F.col("source").alias("grp"), F.col("doc_id").cast("long").alias("doc_id"),
                       leaf(F.col("text")).alias("digest"),
                       F.when(changed, leaf(F.replace("text", F.lit("\n"), F.lit("")))).alias("tampered"))


def digest(parts: bytes) -> bytes:
    return hashlib.sha256(parts).hexdigest().encode()


def levels_of(slots: list[bytes], fixed: bool) -> list[list[bytes]]:
    """The levels of one array from its slots (hex) to its root: ``DEPTH`` levels up if ``fixed``, else to one node."""
    out = [slots]
    while (len(out) <= DEPTH) if fixed else (len(out[-1]) > 1):
        row = out[-1]
        out.append([digest(b"".join(row[i:i + ARITY])) for i in range(0, len(row), ARITY)])
    return out


def branch(levels: list[list[bytes]], i: int) -> list[bytes]:
    """What stands left and right of slot ``i``'s node at each level: left, right, left, right ..."""
    out = []
    for row in levels[:-1]:
        start = i - i % ARITY
        out += (b"".join(row[start:i]), b"".join(row[i + 1:start + ARITY]))
        i //= ARITY
    return out


def fold(node: bytes, path: list[bytes]) -> bytes:
    for k in range(0, len(path), 2):
        node = digest(path[k] + node + path[k + 1])
    return node


def _arrays(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[list[bytes]]]]:
    """Row number, offset of its first slot, and levels of each array in the batch."""
    slots = batch.column("slots")
    digests = [d.hex().encode() for d in slots.flatten().field("digest").to_pylist()]
    start = 0
    for r, (n, many) in enumerate(zip(slots.value_lengths().to_pylist(), batch.column("many").to_pylist())):
        yield r, start, levels_of(digests[start:start + n], many)
        start += n


def _up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roots = [bytes.fromhex(levels[-1][0].decode()) for _, _, levels in _arrays(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("block"), pa.array(roots, pa.binary())],
                                         ["grp", "pos", "digest"])


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path of each slot's node: its branch in the array, then the array's own path."""
    for batch in batches:
        above, block = batch.column("path").to_pylist(), batch.column("block").to_pylist()
        rows, pos, path = [], [], []
        for r, _, levels in _arrays(batch):
            for i in range(len(levels[0])):
                rows.append(r)
                pos.append(block[r] * SLOTS + i)
                path.append(branch(levels, i) + above[r])
        take = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("grp").take(take), pa.array(pos, pa.int64()), pa.array(path, pa.list_(pa.binary())),
             batch.column("subroot").take(take)], ["grp", "pos", "path", "subroot"])


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The proof and the folded root of each leaf."""
    for batch in batches:
        above, flat = batch.column("path").to_pylist(), batch.column("slots").flatten()
        tampered = flat.field("tampered").to_pylist()
        rows, proofs, folded, own = [], [], [], []
        for r, start, levels in _arrays(batch):
            for i, node in enumerate(levels[0]):
                path = branch(levels, i) + above[r]
                changed = tampered[start + i]
                rows.append(r)
                own.append(node)
                proofs.append(digest(b"".join(path)))
                folded.append(fold(node if changed is None else changed.hex().encode(), path))
        text = lambda values: pa.array([v.decode() for v in values], pa.string())
        yield pa.RecordBatch.from_arrays(
            [flat.field("doc_id"), text(own), batch.column("subroot").take(pa.array(rows, pa.int64())),
             text(proofs), text(folded)], ["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])


def reduce(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The written slot arrays of each pass, and the roots ``grp, pos, digest``, of ``nodes(grp, pos, digest, ...)``.

    Further columns of ``nodes`` are kept in the slots of the first pass.
    """
    sizes = checkpoint(nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("n")))
    most = sizes.agg(F.max("n")).first()[0] or 0
    passes: list[DataFrame] = []
    while True:
        rest = [c for c in nodes.columns if c not in ("grp", "pos")]
        arrays = (nodes.groupBy("grp", F.expr(f"pos div {SLOTS}").alias("block"))
                  .agg(F.sort_array(F.collect_list(F.struct((F.col("pos") % SLOTS).alias("slot"), *rest))).alias("slots")))
        many = small_side(sizes.select(F.col("grp").alias("size_grp"), (F.col("n") > SLOTS).alias("many")))
        passes.append(checkpoint(arrays.join(many, same(arrays, many, [("grp", "size_grp")]))
                                 .select("grp", "block", "many", "slots")))
        kind = dict(passes[-1].dtypes)["grp"]
        nodes = checkpoint(passes[-1].mapInArrow(_up, f"grp {kind}, pos long, digest binary"))
        if most <= SLOTS:
            return passes, nodes
        most = -(-most // SLOTS)
        sizes = checkpoint(sizes.select("grp", F.ceil(F.col("n") / SLOTS).cast("long").alias("n")))


def _with_path(arrays: DataFrame, paths: DataFrame) -> DataFrame:
    """The arrays with the paths of their roots."""
    up = paths.select(F.col("grp").alias("up_grp"), F.col("pos").alias("up_pos"), "path", "subroot")
    return arrays.join(up, same(arrays, up, [("grp", "up_grp"), ("block", "up_pos")])).drop("up_grp", "up_pos")


def descend(passes: list[DataFrame], paths: DataFrame) -> DataFrame:
    """Paths ``grp, pos, path, subroot`` of the nodes of the last of ``passes``, from those of the first's roots."""
    for arrays in passes:
        kind = dict(arrays.dtypes)["grp"]
        paths = checkpoint(_with_path(arrays, paths).mapInArrow(
            _down, f"grp {kind}, pos long, path array<binary>, subroot string"))
    return paths


def in_order(table: DataFrame, column: str) -> DataFrame:
    """``table`` with ``pos``, its rows' places by ``column`` (nulls first), by a distributed sort."""
    sort = checkpoint(table.orderBy(F.col(column).asc_nulls_first()).withColumn("at", F.monotonically_increasing_id()))
    task = F.shiftright("at", 33)
    before = F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))  # a row for each task
    starts = (sort.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n"))
              .select("task", F.coalesce(before, F.lit(0).cast("long")).alias("start")))
    return (sort.withColumn("task", task).join(F.broadcast(starts), "task")
            .withColumn("pos", F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("at", "task", "start"))


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for each row of ``docs``."""
    spark = docs.sparkSession
    rows = checkpoint(leaves(docs))
    passes, subroots = reduce(positions(rows, ["grp"], "doc_id", "digest"))
    ordered = checkpoint(in_order(subroots.select(F.col("grp").alias("source"), "digest"), "source"))
    if ordered.isEmpty():
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, "
                                         "proof_sha256 string, folded_root string, verified boolean")
    top, roots = reduce(ordered.select(F.lit(0).alias("grp"), "pos", "digest"))
    root = bytes(roots.first()["digest"]).hex()
    start = spark.range(1).select(F.lit(0).alias("grp"), F.lit(0).cast("long").alias("pos"),
                                  F.array().cast("array<binary>").alias("path"), F.lit("").alias("subroot"))
    places = descend(top[::-1], start).select("pos", "path")
    paths = ordered.join(places, "pos").select(
        F.col("source").alias("grp"), F.lit(0).cast("long").alias("pos"), "path",
        F.lower(F.hex("digest")).alias("subroot"))
    paths = descend(passes[:0:-1], checkpoint(paths))
    proofs = _with_path(passes[0], paths).mapInArrow(
        _prove, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    return proofs.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root",
                         (F.col("folded_root") == root).alias("verified"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(read_table(spark, sf_dir, "documents"))


_PARTS = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in COLUMNS[:-1])
#: The unsigned crc32 of a decimal number: its bytes one by one, eight shifts after each (-1 in the list).
CRC32_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
    string_split({0}::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"""

OP11_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, sha256({_PARTS} || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN coalesce({CRC32_SQL.format('doc_id')} % 2 = 0, false)
              THEN replace(text, chr(10), '') ELSE text END AS other, lang, n_chars
  FROM documents),
l AS (
  SELECT doc_id, source, leaf, sha256({_PARTS} || coalesce(strlen(other) || ':' || other, '-')) AS tampered,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS n, row_number() OVER () AS row_no
  FROM d),
tree(lvl, source, pos, digest, n) AS (
  SELECT 0, source, pos, leaf, n FROM l
  UNION ALL
  SELECT lvl + 1, source, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3
  FROM tree WHERE n > 1 GROUP BY lvl, source, pos // 3, n),
sub AS (
  SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM tree WHERE n = 1),
top(lvl, pos, digest, n) AS (
  SELECT 0, pos, digest, n FROM sub
  UNION ALL
  SELECT lvl + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3
  FROM top WHERE n > 1 GROUP BY lvl, pos // 3, n),
low(row_no, source, lvl, pos, n, cur, proof) AS (
  SELECT row_no, source, 0, pos, n, tampered, '' FROM l
  UNION ALL
  SELECT f.row_no, f.source, f.lvl + 1, f.pos // 3, (f.n + 2) // 3,
         sha256(string_agg(CASE WHEN t.pos = f.pos THEN f.cur ELSE t.digest END, '' ORDER BY t.pos)),
         f.proof || coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (WHERE t.pos <> f.pos), '')
  FROM low f JOIN tree t ON t.source IS NOT DISTINCT FROM f.source AND t.lvl = f.lvl AND t.pos // 3 = f.pos // 3
  WHERE f.n > 1 GROUP BY f.row_no, f.source, f.lvl, f.pos, f.n, f.cur, f.proof),
high(row_no, lvl, pos, n, cur, proof) AS (
  SELECT f.row_no, 0, s.pos, s.n, f.cur, f.proof
  FROM low f JOIN sub s ON s.source IS NOT DISTINCT FROM f.source WHERE f.n = 1
  UNION ALL
  SELECT f.row_no, f.lvl + 1, f.pos // 3, (f.n + 2) // 3,
         sha256(string_agg(CASE WHEN t.pos = f.pos THEN f.cur ELSE t.digest END, '' ORDER BY t.pos)),
         f.proof || coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (WHERE t.pos <> f.pos), '')
  FROM high f JOIN top t ON t.lvl = f.lvl AND t.pos // 3 = f.pos // 3
  WHERE f.n > 1 GROUP BY f.row_no, f.lvl, f.pos, f.n, f.cur, f.proof)
SELECT l.doc_id, l.leaf, s.digest AS subroot, r.digest AS root, sha256(h.proof) AS proof_sha256,
       h.cur AS folded_root, h.cur = r.digest AS verified
FROM l JOIN high h ON h.row_no = l.row_no AND h.n = 1
JOIN sub s ON s.source IS NOT DISTINCT FROM l.source
CROSS JOIN (SELECT digest FROM top WHERE n = 1) r
"""
