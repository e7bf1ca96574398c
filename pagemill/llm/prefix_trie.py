"""Conversation prefix trie by fixed-length block hashing (operator 13).

Turns become digests where they are read; texts are never shuffled. Positions
in a conversation are bitmap ranks of its turn numbers (``ranks.positions``),
so a conversation with very many turns needs no sort in one task. Every
``BLOCK`` turns make a block row with the digests of its turn boundaries; the
digest of all blocks up to each block comes from a scan by doubling, in which
only conversations longer than the step take part. Conversations are grouped
by these block digests first. The turn boundaries inside a block are grouped
anew only where a node has several different blocks below it; elsewhere all
boundaries of the block have the block's members. Counts over subtrees need no
walk: they are sums over a node's members of what each member adds.

For a node v with n members, U(m) the code points before the first node whose
smallest member is m, and P(v) the code points before v's last turn, the saved
tokens below and at v are ``sum U(m) - U(smallest) - (n - 1) P(v)``.

Defined results: turns with equal numbers are ordered by the digest of role and
text; a null conv_id names no conversation and its rows are left out; a
conversation rebuilt to no turns is a member of the root alone. No
conversations give no nodes. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import checkpoint, read_table, text_or_empty
from pagemill.llm.merkle import CRC32_SQL
from pagemill.llm.ranks import positions

#: Turns in a block.
BLOCK = 4
#: Conversations that share their first turns are numbered alike but for the last digits.
FAMILY = 100
#: At most this many turns come from the first of the family, one less than the divisor of the crc32.
HEADS = 5
#: Ids below this many bits are joined in one row before a node's ids are hashed.
ID_BITS = 12


def turns(conversations: DataFrame) -> DataFrame:
    """``conv, turn, digest, chars`` of each turn."""
    role, text = text_or_empty("role"), text_or_empty("text")
    coded = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(coded.cast("binary"), 256)).alias("digest"), F.length(text).cast("long").alias("chars"))


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv, i, digest, chars`` of the rebuilt conversations, and all their ids, of ``placed(conv, pos, ...)``."""
    wanted = (F.crc32(F.col("conv").cast("string").cast("binary")) % (HEADS + 1)).cast("long")
    heads = checkpoint(placed.filter(F.col("pos") < HEADS).select(
        F.col("conv").alias("base"), "pos", "digest", "chars"))
    sizes = heads.groupBy("base").agg(F.count(F.lit(1)).alias("there"))
    convs = checkpoint(placed.select("conv").distinct()
                       .withColumn("h", wanted).withColumn("base", F.col("conv") - F.col("conv") % FAMILY)
                       .join(sizes, "base", "left")
                       .select("conv", "base", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("taken")))
    first = convs.join(heads, "base").filter("pos < h").select("conv", F.col("pos").alias("i"), "digest", "chars")
    own = (placed.filter(F.col("pos") >= wanted).join(convs.select("conv", "h", "taken"), "conv")
           .select("conv", (F.col("taken") + F.col("pos") - F.col("h")).alias("i"), "digest", "chars"))
    return first.unionByName(own), convs.select("conv")


def blocks_of(rows: DataFrame) -> DataFrame:
    """``conv, b, inner, chars, key, total``: the boundaries' digests in a block, and the block's own digest and length."""
    slots = F.sort_array(F.collect_list(F.struct((F.col("i") % BLOCK).alias("j"), F.lower(F.hex("digest")).alias("d"),
                                                 F.col("chars").alias("c"))))
    grouped = rows.groupBy("conv", F.expr(f"i div {BLOCK}").alias("b")).agg(slots.alias("slots"))
    return (grouped.select("conv", "b", F.col("slots.d").alias("ds"), F.col("slots.c").alias("chars"))
            .withColumn("inner", F.expr("transform(sequence(1, size(ds)), k -> sha2(concat_ws('', slice(ds, 1, k)), 256))"))
            .select("conv", "b", "inner", "chars", F.element_at("inner", -1).alias("key"),
                    F.expr("aggregate(chars, 0L, (a, x) -> a + x)").alias("total")))


def scan(blocks: DataFrame) -> DataFrame:
    """The blocks with ``key`` and ``total`` over all blocks of the conversation up to each, by doubling.

    A conversation leaves the scan when the step is past its length, so a
    round costs as much as the conversations that are still longer.
    """
    sizes = blocks.groupBy("conv").agg(F.max("b").alias("top"))
    table = checkpoint(blocks.join(sizes, "conv"))
    most = table.agg(F.max("top")).first()[0] or 0
    done, step = [], 1
    while step <= most:
        done.append(table.filter(F.col("top") < step))
        table = table.filter(F.col("top") >= step)
        left = table.select("conv", (F.col("b") + step).alias("b"), F.col("key").alias("k"), F.col("total").alias("t"))
        table = checkpoint(table.join(left, ["conv", "b"], "left").select(
            "conv", "b", "top", "inner", "chars",
            F.when(F.col("k").isNull(), F.col("key")).otherwise(F.sha2(F.concat("k", "key"), 256)).alias("key"),
            (F.col("total") + F.coalesce("t", F.lit(0))).alias("total")))
        step *= 2
    for part in done:
        table = table.unionByName(part)
    return table


def with_parent(blocks: DataFrame) -> DataFrame:
    """The scanned blocks with ``up``, the key of all before them (empty at the first), and ``before``, its code points."""
    left = blocks.select("conv", (F.col("b") + 1).alias("b"), F.col("key").alias("up"), F.col("total").alias("before"))
    return blocks.join(left, ["conv", "b"], "left").withColumn("up", F.coalesce("up", F.lit(""))).withColumn(
        "before", F.coalesce("before", F.lit(0).cast("long")))


def boundary(up: Column, j: Column, inner: Column, key: Column) -> Column:
    """The id of the node after turn ``j`` of a block: the block's key at a full block's end, else its own digest."""
    return F.when(j == BLOCK - 1, key).otherwise(F.sha2(F.concat_ws(":", up, j.cast("string"), inner), 256))


def nodes(blocks: DataFrame) -> DataFrame:
    """The trie's nodes below the root, of ``blocks(conv, b, up, key, inner, chars, before, u, leaf)``.

    ``nid, parent, depth, conv, n, chars, before, u, all_u, leaves``: ``conv`` is
    the smallest member and ``u`` its, ``n``, ``all_u`` and ``leaves`` are sums
    over the members.
    """
    distinct = checkpoint(blocks.groupBy("key").agg(
        F.first("up").alias("up"), F.first("b").alias("b"), F.first("inner").alias("inner"),
        F.first("chars").alias("chars"), F.first("before").alias("before"),
        F.min(F.struct("conv", "u")).alias("least"), F.count(F.lit(1)).alias("n"),
        F.sum("u").alias("all_u"), F.sum("leaf").alias("leaves")))
    # blocks below the root are refined as they are; it has too many for one key of a join
    siblings = (distinct.filter("b > 0").groupBy("up").agg(F.count(F.lit(1)).alias("different"))
                .filter("different > 1").select("up", F.lit(True).alias("diverge")))
    below = distinct.filter("b > 0").join(siblings, "up", "left")
    marked = below.unionByName(distinct.filter("b = 0").withColumn("diverge", F.lit(True)))
    j = F.col("j").cast("int")
    inner = F.get("inner", j)
    each = (marked.select("*", F.posexplode("chars").alias("j", "turn_chars")).select(
        "diverge", boundary(F.col("up"), j, inner, F.col("key")).alias("nid"),
        F.when(j == 0, F.col("up")).otherwise(
            boundary(F.col("up"), j - 1, F.get("inner", j - 1), F.col("key"))).alias("parent"),
        (F.col("b") * BLOCK + j + 1).alias("depth"), "least", "n", F.col("turn_chars").alias("chars"),
        (F.col("before") + F.expr("aggregate(slice(chars, 1, j), 0L, (a, x) -> a + x)")).alias("before"),
        "all_u", "leaves"))
    refined = each.filter("diverge").groupBy("nid").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("least").alias("least"),
        F.sum("n").alias("n"), F.first("chars").alias("chars"), F.first("before").alias("before"),
        F.sum("all_u").alias("all_u"), F.sum("leaves").alias("leaves"))
    alone = each.filter("diverge IS NULL").select(*refined.columns)
    return refined.unionByName(alone).select(
        "nid", "parent", "depth", F.col("least.conv").alias("conv"), "n", "chars", "before",
        F.col("least.u").alias("u"), "all_u", "leaves")


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each run of equal ``nid``, over its joined ``ids`` in their order."""
    last, state = None, None
    for batch in batches:
        out = []
        for nid, ids in zip(batch.column("nid").to_pylist(), batch.column("ids").to_pylist()):
            if nid != last:
                if last is not None:
                    out.append((last, state.hexdigest()))
                last, state = nid, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_pydict({"nid": [o[0] for o in out], "ends_sha256": [o[1] for o in out]})
    if last is not None:
        yield pa.RecordBatch.from_pydict({"nid": [last], "ends_sha256": [state.hexdigest()]})


def end_digests(ends: DataFrame) -> DataFrame:
    """``nid, ends_sha256`` over the ids of ``ends(nid, conv)``.

    Ids are joined in rows of at most 4,096 first, so that the digest of a
    node with very many, which only one task can compute, streams over few rows.
    """
    parts = checkpoint(ends.groupBy("nid", F.shiftright("conv", ID_BITS).alias("part")).agg(
        F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string"))).alias("ids")))
    counted = checkpoint(parts.groupBy("nid").agg(F.count(F.lit(1)).alias("parts"), F.first("ids").alias("ids")))
    one = counted.filter("parts = 1").select("nid", F.sha2("ids", 256).alias("ends_sha256"))
    many = counted.filter("parts > 1").select("nid")
    if many.isEmpty():
        return one
    streamed = (parts.join(many, "nid", "left_semi").repartition("nid").sortWithinPartitions("nid", "part")
                .select("nid", "ids").mapInArrow(_hash_runs, "nid string, ends_sha256 string"))
    return one.unionByName(streamed)


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    placed = checkpoint(positions(checkpoint(turns(conversations)), ["conv"], "turn", "digest"))
    rows, ids = rebuilt(placed)
    blocks = checkpoint(with_parent(scan(blocks_of(rows))))
    zero = F.lit(0).cast("long")
    grown = checkpoint(nodes(blocks.withColumn("u", zero).withColumn("leaf", zero)))
    children = checkpoint(grown.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")))
    owners = (grown.join(children.select(F.col("parent").alias("nid"), "n_children"), "nid", "left")
              .groupBy("conv").agg(F.min("before").alias("u"),
                                   F.max(F.when(F.col("n_children").isNull(), 1).otherwise(0)).alias("leaf")))
    j = F.size("inner") - 1
    last = blocks.filter(F.col("b") == F.col("top")).select(
        "conv", F.col("total"), boundary(F.col("up"), j, F.get("inner", j), F.col("key")).alias("nid"))
    members = checkpoint(ids.join(last, "conv", "left").join(owners, "conv", "left").select(
        "conv", F.coalesce("nid", F.lit("")).alias("nid"),
        F.coalesce("u", "total", zero).alias("u"), F.coalesce(F.col("leaf").cast("long"), zero).alias("leaf")))
    weighed = checkpoint(nodes(blocks.join(members.select("conv", "u", "leaf"), "conv")))
    root = members.agg(F.min(F.struct("conv", "u")).alias("least"), F.count(F.lit(1)).alias("n"),
                       F.sum("u").alias("all_u"), F.greatest(F.sum("leaf"), F.lit(1)).alias("leaves")).filter("n > 0")
    top = root.select(F.lit("").alias("nid"), F.lit(None).cast("string").alias("parent"),
                      F.lit(0).cast("long").alias("depth"), F.col("least.conv").alias("conv"), "n",
                      zero.alias("chars"), zero.alias("before"), F.col("least.u").alias("u"), "all_u", "leaves")
    names = grown.select(F.col("nid").alias("parent"), F.col("conv").alias("above"))
    least = root.first()
    under = weighed.filter("parent <> ''").join(names, "parent", "left").unionByName(
        weighed.filter("parent = ''").withColumn("above", F.lit(least and least["least"]["conv"]).cast("long")))
    every = under.unionByName(top.withColumn("above", F.lit(None).cast("long")))
    return (every.join(children.withColumnRenamed("parent", "nid"), "nid", "left")
            .join(end_digests(members.select("nid", "conv")), "nid", "left")
            .select(F.col("conv").alias("conv_id"), "depth", F.col("above").alias("parent_conv_id"),
                    F.col("n").alias("n_convs"), F.coalesce("n_children", zero).alias("n_children"),
                    F.col("leaves").alias("n_leaves"),
                    (F.col("all_u") - F.col("u") - (F.col("n") - 1) * F.col("before")).alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(read_table(spark, sf_dir, "conversations"))


OP13_SQL = f"""
WITH t AS (
  SELECT conv_id AS c, length(coalesce(text, '')) AS chars,
         sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d, turn
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, d, chars, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, d) - 1 AS pos FROM t),
convs AS (SELECT c, c - c % 100 AS base, {CRC32_SQL.format('c')} % 6 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (
  SELECT k.c, o.pos AS i, o.d, o.chars FROM convs k JOIN o ON o.c = k.base AND o.pos < k.h
  UNION ALL
  SELECT k.c, o.pos + 1000000, o.d, o.chars FROM convs k JOIN o ON o.c = k.c AND o.pos >= k.h),
p AS (
  SELECT c, row_number() OVER w AS depth, chars, sha256(string_agg(d, '') OVER w) AS nid,
         count(*) OVER (PARTITION BY c) AS len
  FROM r WINDOW w AS (PARTITION BY c ORDER BY i)),
paths AS (
  SELECT c, depth, chars, nid, lag(nid, 1, '') OVER (PARTITION BY c ORDER BY depth) AS parent, len FROM p
  UNION ALL
  SELECT k.c, 0, 0, '', NULL, coalesce(l.len, 0)
  FROM convs k LEFT JOIN (SELECT DISTINCT c, len FROM p) l USING (c)),
nodes AS (
  SELECT nid, min(c) AS conv_id, any_value(depth) AS depth, any_value(parent) AS parent, count(*) AS n_convs,
         any_value(chars) AS chars, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE depth = len) AS ends
  FROM paths GROUP BY nid),
kids AS (SELECT parent, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
sums AS (
  SELECT a.nid, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS n_leaves,
         sum((u.n_convs - 1) * u.chars) AS saved
  FROM nodes u JOIN paths a ON a.c = u.conv_id AND a.depth <= u.depth LEFT JOIN kids ON kids.parent = u.nid
  GROUP BY a.nid)
SELECT v.conv_id, v.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, v.n_convs,
       coalesce(kids.n, 0) AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens,
       sha256(coalesce(v.ends, '')) AS ends_sha256
FROM nodes v JOIN sums s USING (nid) LEFT JOIN nodes q ON q.nid = v.parent LEFT JOIN kids ON kids.parent = v.nid
"""
