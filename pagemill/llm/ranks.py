"""Positions within groups by bitmap rank, without sorting the groups.

The ids of a group are kept as a compressed bitmap: one 64-bit word for each
run of 64 ids that has any, merged with ``bit_or`` (partial words of different
tasks meet in the shuffle). A popcount directory holds what precedes each
word, in four levels of at most 65,536 entries a parent, so that no window
sees a whole group however large or scattered its ids are. The position of a
row is then the directory's count before its word and the bits below its own.

Ids that occur more than once, and null ids (which precede all others), are
placed by counts of their own: by id, then by the first two bytes of a digest,
then by the digest. Rows alike in every column are counted, not sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import checkpoint, fresh

#: Bits of an id below a word, and of each directory level above it.
WORD_BITS = 6
LEVEL_BITS = (10, 16, 16)


def same(left: DataFrame, right: DataFrame, names: list[tuple[str, str]]) -> Column:
    """Null-safe equality of pairs of columns."""
    on = F.lit(True)
    for a, b in names:
        on = on & left[a].eqNullSafe(right[b])
    return on


def _up(table: DataFrame, group: list[str], bits: int) -> DataFrame:
    return (table.groupBy(*group, F.shiftright("key", bits).alias("key"))
            .agg(F.sum("total").alias("total")))


def directory(words: DataFrame, group: list[str]) -> DataFrame:
    """``group..., key, before``: the rows of the group in words before ``key``, for ``words(group..., key, total)``."""
    levels = [words.select(*group, "key", "total")]
    for bits in LEVEL_BITS:
        levels.append(_up(levels[-1], group, bits))
    above = None
    for depth in range(len(LEVEL_BITS), -1, -1):
        table = levels[depth]
        bits = LEVEL_BITS[depth] if depth < len(LEVEL_BITS) else None
        parent = [] if bits is None else [F.shiftright("key", bits)]
        inner = F.sum("total").over(Window.partitionBy(*group, *parent).orderBy("key")
                                    .rowsBetween(Window.unboundedPreceding, -1))
        here = table.withColumn("before", F.coalesce(inner, F.lit(0).cast("long")))
        if above is not None:
            names = [f"up_{i}" for i in range(len(group))]
            up = above.select(*[F.col(g).alias(n) for g, n in zip(group, names)],
                              F.col("key").alias("up_key"), F.col("before").alias("up_before"))
            here = here.withColumn("over", F.shiftright("key", bits))
            here = (here.join(up, same(here, up, [*zip(group, names), ("over", "up_key")]))
                    .withColumn("before", F.col("before") + F.col("up_before"))
                    .select(*group, "key", "before"))
        above = here.select(*group, "key", "before")
    return above


def positions(rows: DataFrame, group: list[str], id_col: str, digest: str, name: str = "pos") -> DataFrame:
    """``rows`` with the position (from 0) of each row in its group, ascending by id, then by digest.

    ``rows`` should be written or checkpointed, and narrow: it is read twice
    and shuffled once. ``group`` and ``id_col`` may be null; ``digest`` is a
    binary column without nulls. Rows alike in all columns take consecutive
    positions. No rows give no rows.
    """
    cols = rows.columns
    own, key, bits, total, before, m = fresh(rows, "w_own", "w_key", "w_bits", "w_total", "w_before", "w_copies")
    prefix, part, by_id, by_prefix, last = fresh(rows, "t_prefix", "t_word", "t_by_id", "t_by_prefix", "t_last")
    g_names = [f"g_{i}" for i in range(len(group))]
    word = F.shiftright(F.col(id_col), WORD_BITS)
    low = F.col(id_col).bitwiseAND(F.lit((1 << WORD_BITS) - 1)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), low)
    below = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), low))
    words = checkpoint(rows.select(*[F.col(g).alias(n) for g, n in zip(group, g_names)],
                                   word.alias("key"), bit.alias("bit"))
                       .groupBy(*g_names, "key").agg(F.bit_or("bit").alias("bits"), F.count(F.lit(1)).alias("total")))
    found = directory(words, g_names)
    d_names = [f"d_{i}" for i in range(len(group))]
    found = found.select(*[F.col(g).alias(n) for g, n in zip(g_names, d_names)], F.col("key").alias("d_key"), "before")
    index = words.join(found, same(words, found, [*zip(g_names, d_names), ("key", "d_key")])).select(
        *[F.col(g) for g in g_names], F.col("key").alias(key), F.col("bits").alias(bits),
        F.col("total").alias(total), F.col("before").alias(before))
    index = checkpoint(index)
    keyed = rows.withColumn(own, word)
    placed = keyed.join(index, same(keyed, index, [*zip(group, g_names), (own, key)]))
    simple = F.coalesce(F.col(total) == F.bit_count(bits), F.lit(False))
    once = placed.filter(simple).select(
        *cols, (F.col(before) + F.bit_count(F.col(bits).bitwiseAND(below))).cast("long").alias(name))
    if index.filter(~F.coalesce(F.col(total) == F.bit_count(bits), F.lit(False))).isEmpty():
        return once
    alike = checkpoint(placed.filter(~simple).groupBy(*cols, F.col(before)).agg(F.count(F.lit(1)).alias(m)))
    alike = alike.withColumn(prefix, F.substring(F.col(digest), 1, 2)).withColumn(part, word)

    def before_in(table: DataFrame, over: list[str], key_col: str, out: str) -> DataFrame:
        w = Window.partitionBy(*over).orderBy(key_col).rowsBetween(Window.unboundedPreceding, -1)
        return table.withColumn(out, F.coalesce(F.sum(m).over(w), F.lit(0).cast("long")))

    ids = before_in(alike.groupBy(*group, part, id_col).agg(F.sum(m).alias(m)), [*group, part], id_col, by_id)
    runs = before_in(alike.groupBy(*group, id_col, prefix).agg(F.sum(m).alias(m)), [*group, id_col], prefix, by_prefix)
    i_names, r_names = [f"i_{i}" for i in range(len(group) + 1)], [f"r_{i}" for i in range(len(group) + 2)]
    ids = ids.select(*[F.col(c).alias(n) for c, n in zip([*group, id_col], i_names)], by_id)
    runs = runs.select(*[F.col(c).alias(n) for c, n in zip([*group, id_col, prefix], r_names)], by_prefix)
    tied = before_in(alike, [*group, id_col, prefix], digest, last)
    tied = tied.join(ids, same(tied, ids, [*zip([*group, id_col], i_names)]))
    tied = tied.join(runs, same(tied, runs, [*zip([*group, id_col, prefix], r_names)]))
    first = F.col(before) + F.col(by_id) + F.col(by_prefix) + F.col(last)
    return once.unionByName(tied.select(
        *cols, F.explode(F.sequence(first, first + F.col(m) - 1)).alias(name)))
