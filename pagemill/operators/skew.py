"""Looking up keys of which a few are very frequent, without one task for each of them.

A sketch finds the heavy keys of the large side; there are at most ``MOST`` of
them, whatever the data. Their rows meet the few rows of the other side that
they name in a broadcast of that bounded size; all other rows are joined by
shuffle, and no key among them is frequent any more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Heavy keys at most, and counters that the sketch keeps.
MOST, TRACKED = 256, 4096
#: A key is heavy from this share of the rows on.
HEAVY = 1 / 1000


def heavy_hashes(rows: DataFrame, key: Column) -> DataFrame:
    """``heavy_hash`` of the keys that a share ``HEAVY`` of the rows have, by a sketch; nulls are no keys."""
    top = (rows.filter(key.isNotNull()).agg(F.call_function("approx_top_k", F.xxhash64(key), F.lit(MOST), F.lit(TRACKED)).alias("top"),
                                            F.count(F.lit(1)).alias("n")))
    each = top.select("n", F.explode("top").alias("t"))
    return each.filter(F.col("t.count") >= F.col("n") * HEAVY).select(F.col("t.item").alias("heavy_hash"))


def lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` left-joined with ``table`` on ``key``, which names each row of ``table`` at most once.

    ``rows`` should be a written table, as it is read for the sketch as well.
    Rows with a null or unknown key get nulls.
    """
    heavy = F.broadcast(heavy_hashes(rows, F.col(key)))
    marked = rows.withColumn("key_hash", F.xxhash64(key)).join(
        heavy.withColumn("is_heavy", F.lit(True)), F.col("key_hash") == F.col("heavy_hash"), "left").drop("heavy_hash")
    named = table.withColumn("key_hash", F.xxhash64(key)).join(
        heavy, F.col("key_hash") == F.col("heavy_hash"), "left_semi").drop("key_hash")
    often = marked.filter("is_heavy AND " + f"`{key}` IS NOT NULL").drop("key_hash", "is_heavy")
    seldom = marked.filter("is_heavy IS NULL OR " + f"`{key}` IS NULL").drop("key_hash", "is_heavy")
    return often.join(F.broadcast(named), key, "left").unionByName(seldom.join(table, key, "left"))
