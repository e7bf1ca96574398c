"""Lookups with frequent keys: the rows of a plain join, and no task with all rows of a key."""

import random

from pyspark.sql import functions as F

from pagemill.operators import skew


def plain(rows, table):
    known = dict(table)
    return sorted(((i, k, known.get(k)) for i, k in rows), key=repr)


def result(spark, rows, table):
    left = spark.createDataFrame(rows, "id long, url string")
    right = spark.createDataFrame(table, "url string, ok boolean")
    return sorted(((r["id"], r["url"], r["ok"]) for r in skew.lookup(left, right, "url").collect()), key=repr)


def test_rows_are_those_of_a_plain_join(spark):
    r = random.Random(6)
    table = [(f"u{i}", i % 3 == 0) for i in range(300)] + [("logo", True), ("never", False)]
    rows = [(i, r.choice(["logo", "banner", None, f"u{r.randrange(400)}"])) for i in range(3000)]
    assert result(spark, rows, table) == plain(rows, table)
    assert result(spark, [], table) == [] and result(spark, rows[:50], []) == plain(rows[:50], [])
    same = [(i, "one") for i in range(500)]
    assert result(spark, same, [("one", True)]) == plain(same, [("one", True)])


def test_heavy_keys_are_bounded_and_found(spark):
    rows = spark.range(200_000).select(F.when(F.col("id") % 3 == 0, "logo").otherwise(
        F.concat(F.lit("u"), (F.col("id") % 50_000).cast("string"))).alias("url"))
    logo = spark.range(1).select(F.xxhash64(F.lit("logo"))).first()[0]
    heavy = [r[0] for r in skew.heavy_hashes(rows, F.col("url")).collect()]
    assert logo in heavy and len(heavy) <= skew.MOST


def test_no_task_has_all_rows_of_a_frequent_key(spark):
    rows = spark.range(0, 90_000, 1, 9).select("id", F.when(F.col("id") % 3 == 0, "logo").otherwise(
        F.concat(F.lit("u"), F.col("id").cast("string"))).alias("url"))
    table = spark.range(90_000).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"),
                                       F.lit(True).alias("ok")).unionByName(
        spark.createDataFrame([("logo", True)], "url string, ok boolean"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = skew.lookup(rows, table, "url")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 90_000 and max(sizes) < 3 * sorted(sizes)[len(sizes) // 2]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan and "NestedLoop" not in plan
