"""Running values by blocks, values bound once, columns built once."""

import random
import time

from pyspark.sql import functions as F

from pagemill.functions.columns import BLOCK, built_once, let, prefix_scan
from pagemill.operators.dom import parse_html
from pagemill.operators.fields import page_fields


def test_running_values_match_plain_loops(spark):
    r = random.Random(2)
    rows = [(i, [r.randrange(100) for _ in range(n)]) for i, n in enumerate((0, 1, 2, BLOCK - 1, BLOCK, BLOCK + 1, 1000))]
    df = spark.createDataFrame(rows, "i int, v array<int>")
    got = df.select("i", prefix_scan(F.col("v"), F.lit(7), F.lit(0), lambda a, b: a + b).alias("s"),
                    prefix_scan(F.col("v"), F.lit(3), F.lit(0), F.greatest).alias("m")).collect()
    for row in got:
        v = rows[row["i"]][1]
        assert row["s"] == [7 + sum(v[:k]) for k in range(len(v) + 1)]
        assert row["m"] == [max([3, *v[:k]]) for k in range(len(v) + 1)]


def test_bound_values(spark):
    x = spark.range(3).select(let(F.col("id") * 2, lambda v: v + v).alias("x")).collect()
    assert [r["x"] for r in x] == [0, 4, 8]


def test_columns_are_built_once(spark):
    calls = []

    @built_once
    def column(n):
        calls.append(n)
        return F.lit(n)

    assert column(1) is column(1) and column(2) is not column(1) and calls == [1, 2]


def test_removed_elements_cost_in_proportion(spark):
    def seconds(n):
        html = "<article>" + "a<nav>b</nav>" * n + "</article>"
        df = spark.createDataFrame([(1, "https://a.example/", html)], "page_id long, url string, html string")
        dom = parse_html(df).select("page_id", "url", "page_text", "nodes").checkpoint()
        start = time.time()
        assert page_fields(dom).first()["main_text"] == "a" * n
        return time.time() - start

    seconds(10)
    # a fold that copies what it has takes minutes for this; the bound leaves room for a busy machine
    assert seconds(20_000) < 12 * max(5.0, seconds(2_000))
