"""P9 totals kept by a stream: against a full recount, with a trigger run again."""

import datetime as dt
import os

import pandas as pd
from pyspark.sql import types as T

from pagemill.streaming import stats_stream as SS

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("at", T.TimestampType()),
                       T.StructField("deleted", T.BooleanType()), T.StructField("content_type", T.StringType()),
                       T.StructField("chars", T.LongType()), T.StructField("images", T.LongType())])


def at(s):
    return dt.datetime(2025, 1, 1) + dt.timedelta(seconds=s)


class State:
    def __init__(self):
        self.get, self.exists = None, False

    def update(self, new):
        self.get, self.exists = new, True


def signed(state, *rows):
    frames = [pd.DataFrame([r], columns=["page_id", "at", "deleted", "content_type", "chars", "images"]) for r in rows]
    return [tuple(r) for f in SS._follow((1,), iter(frames), state) for r in f.itertuples(index=False)]


def test_signed_rows_of_one_page():
    s = State()
    assert signed(s, (1, at(0), False, "a", 10, 1)) == [("a", 1, 10, 1)]
    assert signed(s, (1, at(0), False, "b", 99, 9), (1, at(-5), False, "b", 99, 9)) == []  # no newer than what is held
    assert signed(s, (1, at(2), False, "b", 5, 2), (1, at(1), False, "c", 7, 0)) == [("a", -1, -10, -1), ("b", 1, 5, 2)]
    assert signed(s, (1, at(3), True, None, 0, 0)) == [("b", -1, -5, -2)]
    assert signed(s, (1, at(2), False, "b", 5, 2)) == []
    assert signed(s, (1, at(9), False, "c", 1, 0)) == [("c", 1, 1, 0)]
    unknown = State()
    assert signed(unknown, (1, at(5), True, None, 0, 0)) == [] and signed(unknown, (1, at(4), False, "a", 1, 1)) == []


def recount(rows):
    last = {}
    for r in rows:
        if r[0] not in last or r[1] > last[r[0]][1]:
            last[r[0]] = r
    out = {}
    for _, _, deleted, kind, chars, images in last.values():
        if not deleted:
            n, c, i = out.get(kind, (0, 0, 0))
            out[kind] = (n + 1, c + chars, i + images)
    return out


def test_totals_equal_a_recount_and_survive_a_repeated_trigger(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("changes", "totals", "state"))
    steps = [[(i, at(i), False, "ab"[i % 2], 10 * i, i) for i in range(8)],
             [(1, at(100), False, "a", 7, 0), (2, at(100), True, "a", 0, 0), (3, at(1), False, "a", 1000, 9),
              (9, at(0), True, None, 0, 0), (10, at(0), False, "c", 1, 1)],
             [(10, at(50), True, None, 0, 0), (2, at(200), False, "b", 3, 3), (9, at(-1), False, "c", 5, 5)]]

    def run():
        changes = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        SS.start_totals(changes, out, state).awaitTermination()
        return {r["content_type"]: (r["pages"], r["chars"], r["images"]) for r in SS.read_totals(spark, out).collect()}

    seen = []
    for rows in steps[:2]:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        seen += rows
    assert run() == recount(seen)
    last = max(int(n) for n in os.listdir(f"{state}/commits") if n.isdigit())
    for name in (f"{last}", f".{last}.crc"):  # a stop between the fold and the commit
        if os.path.exists(f"{state}/commits/{name}"):
            os.remove(f"{state}/commits/{name}")
    assert run() == recount(seen)
    spark.createDataFrame(steps[2], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    assert run() == recount(seen + steps[2])
    assert "c" not in recount(seen + steps[2])  # a class whose pages have gone
    assert len(os.listdir(out)) <= 3


def test_totals_before_any_trigger_are_empty(spark, tmp_path):
    assert SS.read_totals(spark, str(tmp_path / "none")).count() == 0


def test_changes_carry_what_is_counted(spark):
    from pagemill.streaming.page_stream import CHANGE_SCHEMA
    rows = [(1, "https://h.example/", "<p>some cafe</p>", at(0), None), (2, "https://h.example/", None, at(1), True)]
    got = {r["page_id"]: r for r in SS.page_changes(spark.createDataFrame(rows, CHANGE_SCHEMA)).collect()}
    assert (got[1]["deleted"], got[1]["content_type"], got[1]["chars"], got[1]["images"]) == (False, "cafe", 9, 0)
    assert got[2]["deleted"] and got[2]["chars"] == 0
