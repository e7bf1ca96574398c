"""T1 with state: snapshots that come late or never, requests that come twice, triggers that are run again."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from pagemill.operators import articles as AR
from pagemill.operators.records import page_records
from pagemill.streaming.page_stream import TIMED_SCHEMA, page_stream, start_page_stream
from pagemill.streaming.request_stream import REQUEST_SCHEMA, answered_once, request_responses, request_stream
from pagemill.streaming.snapshot_stream import records_with_snapshots

START = dt.datetime(2025, 1, 1, 12)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def page(i, images, minutes, name="p"):
    html = "".join(f'<img src="https://cdn.example.net/large/{name}-{i}-{n}.jpg" alt="New goods" width="600" height="400">'
                   for n in range(images))
    return (i, f"https://h{i}.example/", f"<h1>{name}{i}</h1><main>{html}</main>", at(minutes))


def add(spark, path, rows, schema=TIMED_SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def forget_last_commit(folder):
    """What a stop between the sink's write and the commit of the last trigger leaves."""
    names = sorted((int(n) for n in os.listdir(f"{folder}/commits") if n.isdigit()))
    for name in (f"{names[-1]}", f".{names[-1]}.crc"):
        if os.path.exists(f"{folder}/commits/{name}"):
            os.remove(f"{folder}/commits/{name}")


def test_snapshots_in_time_late_missing_and_replayed(spark, tmp_path):
    paths = {n: str(tmp_path / n) for n in ("pages", "snapshots", "out", "state")}
    add(spark, paths["pages"], [page(1, 1, 0), page(2, 1, 0), page(3, 0, 0), page(4, 3, 0), page(5, 2, 0),
                                (6, "https://h6.example/", None, at(0))])
    add(spark, paths["snapshots"], [page(1, 4, 5, "s"), page(4, 5, 5, "s"), page(5, 1, -5, "s"), page(9, 5, 5, "s")])

    def run():
        streams = [page_stream(spark, paths[n], max_files_per_trigger=1, schema=TIMED_SCHEMA) for n in ("pages", "snapshots")]
        records = records_with_snapshots(*streams, wait="10 minutes", late="1 hour")
        query = start_page_stream(records, paths["out"], paths["state"])
        query.awaitTermination()
        return {r["page_id"]: len(r["images"]) for r in spark.read.parquet(paths["out"]).collect()}

    # in time, enough images of its own, a snapshot before its page; the others still wait
    assert run() == {1: 5, 4: 3, 5: 3}
    # too late for page 3, again for page 1; then all time passes
    add(spark, paths["snapshots"], [page(3, 4, 20, "s"), page(1, 2, 6, "again")])
    add(spark, paths["pages"], [page(100, 3, 600)])
    add(spark, paths["snapshots"], [page(100, 3, 600, "s")])
    done = run()
    assert {i: done.get(i) for i in (1, 2, 3, 4, 5, 6)} == {1: 5, 2: 1, 3: 0, 4: 3, 5: 3, 6: 0}
    rows = spark.read.parquet(paths["out"]).count()
    forget_last_commit(paths["state"])
    assert run() == done and spark.read.parquet(paths["out"]).count() == rows == len(done)


def test_one_response_for_each_request(spark, tmp_path):
    paths = {n: str(tmp_path / n) for n in ("requests", "out", "state")}
    records = spark.createDataFrame([(1, "https://a.example/", None), (7, "https://a.example/", "broken"),
                                     (2, "https://b.example/", "AssertionError: x"), (3, None, None)],
                                    "page_id long, url string, error string")
    ask = lambda i, url, m: (i, url, "popup", at(m))
    add(spark, paths["requests"], [ask("r1", "https://a.example/", 0), ask("r1", "https://a.example/", 0),
                                   ask("r2", "https://b.example/", 1), ask("r3", "https://none.example/", 1),
                                   ask("r4", None, 2), ask("r5", "no url", 2), ask(None, "https://a.example/", 2)],
        REQUEST_SCHEMA)

    def run():
        requests = answered_once(request_stream(spark, paths["requests"], max_files_per_trigger=1))
        responses = request_responses(requests, records, F.to_timestamp(F.lit("2025-01-01 00:00:00")))
        start_page_stream(responses, paths["out"], paths["state"]).awaitTermination()
        return sorted(map(tuple, spark.read.parquet(paths["out"]).select(
            "request_id", "page_id", "success", "error").collect()), key=repr)

    want = [("r1", 1, True, None), ("r2", 2, False, "page failed: AssertionError: x"),
            ("r3", None, False, "no page for the url"), ("r4", None, False, "not a url"), ("r5", None, False, "not a url"),
            (None, 1, True, None)]
    assert run() == sorted(want, key=repr)
    add(spark, paths["requests"], [ask("r3", "https://a.example/", 9), ask("r6", "https://a.example/", 9),
                                   ask("r6", "https://b.example/", 9)], REQUEST_SCHEMA)
    second = run()
    assert len(second) == 7 and [r[0] for r in second if r[2]].count("r6") + [
        r[0] for r in second if not r[2]].count("r6") == 1
    forget_last_commit(paths["state"])
    assert run() == second
    told = spark.read.parquet(paths["out"])
    assert told.filter("success AND (docs_url IS NULL OR message IS NULL OR error IS NOT NULL)").count() == 0
    assert told.filter("NOT success AND (docs_url IS NOT NULL OR message IS NOT NULL OR error IS NULL)").count() == 0


def test_batch_responses_are_the_same(spark):
    records = spark.createDataFrame([(1, "https://a.example/", None)], "page_id long, url string, error string")
    requests = spark.createDataFrame([("x", "https://a.example/")], "request_id string, url string")
    row = request_responses(requests, records, F.to_timestamp(F.lit("2025-01-01 00:00:00"))).first()
    assert row["success"] and row["docs_url"].startswith("20250101_0000_") and row["error"] is None


@pytest.mark.parametrize("outcomes, want", [
    (None, (True, None)), ([], (True, None)), ([(1, None)], (True, None)),
    ([(1, "b"), (1, "a"), (1, None), (2, "c")], (False, "a")), ([(None, "x")], (True, None))])
def test_documents_that_could_not_be_written(spark, outcomes, want):
    from pagemill.operators import blocks as BL
    articles = spark.createDataFrame([(1, "T https://a.example/", "<p>x</p>", ["u"])],
                                     "page_id long, title string, content string, images array<string>")
    table = None if outcomes is None else spark.createDataFrame(outcomes, "page_id long, error string")
    r = AR.article_responses(articles, F.to_timestamp(F.lit("2025-01-01 00:00:00")), table).first()
    assert (r["success"], r["error"]) == want and (r["docs_url"] is not None) == r["success"] == (r["message"] is not None)
    s = BL.article_stats(articles, table).first()
    assert (s["success"], s["error"]) == want
    assert (s["content_length"], s["images_processed"]) == ((8, 1) if want[0] else (None, None))


def test_carried_columns(spark):
    rows = spark.createDataFrame([page(1, 1, 0)], TIMED_SCHEMA)
    assert page_records(rows, carry=["at"]).first()["at"] == at(0)


@pytest.mark.parametrize("folder", [False, True])
def test_pages_in_one_file_or_in_a_folder_of_files(spark, tmp_path, folder):
    from pagemill.plans.sink_queries import q_page_stream
    from pagemill.streaming.page_stream import PAGE_SCHEMA
    rows = [(i, f"https://h{i}.example/", f"<title>T{i}</title><p>x</p>") for i in range(6)]
    target = tmp_path / "data" / "pages.parquet"
    written = target if folder else tmp_path / "one"
    spark.createDataFrame(rows, PAGE_SCHEMA).repartition(3 if folder else 1).write.parquet(str(written))
    if not folder:
        target.parent.mkdir()
        next(written.glob("part-*.parquet")).rename(target)
    got = q_page_stream(spark, str(tmp_path / "data")).select("page_id", "title").collect()
    assert sorted(map(tuple, got)) == [(i, f"T{i}") for i in range(6)]


@pytest.mark.parametrize("rows, parts", [(90, 3), (4, 3)])
def test_parts_are_dealt_to_files_and_taken_in_turn(spark, tmp_path, rows, parts):
    from pagemill.plans.sink_queries import _dealt
    table = spark.range(rows).select("id", (F.col("id") % parts).alias("part"))
    path, files = _dealt(spark, table, str(tmp_path / "dealt"), F.col("part"), parts)
    assert files > 1 and len([n for n in os.listdir(path) if n.endswith(".parquet")]) == files * parts
    if rows > files * parts:
        assert table.sparkSession.read.parquet(path).select(F.input_file_name()).distinct().count() > parts
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(path)
    seen = []
    query = (stream.writeStream.foreachBatch(lambda batch, n: seen.append(sorted(map(tuple, batch.collect()))))
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert seen == [[(i, i % parts) for i in range(rows) if i % parts == part] for part in range(parts)]


def test_streams_on_a_mounted_folder_write_plain_files(spark, tmp_path, monkeypatch):
    from pyspark.sql.streaming import DataStreamWriter

    from pagemill.session import FILE_MANAGER, PLAIN_FILES, plain_files
    from pagemill.streaming.page_stream import CHANGE_SCHEMA
    from pagemill.streaming.stats_stream import page_changes, start_totals
    seen, start = [], DataStreamWriter.start
    monkeypatch.setattr(DataStreamWriter, "start", lambda self: seen.append(spark.conf.get(FILE_MANAGER, None)) or start(self))
    add(spark, str(tmp_path / "pages"), [page(1, 1, 0)])
    add(spark, str(tmp_path / "changes"), [(*page(1, 1, 0), False)], CHANGE_SCHEMA)
    rows = page_stream(spark, str(tmp_path / "pages"), schema=TIMED_SCHEMA).select("page_id")
    start_page_stream(rows, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    changes = page_changes(page_stream(spark, str(tmp_path / "changes"), schema=CHANGE_SCHEMA))
    start_totals(changes, str(tmp_path / "totals"), str(tmp_path / "state2")).awaitTermination()
    assert seen == [PLAIN_FILES] * 2 and spark.conf.get(FILE_MANAGER, None) is None
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    with plain_files(spark, str(tmp_path)):
        with plain_files(spark, str(tmp_path)):  # the session names a manager
            pass
        assert spark.conf.get(FILE_MANAGER) == PLAIN_FILES
