import base64
import gzip
import hashlib

import pytest

from pagemill.llm import warc
from pagemill.llm.common import work_path


def brute(rows, least=0):
    first = {}
    for page_id, html in rows:
        body = (html or "").encode()
        if page_id is not None:
            first[body] = min(first.get(body, page_id), page_id)
    out = []
    for page_id, html in rows:
        body = (html or "").encode()
        again = len(body) >= least and body in first and page_id != first[body]
        out.append((page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                    "revisit" if again else "response", first[body] if again else None))
    return sorted(out, key=repr)


ROWS = [(3, "<p>a</p>"), (1, "<p>a</p>"), (2, "<p>é\U0001f600</p>"), (4, None), (5, ""), (6, "x" * 300_000),
        (7, "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"),
        (8, "\r\n\r\nlines\r\n"), (9, "<p>a</p>"), (9, "<p>a</p>"), (10, "only"), (10, "only")]


def through_archives(spark, rows, least=0, per_file=3):
    pages = spark.createDataFrame([(p, f"http://h/{p}", h, "extra") for p, h in rows],
                                  "page_id long, url string, html string, digest string")
    path = work_path(spark, "warc")
    warc.write_archives(warc.plan_captures(pages, least), path, records_per_file=per_file)
    return path, warc.assemble(warc.read_records(spark, path))


def flat(df):
    return sorted([(r["metadata"]["page_id"], r["response"]["size"], r["response"]["seen_digest"], r["capture"]["type"],
                    r["response"]["page_id"] if r["capture"]["type"] == "revisit" else None)
                   for r in df.collect()], key=repr)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip_matches_brute_force(spark, least):
    path, whole = through_archives(spark, ROWS, least)
    assert flat(whole) == brute(ROWS, least)
    for r in whole.collect():
        assert r["capture"]["digest"] == r["response"]["seen_digest"]
        assert r["request"]["uri"] == r["capture"]["uri"]


def test_null_ids_are_responses(spark):
    rows = [(None, "a"), (None, "a"), (1, "a")]
    _, whole = through_archives(spark, rows)
    kinds = sorted((r["capture"]["type"], r["metadata"]["page_id"]) for r in whole.collect()
                   if r["metadata"]["page_id"] is not None)
    assert kinds == [("response", 1)]
    assert whole.count() == 3


def test_files_are_plain_archives(spark):
    import glob
    path, _ = through_archives(spark, ROWS)
    kinds = []
    for name in glob.glob(path.removeprefix("file:") + "/part-*"):
        data = gzip.open(name).read()
        assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")
        kinds += [k for k, _, _ in warc.records(iter([data[i:i + 7] for i in range(0, len(data), 7)]))]
    assert len(kinds) == 3 * len(ROWS)


def test_archives_are_bounded_by_bytes(spark, monkeypatch):
    import glob
    monkeypatch.setattr(warc, "SIZE_CLASSES", [50, 400, 3000, 1 << 62])
    monkeypatch.setattr(warc, "FILE_BYTES", 1000)
    rows = [(i, f"{i} " + "y" * size) for i, size in enumerate([5, 60, 60, 60, 500, 500, 5000, 5000, 7, 30000] * 3)]
    pages = spark.createDataFrame([(p, "u", h) for p, h in rows], "page_id long, url string, html string").coalesce(1)
    path = work_path(spark, "warc")
    warc.write_archives(warc.plan_captures(pages), path)
    assert flat(warc.assemble(warc.read_records(spark, path))) == brute(rows)
    for name in glob.glob(path.removeprefix("file:") + "/part-*"):
        sizes = [len(block) for kind, _, block in warc.records(iter([gzip.open(name).read()])) if kind == "response"]
        assert len(sizes) == 1 or sum(s - 100 for s in sizes) <= 1000


def test_decisions_move_no_payload(spark):
    rows = [(i, f"page {i % 40}") for i in range(400)]
    pages = spark.createDataFrame([(p, "u", h) for p, h in rows], "page_id long, url string, html string")
    plan = warc.plan_captures(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_decisions_beyond_a_broadcast_are_joined_by_page(spark, monkeypatch):
    monkeypatch.setattr(warc, "small_side", lambda df: df.hint("merge"))
    _, whole = through_archives(spark, ROWS)
    assert flat(whole) == brute(ROWS)
    pages = spark.createDataFrame([(p, "u", h) for p, h in ROWS], "page_id long, url string, html string")
    plan = warc.plan_captures(pages)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and all("page_id" in line or "of_page" in line for line in moved)


def test_broken_archives_raise():
    with pytest.raises(ValueError):
        list(warc.records(iter([b"WARC/1.1\r\nContent-Length: 10\r\nWARC-Type: x\r\n\r\nabc"])))
    with pytest.raises(ValueError):
        list(warc.records(iter([b"HTTP/1.1 200\r\n\r\n"])))


def test_no_pages(spark):
    _, whole = through_archives(spark, [])
    assert whole.count() == 0
