"""Charsets of page bodies, against hand-made bytes."""

import pytest
from pyspark.sql import functions as F

from pagemill.functions.charsets import PRESCAN, charsets
from pagemill.operators.dom import parse_html
from pagemill.operators.records import page_records

KANA = "これはテストのページです。日本語で書きます。"
FRENCH = "Été à la plage, garçon naïf: où être. Crème brûlée"

# body, the first codec that decodes it, its text
BODIES = [
    ("plain".encode(), "utf-8", "plain"),
    (KANA.encode(), "utf-8", KANA),
    (b"\xef\xbb\xbf" + KANA.encode(), "utf-8-sig", KANA),
    (KANA.encode("utf-16"), "utf-16", KANA),
    (b"\xfe\xff" + KANA.encode("utf-16-be"), "utf-16", KANA),
    (KANA.encode("utf-32"), "utf-32", KANA),
    (KANA.encode("cp932"), "cp932", KANA),
    (KANA.encode("euc_jp"), "euc_jp", KANA),
    (KANA.encode("iso2022_jp"), "iso2022_jp", KANA),
    (FRENCH.encode("cp1252"), "cp1252", FRENCH),
    (b'<meta charset="shift_jis">' + KANA.encode("cp932"), "cp932", KANA),
    (b"<meta charset = EUC-JP >" + KANA.encode("euc_jp"), "euc_jp", KANA),
    (b"<META HTTP-EQUIV=\"content-type\" CONTENT='text/html; charset=x-sjis'>" + KANA.encode("cp932"), "cp932", KANA),
    (b' <?xml version="1.0" encoding="euc-jp"?>' + KANA.encode("euc_jp"), "euc_jp", KANA),
    (b'<meta charset="iso-8859-1">' + "“quoted” €".encode("cp1252"), "cp1252", "“quoted” €"),
    # declared falsely, or unknown: the bytes decide
    (b'<meta charset="euc-jp">' + FRENCH.encode(), "utf-8", FRENCH),
    (b'<meta charset="no-such-code">' + KANA.encode("cp932"), "cp932", KANA),
    (b'<meta charset="utf-16">' + KANA.encode(), "utf-8", KANA),
    # too far down to be a declaration
    (b" " * PRESCAN + b'<meta charset="euc-jp">' + FRENCH.encode("cp1252"), "cp1252", FRENCH),
    (b"", "utf-8", ""),
]


@pytest.fixture(scope="module")
def bodies(spark):
    rows = [(i, "https://h.example/", bytearray(b)) for i, (b, _, _) in enumerate(BODIES)]
    return spark.createDataFrame(rows, "page_id long, url string, html binary")


def test_order_of_codecs(bodies):
    for r in bodies.select("page_id", charsets(F.col("html")).alias("c")).collect():
        body, codec, text = BODIES[r["page_id"]]

        def takes(name):
            try:
                body.decode(name)
                return True
            except (UnicodeError, LookupError):
                return False

        assert next(c for c in r["c"] if takes(c)) == codec, (body[:60], r["c"])


def test_bytes_parse_like_their_text(spark, bodies):
    got = {r["page_id"]: r for r in parse_html(bodies).collect()}
    for i, (_, _, text) in enumerate(BODIES):
        assert got[i]["parse_error"] is None and got[i]["page_text"].strip() == text, i


def test_undecodable_bytes_and_nulls_fail_alone(spark):
    rows = [(1, "https://h.example/a", bytearray(b"<p>good</p>")), (2, "https://h.example/b", bytearray(b"<p>\x8d\x9d</p>")),
            (3, "https://h.example/c", None), (4, "https://h.example/d", bytearray("<h1>é</h1>".encode()))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html binary")
    got = {r["page_id"]: r for r in page_records(pages).collect()}
    assert "no charset" in got[2]["error"] and got[2]["text_content"] is None
    assert got[1]["error"] is None and got[1]["text_content"] == "good" and got[4]["title"] == "é"
    assert got[3]["error"] is None and got[3]["text_content"] is None


def test_detection_is_no_second_python_step(bodies):
    plan = parse_html(bodies)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
