"""WARC archives: writing captures and assembling their transactions (operator 4).

Writing: every page becomes a response record, or a revisit record if an
earlier page has an equal payload, with a request and a metadata record beside
it that name it in ``WARC-Concurrent-To``. The records of a capture are
concatenated to one string and written by Spark's text writer, whose line
separator supplies the two CRLF that end a record. The files are gzip and are
committed by Spark's protocol, so a repeated task leaves no partial archive.

Reading: each archive file is inflated as a stream and cut into records by
their ``Content-Length``, so a payload may hold anything, the text of a WARC
header too. Assembly then joins request and metadata records to the capture
they name, and revisits to the response they refer to, wherever in the
archives these stand. Payloads are digested where they are read; only headers
and digests are shuffled.

A record's id is made of the page_id and the payload's digest, so a revisit can
name its response without looking it up.

Defined results: a null payload is an empty one; rows alike in page_id and
payload have records alike in id, and those of the smallest page_id are all
responses; a null page_id comes after all others, and is a response only among
nulls. Captures without request or metadata have null there. No pages give no
rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import checkpoint, read_table, small_side, work_path

VERSION = "WARC/1.1"
CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Payloads below each of these sizes share files; a file's number of captures is what keeps it within ``FILE_BYTES``.
SIZE_CLASSES = [1 << 16, 1 << 20, 1 << 24, 1 << 62]
FILE_BYTES = 256 << 20
#: Bytes of a gzip file without content.
EMPTY_GZIP = 20
#: Bytes inflated at a time.
CHUNK = 1 << 20


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's UTF-8 bytes: four times 40 bits, 8 digits each."""
    digest = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), HEX32, BASE32)


def _record(kind: str, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without the two CRLF behind its block."""
    lines = [F.lit(f"{VERSION}{CRLF}WARC-Type: {kind}{CRLF}")]
    for name, value in headers:
        lines += [F.lit(f"{name}: "), value, F.lit(CRLF)]
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"),
                    F.lit(CRLF + CRLF), block)


def _urn(kind: str, key: Column) -> Column:
    h = F.md5(F.concat(F.lit(kind + ":"), key))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def plan_captures(pages: DataFrame, least_revisit: int = 0) -> DataFrame:
    """``page_id, url, payload, digest, size, refers_to``: what to write for each page.

    ``refers_to`` is the page_id of the response that a revisit repeats, else
    null. Payloads of fewer than ``least_revisit`` bytes are never revisits.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"),
                        F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload")))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long"))
    # decided on what names a page alone; the payloads wait
    named = checkpoint(rows.select("page_id", "digest", "size").filter(F.col("size") >= least_revisit))
    first = checkpoint(named.groupBy("digest", "size").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL").drop("n"))
    again = checkpoint(named.join(first, ["digest", "size"]).filter(~F.col("page_id").eqNullSafe(F.col("first")))
                       .select(F.col("page_id").alias("of_page"), F.col("digest").alias("of_digest"),
                               F.col("first").alias("refers_to")).distinct())
    # by the page: beyond a broadcast each payload moves once, and no digest is a hot key
    on = F.col("page_id").eqNullSafe(F.col("of_page")) & (F.col("digest") == F.col("of_digest"))
    return rows.join(small_side(again), on, "left").drop("of_page", "of_digest")


def write_archives(captures: DataFrame, path: str, date: str = "2025-01-01T00:00:00Z",
                   records_per_file: int = 4096) -> None:
    """Write the records of each capture to gzip archives of at most ``records_per_file`` captures.

    Captures are written by size class, with fewer to a file the larger they
    are, so that an archive holds at most ``FILE_BYTES`` of payloads, or one.
    """
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    own = F.concat_ws(":", page, "digest")
    main_id = _urn("capture", own)
    uri = F.regexp_replace("url", "[\\r\\n]", "")
    date_of = ("WARC-Date", F.lit(date))
    target = ("WARC-Target-URI", uri)
    payload = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF
                          + "Content-Length: "), F.col("size").cast("string"), F.lit(CRLF + CRLF))
    response = _record("response", [("WARC-Record-ID", main_id), date_of, target, payload,
                                    ("Content-Type", F.lit("application/http; msgtype=response"))],
                       F.concat(http, F.col("payload")))
    revisit = _record("revisit", [("WARC-Record-ID", main_id), date_of, target, payload,
                                  ("WARC-Profile", F.lit(REVISIT_PROFILE)),
                                  ("WARC-Refers-To", _urn("capture", F.concat_ws(
                                      ":", F.col("refers_to").cast("string"), "digest"))),
                                  ("Content-Type", F.lit("application/http; msgtype=response"))], http)
    request = _record("request", [("WARC-Record-ID", _urn("request", own)), date_of, target,
                                  ("WARC-Concurrent-To", main_id),
                                  ("Content-Type", F.lit("application/http; msgtype=request"))],
                      F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1" + CRLF + CRLF)))
    metadata = _record("metadata", [("WARC-Record-ID", _urn("metadata", own)), date_of, target,
                                    ("WARC-Concurrent-To", main_id),
                                    ("Content-Type", F.lit("application/warc-fields"))],
                       F.concat(F.lit("page-id: "), page, F.lit(CRLF)))
    main = F.when(F.col("refers_to").isNull(), response).otherwise(revisit)
    end = F.lit(CRLF + CRLF)
    held = F.when(F.col("refers_to").isNull(), F.col("size")).otherwise(0)
    size_class = F.lit(0)
    for limit in SIZE_CLASSES[:-1]:
        size_class = size_class + (held >= limit).cast("int")
    there = {r["c"] for r in captures.select(size_class.alias("c")).distinct().collect()} | {0}
    for c in sorted(there):
        most = max(1, min(records_per_file, FILE_BYTES // SIZE_CLASSES[c]))
        (captures.filter(size_class == c).select(F.concat(request, end, main, end, metadata).alias("value"))
         .write.mode("append").option("lineSep", CRLF + CRLF).option("compression", "gzip")
         .option("maxRecordsPerFile", most).text(path))
    if len(there) > 1:  # Spark writes a file for the first partition even if it has no row of the class
        spark = captures.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = place.getFileSystem(spark._jsc.hadoopConfiguration())
        for f in store.listStatus(place):
            if f.getPath().getName().startswith("part-") and f.getLen() <= EMPTY_GZIP:
                store.delete(f.getPath(), False)


def records(stream: Iterator[bytes]) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """``(type, headers, block)`` of each record of an inflated archive."""
    data, at = bytearray(), 0

    def more() -> bool:
        nonlocal at
        chunk = next(stream, None)
        if chunk is None:
            return False
        del data[:at]
        at = 0
        data.extend(chunk)
        return True

    while True:
        while data[at:at + 2] == b"\r\n":
            at += 2
        while (end := data.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if data[at:].strip():
                    raise ValueError("an archive ends within a header")
                return
            while data[at:at + 2] == b"\r\n":
                at += 2
        lines = data[at:end].decode("utf-8").split(CRLF)
        if lines[0] != VERSION:
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        start, size = end + 4, int(headers["content-length"])
        while len(data) - start < size:
            start -= at
            if not more():
                raise ValueError("an archive ends within a record")
        yield headers["warc-type"], headers, bytes(data[start:start + size])
        at = start + size


def _inflated(content: bytes) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, a chunk at a time."""
    view, at = memoryview(content), 0
    inflate = zlib.decompressobj(31)
    while at < len(view) or inflate.unconsumed_tail:
        fed = inflate.unconsumed_tail
        if not fed:
            fed = view[at:at + CHUNK]
            at += len(fed)
        out = inflate.decompress(fed, CHUNK)
        if out:
            yield out
        if inflate.eof:
            at -= len(inflate.unused_data)
            inflate = zlib.decompressobj(31)


RECORD_SCHEMA = ("type string, record_id string, concurrent_to string, uri string, date string, digest string, "
                 "refers_to string, page_id long, size long, seen_digest string")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record: its headers, and of responses the length and digest of the payload read."""
    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for kind, head, block in records(_inflated(content.as_py())):
                    size = seen = page = None
                    if kind == "response":
                        body = block.partition(b"\r\n\r\n")[2]
                        size, seen = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
                    elif kind == "metadata":
                        fields = dict(x.split(": ", 1) for x in block.decode().split(CRLF) if ": " in x)
                        page = fields.get("page-id") or None
                    rows.append({"type": kind, "record_id": head["warc-record-id"],
                                 "concurrent_to": head.get("warc-concurrent-to"), "uri": head.get("warc-target-uri"),
                                 "date": head.get("warc-date"),
                                 "digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                                 "refers_to": head.get("warc-refers-to"), "page_id": int(page) if page else None,
                                 "size": size, "seen_digest": seen})
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    files = (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content"))
    return files.mapInArrow(parse, RECORD_SCHEMA)


ARROW = pa.schema([(n, pa.int64() if t == "long" else pa.string())
                   for n, t in (x.split() for x in RECORD_SCHEMA.split(", "))])


def assemble(found: DataFrame) -> DataFrame:
    """One nested row for each capture: ``capture, request, metadata, response``.

    ``capture`` is the response or revisit record; ``request`` and ``metadata``
    are the records concurrent to it. ``response`` is the record that holds the
    capture's payload, with the page_id of its own metadata: of a response
    itself, of a revisit the one it refers to, or null if the archives lack it.
    """
    names = ["type", "record_id", "uri", "date", "digest", "refers_to", "size", "seen_digest"]
    fields = F.struct(*names, "page_id")
    captures = found.filter(F.col("type").isin("response", "revisit")).select(
        F.col("record_id").alias("id"), fields.alias("capture"))

    def beside(kind: str) -> DataFrame:
        return (found.filter(F.col("type") == kind).groupBy(F.col("concurrent_to").alias("id"))
                .agg(F.min(fields).alias(kind)))

    rows = checkpoint(captures.join(beside("request"), "id", "left").join(beside("metadata"), "id", "left").drop("id"))
    whole = rows.filter(F.col("capture.type") == "response").withColumn(
        "response", F.struct(*[F.col(f"capture.{n}") for n in names], F.col("metadata.page_id").alias("page_id")))
    again = rows.filter(F.col("capture.type") == "revisit")
    # written first: both sides of the join are then plain tables, and a payload with very many revisits is split
    by_id = checkpoint(whole.groupBy(F.col("response.record_id").alias("id")).agg(F.min("response").alias("response")))
    return whole.unionByName(again.join(by_id, F.col("capture.refers_to") == F.col("id"), "left").drop("id"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "warc")
    write_archives(plan_captures(read_table(spark, sf_dir, "pages")), path)
    whole = assemble(checkpoint(read_records(spark, path)))
    return whole.select(F.col("metadata.page_id").alias("page_id"), F.col("response.size").alias("payload_bytes"),
                        F.col("response.seen_digest").alias("payload_digest"),
                        F.col("capture.type").alias("record_type"),
                        F.when(F.col("capture.type") == "revisit", F.col("response.page_id")).alias("refers_to"))


OP4_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS hex FROM p),
g AS (SELECT *, min(page_id) OVER (PARTITION BY hex, payload_bytes) AS first FROM h)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 8), lambda i:
         array_to_string(list_transform([15, 10, 5, 0], lambda s:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  1 + CAST((CAST('0x' || substr(hex, CAST(1 + 5 * i AS INT), 5) AS INT) >> s) & 31 AS INT), 1)), '')), '')
         AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM g
"""
