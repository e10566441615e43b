"""WARC archives: writing request, response and metadata records, reading them back, and joining each transaction.

Records are written by Spark's text writer and read by its binaryFile source, so any store that Spark reaches will do.
A file is read whole, so long pages go to files of fewer pages: PAGES_PER_FILE.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

VERSION = "WARC/1.1"
#: Most bytes of a page's html, and pages in a file of such pages; still longer pages have a file each.
PAGES_PER_FILE = ((1 << 16, 400), (1 << 20, 32), (1 << 24, 2))
#: Equal payloads of at least so many bytes become revisits.
REVISIT_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: Column) -> Column:
    """Base32 of the SHA-1, 40 bits at a time."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(kind: str, same: str, number: Column) -> Column:
    """same: a digest of page_id, url and payload; number: tells rows apart that have it."""
    x = F.md5(F.concat_ws("\n", F.lit(kind), F.col(same), number))
    dashed = F.concat_ws("-", *(F.substring(x, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">"))


def _record(kind: Column | str, record_id: str, block: Column, content_type: str, *more: Column) -> Column:
    """Header lines and the block; more: further header lines, null ones are left out."""
    lines = [F.lit(VERSION), F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind), F.concat(F.lit("WARC-Record-ID: "), F.col(record_id)), F.lit(f"WARC-Date: {DATE}"),
             F.concat(F.lit("WARC-Target-URI: "), F.col("url")), F.lit(f"Content-Type: {content_type}"), *more, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block)


def _numbered(rows: DataFrame, scratch: C.Scratch) -> DataFrame:
    """The rows with number: of rows with the same page_id, url and payload (column same) one has "0", the others a number
    each. Such rows are counted in each input partition and dealt out again from there, however many they are."""
    again = scratch.save(rows.groupBy("same").agg(F.count("*").alias("n")).where("n > 1").select("same"), "again")
    if not again.limit(1).count():
        return rows.withColumn("number", F.lit("0"))
    again = scratch.small(again, "again")
    own = [c for c in rows.columns if c != "same"]
    counted = rows.withColumn("part", F.spark_partition_id()).join(again, "same").groupBy("same", "part").agg(*(F.first(c).alias(c) for c in own), F.count("*").alias("n"))
    counted = scratch.save(counted, "counted")
    lead = counted.groupBy("same").agg(F.min("part").alias("lead"))
    each = counted.join(lead, "same").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    number = F.when((F.col("part") == F.col("lead")) & (F.col("i") == 1), "0").otherwise(F.concat_ws("-", "part", "i"))
    return rows.join(again, "same", "left_anti").withColumn("number", F.lit("0")).unionByName(each.select("same", *own, number.alias("number")))


def write_archives(pages: DataFrame, path: str, scratch: C.Scratch, least: int = REVISIT_BYTES) -> None:
    """One request, one response or revisit, and one metadata record for each row (page_id, url, html).

    The payload is the html, empty where null. Of rows with equal payloads of at least `least` bytes the one with the
    smallest page_id is the response (all rows that repeat that page_id are); rows with a null page_id are responses.
    Line ends in a url are removed; it need not be one. Rows that repeat page_id, url and html are a capture each. Extra
    columns are ignored.
    """
    rows = pages.select("page_id", F.regexp_replace("url", r"[\r\n]", "").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", payload_digest(F.col("html")))
    rows = rows.withColumn("same", F.md5(F.concat_ws("\n", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.coalesce(F.concat(F.lit("u"), "url"), F.lit("-")), "digest")))
    seen = rows.where((F.octet_length("html") >= least) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min(F.struct("page_id", "same")).alias("x"), F.count("*").alias("n"))
    seen = scratch.save(seen.where("n > 1").select("digest", F.col("x.page_id").alias("first"), F.col("x.same").alias("first_same")), "seen")
    rows = _numbered(rows, scratch).join(scratch.small(seen, "seen"), "digest", "left")
    rows = rows.withColumns({k: _record_id(k, "same", F.col("number")) for k in ("request", "response", "metadata")})
    again = F.col("page_id") > F.col("first")
    rows = rows.withColumn("refers", F.when(again, _record_id("response", "first_same", F.lit("0"))))
    http = F.when(again, F.lit(_HTTP)).otherwise(F.concat(F.lit(_HTTP), F.col("html")))
    host = F.coalesce(F.nullif(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("")), F.lit("-"))
    target = F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1), F.lit("/"))
    get = F.concat(F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))
    fields = F.concat_ws("\r\n", F.concat(F.lit("page-id: "), F.col("page_id").cast("string")), F.lit(""))
    to = F.concat(F.lit("WARC-Concurrent-To: "), F.col("response"))
    records = [
        _record("request", "request", get, "application/http; msgtype=request", to),
        _record(
            F.when(again, "revisit").otherwise("response"), "response", http, "application/http; msgtype=response",
            F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")), F.concat(F.lit("WARC-Refers-To: "), F.col("refers")), F.when(again, F.lit(f"WARC-Profile: {_REVISIT}")),
        ),
        _record("metadata", "metadata", fields, "application/warc-fields", to),
    ]
    size = F.octet_length("html")
    kind = F.coalesce(*(F.when(size <= most, i) for i, (most, _) in enumerate(PAGES_PER_FILE)), F.lit(len(PAGES_PER_FILE)))
    present = sorted(r.kind for r in pages.select(F.coalesce("html", F.lit("")).alias("html")).select(kind.alias("kind")).distinct().collect())
    for k in present or [0]:
        per_file = PAGES_PER_FILE[k][1] if k < len(PAGES_PER_FILE) else 1
        text = rows.where(kind == k).select(F.concat_ws("\r\n\r\n", *records).alias("value"))
        text.write.mode("append").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file).text(path)


def _parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields by lower-case name, and the block, of each record. A cut or malformed record ends with an error."""
    at, mark = 0, VERSION.encode() + b"\r\n"
    while at < len(data):
        if not data.startswith(mark, at):
            raise ValueError(f"no record begins at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        fields = dict(x.split(": ", 1) for x in data[at + len(mark) : end].decode().split("\r\n"))
        fields = {k.lower(): v for k, v in fields.items()}
        size = int(fields["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError("the last record is cut")
        yield fields, block
        at = end + 4 + size + 4


RECORDS = "kind string, record_id string, concurrent_to string, refers_to string, uri string, date string, page_id long, payload_bytes long, payload_digest string, payload binary"


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record. payload_bytes and payload_digest come from the payload read back; a revisit has the digest
    of its header and no bytes. payloads: whether to give the payloads out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out = []
                for f, block in _parse(content.as_buffer().to_pybytes()):
                    kind, size, digest, page, payload = f["warc-type"], None, None, None, None
                    if kind == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    elif kind == "revisit":
                        digest = f["warc-payload-digest"].removeprefix("sha1:")
                    elif kind == "metadata":
                        page = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if x).get("page-id")
                    out.append((kind, f["warc-record-id"], f.get("warc-concurrent-to"), f.get("warc-refers-to"), f.get("warc-target-uri"), f["warc-date"], page and int(page), size, digest, payload if payloads else None))
                if out:
                    kinds = [pa.string()] * 6 + [pa.int64(), pa.int64(), pa.string(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [x.split()[0] for x in RECORDS.split(", ")])

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, RECORDS)


def captures(records: DataFrame) -> DataFrame:
    """One nested row for each capture: its response or revisit, with the request and metadata that are concurrent to
    it (null where missing; of several the one with the least record id). Records whose response is missing make a row
    without one."""
    key = F.when(F.col("kind").isin("response", "revisit"), F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id"))
    pick = lambda kinds, *cols: F.min_by(F.struct("record_id", "uri", "date", *cols), F.when(F.col("kind").isin(*kinds), F.col("record_id")))
    return records.groupBy(key.alias("capture_id")).agg(
        pick(["request"]).alias("request"),
        pick(["response", "revisit"], "kind", "refers_to", "payload_bytes", "payload_digest", "payload").alias("response"),
        pick(["metadata"], "page_id").alias("metadata"),
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = C.Scratch(spark, "warc")
    write_archives(C.table(spark, sf_dir, "pages"), scratch.path("archives"), scratch)
    flat = captures(read_records(spark, scratch.path("archives"), payloads=False)).select(
        "capture_id", "metadata.page_id", "response.kind", "response.refers_to", "response.payload_bytes", "response.payload_digest"
    )
    rows = scratch.save(flat, "captures")
    scratch.drop("archives", "seen", "again", "counted")
    out = lambda size, kind, first: ["page_id", F.col(size).alias("payload_bytes"), "payload_digest", F.lit(kind).alias("record_type"), first.alias("refers_to")]
    responses = rows.where("kind = 'response'")
    first = responses.select(F.col("capture_id").alias("refers_to"), F.col("page_id").alias("first"), F.col("payload_bytes").alias("first_bytes"))
    revisits = rows.where("kind = 'revisit'").join(first, "refers_to")
    return responses.select(*out("payload_bytes", "response", F.lit(None).cast("long"))).union(revisits.select(*out("first_bytes", "revisit", F.col("first"))))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h FROM p),
b AS (
  SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, 1 + 10 * (i // 8)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31)::INT, 1)), '') AS payload_digest,
    min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM b
"""
