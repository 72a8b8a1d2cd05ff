"""WARC archives without repeated payloads.

Headers (digest, length, page) are shuffled by payload digest; the smallest
page of a digest keeps its payload as a ``response`` record and all others
become ``revisit`` records that name it.  Records are written as compressed
WARC 1.1 files with fresh headers by Spark's own text writer.  Reading walks
the records of each file by their lengths, checks every payload against its
digest and joins revisits with their responses by digest.

Defined cases: a null payload is an empty one; rows that repeat the smallest
page id of a payload are responses both; a null page id counts as larger than
any other; a payload below ``least_bytes`` is always a response; line breaks in
an address are percent-encoded, a null address has no header; other columns are
never looked at.
"""

from __future__ import annotations

import base64
import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worklore.session import fresh_path

#: Records per file, and payloads above this size get files of their own.
RECORDS_PER_FILE = 2000
LARGE_BYTES = 1 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = "page_id long, record_type string, payload_digest string, payload_bytes long, refers_to_digest string, intact boolean"
END = "\r\n"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base32: four groups of 40 bits, eight characters each."""
    code = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(code, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _header(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))


def _record_id(kind: Column, page_id: Column, digest: Column) -> Column:
    """A record's name follows from its content, so a repeated write makes the same file."""
    code = F.md5(F.concat_ws("/", kind, F.coalesce(page_id.cast("string"), F.lit("")), digest))
    parts = [F.substring(code, at, size) for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def records(pages: DataFrame, least_bytes: int = 0, date: str = DATE) -> DataFrame:
    """The text of one WARC record per page, and the payload's size."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.encode("html", "utf-8"))).withColumn("n", F.octet_length("html").cast("long"))
    firsts = rows.where(F.col("n") >= least_bytes).groupBy(F.col("digest").alias("same")).agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    joined = rows.join(firsts.where("copies > 1 and first is not null"), F.col("digest") == F.col("same"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    kind = F.when(revisit, "revisit").otherwise("response")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("n").cast("string"), F.lit(END * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    lines = [
        F.lit(f"WARC/1.1{END}"),
        _header("WARC-Type", kind),
        _header("WARC-Record-ID", _record_id(kind, F.col("page_id"), F.col("digest"))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", url),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _header("WARC-Profile", F.when(revisit, PROFILE)),
        _header("WARC-Refers-To", F.when(revisit, _record_id(F.lit("response"), F.col("first"), F.col("digest")))),
        _header("X-Page-ID", F.col("page_id").cast("string")),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", F.octet_length(block).cast("string")),
        F.lit(END),
        block,
        F.lit(END),
    ]
    return joined.select(F.concat(*lines).alias("value"), "n")


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> list[str]:
    """Write deduplicated archives; gives the folders written."""
    made = records(pages, least_bytes)
    largest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    parts = [("small", made.where(F.col("n") <= LARGE_BYTES), RECORDS_PER_FILE)]
    if largest > LARGE_BYTES:
        parts.append(("large", made.where(F.col("n") > LARGE_BYTES), 1))
    for name, rows, most in parts:
        # The writer adds the last line end of each record.
        rows.select("value").write.options(lineSep=END, compression="gzip", maxRecordsPerFile=most).text(f"{path}/{name}")
    return [f"{path}/{name}" for name, _, _ in parts]


def parse(content: bytes):
    """Header values of each record of one archive file."""
    at = 0
    while at < len(content):
        stop = content.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in content[at:stop].decode().split(END)[1:])
        begin, size = stop + 4, int(head["Content-Length"])
        block = content[begin : begin + size]
        cut = block.index(b"\r\n\r\n") + 4
        http = dict(line.split(": ", 1) for line in block[:cut].decode().strip().split(END)[1:])
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        kind = head["WARC-Type"]
        whole = kind == "revisit" or base64.b32encode(hashlib.sha1(block[cut:]).digest()).decode() == digest and len(block) - cut == int(http["Content-Length"])
        page = head.get("X-Page-ID")
        yield None if page is None else int(page), kind, digest, int(http["Content-Length"]), digest if kind == "revisit" else None, whole
        at = begin + size + 4


def read_headers(spark: SparkSession, folders: list[str]) -> DataFrame:
    """One row per record of the archives."""

    def walk(batches):
        for batch in batches:
            for content in batch.column(0):
                raw = content.as_py()
                rows = list(parse(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw))
                columns = list(zip(*rows)) or [[]] * 6
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=HEADERS.replace(",", "").split()[::2])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folders).select("content").mapInArrow(walk, HEADERS)


def resolve(headers: DataFrame) -> DataFrame:
    """Every record with the page whose response it repeats."""
    originals = headers.where("record_type = 'response'").groupBy(F.col("payload_digest").alias("original")).agg(F.min("page_id").alias("response_page"), F.max("payload_bytes").alias("response_bytes"))
    return headers.join(originals, F.col("refers_to_digest") == F.col("original"), "left").select(
        "page_id",
        F.coalesce("response_bytes", "payload_bytes").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        F.col("response_page").alias("refers_to"),
        "intact",
    )


def archive(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write archives into the shared folder, read them back and resolve the revisits."""
    spark = pages.sparkSession
    return resolve(read_headers(spark, write_archives(pages, fresh_path(spark, "warc"), least_bytes)))
