"""Content-addressed WARC archive.

An archive is a folder with three parts:

* ``payloads/*.txt.gz``: gzipped WARC/1.1 response records, one for each different payload: an HTTP head and the payload's bytes. Spark's
  text writer makes them, with CRLF CRLF, which ends a WARC record, as the separator; so they go to any file system that Spark writes to.
* ``revisits/*.txt.gz``: WARC/1.1 revisit records of the other pages: a header, and a block that holds the HTTP head only.
* ``headers/``: a Parquet table with the exact header block of every record, responses and revisits, and the payload's address.

The address is SHA-256 of the payload; headers carry the customary SHA-1 in base32, and SHA-256 of the block. Reading verifies each block's length and both
digests. Joins of headers and payloads by address give the original records back.

Of records with equal payloads the one with the largest key is the response and holds the bytes; the others are revisits that
refer to it. Payloads shorter than ``min_bytes`` are all responses (their bytes are stored once all the same).

Copies of a payload are never brought together: winners come from an aggregate over (address, key) with map-side combine. Bodies go straight
from the pages to the archive: only pages that lose, or that may have a double of equal key and payload, are shuffled with their bodies, told by a bitmap.

Defined cases: null payload is empty; null url gives no target header; line ends in a url become spaces; rows with a group's largest key repeated are all responses, stored once;
null keys lose to others; keys are read back in the type they had; an empty table gives an empty archive; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.sieve import passing
from lexispark.scratch import spill

HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed values: RFC 4648
URN = "urn:x-record:"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: five hex digits are four base32 digits."""
    h = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(h, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), HEX32, BASE32)


def _digests(pages: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """k, url, sha256 and sha1 of the payload, block (sha256 of HTTP head and payload), n (payload bytes), body."""
    body = F.coalesce(F.col(payload), F.lit(""))
    got = pages.select(F.col(key).alias("k"), F.col(url).alias("url"), body.alias("body"))
    return got.withColumns({"sha256": F.sha2("body", 256), "sha1": base32_sha1(F.col("body").cast("binary")), "block": F.sha2(F.concat(F.lit(HTTP), "body"), 256), "n": F.octet_length("body").cast("long")})


def _header(own: Column, keep: Column, date: str) -> Column:
    """A record's exact header block, CRLF between lines."""
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    return F.concat(
        F.lit("WARC/1.1"),
        line("WARC-Type", F.when(own, "response").otherwise("revisit")),
        line("WARC-Record-ID", F.concat(F.lit(f"<{URN}"), F.coalesce(F.col("k").cast("string"), F.lit("null")), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.when(own, F.col("block")).otherwise(F.lit(hashlib.sha256(HTTP.encode()).hexdigest())))),
        F.when(own, F.lit("")).otherwise(F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", F.concat(F.lit(f"<{URN}"), keep.cast("string"), F.lit(">"))))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.when(own, F.col("n")).otherwise(F.lit(0)) + len(HTTP)).cast("string")),
    )


def write_archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, records_per_file: int = 2000, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write pages as an archive to ``path``, which must not exist. date: every record's WARC-Date, as pages have none."""
    d = spill(_digests(pages, key, url, payload).drop("body"), "payload-digests")
    winners = d.groupBy("sha256").agg(F.max("k").alias("keep"))
    own = F.col("k").eqNullSafe(F.col("keep")) | (F.col("n") < min_bytes)
    told = d.join(winners, "sha256").select("k", "sha256", F.col("k").eqNullSafe(F.col("keep")).alias("stored"), own.alias("own"), F.when(~own, F.col("keep")).alias("refers_to"), _header(own, F.col("keep"), date).alias("header"))
    told.write.parquet(f"{path}/headers")
    told = pages.sparkSession.read.schema(told.schema).parquet(f"{path}/headers")
    out = {"lineSep": "\r\n\r\n", "maxRecordsPerFile": records_per_file, "compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
    told.where("not own").select(F.concat("header", F.lit("\r\n\r\n" + HTTP)).alias("value")).write.options(**out).text(f"{path}/revisits")
    mark = lambda k: F.xxhash64(F.col(k).isNull(), k, "sha256")
    twice = told.where("stored").groupBy("k", "sha256").agg(F.count("*").alias("c")).where("c > 1")
    doubt = spill(told.where("not stored").select(mark("k").alias("x")).union(twice.select(mark("k"))).distinct(), "pages-in-doubt")
    bodies = passing(_digests(pages, key, url, payload), mark("k"), doubt)
    record = F.concat(_header(F.lit(True), F.lit(None), date), F.lit("\r\n\r\n" + HTTP), "body").alias("value")
    first = told.where("stored").select(F.col("k").alias("wk"), F.col("sha256").alias("wsha")).distinct()
    some = bodies.where("may_be_member").join(first, F.col("k").eqNullSafe(F.col("wk")) & (F.col("sha256") == F.col("wsha"))).dropDuplicates(["k", "sha256"])
    bodies.where("not may_be_member").select(record).unionByName(some.select(record)).write.options(**out).text(f"{path}/payloads")


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzipped WARC file (one member or several)."""
    out = []
    while data:
        z = zlib.decompressobj(31)
        out.append(z.decompress(data) + z.flush())
        data = z.unused_data
    raw, at = b"".join(out), 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        n = int(head["Content-Length"])
        block = raw[end + 4 : end + 4 + n]
        at = end + 4 + n + 4
        if len(block) != n or raw[at - 4 : at] != b"\r\n\r\n":
            raise ValueError(f"a WARC record is cut off at byte {at}")
        yield head, block


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            sha256, sha1, body = [], [], []
            for head, block in parse_warc(content.as_py()):
                entity = block[block.index(b"\r\n\r\n") + 4 :]
                b = base64.b32encode(hashlib.sha1(entity).digest()).decode()
                if head["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}" or head["WARC-Payload-Digest"] != f"sha1:{b}":
                    raise ValueError(f"the payload of {head['WARC-Record-ID']} isn't what was written")
                sha256.append(hashlib.sha256(entity).hexdigest())
                sha1.append(b)
                body.append(entity)
            yield pa.RecordBatch.from_arrays([pa.array(sha256, pa.string()), pa.array(sha1, pa.string()), pa.array(map(len, body), pa.int64()), pa.array(body, pa.binary())], names=["sha256", "payload_digest", "payload_bytes", "payload"])


def read_archive(spark: SparkSession, path: str, key: str = "page_id") -> DataFrame:
    """The original records: key, url, record_type, refers_to, header, payload_bytes, payload_digest, payload."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(f"{path}/payloads").select("content")
    payloads = files.mapInArrow(_verified, "sha256 string, payload_digest string, payload_bytes long, payload binary")
    headers = spark.read.parquet(f"{path}/headers")
    kind = dict(headers.dtypes)["k"]
    field = lambda name, pattern="([^\r\n]*)": F.nullif(F.regexp_extract("header", rf"\r\n{name}: {pattern}", 1), F.lit(""))
    id_of = rf"<{URN}([^>]*)>"
    h = headers.select(
        "header",
        "sha256",
        F.when(F.col("k").isNotNull(), field("WARC-Record-ID", id_of)).cast(kind).alias(key),
        field("WARC-Target-URI").alias("url"),
        field("WARC-Type").alias("record_type"),
        field("WARC-Refers-To", id_of).cast(kind).alias("refers_to"),
    )
    return h.join(payloads, "sha256").select(key, "url", "record_type", "refers_to", "header", "payload_bytes", "payload_digest", "payload")
