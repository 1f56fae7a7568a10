"""A content-addressed WARC archive.

An archive is two tables: ``payloads`` holds every different payload once, under the SHA-256 of its bytes;
``records`` holds the exact header block of every record and the digest of its payload. The record as it would
stand in a WARC file is the header, the payload and a closing blank line, joined again when read. Payloads are
verified when the archive is read: their bytes must still have the digests under which they are stored.

Headers are lines ended by CRLF and are read as such, so any other character may stand in a value. A URL with spaces,
controls, or CR or LF, which may not, is stored with these and ``%`` and ``+`` percent-encoded and a field that says so;
reading gives back the URL as it was.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DATE = "2024-01-01T00:00:00Z"  # of all records, for archives that can be made again byte by byte
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
#: Characters that no URL in a header may hold, and those that the encoding needs for itself.
UNSAFE, ESCAPES = r"[\x00-\x20\x7F]", "%+"
ENCODED = "X-Target-URI-Encoding"
BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def base32_of(hex_digest: Column) -> Column:
    """A hexadecimal SHA-1 in upper-case base32: four times ten hexadecimal digits are eight of base 32."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), *BASE32)


def _percent_encoded(url: Column) -> Column:
    """``url`` with the characters of UNSAFE and ESCAPES as percent and two digits; url_decode gives it back."""
    unsafe = [chr(c) for c in range(0x21)] + ["\x7f"]
    return reduce(lambda done, c: F.replace(done, F.lit(c), F.lit(f"%{ord(c):02X}")), [*ESCAPES, *unsafe], url)


def _record_id(*parts: Column) -> Column:
    h = F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _header(names: list[tuple[str, Column]]) -> Column:
    """A WARC/1.1 header block; fields with null values are left out."""
    lines = [F.lit("WARC/1.1"), *[F.concat(F.lit(f"{name}: "), value.cast("string")) for name, value in names]]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> None:
    """Write a record for every row of ``pages`` to a new archive in folder ``path``.

    The payload is the text in UTF-8, null counting as empty. Of the rows with equal payloads of at least
    ``min_bytes`` bytes the one with the smallest id (nulls last, then by URL) becomes a response, all others
    become revisits of it; rows alike in id, URL and payload are told apart by number. Smaller payloads are
    stored once as well, but all their records are responses. An empty table gives an empty archive.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"))
    sha = F.sha2("payload", 256)
    slim = rows.select("page_id", "url", sha.alias("digest"), F.sha1("payload").alias("sha1"), F.length("payload").cast("long").alias("bytes"))
    # counted first: equal rows are one, and a payload that a third of all pages have is one row a task
    alike = slim.groupBy("digest", "sha1", "bytes", "page_id", "url").agg(F.count(F.lit(1)).alias("copies"))
    order = F.struct(F.col("page_id").isNull(), "page_id", F.col("url").isNull(), "url")
    first = slim.groupBy("digest").agg(F.min(order).alias("first"))
    joined = alike.join(first, "digest")
    joined = joined.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    is_first = (order == F.col("first")) & (F.col("copy") == 0)
    joined = joined.withColumn("type", F.when(is_first | (F.col("bytes") < min_bytes), "response").otherwise("revisit"))
    revisit = F.col("type") == "revisit"
    unsafe = F.col("url").rlike(UNSAFE)
    uri = lambda c: F.when(c.rlike(UNSAFE), _percent_encoded(c)).otherwise(c)
    own = _record_id(F.col("page_id"), F.col("url"), F.col("copy"), F.col("digest"))
    other = _record_id(F.col("first.page_id"), F.col("first.url"), F.lit(0), F.col("digest"))
    header = _header([
        ("WARC-Type", F.col("type")),
        ("WARC-Record-ID", own),
        ("WARC-Target-URI", uri(F.col("url"))),
        (ENCODED, F.when(unsafe, F.lit("percent"))),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("base32"))),
        ("WARC-Refers-To", F.when(revisit, other)),
        ("WARC-Refers-To-Target-URI", F.when(revisit, uri(F.col("first.url")))),
        ("WARC-Refers-To-Date", F.when(revisit, F.lit(DATE))),
        ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        ("X-Page-ID", F.col("page_id")),
        ("X-Refers-To-Page-ID", F.when(revisit, F.col("first.page_id"))),
        ("Content-Type", F.lit("text/html; charset=utf-8")),
        ("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))),
    ])
    joined = joined.withColumn("base32", base32_of(F.col("sha1")))
    joined.select(header.cast("binary").alias("header"), "digest").write.option("compression", "zstd").parquet(f"{path}/records")
    # payloads move once, to where those with the same digest meet; each partition keeps one of each
    once = rows.select(sha.alias("digest"), "payload").groupBy("digest").agg(F.first("payload").alias("payload"))
    once.write.option("compression", "zstd").parquet(f"{path}/payloads")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """header, payload and record of every record, joined from both tables.

    ``record`` is the exact bytes as in a WARC file: header, block and closing CRLF CRLF (a revisit's block is empty);
    ``payload`` is the full payload, for revisits too. A payload that no longer has the digest under which it is stored
    raises an error. Records with one payload are joined where it is; a payload that many have is split off as skew.
    """
    records = spark.read.schema("header binary, digest string").parquet(f"{path}/records")
    stored = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    right = F.sha2("payload", 256) == F.col("digest")
    stored = stored.select("digest", F.when(right, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload is damaged: "), "digest")).cast("binary")).alias("payload"))
    joined = records.join(stored, "digest")
    block = F.when(_field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return joined.select("header", "payload", F.concat("header", block, F.lit((CRLF + CRLF).encode())).alias("record"))


def _field(name: str) -> Column:
    """A field's value in the column header; null where there is none."""
    lines = F.filter(F.split(F.col("header").cast("string"), CRLF, -1), lambda line: line.startswith(f"{name}: "))
    return F.get(F.transform(lines, lambda line: F.substr(line, F.lit(len(name) + 3))), 0)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, record_id of every record, parsed from the
    reconstructed records. A header whose payload digest or length contradicts the payload raises an error.
    """
    whole = reconstruct(spark, path)
    uri = _field("WARC-Target-URI")
    parsed = whole.select(
        _field("X-Page-ID").cast("long").alias("page_id"),
        _field("WARC-Type").alias("record_type"),
        _field("X-Refers-To-Page-ID").cast("long").alias("refers_to"),
        F.when(_field(ENCODED).isNotNull(), F.url_decode(uri)).otherwise(uri).alias("url"),
        _field("WARC-Record-ID").alias("record_id"),
        F.substring_index(_field("WARC-Payload-Digest"), ":", -1).alias("said"),
        _field("Content-Length").cast("long").alias("length"),
        (F.length("record") - F.length("header") - 4).cast("long").alias("block"),
        F.length("payload").cast("long").alias("bytes"),
        base32_of(F.sha1("payload")).alias("payload_digest"),
    )
    agrees = (F.col("said") == F.col("payload_digest")) & (F.col("length") == F.col("block")) & ((F.col("block") == 0) | (F.col("block") == F.col("bytes")))
    return parsed.select(
        "page_id",
        F.when(agrees, F.col("bytes")).otherwise(F.raise_error(F.concat(F.lit("header and payload differ: "), F.col("record_id")))).cast("long").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        "refers_to",
        "url",
        "record_id",
    )


ORACLE = r"""
WITH rows AS (
  SELECT page_id, coalesce(html, '') AS payload, url FROM pages),
ranked AS (
  SELECT page_id, url, payload, row_number() OVER (PARTITION BY payload ORDER BY page_id NULLS LAST, url NULLS LAST) AS n,
         first_value(page_id) OVER (PARTITION BY payload ORDER BY page_id NULLS LAST, url NULLS LAST) AS first_id, sha1(payload) AS hex
  FROM rows),
bits AS (
  SELECT *, list_transform(range(32), lambda i: (
      ('0x' || substr(hex || '00', 1 + (i * 5 // 8) * 2, 4))::BIGINT >> (11 - (i * 5 % 8))) & 31) AS digits
  FROM ranked)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
       array_to_string(list_transform(digits, lambda d: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (d + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n > 1 THEN first_id END AS refers_to
FROM bits
"""
