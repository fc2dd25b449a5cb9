"""Content-addressed WARC archive.

Payload bytes are stored once each, under their SHA-256; exact record headers
are stored apart, one per record, with the digest they point to.  Original
records come back by joining the two on the digest, after each stored payload
has been hashed again.

An archive is a folder of two tables:

    headers   digest, header (the exact header block, ending in an empty line)
    payloads  digest, payload (binary)

Records of one payload of `least_bytes` or more are deduplicated in WARC's own
terms as well: the record with the smallest id is a response and the others
are revisit records that refer to it.

Writing shuffles each payload once, combined before the shuffle, so that a page
copied a million times moves once per map task; headers are made from
(id, digest, length) rows, which carry no payload.  Nothing runs in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table

LEAST_BYTES = 100
CRLF = "\r\n"
#: Pages carry no fetch time; archives that must not change between runs can't use the clock.
DATE = "1970-01-01T00:00:00Z"


def _urn(identity: Column) -> Column:
    """A record id that follows from the page id."""
    h = F.md5(F.concat(F.lit("record:"), F.coalesce(identity.cast("string"), F.lit("null"))))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line; none where the value is null."""
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise(F.lit(""))


def _uri(url: Column) -> Column:
    """Control characters would end the header line: they are percent-encoded as %0D, %0A and %00."""
    return F.replace(F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit("\0"), F.lit("%00"))


def header(page_id: Column, url: Column, digest: Column, n_bytes: Column, kind: Column, refers_to: Column) -> Column:
    """The header block of a record as text."""
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", _urn(page_id)),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", _uri(url)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        _line("WARC-Refers-To", F.when(refers_to.isNotNull(), _urn(refers_to))),
        _line("X-Page-Id", page_id.cast("string")),
        _line("X-Refers-To-Page-Id", refers_to.cast("string")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", n_bytes.cast("string")),
        F.lit(CRLF),
    )


def write_archive(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Write a record for each row of pages (page_id, url, html) below `path`.

    Null html is an empty payload; a null url leaves its header line out.  Rows
    that share the smallest id of a payload are all responses; a null id comes
    after every other, and payloads that only null ids have are all responses.
    An empty table makes an archive without records.  Other columns are ignored.
    """
    rows = pages.select(
        "page_id",
        "url",
        F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    rows.groupBy("digest").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    slim = rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("n_bytes"))
    first = slim.filter(F.col("n_bytes") >= least_bytes).groupBy(F.col("digest").alias("_digest")).agg(F.min("page_id").alias("_first"))
    known = slim.join(first, F.col("digest") == F.col("_digest"), "left")
    is_revisit = F.col("_digest").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("_first"), F.col("_first").isNull())
    records = known.withColumn("kind", F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response"))).withColumn("refers_to", F.when(is_revisit, F.col("_first")))
    block = header(F.col("page_id"), F.col("url"), F.col("digest"), F.col("n_bytes"), F.col("kind"), F.col("refers_to"))
    records.select("digest", block.alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def _field(name: str) -> Column:
    """A header's value; null where the line is missing."""
    value = F.regexp_extract(F.col("header"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(F.contains(F.col("header"), F.lit(f"{CRLF}{name}: ")), value)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """The records' headers, parsed: page_id, url, record_type, refers_to, payload_digest, content_length, header."""
    rows = spark.read.schema("digest string, header string").parquet(f"{path}/headers")
    return rows.select(
        _field("X-Page-Id").cast("long").alias("page_id"),
        _field("WARC-Target-URI").alias("url"),
        _field("WARC-Type").alias("record_type"),
        _field("X-Refers-To-Page-Id").cast("long").alias("refers_to"),
        F.substring(_field("WARC-Payload-Digest"), 8, 64).alias("payload_digest"),
        _field("Content-Length").cast("long").alias("content_length"),
        "header",
    )


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """digest, payload, payload_bytes and verified (the bytes still have the digest they are stored under)."""
    rows = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    return rows.select("digest", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), (F.sha2("payload", 256) == F.col("digest")).alias("verified"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record rebuilt: parsed headers, payload, and `record`, its bytes as a WARC file has them.

    A payload that fails its digest or its header's length stops the read.
    """
    heads, stored = read_headers(spark, path), read_payloads(spark, path)
    sound = F.coalesce(F.col("verified") & (F.col("payload_bytes") == F.col("content_length")), F.lit(False))
    return (
        heads.join(stored, heads.payload_digest == stored.digest, "left")
        .withColumn("payload_bytes", F.when(sound, F.col("payload_bytes")).otherwise(F.raise_error(F.concat(F.lit("archive is damaged at digest "), F.col("payload_digest"))).cast("long")))
        .withColumn("record", F.concat(F.encode("header", "UTF-8"), F.col("payload"), F.lit(b"\r\n\r\n")))
        .drop("digest", "verified", "content_length")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: archive all pages, then read every record back.

    Columns that aren't asked for are pruned, so the join moves lengths and
    digests, taken from the payloads as read back, and no payload.
    """
    path = shared_dir(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_records(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""
