"""Content-addressed web archive.

Under `path`:

  payloads/  digest, payload: each distinct payload once, under its SHA-256. The writer compares SHA-1, a 64-bit
             hash and length of all payloads of a digest and fails if they differ.
  headers/   digest, payload_bytes, header: the exact header bytes of every record (WARC/1.1).

Records are put together again by a join on the digest: header, payload, two line ends. A payload of at least
REVISIT_BYTES that several pages have is a response in the page with the largest page_id and a revisit in the
others. read() parses the headers and recomputes length and digests from the payloads' bytes, once for each payload, before
the join; where a payload is that of very many records, adaptive execution splits their side of the join.

Null html is an empty payload. A null page_id is the smallest and gives no page field, a null url no target. Of
rows that repeat page_id and payload (ties) one is the response, the others are revisits of it. Payloads of any length
are kept whole. Other columns are never read, whatever their names. An empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.llm.common import scratch, stored, table

REVISIT_BYTES = 1000
NO_ID = -(1 << 63)
EOL = "\r\n"


def _field(name: str, value: F.Column) -> F.Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(EOL)), F.lit(""))


def _header() -> F.Column:
    revisit = F.col("record_type") == "revisit"
    return F.concat(
        F.lit(f"WARC/1.1{EOL}"),
        _field("WARC-Type", F.col("record_type")),
        _field("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.col("uuid"), F.lit(">"))),
        _field("WARC-Date", F.col("date")),
        _field("WARC-Page-ID", F.col("page_id").cast("string")),
        _field("WARC-Target-URI", F.regexp_replace("url", "[\\r\\n]+", "%0A")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{EOL}")).otherwise(""),
        F.when(revisit, _field("WARC-Refers-To-Page-ID", F.col("winner_id").cast("string"))).otherwise(""),
        _field("Content-Type", F.lit("text/html")),
        _field("Content-Length", F.col("payload_bytes").cast("string")),
        F.lit(EOL),
    ).cast("binary")


def write(pages: DataFrame, path: str) -> None:
    """Write the archive of pages (page_id, url, html). WARC-Date is the time of writing, in UTC."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    slim = rows.select("page_id", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    date = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    slim = stored(slim.select("*", F.monotonically_increasing_id().alias("row"), F.uuid().alias("uuid"), date.alias("date")), "records")
    last = F.struct(F.coalesce("page_id", F.lit(NO_ID)).alias("i"), F.col("row").alias("r"))
    winners = slim.groupBy("digest").agg(F.max(last).alias("w")).select("digest", F.col("w.r").alias("winner_row"), F.when(F.col("w.i") != NO_ID, F.col("w.i")).alias("winner_id"))
    kind = F.when((F.col("payload_bytes") < REVISIT_BYTES) | (F.col("row") == F.col("winner_row")), "response").otherwise("revisit")
    headers = slim.join(winners, "digest").withColumn("record_type", kind).select("digest", "payload_bytes", _header().alias("header"))
    headers.write.parquet(f"{path}/headers")
    # copies fold before the shuffle; equal digests must have equal bytes
    second = rows.withColumn("second", F.concat_ws(":", F.sha1("payload"), F.xxhash64("payload").cast("string"), F.octet_length("payload").cast("string")))
    once = second.groupBy("digest").agg(F.first("payload").alias("payload"), F.min("second").alias("least"), F.max("second").alias("greatest"))
    same = F.when(F.col("least") == F.col("greatest"), F.col("payload")).otherwise(F.raise_error(F.lit("two payloads have one digest")))
    once.select("digest", same.alias("payload")).write.parquet(f"{path}/payloads")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """digest, payload, bytes, sha1 of each payload; fails where one is damaged."""
    rows = spark.read.schema("digest binary, payload binary").parquet(f"{path}/payloads")
    sound = F.unhex(F.sha2("payload", 256)) == F.col("digest")
    checked = F.when(F.coalesce(sound, F.lit(False)), F.col("payload")).otherwise(F.raise_error(F.lit("a payload is damaged")))
    return rows.select("digest", checked.alias("payload")).select("*", F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("sha1"))


def records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """header, digest, bytes, sha1 and, if asked for, payload of every record; fails where a payload is missing or damaged."""
    headers = spark.read.schema("digest binary, payload_bytes long, header binary").parquet(f"{path}/headers")
    found = payloads(spark, path)
    joined = headers.join(found if with_payload else found.drop("payload"), "digest", "left")
    fits = F.when(F.col("bytes").eqNullSafe(F.col("payload_bytes")), F.col("bytes")).otherwise(F.raise_error(F.lit("a payload is damaged")).cast("long"))
    return joined.select("header", "digest", fits.alias("bytes"), "sha1", *(["payload"] if with_payload else []))


def original(header: F.Column, payload: F.Column) -> F.Column:
    """The bytes of a whole record."""
    return F.concat(header, payload, F.lit(EOL + EOL).cast("binary"))


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if asked for, payload: one row per record."""
    text = F.col("header").cast("string")
    field = lambda name: F.nullif(F.regexp_extract(text, f"(?md)^{name}: (.*?)\\r$", 1), F.lit(""))
    return records(spark, path, with_payload).select(
        field("WARC-Page-ID").cast("long").alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        F.col("bytes").alias("payload_bytes"),
        F.col("sha1").alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        field("WARC-Refers-To-Page-ID").cast("long").alias("refers_to"),
        *(["payload"] if with_payload else []),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path, False).drop("url")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, h, strlen(h) AS n, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN n < {REVISIT_BYTES} OR page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n < {REVISIT_BYTES} OR page_id = last THEN NULL ELSE last END AS refers_to
FROM q
"""
