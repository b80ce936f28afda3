"""Content-addressed WARC archive.

An archive is two tables in the shared folder. ``payloads`` holds each distinct
payload once under its SHA-256; ``records`` holds each record's exact header
bytes and the digest of its payload. Reading joins the two again, recomputes
both digests of every stored payload and fails on a mismatch.

Cases: a null payload is an empty payload; a null URI leaves its header line
out; CR and LF in a URI are percent-encoded; rows with the same key and payload
are all responses when theirs is the least key; a null key is a revisit of its
group's least key, or a response when the group has no other; an empty table
gives an empty archive; extra input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.plans.shared import scratch_path
from codeloom.plans.skew import salted_lookup

#: The base32 alphabet and the revisit profile.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRAWL_DATE = "1970-01-01T00:00:00Z"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1, from JVM expressions only."""
    digest = F.sha1(data)

    def twenty_bits(i: Column) -> Column:
        bits = F.conv(F.substring(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)])

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), twenty_bits), "")


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _header(key: Column, refers_to: Column, uri: Column, revisit: Column, digest: Column, size: Column) -> Column:
    """The exact bytes before a record's payload: WARC header, then HTTP header."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), _line("Content-Type", F.lit("text/html; charset=utf-8")), _line("Content-Length", size.cast("string")), F.lit("\r\n"))
    block = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(size)
    urn = lambda k: F.concat(F.lit("<urn:record:"), F.coalesce(k.cast("string"), F.lit("")), F.lit(">"))
    safe_uri = F.replace(F.replace(uri, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.encode(
        F.concat(
            F.lit("WARC/1.1\r\n"),
            _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            _line("WARC-Record-ID", urn(key)),
            F.coalesce(_line("WARC-Target-URI", safe_uri), F.lit("")),
            _line("WARC-Date", F.lit(CRAWL_DATE)),
            _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
            F.when(revisit, F.concat(_line("WARC-Profile", F.lit(REVISIT_PROFILE)), _line("WARC-Refers-To", urn(refers_to)))).otherwise(F.lit("")),
            _line("Content-Type", F.lit("application/http; msgtype=response")),
            _line("Content-Length", block.cast("string")),
            F.lit("\r\n"),
            http,
        ),
        "UTF-8",
    )


def write_archive(captures: DataFrame, path: str, key: str, uri: str, payload: str, min_bytes: int = 0) -> None:
    """Archive ``captures`` under ``path``.

    Of the records with equal payloads of at least ``min_bytes`` bytes the one
    with the least key is the response and the others revisit it. The payload
    group is reduced on the map side first, so copies of one payload meet as
    one row per task; headers look their group up through a salted join.
    """
    rows = captures.select(F.col(key).alias("key"), F.col(uri).alias("uri"), F.coalesce(F.col(payload), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha256", F.sha2("payload", 256))
    (
        rows.groupBy("sha256")
        .agg(F.first("payload").alias("payload"), F.min(F.octet_length("payload")).alias("least"), F.max(F.octet_length("payload")).alias("most"))
        .select("sha256", F.when(F.col("least") == F.col("most"), F.col("payload")).otherwise(F.raise_error(F.lit("one digest, two payloads"))).alias("payload"))
        .write.option("compression", "zstd")
        .parquet(f"{path}/payloads")
    )
    facts = rows.select("key", "uri", "sha256", base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("size"))
    copied = rows.groupBy("sha256").agg(F.min("key").alias("first_key"), F.count("*").alias("n")).filter("n > 1").drop("n")
    facts = salted_lookup(facts, copied, ["sha256"], F.struct("key", "uri"))
    revisit = (F.col("size") >= min_bytes) & F.col("first_key").isNotNull() & ~F.col("key").eqNullSafe(F.col("first_key"))
    (
        facts.withColumn("revisit", revisit)
        .select("key", "sha256", _header(F.col("key"), F.col("first_key"), F.col("uri"), F.col("revisit"), F.col("sha1"), F.col("size")).alias("header"))
        .write.option("compression", "zstd")
        .parquet(f"{path}/records")
    )


def _payloads(spark: SparkSession, path: str) -> DataFrame:
    """Every stored payload, verified against its key."""
    stored = spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads")
    checked = F.when(F.sha2("payload", 256) == F.col("sha256"), F.octet_length("payload").cast("long")).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("sha256"))))
    return stored.select("sha256", "payload", checked.alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))


def _records(spark: SparkSession, path: str) -> DataFrame:
    """Every record with the fields of its header."""
    stored = spark.read.schema("key long, sha256 string, header binary").parquet(f"{path}/records")
    text = F.decode("header", "UTF-8")
    field = lambda name, value: F.nullif(F.regexp_extract(text, rf"\r\n{name}: {value}\r\n", 1), F.lit(""))
    return stored.select(
        "sha256",
        "header",
        field("WARC-Record-ID", r"<urn:record:(-?[0-9]*)>").cast("long").alias("key"),
        field("WARC-Type", "([a-z]+)").alias("record_type"),
        field("WARC-Refers-To", r"<urn:record:(-?[0-9]*)>").cast("long").alias("refers_to"),
        field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)").alias("header_digest"),
        field("WARC-Target-URI", "([^\r\n]*)").alias("uri"),
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, joined to its verified payload's length and digest.

    A header whose digest is not the payload's fails the read.
    """
    # The payload itself stops here: only its length and digest cross the join.
    facts = _payloads(spark, path).drop("payload")
    joined = salted_lookup(_records(spark, path), facts, ["sha256"], F.col("key"), "left")
    digest = F.when(F.col("header_digest") == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("record does not match its payload:"), F.col("key"))))
    return joined.select("key", "uri", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to", F.octet_length("header").alias("header_bytes"))


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """The original bytes of every record: header, then the payload of a response.

    Only responses meet their payload, so a payload with many revisits is
    joined once.
    """
    records = _records(spark, path).select("key", "record_type", "sha256", "header")
    payloads = _payloads(spark, path).filter(F.col("payload_bytes") >= 0).select("sha256", "payload")
    end = F.lit(b"\r\n\r\n")
    full = records.filter("record_type = 'response'").join(payloads, "sha256").select("key", "record_type", F.concat("header", "payload", end).alias("record"))
    return full.unionByName(records.filter("record_type = 'revisit'").select("key", "record_type", F.concat("header", end).alias("record")))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page, read the archive back, and return what its records say."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.encode("html", "UTF-8").alias("payload"))
    path = scratch_path(spark, "warc")
    write_archive(pages, path, "page_id", "url", "payload")
    return read_archive(spark, path).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "header_bytes")
