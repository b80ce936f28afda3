"""The archive round trip, duplicates, nulls and verification."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from codeloom.llm import warc
from codeloom.plans.shared import scratch_path

PAGES = "page_id long, url string, html string, sha256 string, n int"
ROWS = [(5, "http://a/5", "same", "x", 1), (2, "http://a/2", "same", "x", 1), (9, None, "same", "x", 1), (3, "http://a/3", None, "x", 1), (4, "u\r\nv", "", "x", 1), (7, "http://é/", "ü" * 1000, "x", 1), (None, "http://n/", "lone", "x", 1), (None, "http://m/", "same", "x", 1)]


def sha1(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_records_of_pages(spark, folder):
    out = {(r.page_id, r.payload_digest): r for r in warc.op1_warc(spark, folder(pages=(ROWS, PAGES))).collect()}
    assert len(out) == len(ROWS)
    for page_id, _, html, _, _ in ROWS:
        r = out[page_id, sha1(html)]
        peers = [p for p, _, h, _, _ in ROWS if (h or "") == (html or "") and p is not None]
        first = min(peers, default=None)
        assert r.payload_bytes == len((html or "").encode())
        assert (r.record_type, r.refers_to) == (("response", None) if page_id == first or not peers else ("revisit", first))


def test_reconstructs_exact_records(spark, folder):
    path = scratch_path(spark, "t-warc")
    pages = spark.read.parquet(folder(pages=(ROWS, PAGES)) + "/pages.parquet").withColumn("payload", F.encode("html", "UTF-8"))
    warc.write_archive(pages, path, "page_id", "url", "payload", min_bytes=5)
    records = {(r.key, bytes(r.record)) for r in warc.reconstruct(spark, path).collect()}
    assert len(records) == len(ROWS)
    assert {r.record_type for r in warc.reconstruct(spark, path).collect()} == {"response"}  # all equal payloads are short
    long = next(b for k, b in records if k == 7)
    head, _, payload = long.partition(b"\r\n\r\nHTTP/1.1")
    assert b"WARC-Type: response" in head and payload.endswith(("ü" * 1000).encode() + b"\r\n\r\n")
    block = b"HTTP/1.1" + payload[:-4]
    assert f"Content-Length: {len(block)}".encode() in head
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h, _, _ in ROWS})
    assert not any(b"\nv" in b for k, b in records if k == 4)


def test_a_changed_payload_fails_the_read(spark, folder):
    path = scratch_path(spark, "t-warc")
    pages = spark.read.parquet(folder(pages=(ROWS, PAGES)) + "/pages.parquet").withColumn("payload", F.encode("html", "UTF-8"))
    warc.write_archive(pages, path, "page_id", "url", "payload")
    bad = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"other"))
    bad.write.parquet(f"{path}-bad/payloads")
    spark.read.parquet(f"{path}/records").write.parquet(f"{path}-bad/records")
    with pytest.raises(Exception, match="does not match"):
        warc.read_archive(spark, f"{path}-bad").collect()


def test_empty(spark, empty_folder):
    assert warc.op1_warc(spark, empty_folder).collect() == []
