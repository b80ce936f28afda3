"""Versions, incremental ingestion, and upserts."""

import hashlib

import pytest

from codeloom.sources.store import CatalogStore, ingest, upsert_domain, upsert_slices

SCHEMA = "path string, language string, content string, content_hash string, size_bytes long, mtime_ms long, line_count int"


def snapshot(spark, files, mtime=1):
    return spark.createDataFrame([(p, "python", c, hashlib.sha256(c.encode()).hexdigest(), len(c), mtime, c.count("\n") + 1) for p, c in files.items()], SCHEMA)


def content(store):
    return {t: sorted(map(str, store.read(t).collect())) for t in ("files", "symbols", "dependencies", "diagnostics")}


def test_incremental_equals_full(spark, tmp_path):
    one = {"a.py": "import os\nclass A: pass", "b.py": "def f(): pass", "c.py": "X = 1"}
    two = {"a.py": "import os\nclass A: pass", "b.py": "def g(): pass\ndef h(): pass", "d.py": "def ("}
    steps, whole = CatalogStore(spark, f"{tmp_path}/steps"), CatalogStore(spark, f"{tmp_path}/whole")
    assert ingest(steps, snapshot(spark, one)) == {"added": 3, "modified": 0, "deleted": 0, "unchanged": 0}
    assert ingest(steps, snapshot(spark, one, 2)) == {"added": 0, "modified": 0, "deleted": 0, "unchanged": 3}
    assert {r.mtime_ms for r in steps.read("files").collect()} == {2}
    assert ingest(steps, snapshot(spark, two, 3)) == {"added": 1, "modified": 1, "deleted": 1, "unchanged": 1}
    ingest(whole, snapshot(spark, two, 3))
    assert content(steps) == content(whole) and steps.version() == 3
    assert {r.path: r.status for r in steps.read("diagnostics").collect()}["d.py"] == "degraded"


def test_a_failed_write_leaves_the_version(spark, tmp_path):
    store = CatalogStore(spark, str(tmp_path))
    store.publish({"t": spark.range(3)})
    with pytest.raises(Exception, match="boom"):
        store.publish({"t": spark.range(5), "u": spark.sql("select raise_error('boom') as x")})
    assert store.version() == 1 and store.read("t").count() == 3 and store.tables() == {"t"}


def test_a_crash_before_the_pointer_moves_leaves_the_version(spark, tmp_path):
    store = CatalogStore(spark, str(tmp_path))
    store.publish({"t": spark.range(3)})

    class Crash:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def rename(self, *_):
            raise OSError("lost")

    broken = CatalogStore(spark, str(tmp_path))
    broken._fs = Crash(broken._fs)
    with pytest.raises(OSError, match="lost"):
        broken.publish({"t": spark.range(9)})
    assert store.version() == 1 and store.read("t").count() == 3
    assert store.publish({"u": spark.range(2)}) == 2 and store.tables() == {"t", "u"}


def test_of_two_writers_of_one_version_one_fails(spark, tmp_path):
    one, two = CatalogStore(spark, str(tmp_path)), CatalogStore(spark, str(tmp_path))
    before = two._pointer()
    one.publish({"t": spark.range(3)})
    two._pointer = lambda: before
    with pytest.raises(RuntimeError, match="another writer"):
        two.publish({"t": spark.range(4)})
    assert one.read("t").count() == 3


def test_upserts(spark):
    schema = "http_method string, route_uri string, name string"
    base = spark.createDataFrame([("GET", "/a", "old"), ("GET", "/b", "old")], schema)
    fresh = spark.createDataFrame([("GET", "/a", "x", 1), ("GET", "/a", "y", 2), ("PUT", "/a", "z", 1)], schema + ", seq int")
    assert {(r.http_method, r.route_uri): r.name for r in upsert_slices(base, fresh, "seq").collect()} == {("GET", "/a"): "y", ("GET", "/b"): "old", ("PUT", "/a"): "z"}
    rows = upsert_domain([], "Orders", "src/orders", ["billing"])
    rows = upsert_domain(rows, "orders", "src/o", None, ["x"])
    assert rows == [{"name": "orders", "root_path": "src/o", "allowed": ["billing"], "forbidden": ["x"]}]
    assert upsert_domain(rows, "ORDERS", "r", [])[0]["allowed"] == []
    with pytest.raises(ValueError, match="conflicting"):
        upsert_domain([{"name": "a", "root_path": "", "allowed": ["x"], "forbidden": []}, {"name": "A", "root_path": "", "allowed": ["y"], "forbidden": []}], "a", "")
