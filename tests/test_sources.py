"""Workspace scan, manifests and the streaming feed."""

from datetime import datetime

from pyspark.sql import functions as F

from codeloom.functions.lines import brace_depths, explode_lines, page
from codeloom.sources import workspace
from codeloom.streaming import feed


def test_scan(spark, tmp_path):
    files = {"src/a.py": "x = 1\n", "src/b.ts": "let x;", "node_modules/c.js": "", ".git/d.py": "", "docs/readme.md": "", "gen/e.go": "package e"}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    (tmp_path / "src/huge.py").write_bytes(b"x" * (workspace.MAX_BYTES + 1))
    out = {r.path: r for r in workspace.scan(spark, str(tmp_path), ("gen/**",)).collect()}
    assert set(out) == {"src/a.py", "src/b.ts", "src/huge.py"}
    assert (out["src/a.py"].language, out["src/a.py"].line_count, out["src/a.py"].content) == ("python", 2, "x = 1\n")
    assert out["src/huge.py"].skipped == "file_too_large" and out["src/huge.py"].content is None


def test_manifests():
    assert workspace.parse_env("# c\nA=1\nexport B = 'x y'\nbad\n") == {"A": "1", "B": "x y"}
    assert workspace.parse_json_with_comments('{"a": "//x", /* c */ "b": [1, 2,], // d\n}') == {"a": "//x", "b": [1, 2]}
    assert workspace.parse_go_mod("module m.io/a\n\nrequire x.io/b v1\nrequire (\n  y.io/c v2 // d\n)\n") == ("m.io/a", ["x.io/b", "y.io/c"])


def test_lines(spark):
    files = spark.createDataFrame([("a", "f() {\n  { x }\n}\n")], "path string, content string")
    out = brace_depths(explode_lines(files, "path"), "path").orderBy("line_number").collect()
    assert [(r.line_number, r.depth) for r in out] == [(1, 1), (2, 1), (3, 0), (4, 0)]
    rows = page(spark.createDataFrame([("s", 1, 300), ("t", 5, 9)], "name string, line_start int, line_end int"), 500).collect()
    assert [(r.page_end, r.next_start_line) for r in rows] == [(200, 201), (9, None)]


def test_feed(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    rows = [(1, at(0), "a", "modify"), (2, at(1), "a", "delete"), (3, at(30), "a", "create"), (4, at(2), "b", "modify")]
    changes = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, path string, op string")
    assert {r.path: (r.op, r.n) for r in feed.coalesced(changes, "path", ["ts", "event_id"]).collect()} == {"a": ("create", 3), "b": ("modify", 1)}
    assert sorted((r.path, r.session, r.n) for r in feed.sessions(changes, "path", "ts", 10).collect()) == [("a", 1, 2), ("a", 2, 1), ("b", 1, 1)]
    source = str(tmp_path / "in")
    changes.write.parquet(source)
    stream = spark.readStream.schema(changes.schema).parquet(source)
    for name, frame in (("dd", feed.distinct_changes(stream, "path", "ts")), ("db", feed.debounced(stream, "path", "ts", "10 seconds"))):
        job = frame.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c{name}")).outputMode("append").trigger(availableNow=True).start()
        job.awaitTermination(120)
    assert spark.table("dd").select(F.countDistinct("path")).first()[0] == 2
    assert spark.table("db").columns == ["window", "path", "n"]
