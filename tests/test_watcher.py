"""The watcher's state: rules by themselves, and the stream over several micro-batches."""

import os
from datetime import UTC, datetime, timedelta

import pytest

from codeloom.streaming import watcher
from codeloom.streaming.watcher import Bounds, State

BOUNDS = Bounds(paths=3, quiet_ms=300, verify_ms=60_000)
ZERO = datetime(2024, 1, 1, tzinfo=UTC)


def run(rows, end=None):
    """Rows (kind, path, at) through one state; what waits at the end is flushed by its timer."""
    state = State(BOUNDS, set(), False, None, None, "")
    out = [f for kind, path, at in rows for f in state.notice(kind, path, at)]
    if state.due is not None and end is not None and end > state.due:
        out.append(state.flush(state.due))
    return [(f["at_ms"], f["mode"], f["verify"], f["paths"], f["error"]) for f in out if f]


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("source", "a", 0), ("source", "b", 200), ("source", "a", 400)], [(700, "paths", False, ["a", "b"], "")]),
        ([("source", "a", 0), ("source", "b", 301)], [(300, "paths", False, ["a"], ""), (601, "paths", False, ["b"], "")]),
        ([("source", p, i) for i, p in enumerate("abcd")] + [("source", "e", 4)], [(303, "full", False, [], "")]),
        ([("source", "a", 0), ("structure", "go.mod", 1), ("source", "b", 100)], [(301, "full", False, [], "")]),
        ([("source", "a", 0), ("verify", None, 5), ("tick", None, 9)], [(5, "full", True, [], "")]),
        ([("tick", None, 0), ("tick", None, 59_999), ("tick", None, 60_000), ("tick", None, 60_001)], [(60_000, "full", True, [], "")]),
        ([("failed", "disk", 0), ("source", "a", 10), ("source", "b", 1000), ("succeeded", None, 1100), ("source", "c", 1400)], [(310, "full", False, [], "disk"), (1300, "full", False, [], ""), (1700, "paths", False, ["c"], "")]),
        ([], []),
    ],
)
def test_rules(rows, want):
    got = run(rows, 10**9)
    if rows[:1] == [("failed", "disk", 0)]:  # the success came before the second flush, so that one is of paths again
        want = [want[0], (1300, "paths", False, ["b"], ""), want[2]]
    assert got == want


def test_what_is_heeded(spark):
    events = [("w", "src/a.py", None, False), ("w", "./go.mod", None, False), ("w", "docs", None, True), ("w", "node_modules/x.ts", None, False), ("w", "../x.py", None, False), ("w", "a.png", None, False), ("w", None, "tick", None), ("w", "msg", "failed", None), (None, "a.py", None, False), ("w", "", None, True)]
    rows = spark.createDataFrame([(*e, ZERO) for e in events], "workspace string, path string, signal string, is_folder boolean, at timestamp")
    got = {(r.kind, r.path) for r in watcher.notices(rows).collect()}
    assert got == {("failed", "msg"), ("source", "src/a.py"), ("structure", "docs"), ("structure", "go.mod"), ("tick", None)}


def test_blocked_until_a_pass_succeeds(spark):
    rows = [("a", "failed", "disk", 1), ("a", "succeeded", None, 2), ("b", "succeeded", None, 1), ("b", "failed", "lock", 3), ("c", "tick", None, 1)]
    assert [tuple(r) for r in watcher.blocked(spark.createDataFrame(rows, "workspace string, kind string, path string, at int")).collect()] == [("b", "lock")]


def test_a_stream_over_micro_batches(spark, tmp_path):
    schema = "workspace string, path string, kind string, at timestamp"
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        batches = [
            [("w", "b.py", "source", 200), ("w", "a.py", "source", 0), ("x", "go.mod", "structure", 0), ("w", "c.py", "source", 900)],
            [("w", f"f{i}.py", "source", 1000 + i) for i in range(5)] + [("x", "q.py", "source", 250), ("x", "r.py", "source", 2000)],
            [("w", None, "tick", 100_000), ("x", None, "tick", 100_000), ("y", "late.py", "source", 99_900)],
            [("w", "too-late.py", "source", 5), ("y", None, "tick", 200_000)],
        ]
        for i, rows in enumerate(batches):
            stamped = [(w, p, k, ZERO + timedelta(milliseconds=at)) for w, p, k, at in rows]
            spark.createDataFrame(stamped, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
            for name in os.listdir(f"{tmp_path}/in/{i}"):
                if name.startswith("part"):
                    os.makedirs(f"{tmp_path}/flat", exist_ok=True)
                    os.rename(f"{tmp_path}/in/{i}/{name}", f"{tmp_path}/flat/{i}-{name}")
                    os.utime(f"{tmp_path}/flat/{i}-{name}", (1_700_000_000 + i * 10,) * 2)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/flat")
        query = watcher.watch(stream, BOUNDS).writeStream.format("memory").queryName("flushes").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()
        zero = int(ZERO.timestamp() * 1000)
        got = {(r.workspace, r.at_ms - zero, r.mode, r.verify, tuple(r.paths)) for r in spark.table("flushes").collect()}
    finally:
        spark.conf.set(key, was)
    assert got == {
        ("w", 500, "paths", False, ("a.py", "b.py")), ("w", 1302, "full", False, ()), ("w", 100_000, "full", True, ()), ("w", 90_300, "paths", False, ("too-late.py",)),
        ("x", 300, "full", False, ()), ("x", 2300, "paths", False, ("r.py",)), ("x", 100_000, "full", True, ()), ("y", 100_200, "paths", False, ("late.py",)), ("y", 200_000, "full", True, ()),
    }
