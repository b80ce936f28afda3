"""Batches, commits that repeat or die, sources that change meanwhile, and stale slices."""

import random

import pytest
from pyspark.sql import functions as F
from tests.test_store import content, snapshot

from codeloom.sources import commits
from codeloom.sources.commits import Limits, SourceChanged, refresh_slices, stale, synchronise
from codeloom.sources.store import CatalogStore, ingest


def test_batches_keep_their_limits(spark):
    rnd = random.Random(1)
    rows = [(f"f{i:03}", rnd.choice([0, 10, 40, 90, 250, None])) for i in range(300)]
    changes = spark.createDataFrame(rows, "path string, size_bytes long")
    for lanes in (1, 4):
        got = {}
        for r in commits.packed(changes, Limits(7, 200), lanes).orderBy("path").collect():
            got.setdefault(r.batch, []).append(r.size_bytes or 0)
        assert sorted(got) == list(range(len(got))) and sum(map(len, got.values())) == 300
        assert all(len(b) <= 7 and sum(b[:-1]) < 200 for b in got.values())
        assert len(got) < 120
    assert commits.packed(changes.limit(0)).collect() == []


ONE = {f"{c}.py": f"import os\nclass {c.upper()}: pass" for c in "abcdefg"}
TWO = {k: v for k, v in ONE.items() if k not in ("a.py", "b.py")} | {"c.py": "def g(): pass", "h.py": "X = 1"}


def test_batches_come_to_what_one_step_gives(spark, tmp_path):
    steps, whole = CatalogStore(spark, f"{tmp_path}/steps"), CatalogStore(spark, f"{tmp_path}/whole")
    assert synchronise(steps, lambda: snapshot(spark, ONE), Limits(files=4))["batches"] == 2
    assert synchronise(steps, lambda: snapshot(spark, ONE), Limits(files=4)) == {"added": 0, "modified": 0, "deleted": 0, "unchanged": 7, "batches": 0}
    before = steps._pointer()["tables"]["files"]
    counts = synchronise(steps, lambda: snapshot(spark, TWO), Limits(files=9))
    assert (counts["added"], counts["modified"], counts["deleted"], counts["batches"]) == (1, 1, 2, 1)
    ingest(whole, snapshot(spark, TWO))
    assert content(steps) == content(whole)
    after = steps._pointer()["tables"]["files"]
    assert any(after.get(b) == p for b, p in before.items())  # untouched buckets are carried


def test_a_batch_that_dies_is_repeated_once(spark, tmp_path, monkeypatch):
    store = CatalogStore(spark, f"{tmp_path}/s")
    real, calls = CatalogStore._commit, []

    def die(self, *args):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("lost")
        return real(self, *args)

    monkeypatch.setattr(CatalogStore, "_commit", die)
    with pytest.raises(OSError, match="lost"):
        synchronise(store, lambda: snapshot(spark, ONE), Limits(files=4))
    assert store.read("files").count() == 4 and store.last("sync") == 0
    assert synchronise(store, lambda: snapshot(spark, ONE), Limits(files=4))["added"] == 3
    assert store.read("files").count() == 7 and store.last("sync") == 1


def test_a_stream_repeats_a_batch_without_a_second_row(spark, tmp_path):
    store = CatalogStore(spark, f"{tmp_path}/s")
    sink = commits.stream_sink(store, "feed")
    changes = snapshot(spark, ONE).withColumn("op", F.lit("modify"))
    for number in (0, 0):
        sink(changes.unionByName(changes), number)
    assert store.version() == 1 and store.read("files").count() == 7 and store.read("symbols").count() == 7
    sink(changes.filter("path = 'a.py'").withColumn("op", F.lit("delete")), 1)
    assert store.read("files").count() == 6 and "a.py" not in {r.path for r in store.read("symbols").collect()}


def test_a_source_that_changes_is_read_once_more(spark, tmp_path):
    store = CatalogStore(spark, f"{tmp_path}/s")
    states = [ONE, ONE | {"a.py": "changed = 1"}, TWO, TWO]
    counts = synchronise(store, lambda: snapshot(spark, states.pop(0) if len(states) > 1 else states[0]))
    assert counts["added"] == 6 and {r.path for r in store.read("files").collect()} == set(TWO)
    n = [0]

    def restless():
        n[0] += 1
        return snapshot(spark, TWO | {"c.py": f"x = {n[0]}"})

    version = store.version()
    with pytest.raises(SourceChanged, match=r"c\.py"):
        synchronise(store, restless)
    assert store.version() == version and n[0] == 4


def test_slices_are_computed_again_only_when_stale(spark, tmp_path):
    store = CatalogStore(spark, f"{tmp_path}/s")
    rows = spark.createDataFrame([("GET", "/a"), ("PUT", "/b")], "http_method string, route_uri string")
    prints = {"extractor": "3", "inventory": commits.fingerprint(rows, "route_uri"), "inputs": "i", "rules": "r"}
    assert commits.fingerprint(rows.orderBy(F.desc("route_uri")), "route_uri") == prints["inventory"] != commits.fingerprint(rows.limit(1), "route_uri")
    assert refresh_slices(store, prints, lambda: rows) and store.read("slices").count() == 2
    assert not refresh_slices(store, prints, lambda: rows.limit(0)) and stale(store, prints, 0, 0) == []
    assert stale(store, prints, 1, 0) == ["updated"] and stale(store, prints, 0, 2) == ["removed"]
    for name in commits.FINGERPRINTS:
        assert stale(store, prints | {name: "other"}) == [name]
    synchronise(store, lambda: snapshot(spark, ONE))
    assert stale(store, prints) == ["dirty"]
    with pytest.raises(Exception, match="boom"):
        refresh_slices(store, prints, lambda: spark.sql("select raise_error('boom') as x"))
    assert stale(store, prints) == ["dirty"]
    assert refresh_slices(store, prints, lambda: rows.limit(1)) and stale(store, prints) == [] and store.read("slices").count() == 1
