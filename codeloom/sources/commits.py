"""Bounded commits: changes packed into batches, each applied once, and what must be computed again afterwards.

A batch is a commit of the store. Its number is written in the pointer with the
tables, so a batch that a dead job repeats is known and skipped. Tables lie in
buckets of paths, and a commit rewrites the buckets that its files touch; all
others are carried by reference.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.catalog import snapshot_diff
from codeloom.plans.shared import materialize
from codeloom.sources.extract import dependencies_of, extract, symbols_of
from codeloom.sources.store import PARSER_REVISION, CatalogStore

META = ("path", "language", "content_hash", "size_bytes", "mtime_ms", "line_count")
#: Tables by the column that names their file.
KEYS = {"files": "path", "symbols": "path", "dependencies": "source", "diagnostics": "path"}
#: Buckets of paths, and changed files that one lane of batches holds about.
BUCKETS, LANE_FILES = 64, 10_000
#: What makes slices stale besides changed and removed files.
FINGERPRINTS = ("extractor", "inventory", "inputs", "rules")


class SourceChanged(RuntimeError):
    """A file is no longer what was read."""


@dataclass(frozen=True)
class Limits:
    """A batch ends with the file that brings it to either."""

    files: int = 50
    bytes: int = 1 << 20


def bucket_of(path: Column) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


def packed(changes: DataFrame, limits: Limits = Limits(), lanes: int = 1, lane: Column | None = None) -> DataFrame:
    """``changes`` (path, size_bytes) with ``batch``, from 0 and without gaps, in the order of paths within a lane.

    A batch has at most ``limits.files`` files and, without its last one, fewer
    than ``limits.bytes`` bytes; a file of more is alone or ends a batch. Lanes
    are dealt by a hash of the path (or by ``lane``), so no running sum goes over
    all changes; only the batches themselves, a row each, are numbered in one
    task. Null sizes count as 0.
    """
    order = Window.partitionBy("lane").orderBy("path")
    before = F.coalesce(F.sum(F.coalesce("size_bytes", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = changes.withColumn("lane", F.pmod(F.xxhash64("path"), F.lit(lanes)) if lane is None else lane).withColumn("part", F.floor(before / limits.bytes))
    rows = rows.withColumn("slice", F.floor((F.row_number().over(Window.partitionBy("lane", "part").orderBy("path")) - 1) / limits.files))
    # One row a batch.
    numbers = rows.select("lane", "part", "slice").distinct().withColumn("batch", F.row_number().over(Window.orderBy("lane", "part", "slice")) - 1)
    return rows.join(numbers, ["lane", "part", "slice"]).drop("lane", "part", "slice")


def verify(read: DataFrame, now: DataFrame) -> None:
    """Raise when a file of ``read`` (path, content_hash) is not the same in ``now``; a file that is gone is not the same."""
    was = read.select("path", F.col("content_hash").alias("was"))
    other = was.join(now.select("path", F.col("content_hash").alias("is")), "path", "left").filter(~F.col("was").eqNullSafe(F.col("is"))).select("path").limit(1).collect()
    if other:
        raise SourceChanged(f"source changed during synchronization: {other[0].path}")


def apply_batch(store: CatalogStore, changed: DataFrame, gone: DataFrame, batch: tuple[str, int], now: Callable[[], DataFrame] | None = None) -> bool:
    """Commit ``changed`` files (path, language, content and the columns of ``META``) and the paths of ``gone``; false when the batch was committed before.

    ``now`` gives (path, content_hash) of the sources as they are just before
    the commit; a difference raises :class:`SourceChanged` and commits nothing.
    """
    if store.committed(batch):
        return False
    # Written once: a lost executor reads it again and extracts nothing twice.
    rows = materialize(changed.select(*META, "content"), "batch-files")
    read = materialize(extract(rows), "batch-read")
    touched = materialize(rows.select("path").unionByName(gone.select("path")).distinct(), "batch-touched")
    if now is not None:
        verify(rows, now())
    fresh = {"files": rows.select(*META), "symbols": symbols_of(read), "dependencies": dependencies_of(read), "diagnostics": read.select("path", "language", "status", "diagnostic")}
    buckets = sorted(r.bucket for r in touched.select(bucket_of(F.col("path")).alias("bucket")).distinct().collect())  # at most BUCKETS
    store.replace_buckets({name: (fresh[name], key, touched) for name, key in KEYS.items()}, buckets, bucket_of, batch, {"slices_dirty": "1"})
    return True


def synchronise(store: CatalogStore, snapshot: Callable[[], DataFrame], limits: Limits = Limits(), name: str = "sync") -> dict[str, int]:
    """Bring the catalog to what ``snapshot`` reads, batch by batch; a source that changes meanwhile is read once more, then given up.

    Returns the counts of the statuses and of ``batches``. A run that died goes
    on where it stopped, since committed files are no changes any more.
    """
    for attempt in (0, 1):
        try:
            return _synchronise(store, snapshot, limits, name)
        except SourceChanged:
            if attempt:
                raise
    raise AssertionError


def _synchronise(store: CatalogStore, snapshot: Callable[[], DataFrame], limits: Limits, name: str) -> dict[str, int]:
    def keyed() -> DataFrame:
        return snapshot().withColumn("content_hash", F.concat("content_hash", F.lit(f":{PARSER_REVISION}")))

    files = materialize(keyed(), "snapshot")
    old = store.read("files").select(*META) if "files" in store.tables() else files.select(*META).limit(0)
    diff = materialize(snapshot_diff(old, files, "path", "content_hash"), "diff")
    counts = {s: 0 for s in ("added", "modified", "deleted", "unchanged")} | {r["status"]: r["count"] for r in diff.groupBy("status").count().collect()}
    todo = diff.filter("status <> 'unchanged'").join(files.select("path", "size_bytes"), "path", "left")
    total = counts["added"] + counts["modified"] + counts["deleted"]
    dealt = materialize(packed(todo, limits, -(-total // LANE_FILES) or 1), "batches")
    first, n = store.last(name) + 1, (dealt.agg(F.max("batch")).first()[0] or 0) + 1 if total else 0
    for i in range(n):
        own = dealt.filter(F.col("batch") == i)
        changed = files.join(own.filter("status <> 'deleted'").select("path"), "path", "left_semi")
        apply_batch(store, changed, own.filter("status = 'deleted'").select("path"), (name, first + i), lambda: keyed().select("path", "content_hash"))
    return counts | {"batches": n}


def stream_sink(store: CatalogStore, name: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: changes (the columns of files, and ``op``, where ``delete`` removes) committed once under the stream's name.

    Of several changes of a path in a batch the last by mtime counts. A batch
    that the stream repeats after a failure finds its number in the pointer.
    """

    def apply(batch: DataFrame, number: int) -> None:
        last = materialize(batch.withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("mtime_ms"), F.desc("content_hash")))).filter("k = 1").drop("k"), "stream")
        changed = last.filter("op <> 'delete'").withColumn("content_hash", F.concat("content_hash", F.lit(f":{PARSER_REVISION}")))
        apply_batch(store, changed, last.filter("op = 'delete'").select("path"), (name, number))

    return apply


def fingerprint(rows: DataFrame, *columns: str) -> str:
    """A digest of a table's rows, whatever their order: their number and the sum of their hashes, from one aggregation."""
    row = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("s")).first()
    return f"{row.n}:{row.s or 0}"


def stale(store: CatalogStore, now: dict[str, str], updated: int = 0, removed: int = 0) -> list[str]:
    """Why slices must be computed again: any changed fingerprint of :data:`FINGERPRINTS`, ``updated`` or ``removed`` files, or the dirty mark."""
    marks = store.marks()
    why = [f for f in FINGERPRINTS if marks.get(f"slices_{f}") != now.get(f)]
    return why + ["updated"] * (updated > 0) + ["removed"] * (removed > 0) + ["dirty"] * (marks.get("slices_dirty") == "1")


def refresh_slices(store: CatalogStore, now: dict[str, str], compute: Callable[[], DataFrame], updated: int = 0, removed: int = 0) -> bool:
    """Compute and publish ``slices`` when they are stale, with the fingerprints they were computed under; false when they are kept.

    The dirty mark goes in the same commit, so a job that dies before it leaves
    the slices to be computed again.
    """
    if not stale(store, now, updated, removed):
        return False
    store.publish({"slices": compute()}, marks={f"slices_{f}": now.get(f) for f in FINGERPRINTS} | {"slices_dirty": ""})
    return True
