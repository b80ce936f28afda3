"""The catalog's tables as versioned Parquet folders behind one pointer.

A version is written whole beside the last and becomes current by renaming one
small file, so readers see all tables of a version or none, and a job that dies
leaves the current version as it was. A table that did not change is carried by
reference: the pointer names a path for each table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.operators.catalog import replace_rows, snapshot_diff
from codeloom.sources.extract import dependencies_of, extract, symbols_of

SCHEMA_VERSION = 1
#: Part of every file's change key: a new extractor reads all files again.
PARSER_REVISION = 1
POINTER = "_VERSION-"


class CatalogStore:
    """Tables by name under one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _newest(self):
        """The pointer of the highest number, or none."""
        if not self._fs.exists(self._path(self.root)):
            return None
        found = [f.getPath() for f in self._fs.listStatus(self._path(self.root)) if f.getPath().getName().startswith(POINTER)]
        return max(found, key=lambda p: int(p.getName().removeprefix(POINTER)), default=None)

    def _pointer(self) -> dict:
        at = self._newest()
        if at is None:
            return {"schema": SCHEMA_VERSION, "version": 0, "tables": {}}
        stream = self._fs.open(at)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = json.loads(text)
        return found if found["schema"] == SCHEMA_VERSION else {"schema": SCHEMA_VERSION, "version": found["version"], "tables": {}}

    def version(self) -> int:
        """The current version; 0 before the first."""
        return self._pointer()["version"]

    def tables(self) -> set[str]:
        """Names of the current tables; none when they were written under another schema."""
        return set(self._pointer()["tables"])

    def _read(self, place: str | dict[str, str]) -> DataFrame:
        """A table at its place, or at the places of its buckets."""
        if isinstance(place, str):
            return self.spark.read.parquet(f"{self.root}/{place}")
        return self.spark.read.parquet(*[f"{self.root}/{p}" for p in sorted(set(place.values()))])

    def read(self, name: str) -> DataFrame:
        """A table of the current version."""
        return self._read(self._pointer()["tables"][name])

    def marks(self) -> dict[str, str]:
        """Values kept with the current version."""
        return self._pointer().get("marks", {})

    def last(self, stream: str) -> int:
        """The last batch of a stream that was committed, else -1."""
        return self._pointer().get("batches", {}).get(stream, -1)

    def committed(self, batch: tuple[str, int]) -> bool:
        """Whether a batch (stream, number) is part of the current version."""
        return batch[1] <= self.last(batch[0])

    def publish(self, tables: dict[str, DataFrame], marks: dict[str, str | None] | None = None) -> int:
        """Write the given tables and make them, with all others as they are, the next version."""
        now = self._pointer()
        folder = f"v{now['version'] + 1}-{uuid.uuid4().hex[:8]}"
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{folder}/{name}")
        return self._commit(now, {name: f"{folder}/{name}" for name in tables}, marks)

    def replace_buckets(self, tables: dict[str, tuple[DataFrame, str, DataFrame]], buckets: list[int], bucket_of: Callable[[Column], Column], batch: tuple[str, int], marks: dict[str, str | None] | None = None) -> int:
        """The next version: of each table (fresh rows, key, touched paths) the given buckets are written anew, without the rows of touched paths.

        A table that is not in buckets yet is dealt whole.
        """
        now = self._pointer()
        folder = f"v{now['version'] + 1}-{uuid.uuid4().hex[:8]}"
        places = {}
        for name, (fresh, key, touched) in tables.items():
            place = now["tables"].get(name, {})
            whole = isinstance(place, str)
            held = {} if whole else dict(place)
            parts = [held[str(b)] for b in buckets if str(b) in held]
            rows = fresh
            if whole or parts:
                old = self._read(place if whole else dict(enumerate(parts)))
                rows = old.join(touched.select(F.col("path").alias(key)), key, "left_anti").unionByName(fresh)
            at = f"{folder}/{name}"
            dealt = rows.withColumn("__bucket", bucket_of(F.col(key)))
            # A bucket is one file a task; an empty one has none.
            dealt.repartition(max(len(buckets), 1), "__bucket").write.partitionBy("__bucket").parquet(f"{self.root}/{at}")
            made = {f.getPath().getName().split("=")[1] for f in self._fs.listStatus(self._path(f"{self.root}/{at}")) if "=" in f.getPath().getName()}
            held = {b: p for b, p in held.items() if int(b) not in buckets} | {b: f"{at}/__bucket={b}" for b in made}
            if not held:
                rows.limit(0).write.parquet(f"{self.root}/{at}/none")
                held = {"none": f"{at}/none"}
            elif "none" in held and len(held) > 1:
                del held["none"]
            places[name] = held
        return self._commit(now, places, marks, batch)

    def _commit(self, now: dict, tables: dict, marks: dict[str, str | None] | None, batch: tuple[str, int] | None = None) -> int:
        """Make the tables' new places, the marks and the batch's number the next version."""
        version = now["version"] + 1
        kept = {k: v for k, v in (now.get("marks", {}) | (marks or {})).items() if v is not None}
        batches = now.get("batches", {}) | ({batch[0]: batch[1]} if batch else {})
        fresh = self._path(f"{self.root}/_NEXT-{uuid.uuid4().hex}")
        out = self._fs.create(fresh, True)
        out.write(bytearray(json.dumps({"schema": SCHEMA_VERSION, "version": version, "tables": now["tables"] | tables, "marks": kept, "batches": batches}).encode()))
        out.close()
        # Pointers are numbered and never replaced: until the rename, readers have the version before; of two writers one fails.
        next_ = self._path(f"{self.root}/{POINTER}{version}")
        if self._fs.exists(next_) or not self._fs.rename(fresh, next_):
            self._fs.delete(fresh, False)
            raise RuntimeError(f"another writer published version {version}")
        return version


def ingest(store: CatalogStore, files: DataFrame) -> dict[str, int]:
    """Bring the catalog to a snapshot of files (path, language, content, content_hash, size_bytes, mtime_ms, line_count).

    Only added and modified files are read by the extractors; rows of modified
    and deleted files leave every dependent table; a file whose content is the
    same keeps its rows and takes the new times. Returns the counts of each
    status. Ingesting the same files in one step or several gives equal tables.
    """
    meta = ["path", "language", "content_hash", "size_bytes", "mtime_ms", "line_count"]
    keyed = files.withColumn("content_hash", F.concat("content_hash", F.lit(f":{PARSER_REVISION}")))
    first = "files" not in store.tables()
    old = keyed.select(*meta).limit(0) if first else store.read("files").select(*meta)
    diff = snapshot_diff(old, keyed, "path", "content_hash").cache()
    counts = {s: 0 for s in ("added", "modified", "deleted", "unchanged")} | {r["status"]: r["count"] for r in diff.groupBy("status").count().collect()}
    changed = keyed.join(diff.filter("status in ('added', 'modified')").select("path"), "path", "left_semi")
    read = extract(changed).cache()
    tables = {"files": keyed.select(*meta)}
    gone = diff.filter("status in ('modified', 'deleted')").select("path")
    for name, fresh, key in (("symbols", symbols_of(read), "path"), ("dependencies", dependencies_of(read), "source"), ("diagnostics", read.select("path", "language", "status", "diagnostic"), "path")):
        kept = fresh.limit(0) if first else store.read(name).join(gone.withColumnRenamed("path", key), key, "left_anti")
        tables[name] = kept.unionByName(fresh)
    if counts["added"] or counts["modified"] or counts["deleted"] or first:
        store.publish(tables)
    else:
        store.publish({"files": tables["files"]})
    read.unpersist()
    diff.unpersist()
    return counts


def upsert_slices(base: DataFrame, fresh: DataFrame, seq: str) -> DataFrame:
    """Slices by (http_method, route_uri): the last of the fresh ones by ``seq`` replaces what was there."""
    keys = ["http_method", "route_uri"]
    rank = Window.partitionBy(*keys).orderBy(F.desc(seq))
    last = fresh.withColumn("__k", F.row_number().over(rank)).filter("__k = 1").drop("__k", seq)
    return base.join(last.select(*keys), keys, "left_anti").unionByName(last)


def upsert_domain(domains: list[dict], name: str, root: str, allowed: list[str] | None = None, forbidden: list[str] | None = None) -> list[dict]:
    """A list of domains with one added or changed; names are equal without case, None keeps a list and [] clears it.

    Raises when case variants of the name have policies that conflict.
    """
    same = [d for d in domains if d["name"].lower() == name.lower()]
    for field in ("allowed", "forbidden"):
        if len({tuple(sorted(d[field])) for d in same if d[field]}) > 1:
            raise ValueError(f"conflicting {field} lists for {name}")
    old = {f: next((d[f] for d in same if d[f]), []) for f in ("allowed", "forbidden")}
    new = {"name": name, "root_path": root, "allowed": old["allowed"] if allowed is None else allowed, "forbidden": old["forbidden"] if forbidden is None else forbidden}
    return sorted([d for d in domains if d not in same] + [new], key=lambda d: d["name"].lower())


def replace_file_rows(base: DataFrame, fresh: DataFrame) -> DataFrame:
    """A table with the rows of the files in ``fresh`` replaced as a unit."""
    return replace_rows(base, fresh, "path")
