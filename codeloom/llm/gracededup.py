"""Exact duplicates by Grace hashing.

1. Each task keeps the distinct texts it meets in an open-addressing table and
   writes them as *classes*: a text once, with its hash, its number of rows and
   its ids in short lists. A text with a third of all rows is one class a task.
2. Buckets are prefixes of the hash. A bucket whose contents exceed
   ``bucket_bytes`` is divided by further bits of the hash, again and again,
   until each fits or holds one text alone. Sizes are known from the classes
   before any text moves, so each text is spilled once, to its final bucket.
3. A task takes a bucket at a time into an open-addressing table, which compares
   complete contents: equal hashes of different texts stay apart.
4. The groups come back to the lists of ids by the class, not by the text.

Memory is bounded by ``TASK_BYTES`` in the first step and by ``bucket_bytes``,
or one text, in the third. A text reaches its bucket at most once from each
task of the first step, as a stream.

Cases: a null text is an empty one; texts are compared as bytes without any
change; of equal texts the row with the largest id stays, a null id only when
the group has no other; of repeated rows with that id exactly one stays; an
empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm._tables import bound_batches, table
from codeloom.plans.shared import materialize

#: Bytes of distinct text that a bucket may hold, and that a task holds before it writes its classes.
BUCKET_BYTES = TASK_BYTES = 1 << 25
#: Bytes that a task reads from its buckets, one after the other.
PARTITION_BYTES = 1 << 29
#: Ids in one list, and ids that a task holds before it writes.
LIST_IDS, TASK_IDS = 256, 1 << 20
#: Bits of the hash that divide a bucket which does not fit.
SPLIT_BITS = 4

CLASSES = "class bigint, hash bigint, size bigint, n bigint, last bigint, ids array<bigint>, text binary"
GROUPS = "class bigint, keeper boolean, keep_id bigint, group_size bigint, sha256 binary"


class Table:
    """Distinct texts by open addressing with linear probing; an entry's number is its order of arrival."""

    def __init__(self) -> None:
        self.slots, self.hashes, self.texts, self.size = [-1] * 64, [], [], 0

    def place(self, hashed: int, text: bytes) -> int:
        """The number of the text's entry, which is new when no entry has the same content."""
        mask = len(self.slots) - 1
        at = hashed & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == hashed and self.texts[entry] == text:
                return entry
            at = (at + 1) & mask
        self.slots[at] = entry = len(self.texts)
        self.hashes.append(hashed)
        self.texts.append(text)
        self.size += len(text)
        if 2 * len(self.texts) > mask:
            self._grow()
        return entry

    def _grow(self) -> None:
        mask = 4 * len(self.slots) - 1
        self.slots = [-1] * (mask + 1)
        for entry, hashed in enumerate(self.hashes):
            at = hashed & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


def _class_rows(found: Table, firsts: list[int], ids: list[list[int | None]], many: int) -> Iterator[pa.RecordBatch]:
    """The classes of a task, in batches; a long list of ids goes on in rows without a text."""
    types = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.binary()]
    names = [c.split()[0] for c in CLASSES.split(", ")]
    rows, size = [], 0
    for entry, own in enumerate(ids):
        last = max((i for i in own if i is not None), default=None)
        others = own.copy()
        others.remove(last)
        text = found.texts[entry]
        rows.append((firsts[entry], found.hashes[entry], len(text), len(own), last, others[:many], text))
        rows += [(firsts[entry], None, None, None, None, others[at : at + many], None) for at in range(many, len(others), many)]
        size += len(text) + 100
        if size > TASK_BYTES // 8:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def local_classes(docs: DataFrame, hashed: Column) -> DataFrame:
    """``CLASSES`` of (doc_id, text): the distinct texts of each task. A class is named by the number of its first row."""
    many, most = LIST_IDS, TASK_IDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, firsts, ids, held = Table(), [], [], 0
        for batch in batches:
            for row, doc_id, own, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                entry = found.place(own, text)
                if entry == len(ids):
                    firsts.append(row)
                    ids.append([])
                ids[entry].append(doc_id)
            held += batch.num_rows
            if found.size > TASK_BYTES or held > most:
                yield from _class_rows(found, firsts, ids, many)
                found, firsts, ids, held = Table(), [], [], 0
        yield from _class_rows(found, firsts, ids, many)

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return own.select(F.monotonically_increasing_id().alias("row"), "doc_id", hashed.alias("hash"), "text").mapInArrow(run, CLASSES)


def _prefix(depth: Column) -> Column:
    """The leading bits of the hash, so many as the bucket's depth."""
    return F.when(depth == 0, F.lit(0).cast("bigint")).otherwise(F.expr("shiftrightunsigned(hash, 64 - depth)"))


def with_buckets(classes: DataFrame, bucket_bytes: int) -> DataFrame:
    """``classes`` that carry a text, with (depth, prefix) of a bucket that fits."""
    owners = classes.filter("hash is not null")
    contents = materialize(owners.select("hash", "size").distinct(), "grace-sizes")
    total = contents.agg(F.sum("size")).first()[0] or 0
    start = min(max(-(-total // max(bucket_bytes, 1)) - 1, 0).bit_length(), 32)

    def dealt(rows: DataFrame, divided: list[DataFrame]) -> DataFrame:
        rows = rows.withColumn("depth", F.lit(start)).withColumn("prefix", _prefix(F.col("depth")))
        for split in divided:
            rows = rows.join(split, ["depth", "prefix"], "left").withColumn("depth", F.when(F.col("divided"), F.least(F.col("depth") + SPLIT_BITS, F.lit(64))).otherwise(F.col("depth"))).drop("divided").withColumn("prefix", _prefix(F.col("depth")))
        return rows

    divided: list[DataFrame] = []
    while True:
        sizes = dealt(contents, divided).groupBy("depth", "prefix").agg(F.sum("size").alias("bytes"), F.count_distinct("hash").alias("n"))
        # One row a bucket that does not fit; Spark broadcasts the table by its size, or shuffles.
        large = materialize(sizes.filter((F.col("bytes") > bucket_bytes) & (F.col("n") > 1) & (F.col("depth") < 64)).select("depth", "prefix", F.lit(True).alias("divided")), "grace-split")
        if large.isEmpty():
            return dealt(owners, divided), total
        divided.append(large)


def merge_buckets(owners: DataFrame, parts: int) -> DataFrame:
    """``GROUPS``: each class with what its group came to; one bucket at a time is in memory."""

    def flush(found: Table, members: list[list[tuple[int, int, int | None]]]) -> Iterator[pa.RecordBatch]:
        rows = []
        for entry, own in enumerate(members):
            kept = max((x[2] for x in own if x[2] is not None), default=None)
            keeper = min(c for c, _, last in own if last == kept)
            size, digest = sum(n for _, n, _ in own), hashlib.sha256(found.texts[entry]).digest()
            rows += [(c, c == keeper, kept, size, digest) for c, _, _ in own]
        for at in range(0, len(rows), 1 << 14):
            columns = zip(*rows[at : at + (1 << 14)], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()], strict=True)], [c.split()[0] for c in GROUPS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, found, members = None, Table(), []
        for batch in batches:
            for depth, prefix, own, hashed, n, last, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (depth, prefix) != bucket:
                    yield from flush(found, members)
                    bucket, found, members = (depth, prefix), Table(), []
                entry = found.place(hashed, text)
                if entry == len(members):
                    members.append([])
                members[entry].append((own, n, last))
        yield from flush(found, members)

    dealt = owners.select("depth", "prefix", "class", "hash", "n", "last", "text").repartition(parts, "depth", "prefix").sortWithinPartitions("depth", "prefix")
    return dealt.mapInArrow(run, GROUPS)


def exact_groups(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, hashed: Column | None = None) -> DataFrame:
    """A row for each row of (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    bound_batches(spark)
    classes = materialize(local_classes(docs, F.xxhash64("text") if hashed is None else hashed), "grace-classes")
    owners, total = with_buckets(classes, bucket_bytes)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_BYTES))
    groups = materialize(merge_buckets(owners, parts), "grace-groups")
    rows = classes.select("class", F.col("hash").isNotNull().alias("first"), "last", "ids").join(groups, "class")
    others = F.transform("ids", lambda i: F.struct(i.alias("doc_id"), F.lit(False).alias("kept")))
    own = F.array(F.struct(F.col("last").alias("doc_id"), F.col("keeper").alias("kept")))
    return rows.select(F.explode(F.when(F.col("first"), F.concat(own, others)).otherwise(others)).alias("row"), "keep_id", "group_size", "sha256").select(
        "row.doc_id", "keep_id", "group_size", "row.kept", F.lower(F.hex("sha256")).alias("text_sha256")
    )


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its group."""
    return exact_groups(table(spark, sf_dir, "documents", "doc_id", "text"))


OP11_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW g AS (PARTITION BY t)
"""
