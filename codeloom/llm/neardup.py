"""Exact Jaccard similarity join of word shingles, with adaptive multi-match prefixes.

Texts with equal shingle sets are one class, and only classes are compared. All
shingles have one global order, from rare to frequent by a sketch of their
document counts over the whole corpus. Two sets of sizes n and m that are
similar enough share at least ``a = overlap(n, m)`` shingles, so their first
``n - a + l`` and ``m - a + l`` shingles share at least ``l`` (for any l).

Each class takes its own ``l``: the more candidates its prefix is expected to
meet, the longer the prefix and the more shared prefix shingles are asked for
before a pair is verified; a pair goes by the smaller ``l``.

Candidates come in two steps, so that a large group of near copies does not make
all its pairs. First every class is verified against one hub of each shared
prefix shingle, the class that has it earliest, and the links make components.
Then the remaining pairs, those across components, are joined, counted and
verified. Pairs inside a component could not change it.

The links of a class are counted afterwards, over all pairs inside its
component: blocks of classes meet, a product of their incidence matrices gives
all intersections, and only the counts leave a task.

What two branches of a later step read is written first, so that no plan repeats
the steps before it and the driver holds small plans only.

Shingles are compared by 64-bit hashes; class digests have 128 bits.

Cases: a null or empty text, or one of white space, has no shingles, no class and
no links, and is its own component; a text of fewer words than a shingle is one
shingle of all its words; repeated rows each give a row; a null id never names a
component unless all ids in it are null; an empty table gives none; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm._bytes import mix, utf8, windows, words
from codeloom.llm._tables import bound_batches, spare, table
from codeloom.operators.components import connected_components
from codeloom.plans.shared import materialize, remove_table
from codeloom.plans.skew import salted_lookup

#: Counters of the document-count sketch, and in how many parts tasks hand it on: 8 MB whatever the input.
SKETCH, PARTS = 1 << 21, 64
#: Bits of the filters of shared shingles and of candidate texts: 8 MB whatever the input.
FILTER = 1 << 26
#: Classes of a block whose pairs one task counts, about, and shingles of a block's matrix.
MEMBERS, COLUMNS = 512, 4096
#: Groups that the pairs of one class are dealt over.
SALTS = 16
#: Partial sketches that one task of the first round adds up.
FAN_IN = 64


@dataclass(frozen=True)
class Settings:
    """Shingle size, the least similarity in percent, and the adaptive prefix."""

    words: int = 4
    percent: int = 85
    #: Expected candidates at which a prefix is lengthened first; each fourfold more lengthens it again.
    cost: int = 64
    most_matches: int = 4


def overlap(n, m, percent: int):
    """Least intersection of similar sets of sizes n and m: 100 i >= p (n + m - i)."""
    return (percent * (n + m) + 99 + percent) // (100 + percent)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingles of a text's word hashes; a shorter text is one shingle."""
    if len(hashes) >= size:
        return np.unique(windows(hashes, size))
    if not len(hashes):
        return hashes
    return mix(windows(hashes, len(hashes)) ^ np.uint64(0xA5A5A5A5A5A5A5A5 + len(hashes)))


def sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The shingle set of each text of a column."""
    hashes, bounds = words(*utf8(column))
    for i in range(len(bounds) - 1):
        yield shingles(hashes[bounds[i] : bounds[i + 1]], size)


def digest(own: np.ndarray) -> bytes | None:
    """The class of a set; none for the empty set."""
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None


def classify(docs: DataFrame, settings: Settings) -> DataFrame:
    """One scan: (doc_id, n, class) of every row, and each task's part of the sketch (part, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.uint32)
        names = ["doc_id", "n", "class", "part", "counts"]
        for batch in batches:
            sizes, classes = [], []
            for own in sets(batch.column(1), settings.words):
                sizes.append(len(own))
                classes.append(digest(own))
                np.add.at(counts, own & np.uint64(SKETCH - 1), 1)
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names)
        for part, own in enumerate(np.split(counts, PARTS)):
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([part], pa.int32()), pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, class binary, part int, counts binary")


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the sketch parts that a task reads; one row per part, whatever it reads."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(zlib.decompress(data), np.uint32)
            total[part] = np.minimum(total[part].astype(np.uint64) + own, 0xFFFFFFFF).astype(np.uint32) if part in total else own
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], ["part", "counts"])


def sketch(parts: DataFrame) -> np.ndarray:
    """The corpus's sketch, added up in two rounds of streaming sums."""
    schema = "part int, counts binary"
    for spread in (F.pmod(F.xxhash64("counts"), F.lit(FAN_IN)), F.lit(0)):
        parts = parts.repartition(PARTS, "part", spread).select("part", "counts").mapInArrow(_added, schema)
    found = np.zeros((PARTS, SKETCH // PARTS), np.uint32)
    for row in parts.toArrow().to_pylist():
        found[row["part"]] = np.frombuffer(zlib.decompress(row["counts"]), np.uint32)
    return found.reshape(-1)


def prefixes(docs: DataFrame, counts: np.ndarray, settings: Settings) -> DataFrame:
    """One scan: (class, n, matches, text_key, prefix) of every row that has shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    noise = float(counts.mean(dtype=np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = shared.value
        for batch in batches:
            rows = []
            for key, own in zip(batch.column(0).to_pylist(), sets(batch.column(1), settings.words), strict=True):
                n = len(own)
                if not n:
                    continue
                often = frequency[own & np.uint64(SKETCH - 1)]
                order = np.lexsort((own, often))
                first = n - overlap_alone(n, settings.percent) + 1
                expected = float(np.maximum(often[order[:first]] - 1 - noise, 0).sum())
                extra = min(settings.most_matches - 1, int(np.log2(1 + expected / settings.cost) / 2))
                rows.append((digest(own), n, 1 + extra, key, own[order[: first + extra]].view(np.int64)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.list_(pa.int64()))],
                ["class", "n", "matches", "text_key", "prefix"],
            )

    return docs.select(F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, "class binary, n bigint, matches int, text_key bigint, prefix array<bigint>")


def overlap_alone(n: int, percent: int) -> int:
    """Least intersection with any similar set."""
    return (percent * n + 99) // 100


def bit_filter(keys: DataFrame) -> np.ndarray:
    """Bits of the keys (k) in a filter of fixed size."""
    place = F.col("k").bitwiseAND(F.lit(FILTER - 1))
    found = keys.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(k & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER // 64, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys.view(np.uint64) & np.uint64(FILTER - 1)
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def buckets(nodes: DataFrame) -> DataFrame:
    """(token, node, n, matches, pos) of the prefix shingles that more than one class has, and few others."""
    spark = nodes.sparkSession
    shared = nodes.select(F.explode("prefix").alias("k")).groupBy("k").count().filter("count > 1").select("k")
    bits = spark.sparkContext.broadcast(bit_filter(shared))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            tokens = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), sizes)
            pos = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            kept = np.flatnonzero(_passes(bits.value, tokens))
            take = pa.array(row[kept])
            yield pa.RecordBatch.from_arrays([pa.array(tokens[kept]), batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), pa.array(pos[kept].astype(np.int64))], ["token", "node", "n", "matches", "pos"])

    return materialize(nodes.select("node", "n", "matches", "prefix").mapInArrow(run, "token bigint, node bigint, n bigint, matches int, pos bigint"), "nd-buckets")


def _least(a: str, b: str, percent: int) -> Column:
    """:func:`overlap` of two sides' sizes."""
    return F.floor((percent * (F.col(a) + F.col(b)) + 99 + percent) / (100 + percent)).cast("int")


def _could_meet(a: str, b: str, percent: int) -> Column:
    """Whether a shared shingle can be a similar pair's first: enough of both sets must follow it."""
    least = _least(f"{a}.n", f"{b}.n", percent)
    return (F.col(f"{a}.pos") <= F.col(f"{a}.n") - least) & (F.col(f"{b}.pos") <= F.col(f"{b}.n") - least)


def match_prefixes(pairs: DataFrame, nodes: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b, asked) whose prefixes share as many shingles as the pair must.

    A pair has met in one; only pairs that are asked for more fetch their
    prefixes, and only classes with longer ones are in such pairs.
    """
    longer = nodes.filter("matches > 1")
    one = lambda side: longer.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("n", "prefix")])
    both = pairs.filter("asked > 1").join(one("a"), "a").join(one("b"), "b")
    least = _least("n_a", "n_b", settings.percent)
    asked = F.least("asked", least)
    own = lambda side: F.slice(f"prefix_{side}", F.lit(1), (F.col(f"n_{side}") - least + asked).cast("int"))
    many = both.filter(F.size(F.array_intersect(own("a"), own("b"))) >= asked).select("a", "b")
    return pairs.filter("asked = 1").select("a", "b").unionByName(many)


def candidate_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, class, text) of the classes ``wanted``: other texts stay where they are."""
    keys = wanted.select("node", "class", "text_key")
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(keys.select(F.col("text_key").alias("k"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_passes(bits.value, batch.column(0).to_numpy(zero_copy_only=False))))

    near = docs.select(F.xxhash64("text").alias("text_key"), "text").filter("text is not null").mapInArrow(run, "text_key bigint, text string")
    # Copies of one text become one row in each task before they travel.
    return materialize(near.groupBy("text_key", F.sha2("text", 256).alias("sha")).agg(F.first("text").alias("text")).join(keys, "text_key").select("node", "class", "text"), "nd-texts")


def verify(pairs: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """The distinct pairs (a, b) of classes that are similar enough, by their whole sets, written; ``pairs`` has each pair once.

    The pairs of one ``a`` are dealt over :data:`SALTS` groups, and its text
    goes once to each group in use, not to each pair. Pairs and texts meet by
    sorting at every size, so that no list of pairs goes through the driver.
    """
    keyed = materialize(pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")), "nd-pairs")
    own = texts.select(F.col("node").alias("other"), "class", "text")
    first = keyed.select("a", "salt").distinct().withColumn("other", F.col("a")).withColumn("kind", F.lit(0))
    second = keyed.select("a", "salt", F.col("b").alias("other"), F.lit(1).alias("kind"))
    rows = first.unionByName(second).join(own.hint("merge"), "other").select("a", "salt", "kind", "other", "class", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hub = None, None
        for batch in batches:
            a, b = [], []
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for own_a, salt, kind, other, name, found in zip(*columns, sets(batch.column(5), settings.words), strict=True):
                # Another text with the same key is no text of this class.
                if digest(found) != name:
                    continue
                if kind == 0:
                    held, hub = (own_a, salt), found
                elif held == (own_a, salt):
                    met = len(np.intersect1d(hub, found, assume_unique=True))
                    if 100 * met >= settings.percent * (len(hub) + len(found) - met):
                        a.append(own_a)
                        b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    found = materialize(rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "kind").mapInArrow(run, "a bigint, b bigint").distinct(), "nd-links")
    remove_table(keyed)
    return found


def links(docs: DataFrame, nodes: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links (a, b) between classes with the same components as all links, and no pair that is none; the components (node, component); and the classes' texts."""
    met = buckets(nodes)
    hubs = met.groupBy("token").agg(F.min(F.struct("pos", "node", "n", "matches")).alias("h"), F.count("*").alias("rows")).filter("rows > 1").select("token", "h.*")
    hubs = materialize(hubs, "nd-hubs")
    shared = materialize(met.join(hubs.select("token"), "token"), "nd-shared")
    remove_table(met)
    wanted = materialize(nodes.select("node", "class", "text_key").join(shared.select("node").distinct(), "node"), "nd-wanted")
    texts = candidate_texts(docs, wanted)
    star = shared.alias("x").join(hubs.alias("y"), "token").filter("x.node <> y.node").filter(_could_meet("x", "y", settings.percent))
    asked = F.least("x.matches", "y.matches").alias("asked")
    star = materialize(star.select(F.col("y.node").alias("a"), F.col("x.node").alias("b"), asked).distinct(), "nd-star")
    linked = verify(match_prefixes(star, nodes, settings), texts, settings)
    labels = materialize(connected_components(linked, "a", "b"), "nd-labels")
    labelled = shared.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    blocks = F.ceil(F.count("*") / MEMBERS).cast("int").alias("blocks")
    open_tokens = labelled.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), blocks).filter("lo <> hi").select("token", "blocks")
    rest = materialize(labelled.join(open_tokens, "token"), "nd-rest")
    remove_table(hubs, shared, wanted)
    known = star.select("a", "b").unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = materialize(across_pairs(rest, settings).join(known, ["a", "b"], "left_anti"), "nd-left")
    remove_table(star, rest)
    later = verify(match_prefixes(left, nodes, settings), texts, settings)
    remove_table(left)
    if later.isEmpty():
        return linked, labels, texts
    return linked.unionByName(later), joined_components(labels, later), texts


def across_pairs(rest: DataFrame, settings: Settings) -> DataFrame:
    """Pairs (a, b, asked) of classes of two components that share a prefix shingle.

    The classes of a shingle are dealt over its ``blocks``, and each two blocks
    of it meet in a task of their own.
    """
    dealt = rest.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    low = dealt.withColumn("lo", F.col("block")).withColumn("hi", F.explode(every))
    high = dealt.withColumn("hi", F.col("block")).withColumn("lo", F.explode(every))
    across = low.alias("x").join(high.alias("y"), ["token", "lo", "hi"]).filter("x.component < y.component").filter(_could_meet("x", "y", settings.percent))
    return across.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.least("x.matches", "y.matches").alias("asked")).distinct()


def joined_components(labels: DataFrame, later: DataFrame) -> DataFrame:
    """Components (node, component) when the links ``later`` come to those of ``labels``: only components are linked anew."""
    ends = later.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti")
    every = materialize(labels.unionByName(ends.select("node", F.col("node").alias("component"))), "nd-ends")
    one = lambda side: every.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
    merged = connected_components(later.join(one("a"), "a").join(one("b"), "b"), "c_a", "c_b").select(F.col("node").alias("component"), F.col("component").alias("into"))
    found = salted_lookup(every, merged, ["component"], F.col("node")).select("node", F.coalesce("into", "component").alias("component"))
    made = materialize(found, "nd-labels")
    remove_table(labels, every)
    return made


def intersections(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """The size of the intersection of each set of ``x`` with each of ``y``."""
    out = np.zeros((len(x), len(y)), np.float64)
    common = np.intersect1d(np.concatenate(x), np.concatenate(y))

    def incidence(sets_of: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
        rows = np.zeros((len(sets_of), len(columns)), np.float32)
        for row, own in zip(rows, sets_of, strict=True):
            part = own[np.searchsorted(own, columns[0]) : np.searchsorted(own, columns[-1], "right")]
            at = np.searchsorted(columns, part)
            row[at[columns[at] == part]] = 1
        return rows

    for start in range(0, len(common), COLUMNS):
        columns = common[start : start + COLUMNS]
        out += incidence(x, columns) @ incidence(y, columns).T
    return out


def block_pairs(labels: DataFrame, nodes: DataFrame, settings: Settings) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """(component, sa, ba, sb, bb, side, node): the pairs of blocks in which all similar pairs of a component meet, each with its classes; and the tables it reads.

    Sizes are cut into steps that similar sets are at most one apart.
    """
    width = -math.log(settings.percent / 100) * (1 + 1e-9)
    step = F.floor(F.log("n") / width) if settings.percent < 100 else F.col("n")
    sized = labels.join(nodes.select("node", "n"), "node").select("component", "node", step.cast("bigint").alias("step"))
    # Two classes of one component are linked to each other.
    most = sized.groupBy("component").count().filter("count > 2").select("component")
    groups = sized.groupBy("component", "step").count().join(most, "component")
    groups = materialize(groups.select("component", "step", F.ceil(F.col("count") / MEMBERS).cast("int").alias("blocks")), "nd-blocks")
    own = salted_lookup(sized, groups, ["component", "step"], F.col("node"), "inner")
    own = materialize(own.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).select("component", "step", "block", "node"), "nd-dealt")
    each = groups.select("component", "step", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    meets = (F.col("y.step") == F.col("x.step") + 1) | ((F.col("y.step") == F.col("x.step")) & (F.col("y.block") >= F.col("x.block")))
    pairs = each.alias("x").join(each.alias("y"), "component").filter(meets)
    pairs = pairs.select("component", F.col("x.step").alias("sa"), F.col("x.block").alias("ba"), F.col("y.step").alias("sb"), F.col("y.block").alias("bb"))
    end = lambda side, step, block: F.struct(F.lit(side).alias("side"), F.col(step).alias("step"), F.col(block).alias("block"))
    ends = pairs.withColumn("end", F.explode(F.array(end(0, "sa", "ba"), end(1, "sb", "bb")))).filter("end.side = 0 or sa <> sb or ba <> bb").select(*pairs.columns, "end.*")
    return own.join(ends, ["component", "step", "block"]).select("component", "sa", "ba", "sb", "bb", "side", "node"), (groups, own)


def link_counts(labels: DataFrame, nodes: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """(node, n_links), written: how many classes each class of a component is similar to."""
    key = ["component", "sa", "ba", "sb", "bb"]

    def counted(members: dict[int, tuple[int, np.ndarray]], both: bool) -> pa.RecordBatch:
        x, y = ([n for n, (side, _) in members.items() if side == own] for own in (0, 1))
        if not both:
            y = x
        nodes_of, found = [*x, *y] if both else x, np.zeros(0, np.int64)
        if x and y:
            sizes = lambda part: np.array([len(members[n][1]) for n in part])
            met = intersections([members[n][1] for n in x], [members[n][1] for n in y])
            linked = 100 * met >= settings.percent * (sizes(x)[:, None] + sizes(y)[None] - met)
            if not both:
                np.fill_diagonal(linked, False)
            found = np.concatenate([linked.sum(1), linked.sum(0)]) if both else linked.sum(1)
        else:
            nodes_of = []
        return pa.RecordBatch.from_arrays([pa.array(nodes_of, pa.int64()), pa.array(found, pa.int64())], ["node", "n_links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, members = None, {}
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True))
            for k, side, node, own, name in zip(keys, batch.column(5).to_pylist(), batch.column(6).to_pylist(), sets(batch.column(8), settings.words), batch.column(7).to_pylist(), strict=True):
                if k != held:
                    if members:
                        yield counted(members, held[1:3] != held[3:5])
                    held, members = k, {}
                # Another text with the same key is no text of this class.
                if digest(own) == name:
                    members[node] = (side, own)
        if members:
            yield counted(members, held[1:3] != held[3:5])

    pairs, read = block_pairs(labels, nodes, settings)
    rows = pairs.join(texts.select("node", "class", "text"), "node").select(*key, "side", "node", "class", "text")
    counts = rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "node bigint, n_links bigint")
    two = labels.groupBy("component").agg(F.count("*").alias("members"), F.min("node").alias("a"), F.max("node").alias("b")).filter("members = 2")
    found = counts.unionByName(two.select(F.explode(F.array("a", "b")).alias("node"), F.lit(1).cast("bigint").alias("n_links"))).groupBy("node").agg(F.sum("n_links").alias("n_links"))
    found = materialize(found, "nd-degrees")
    remove_table(*read)
    return found


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), count_links: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_size, n_links) of every row of (doc_id, text).

    ``class_size`` is how many rows share the row's shingle set, ``n_links`` to
    how many other classes its class is similar; without ``count_links`` only
    the links that made the components count, which are none where it has none.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    read = materialize(classify(docs, settings), "nd-read")
    rows = read.filter("part is null").select("doc_id", "n", "class")
    counts = sketch(read.filter("part is not null").select("part", "counts"))
    found = prefixes(docs, counts, settings).groupBy("class").agg(*[F.first(c).alias(c) for c in ("n", "matches", "text_key", "prefix")])
    nodes = materialize(found.withColumn("node", F.monotonically_increasing_id()), "nd-nodes")
    made, labels, texts = links(docs, nodes, settings)
    if count_links:
        degrees = link_counts(labels, nodes, texts, settings)
    else:
        degrees = made.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    classes = rows.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("class_size"))
    own = classes.join(nodes.select("class", "node"), "class").join(labels, "node", "left").join(degrees, "node", "left")
    own = materialize(own.filter("class_size > 1 or component is not null").select("class", "class_size", "least", "component", "n_links"), "nd-classes")
    least = own.filter("component is not null").groupBy("component").agg(F.min("least").alias("component_least"))
    # Rows of a class or component of one need no lookup.
    lookup = materialize(own.join(least, "component", "left").select("class", "class_size", F.coalesce("component_least", "least").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "nd-lookup")
    remove_table(nodes, labels, texts, own, *([degrees] if count_links else []))
    joined = rows.join(lookup, "class", "left")
    return joined.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
    )


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle components of every document."""
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


#: The pipeline's near duplicates: five words, 0.8.
STAGE = Settings(words=5, percent=80)


def kept_one_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates one document stays, the one with the least id.

    Of rows that have the same id and a set in common one stays; rows without
    shingles stay. The rows that go are few against the corpus, so what is
    joined to the texts is the list of those.
    """
    key, flag = spare(docs, "key"), spare(docs, "once")
    # A key of its own per row: ids may repeat or be null.
    row = F.xxhash64("doc_id", "text")
    found = materialize(near_duplicates(docs.select(row.alias("doc_id"), "text"), STAGE, count_links=False), "nd-stage")
    ids = docs.select(row.alias("key"), "doc_id").groupBy("key").agg(F.min("doc_id").alias("id"))
    groups = found.filter("n_shingles > 0 and (class_size > 1 or n_links > 0)").join(ids, F.col("doc_id") == F.col("key")).select("key", "id", "component_id")
    best = groups.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("b"))
    # Copies of a row share its key; the group's least key stays, once.
    gone = materialize(groups.join(best, "component_id").filter("key <> b.key").select("key").distinct(), "nd-gone")
    once = materialize(best.select(F.col("b.key").alias("key")), "nd-once")
    # Texts whose key passes the filter meet the lists; all others stay where they are.
    bits = spark.sparkContext.broadcast(bit_filter(gone.unionByName(once).select(F.col("key").alias("k"))))
    keyed = docs.select(row.alias(key), *docs.columns)

    def sifted(pass_: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(_passes(bits.value, batch.column(0).to_numpy(zero_copy_only=False)) == pass_))

        return keyed.mapInArrow(run, keyed.schema)

    listed = sifted(True).join(gone.withColumnRenamed("key", key), key, "left_anti")
    listed = listed.join(once.select(F.col("key").alias(key), F.lit(True).alias(flag)), key, "left")
    repeated = listed.filter(F.col(flag)).dropDuplicates([key])
    return sifted(False).select(*docs.columns).unionByName(listed.filter(F.col(flag).isNull()).unionByName(repeated).select(*docs.columns))
