"""Language-model scoring by context-tree weighting, beside a unigram base.

A byte is eight binary decisions, one for each prefix of its bits. For every
such decision a context tree over the ``DEPTH`` bytes before it holds the counts of
both outcomes; a node's Krichevsky-Trofimov estimate and the product of its
children's weighted probabilities are mixed half and half, over all depths from
none to ``DEPTH``. The counts are of every training document; text begins after,
and ends with, the byte 0xFF, which UTF-8 never has. Every context has its node.

The tree is dealt over ``BUCKETS`` buckets by the last two bytes of a context, so
all that lies below such a pair is in one bucket; what all pairs have together,
the depths none and one, has at most 2**16 nodes and is broadcast. Texts are read
in chunks. The distinct grams of a chunk go to their buckets and come back with
their log probabilities, so no task holds more than a bucket or a chunk. A bucket whose
chunks bring more than ``PART_BYTES`` is divided by the third byte of context into
as many parts as that needs, at most ``PARTS``; the nodes of two bytes, at most
255 for each pair, are then summed over its parts and sent back to each.
``fit`` and ``weigh`` hold a tree of ``MAX_CONTEXTS`` contexts on one machine;
the tests compare the two.

The base needs a count for every word of every text. The ``FREQUENT`` most
frequent words are looked up where the text is read; all others, of which none
is a hot key, travel by hash and meet their count in a join.

Cases: a null text is empty and has one token, its end; a null id is in neither
half: it is not learned from and not held out; without training text every
count is 0 and every byte has probability 1/256; repeated rows are each counted
and scored; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm._bytes import BLOCK, mix, utf8, words
from codeloom.llm._tables import bound_batches, remainder5, table
from codeloom.plans.shared import materialize

#: Words whose counts are broadcast: at most 16 bytes each, 8 MB.
FREQUENT = 1 << 19
#: Bytes of context at most.
DEPTH = 5
#: Contexts of three bytes or more that :func:`fit` keeps.
MAX_CONTEXTS = 1 << 15
#: Bins to a doubling, where a count's rank is sought.
BINS = 8
#: Distinct keys that a task gathers before it hands them on.
HELD = 1 << 20
#: Bytes of text of a chunk, about, and parts of the tree.
CHUNK, BUCKETS = 1 << 24, 256
#: Packed bytes that a bucket may receive before it is divided, and its parts at most.
PART_BYTES, PARTS = 1 << 24, 256
EDGE = 0xFF
#: The hash that stands for the end of a text.
END = np.uint64(0x5EED0FED0E11D0C5)


def framed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with ``DEPTH`` edge bytes before and one after each, and their new offsets."""
    rows = len(offsets) - 1
    out = np.full(len(data) + (DEPTH + 1) * rows, EDGE, np.uint8)
    moved = offsets + (DEPTH + 1) * np.arange(rows + 1)
    shift = np.repeat((DEPTH + 1) * np.arange(rows) + DEPTH, np.diff(offsets))
    out[np.arange(len(data)) + shift] = data
    return out, moved


def grams(text: np.ndarray) -> np.ndarray:
    """Each ``DEPTH`` + 1 bytes as a number, the earliest highest."""
    wide = text.astype(np.uint64)
    out = wide[: len(wide) - DEPTH].copy()
    for i in range(1, DEPTH + 1):
        out <<= np.uint64(8)
        out |= wide[i : len(wide) - DEPTH + i]
    return out


class Tally:
    """Counts of keys, merged now and then."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, int)
        counts = np.add.reduceat(counts, first) if len(first) else counts
        self.keys, self.counts, self.size = [keys[first]], [counts], len(first)
        return self.keys[0], self.counts[0]


def own_grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The grams of each text, a block at a time."""
    text, bounds = framed(data, offsets)
    for at in range(0, len(text) - DEPTH, BLOCK):
        stop = min(at + BLOCK, len(text) - DEPTH)
        # Grams that end in another text's edge bytes are no text's.
        own = np.ones(stop - at, bool)
        for k in range(DEPTH):
            ends = bounds[1:-1] + k - DEPTH - at
            own[ends[(ends >= 0) & (ends < stop - at)]] = False
        yield grams(text[at : stop + DEPTH])[own]


def count_keys(docs: DataFrame, kinds: tuple[int, ...] = (0, 1)) -> DataFrame:
    """(kind, key, n): counts of the words (kind 0) and byte grams (kind 1) of all texts."""

    def rows(kind: int, tally: Tally) -> pa.RecordBatch:
        keys, counts = tally.merge()
        own = [pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys.astype(np.uint64).view(np.int64)), pa.array(counts.astype(np.int64))]
        return pa.RecordBatch.from_arrays(own, ["kind", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = [Tally(), Tally()]
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            if 0 in kinds:
                tallies[0].add(words(data, offsets)[0])
                tallies[0].add(np.array([END]), np.array([batch.num_rows]))
            if 1 in kinds:
                for found in own_grams(data, offsets):
                    tallies[1].add(found)
            for kind, tally in enumerate(tallies):
                if tally.size > HELD and len(tally.merge()[0]) > HELD // 2:
                    yield rows(kind, tally)
                    tallies[kind] = Tally()
        for kind, tally in enumerate(tallies):
            yield rows(kind, tally)

    bound_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "kind tinyint, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def least_frequent(counted: DataFrame, most: int) -> int:
    """The least count c such that at most ``most`` rows have ``n >= c``, to 1/BINS of a doubling."""
    bins = counted.groupBy(F.floor(F.log2("n") * BINS).alias("bin")).agg(F.count("*").alias("rows"), F.min("n").alias("least")).orderBy(F.desc("bin")).collect()
    total, found = 0, 1 << 62
    for b in bins:
        total += b["rows"]
        if total > most:
            break
        found = b["least"]
    return found


def _log_gamma(x: np.ndarray) -> np.ndarray:
    shifted = x + 7
    product = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6)
    series = 1 / (12 * shifted) - 1 / (360 * shifted**3) + 1 / (1260 * shifted**5)
    return (shifted - 0.5) * np.log(shifted) - shifted + 0.5 * np.log(2 * np.pi) + series - np.log(product)


def bit_counts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones of the 255 decisions, from counts of the 256 bytes (a row per context)."""
    zeros, ones = [], []
    for level in range(8):
        split = counts.reshape(len(counts), 1 << level, 2, 128 >> level).sum(-1)
        zeros.append(split[:, :, 0])
        ones.append(split[:, :, 1])
    return np.concatenate(zeros, 1), np.concatenate(ones, 1)


def _kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def _byte_logs(p_one: np.ndarray) -> np.ndarray:
    """log10 of the probability of each byte, from the probability of a one in each decision."""
    total, at = np.zeros((len(p_one), 1)), 0
    for level in range(8):
        p = p_one[:, at : at + (1 << level)]
        at += 1 << level
        total = (total[:, :, None] + np.log10(np.stack([1 - p, p], -1))).reshape(len(p_one), -1)
    return total.astype(np.float32)


@dataclass
class Model:
    """Byte log probabilities by context. Rows: kept contexts of each length from three, then two-byte ones, then one-byte ones."""

    kept: list[np.ndarray]
    pairs: np.ndarray
    table: np.ndarray

    def index(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """The row of each of the 2**24 three-byte contexts, and for each longer length the row of a kept context's next byte (none: -1)."""
        starts = np.cumsum([0, *[len(k) for k in self.kept]])
        two = starts[-1] + len(self.pairs) + (np.arange(1 << 16) & 255)
        two[self.pairs] = starts[-1] + np.arange(len(self.pairs))
        rows = np.tile(two.astype(np.int32), 256)
        rows[self.kept[0]] = np.arange(len(self.kept[0]), dtype=np.int32)
        children = []
        for i in range(1, len(self.kept)):
            child = np.full((max(len(self.kept[i - 1]), 1), 256), -1, np.int32)
            bits = 8 * (i + 2)
            child[np.searchsorted(self.kept[i - 1], self.kept[i] & ((1 << bits) - 1)), self.kept[i] >> bits] = starts[i] + np.arange(len(self.kept[i]))
            children.append(child.reshape(-1))
        return rows, children

    def find(self, index: tuple[np.ndarray, list[np.ndarray]], found: np.ndarray) -> np.ndarray:
        """The row of each gram: that of its longest kept context."""
        rows, children = index
        own = rows[(found >> np.uint64(8)) & np.uint64(0xFFFFFF)]
        live, start = np.flatnonzero(own < len(self.kept[0])), 0
        for i, child in enumerate(children):
            following = child[(own[live] - start).astype(np.int64) * 256 + ((found[live] >> np.uint64(8 * (i + 4))) & np.uint64(255)).astype(np.int64)]
            more = following >= 0
            live = live[more]
            own[live] = following[more]
            start += len(self.kept[i])
        return own


#: Contexts weighed at a time.
STEP = 1024


def weigh(nodes: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """The weighted tree from (contexts, byte counts) of two bytes, then three, up to ``DEPTH``; each kept context's suffix is kept."""
    up = [None] + [np.searchsorted(nodes[i - 1][0], nodes[i][0] & ((1 << 8 * (i + 1)) - 1)) for i in range(1, len(nodes))]
    rest = [n[1].astype(np.int64) for n in nodes]
    for i in range(1, len(nodes)):
        np.subtract.at(rest[i - 1], up[i], nodes[i][1])
    pairs = nodes[0][0]
    single = np.zeros((256, 256))
    np.add.at(single, pairs & 255, nodes[0][1])
    root = single.sum(0, keepdims=True)

    def stop(counts: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        zeros, ones = bit_counts(counts.astype(float))
        own = _kt(zeros, ones)
        return 1 / (1 + np.exp(np.clip(below - own, -700, 700))), np.log(0.5) + np.logaddexp(own, below), (ones + 0.5) / (zeros + ones + 1)

    last = len(nodes) - 1
    stops, chances = [None] * last, [None] * last
    below = None
    below1 = np.zeros((256, 255))
    for i in range(last, -1, -1):
        n = len(nodes[i][0])
        above = np.zeros((len(nodes[i - 1][0]), 255)) if i else below1
        parent = up[i] if i else pairs & 255
        if i < last:
            stops[i], chances[i] = np.empty((n, 255), np.float32), np.empty((n, 255), np.float32)
        for at in range(0, n, STEP):
            part = slice(at, min(at + STEP, n))
            if i == last:
                weight = _kt(*bit_counts(nodes[i][1][part].astype(float)))
            else:
                stops[i][part], weight, chances[i][part] = stop(nodes[i][1][part], below[part] + _kt(*bit_counts(rest[i][part].astype(float))))
            np.add.at(above, parent[part], weight)
        below = above
    stop1, log1, p1 = stop(single, below1)
    stop0, _, p0 = stop(root, log1.sum(0, keepdims=True))

    def rows(i: int) -> list[np.ndarray]:
        out = []
        for at in range(0, len(nodes[i][0]), STEP):
            own = np.arange(at, min(at + STEP, len(nodes[i][0])))
            zeros, ones = bit_counts((rest[i] if i < last else nodes[i][1])[own].astype(float))
            p = (ones + 0.5) / (zeros + ones + 1)
            for k in range(i, -1, -1):
                if k < last:
                    p = stops[k][own] * chances[k][own] + (1 - stops[k][own]) * p
                if k:
                    own = up[k][own]
            byte = pairs[own] & 255
            p = stop1[byte] * p1[byte] + (1 - stop1[byte]) * p
            out.append(_byte_logs(stop0 * p0 + (1 - stop0) * p))
        return out

    tables = [t for i in range(1, len(nodes)) for t in rows(i)] + rows(0)
    tables.append(_byte_logs(stop0 * p0 + (1 - stop0) * (stop1 * p1 + (1 - stop1) * 0.5)))
    return Model([n[0] for n in nodes[1:]], pairs, np.concatenate(tables))


def fit(counted: DataFrame) -> Model:
    """The model from a table of gram counts (key, n).

    At most 2**24 counts after two-byte contexts, and ``MAX_CONTEXTS`` * 256
    after longer ones, reach the driver.
    """
    # Counts after shorter contexts are sums of those after longer ones.
    levels = {DEPTH: counted}
    for length in range(DEPTH - 1, 1, -1):
        levels[length] = materialize(levels[length + 1].groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * (length + 1)) - 1)).alias("key")).agg(F.sum("n").alias("n")), "ctw-level")
    contexts = {d: materialize(levels[d].groupBy(F.shiftright("key", 8).alias("context")).agg(F.sum("n").alias("n")), "ctw-contexts") for d in range(3, DEPTH + 1)}
    every = None
    for c in contexts.values():
        every = c.select("n") if every is None else every.unionByName(c.select("n"))
    least = least_frequent(every, MAX_CONTEXTS)

    def dense(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        keys, n = rows["key"].to_numpy(), rows["n"].to_numpy()
        own, place = np.unique(keys >> 8, return_inverse=True)
        counts = np.zeros((len(own), 256), np.uint32 if not len(n) or n.max() < 1 << 32 else np.int64)
        counts[place, keys & 255] = n
        return own, counts

    nodes = [dense(levels[2].toArrow())]
    for d in range(3, DEPTH + 1):
        kept = contexts[d].filter(F.col("n") >= least).select("context")
        nodes.append(dense(levels[d].withColumn("context", F.shiftright("key", 8)).join(kept, "context").select("key", "n").toArrow()))
    return weigh(nodes)


def pack(numbers: np.ndarray) -> bytes:
    """Numbers as bytes, a plane for each place, so that small ones cost little."""
    return zlib.compress(np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u8")


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys by their distances."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def bucket_of(keys: np.ndarray) -> np.ndarray:
    """The part of the tree that a gram's two-byte context lies in."""
    return (mix((keys >> np.uint64(8)) & np.uint64(0xFFFF)) % np.uint64(BUCKETS)).astype(np.int32)


READ = "chunk bigint, row bigint, doc_id bigint, held_out boolean, text string, bucket int, keys binary, counts binary, logs binary"
_NAMES = [c.split()[0] for c in READ.split(", ")]
_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


def _batch(n: int, **columns) -> pa.RecordBatch:
    """A batch of ``READ``; columns that are not given are null."""
    types = [_TYPES[c.split()[1]] for c in READ.split(", ")]
    own = [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(_NAMES, types, strict=True)]
    return pa.RecordBatch.from_arrays([x.cast(t) for x, t in zip(own, types, strict=True)], _NAMES)


def read_chunks(docs: DataFrame, train) -> DataFrame:
    """One scan: every text with its chunk, and (chunk, bucket, keys, counts) of the distinct grams of each chunk; only training texts count."""

    def parts(chunk: int, tally: Tally) -> Iterator[pa.RecordBatch]:
        keys, counts = tally.merge()
        buckets = bucket_of(keys)
        order = np.argsort(buckets, kind="stable")
        ends = np.searchsorted(buckets[order], np.arange(BUCKETS + 1))
        for bucket in np.flatnonzero(np.diff(ends)):
            own = order[ends[bucket] : ends[bucket + 1]]
            yield _batch(1, chunk=[chunk], bucket=[int(bucket)], keys=[pack_keys(keys[own])], counts=[pack(counts[own])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size, tally = None, 0, Tally()
        for batch in batches:
            if not batch.num_rows:
                continue
            if chunk is None:
                # No other chunk has the row.
                chunk = batch.column(0)[0].as_py()
            learned = batch.column(4).fill_null(False)
            for mine, wanted in ((learned, True), (pa.compute.invert(learned), False)):
                for found in own_grams(*utf8(batch.column(3).filter(mine))):
                    if wanted:
                        tally.add(found)
                    else:
                        keys = np.unique(found)
                        tally.add(keys, np.zeros(len(keys), np.int64))
                if tally.size > 4 * HELD:
                    tally.merge()
            size += batch.column(3).nbytes
            yield _batch(batch.num_rows, chunk=[chunk] * batch.num_rows, row=batch.column(0), doc_id=batch.column(1), held_out=batch.column(2), text=batch.column(3))
            if size > CHUNK:
                yield from parts(chunk, tally)
                chunk, size, tally = None, 0, Tally()
        if chunk is not None:
            yield from parts(chunk, tally)

    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint"), "held_out", "text", train.alias("train"))
    return materialize(own.mapInArrow(run, READ), "ctw-read")


def _summed(keys: np.ndarray, *numbers: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and the sums of their numbers."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, int)
    return keys[first], *(np.add.reduceat(n[order], first) if len(first) else n for n in numbers)


def _decision(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """A gram's node at a level, its context above the node's number, and the bit that is decided."""
    byte = keys & np.uint64(255)
    node = np.uint64(1 << level) | byte >> np.uint64(8 - level)
    return keys >> np.uint64(8) << np.uint64(8) | node, (byte >> np.uint64(7 - level)) & np.uint64(1) == 1


def _mask(depth: int) -> np.uint64:
    return np.uint64((1 << 8 * (depth + 1)) - 1)


def _node(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chance of a one, weight of stopping here and log of the weighted probability."""
    own = _kt(zeros, ones)
    return (ones + 0.5) / (zeros + ones + 1), 1 / (1 + np.exp(np.clip(below - own, -700, 700))), np.log(0.5) + np.logaddexp(own, below)


def grow(keys: np.ndarray, counts: np.ndarray, least: int = 2) -> tuple[list[tuple], tuple]:
    """The nodes (keys, chance, stop) of ``DEPTH`` bytes, then fewer, to ``least``; and the sums (keys, zeros, ones, below) of one byte less."""
    nodes, zeros, ones = [], [], []
    for level in range(8):
        node, one = _decision(keys, level)
        nodes.append(node)
        ones.append(np.where(one, counts, 0).astype(float))
        zeros.append(np.where(one, 0, counts).astype(float))
    own, zeros, ones = _summed(np.concatenate(nodes), np.concatenate(zeros), np.concatenate(ones))
    weight = _kt(zeros, ones)
    levels = [(own, (ones + 0.5) / (zeros + ones + 1), np.ones(len(own)))]
    for depth in range(DEPTH - 1, least - 1, -1):
        own, zeros, ones, below = _summed(own & _mask(depth), zeros, ones, weight)
        chance, stop, weight = _node(zeros, ones, below)
        levels.append((own, chance, stop))
    return levels, _summed(own & _mask(least - 1), zeros, ones, weight)


def byte_logs(levels: list[tuple], keys: np.ndarray) -> np.ndarray:
    """log10 of the probability of each gram's last byte; ``levels`` are those of all depths, the longest contexts first.

    A node that was never counted, and all below it, has chance a half.
    """
    total = np.zeros(len(keys))
    for level in range(8):
        nodes, one = _decision(keys, level)
        p = np.full(len(keys), 0.5)
        for depth, (own, chance, stop) in zip(range(DEPTH, -1, -1), levels, strict=True):
            if not len(own):
                continue
            wanted = nodes & _mask(depth)
            at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
            p = np.where(own[at] == wanted, stop[at] * chance[at] + (1 - stop[at]) * p, p)
        total += np.log10(np.where(one, p, 1 - p))
    return total


def divided(parts: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(bucket, part, chunk, keys, counts) of all chunks, and how many parts each bucket that is divided has.

    At most ``BUCKETS`` sums reach the driver.
    """
    sizes = parts.groupBy("bucket").agg(F.sum(F.octet_length("keys") + F.octet_length("counts")).alias("n")).filter(F.col("n") > PART_BYTES).collect()
    ways = {r["bucket"]: min(PARTS, -(-r["n"] // PART_BYTES)) for r in sizes}
    plain = F.lit(0).alias("part")
    if not ways:
        return parts.select("bucket", plain, "chunk", "keys", "counts"), ways

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, chunk, keys, counts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                keys, counts = unpack_keys(keys), unpack(counts)
                part = mix(keys >> np.uint64(24) & np.uint64(0xFF)) % np.uint64(ways[bucket])
                for i in np.unique(part):
                    own = part == i
                    yield pa.RecordBatch.from_pylist([{"bucket": bucket, "part": int(i), "chunk": chunk, "keys": pack_keys(keys[own]), "counts": pack(counts[own])}], schema)

    schema = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
    large = F.col("bucket").isin(*ways)
    split = parts.filter(large).select("bucket", "chunk", "keys", "counts").mapInArrow(run, "bucket int, part int, chunk bigint, keys binary, counts binary")
    return parts.filter(~large).select("bucket", plain, "chunk", "keys", "counts").unionByName(split), ways


_SUMS = "node array<bigint>, zeros array<double>, ones array<double>, below array<double>"


def _sums(node: np.ndarray, *sums: np.ndarray) -> list[pa.Array]:
    """The columns of ``_SUMS`` of one row."""
    return [pa.array([node.astype(np.int64)], pa.list_(pa.int64())), *(pa.array([x], pa.list_(pa.float64())) for x in sums)]


def merge_buckets(parts: DataFrame, ways: dict[int, int]) -> DataFrame:
    """(bucket, part, keys, counts, sums) of each part: its distinct grams, and its sums for contexts of one byte, or of two where a bucket is divided."""

    def finish(place: tuple[int, int], tally: Tally) -> pa.RecordBatch:
        keys, counts = tally.merge()
        learned = counts > 0
        sums = grow(keys[learned], counts[learned], 3 if place[0] in ways else 2)[1]
        own = [pa.array([place[0]], pa.int32()), pa.array([place[1]], pa.int32()), pa.array([pack_keys(keys)], pa.binary()), pa.array([pack(counts)], pa.binary()), *_sums(*sums)]
        return pa.RecordBatch.from_arrays(own, ["bucket", "part", "keys", "counts", "node", "zeros", "ones", "below"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, tally = None, Tally()
        for batch in batches:
            for bucket, part, keys, counts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (bucket, part) != place:
                    if place is not None:
                        yield finish(place, tally)
                    place, tally = (bucket, part), Tally()
                tally.add(unpack_keys(keys), unpack(counts).astype(np.int64))
                if tally.size > 2 * HELD and tally.size > 2 * len(tally.keys[0]):
                    tally.merge()
        if place is not None:
            yield finish(place, tally)

    own = parts.select("bucket", "part", "keys", "counts").repartition("bucket", "part").sortWithinPartitions("bucket", "part")
    return materialize(own.mapInArrow(run, f"bucket int, part int, keys binary, counts binary, {_SUMS}"), "ctw-buckets")


def middle(merged: DataFrame, ways: dict[int, int]) -> DataFrame:
    """(bucket, parts, keys, chance, stop, sums) of each divided bucket: its nodes of two bytes over all its parts, and its sums for contexts of one."""

    def finish(bucket: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        own = pa.Table.from_batches(rows)
        keys, zeros, ones, below = _summed(own["node"].to_numpy().astype(np.uint64), *(own[c].to_numpy() for c in ("zeros", "ones", "below")))
        chance, stop, weight = _node(zeros, ones, below)
        head = [pa.array([bucket], pa.int32()), pa.array([ways[bucket]], pa.int32()), *(pa.array([x], pa.binary()) for x in (pack_keys(keys), chance.tobytes(), stop.tobytes()))]
        return pa.RecordBatch.from_arrays([*head, *_sums(*_summed(keys & _mask(1), zeros, ones, weight))], ["bucket", "parts", "keys", "chance", "stop", "node", "zeros", "ones", "below"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            of = batch.column("bucket").to_numpy()
            edges = [0, *map(int, np.flatnonzero(np.diff(of)) + 1), batch.num_rows] if batch.num_rows else []
            for start, stop in zip(edges, edges[1:], strict=False):
                if of[start] != bucket:
                    if bucket is not None:
                        yield finish(bucket, held)
                    bucket, held = int(of[start]), []
                held.append(batch.slice(start, stop - start))
        if bucket is not None:
            yield finish(bucket, held)

    each = merged.filter(F.col("bucket").isin(*ways)).select("bucket", F.inline(F.arrays_zip("node", "zeros", "ones", "below")))
    summed = each.groupBy("bucket", "node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")])
    own = summed.repartition("bucket").sortWithinPartitions("bucket")
    return materialize(own.mapInArrow(run, f"bucket int, parts int, keys binary, chance binary, stop binary, {_SUMS}"), "ctw-middle")


def top_levels(sums: DataFrame) -> list[tuple]:
    """The nodes of one byte and of none; at most 2**16 rows reach the driver."""
    each = sums.select(F.inline(F.arrays_zip("node", "zeros", "ones", "below")))
    rows = each.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")]).toArrow()
    levels = []
    own, zeros, ones, below = rows["node"].to_numpy().astype(np.uint64), *(rows[c].to_numpy() for c in ("zeros", "ones", "below"))
    for depth in (1, 0):
        own, zeros, ones, below = _summed(own & _mask(depth), zeros, ones, below)
        chance, stop, below = _node(zeros, ones, below)
        levels.append((own, chance, stop))
    return levels


def chunk_logs(parts: DataFrame) -> DataFrame:
    """The rows of ``READ`` with the log probability of each gram of each chunk."""
    dealt, ways = divided(parts)
    merged = merge_buckets(dealt, ways)
    sums = ["node", "zeros", "ones", "below"]
    between = middle(merged, ways) if ways else None
    ends = merged.select(*sums) if between is None else merged.filter(~F.col("bucket").isin(*ways)).select(*sums).unionByName(between.select(*sums))
    top = parts.sparkSession.sparkContext.broadcast(top_levels(ends))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = logs = None
        pair = []
        for batch in batches:
            for bucket, chunk, keys, counts, chance, stop in zip(*(batch.column(c).to_pylist() for c in ("bucket", "chunk", "keys", "counts", "chance", "stop")), strict=True):
                # A divided bucket's nodes of two bytes come first, then a part's own row, then those of its chunks.
                if chance is not None:
                    pair = [(unpack_keys(keys), np.frombuffer(chance), np.frombuffer(stop))]
                elif chunk is None:
                    every, n = unpack_keys(keys), unpack(counts).astype(np.int64)
                    between = pair if bucket in ways else []
                    logs = byte_logs(grow(every[n > 0], n[n > 0], 3 if between else 2)[0] + between + top.value, every).astype("<f4")
                else:
                    yield _batch(1, chunk=[chunk], bucket=[bucket], keys=[keys], logs=[logs[np.searchsorted(every, unpack_keys(keys))].tobytes()])

    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    nodes = [none("binary", "chance"), none("binary", "stop")]
    own = merged.select("bucket", "part", F.lit(1).alias("kind"), none("bigint", "chunk"), "keys", "counts", *nodes)
    own = own.unionByName(dealt.select("bucket", "part", F.lit(2).alias("kind"), "chunk", "keys", none("binary", "counts"), *nodes))
    if between is not None:
        each = between.select("bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), none("bigint", "chunk"), "keys", none("binary", "counts"), "chance", "stop")
        own = own.unionByName(each)
    return own.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "kind").mapInArrow(run, READ)


class Lookup:
    """Numbers by key, by open addressing; every key asked for is there."""

    def __init__(self, keys: np.ndarray, numbers: np.ndarray):
        self.keys, self.numbers = keys, numbers
        self.shift = np.uint64(64 - max(int(4 * len(keys)).bit_length(), 4))
        self.slots = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        at = self._place(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            more = self.slots[at] != left
            left, at = left[more], (at[more] + 1) & (len(self.slots) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._place(keys)
        found = self.slots[at]
        left = np.flatnonzero(self.keys[found] != keys)
        while len(left):
            at[left] = (at[left] + 1) & (len(self.slots) - 1)
            found[left] = self.slots[at[left]]
            left = left[self.keys[found[left]] != keys[left]]
        return self.numbers[found]


def _scores(logs: Lookup, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """log10 probability of each text, its end included."""
    sizes = np.diff(offsets) + 1
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out, at = np.zeros(len(sizes)), 0
    for found in own_grams(data, offsets):
        sums = np.concatenate([[0.0], np.cumsum(logs(found).astype(float))])
        inner = np.clip(bounds - at, 0, len(found))
        out += sums[inner[1:]] - sums[inner[:-1]]
        at += len(found)
    return out


def score(docs: DataFrame, train) -> DataFrame:
    """Score every row of (doc_id, text, held_out), learning from the rows that ``train`` selects."""
    spark = docs.sparkSession
    bound_batches(spark)
    word_counts = materialize(count_keys(docs.filter(train), (0,)).select("key", "n"), "ctw-counts")
    total = word_counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = least_frequent(word_counts, FREQUENT)
    often = word_counts.filter(F.col("n") >= least).toArrow()
    keys, ns = often["key"].to_numpy().view(np.uint64), often["n"].to_numpy()
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], np.log10(ns[order] + 0.5)))
    chunks = read_chunks(docs, train)
    parts = chunks.filter("bucket is not null")
    logs_of = chunk_logs(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logs = shared.value
        held, tree = [], None
        for batch in batches:
            # Each chunk's log probabilities come before its texts.
            dictionary = batch.column("bucket").is_valid()
            chunk_of = batch.column("chunk").to_numpy()
            cuts = np.flatnonzero(np.diff(chunk_of, prepend=chunk_of[:1]) | np.diff(dictionary.to_numpy(zero_copy_only=False).astype(int), prepend=0)) if batch.num_rows else []
            edges = sorted({0, *map(int, cuts), batch.num_rows})
            for start, stop in zip(edges, edges[1:], strict=False):
                piece = batch.slice(start, stop - start)
                if dictionary[start].as_py():
                    held += zip(piece.column("keys").to_pylist(), piece.column("logs").to_pylist(), strict=True)
                    continue
                if held:
                    tree = Lookup(np.concatenate([unpack_keys(k) for k, _ in held]), np.concatenate([np.frombuffer(x, "<f4") for _, x in held]))
                    held = []
                yield score_batch(piece, known, logs, tree)

    def score_batch(batch: pa.RecordBatch, known: np.ndarray, logs: np.ndarray, tree: Lookup) -> pa.RecordBatch:
        data, offsets = utf8(batch.column("text"))
        hashes, bounds = words(data, offsets)
        # A text's tokens are its words and one end.
        hashes = np.insert(hashes, bounds[1:], END)
        bounds = bounds + np.arange(len(bounds))
        at = np.searchsorted(known, hashes)
        at[at == len(known)] = 0
        hit = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
        sums = np.concatenate([[0.0], np.cumsum(np.where(hit, logs[at], 0.0) if len(known) else np.zeros(len(hashes)))])
        hits = np.concatenate([[0], np.cumsum(hit)])
        rest = np.flatnonzero(~hit)
        rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(rest, bounds).astype(np.int32)), pa.array(hashes[rest].view(np.int64)))
        own = [
            *(batch.column(c) for c in ("row", "doc_id", "held_out")),
            pa.array(np.diff(bounds).astype(np.int64)),
            pa.array(np.diff(offsets).astype(np.int64)),
            pa.array(hits[bounds[1:]] - hits[bounds[:-1]]),
            pa.array(sums[bounds[1:]] - sums[bounds[:-1]]),
            pa.array(_scores(tree, data, offsets)),
            rare,
        ]
        return pa.RecordBatch.from_arrays(own, ["row", "doc_id", "held_out", "n_tokens", "n_bytes", "n_often", "often", "score", "rare"])

    schema = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_bytes bigint, n_often bigint, often double, score double, rare array<bigint>"
    every = logs_of.unionByName(chunks.filter("bucket is null")).drop("counts")
    read = materialize(every.repartition("chunk").sortWithinPartitions("chunk", F.desc_nulls_last("bucket")).mapInArrow(run, schema), "ctw-scored")
    # Rare words meet their counts by hash; what a text gathers is summed before it is sent to it.
    rare = read.select("row", F.explode("rare").alias("key")).join(word_counts.filter(F.col("n") < least), "key", "left")
    summed = rare.groupBy("row").agg(F.count("n").alias("n_rare"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("seldom"))
    size = F.log10(F.lit(total[0] + 0.5 * (total[1] + 1)))
    return (
        read.drop("rare")
        .join(summed, "row", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_often") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
            F.lit(total[0]).cast("bigint").alias("train_tokens"),
            (F.col("often") + F.coalesce("seldom", F.lit(0.0)) - F.col("n_tokens") * size).alias("base_score"),
            "score",
            (-F.col("score") / F.log10(F.lit(2.0)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
        )
    )


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every whole document, learning from those whose remainder is not 1."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("held_out", F.coalesce(remainder5() == 1, F.lit(False)))
    return score(docs, remainder5() != 1)
