"""Document fingerprints by a homomorphic multiset hash.

Each paragraph (a line) gives a wide vector: ``DENSE`` lanes of a cryptographic
hash of the paragraph, and ``SKETCH`` lanes that count its three-word shingles,
each with a sign, in a hashed lane. A document's fingerprint is the sum of its
paragraphs' vectors, each lane modulo 2**16. So texts with the same paragraphs in
any order have the same fingerprint, and a paragraph is inserted or deleted by
adding or subtracting its vector. The likeness of two fingerprints is 1 when
they are equal, else the cosine of their sketch lanes, between 0 and 1.

Cases: a null text is an empty one; an empty text has no paragraph and the zero
fingerprint, whose likeness to another is 0; empty lines are paragraphs of
their own; repeated rows each give a row, one after the other, and rows with
equal ids are ordered by a hash of their text; a null id comes last; a table of
one row is its own next document; an empty table gives none; extra columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm._bytes import BLOCK, mix, windows, words
from codeloom.llm._tables import bound_batches, table

DENSE, SKETCH, SHINGLE = 128, 256, 3
#: Range buckets are cut at no more quantiles than this; each is then divided evenly.
MAX_CUTS = 255
#: Documents fingerprinted together, and bytes of them.
TOGETHER = 256


def vectors(paragraphs: list[bytes]) -> np.ndarray:
    """The vectors of paragraphs, a row of 16-bit lanes each."""
    out = np.zeros((len(paragraphs), DENSE + SKETCH), np.uint16)
    if not paragraphs:
        return out
    out[:, :DENSE] = np.frombuffer(b"".join([hashlib.shake_128(p).digest(2 * DENSE) for p in paragraphs]), np.uint16).reshape(-1, DENSE)
    row, lane, sign = _shingles(paragraphs)
    out[:, DENSE:] = np.bincount(row * SKETCH + lane, sign, len(paragraphs) * SKETCH).reshape(-1, SKETCH).astype(np.int64).astype(np.uint16)
    return out


def _shingles(paragraphs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Paragraph, lane and sign of each shingle; a shorter paragraph is one shingle of all its words."""
    data = np.frombuffer(b"".join(paragraphs), np.uint8)
    hashes, bounds = words(data, np.concatenate([[0], np.cumsum([len(p) for p in paragraphs])]))
    row = np.repeat(np.arange(len(paragraphs)), np.diff(bounds))
    found, owner = windows(hashes, SHINGLE), row[: max(len(hashes) - SHINGLE + 1, 0)]
    inside = owner == row[SHINGLE - 1 :] if len(found) else np.empty(0, bool)
    sizes = np.diff(bounds)
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    whole = mix(hashes[bounds[short]] + np.where(sizes[short] > 1, hashes[np.minimum(bounds[short] + 1, max(len(hashes) - 1, 0))] * np.uint64(3), np.uint64(1))) if len(short) else np.empty(0, np.uint64)
    h = np.concatenate([found[inside], whole])
    return np.concatenate([owner[inside], short]), (h & np.uint64(SKETCH - 1)).astype(np.int64), 1.0 - 2.0 * ((h >> np.uint64(40)) & np.uint64(1)).astype(float)


def fingerprints(texts: list[str]) -> np.ndarray:
    """The fingerprint of each text: a row of lanes."""
    out = np.zeros((len(texts), DENSE + SKETCH), np.uint16)
    paragraphs: list[bytes] = []
    owners: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        for line in text.encode("utf-8", "replace").split(b"\n") if text else ():
            paragraphs.append(line)
            owners.append(i)
            size += len(line) + DENSE
            if size > BLOCK:
                _sum(out, paragraphs, owners)
                paragraphs, owners, size = [], [], 0
    _sum(out, paragraphs, owners)
    return out


def _sum(out: np.ndarray, paragraphs: list[bytes], owners: list[int]) -> None:
    if paragraphs:
        own = np.array(owners)
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        out[own[first]] += np.add.reduceat(vectors(paragraphs), first, axis=0, dtype=np.uint16)


def insert(fingerprint: np.ndarray, paragraph: str) -> np.ndarray:
    """The fingerprint with one paragraph more."""
    return fingerprint + vectors([paragraph.encode()])[0]


def delete(fingerprint: np.ndarray, paragraph: str) -> np.ndarray:
    """The fingerprint with one paragraph less."""
    return fingerprint - vectors([paragraph.encode()])[0]


def shown(fingerprint: np.ndarray) -> str:
    """A fingerprint as text."""
    return base64.b64encode(fingerprint.tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness of fingerprints, row by row."""
    x, y = a[:, DENSE:].astype(np.int16).astype(float), b[:, DENSE:].astype(np.int16).astype(float)
    size = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    cosine = np.divide((x * y).sum(1), size, out=np.zeros(len(x)), where=size > 0)
    return np.where((a == b).all(1), 1.0, np.clip(cosine, 0.0, 1.0))


def edited(text: str, after: str) -> str:
    """The text, its last half replaced by as much of the start of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def in_order(docs: DataFrame) -> DataFrame:
    """(bucket, tail, doc_id, text) such that each bucket, read in descending order of ids, ends with the first row of the next.

    Buckets are ranges of ids cut at quantiles, so the order is never in one
    task. The text travels once; only the first row of a bucket travels twice.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    cuts = sorted(set(ids.na.drop().approxQuantile("doc_id", [i / min(parts, MAX_CUTS + 1) for i in range(1, min(parts, MAX_CUTS + 1))], 0.001))) if parts > 1 else []
    low, high = ids.agg(F.min("doc_id"), F.max("doc_id")).first()
    fine = -(-parts // (MAX_CUTS + 1))
    held = F.array(*[F.lit(int(c)) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    edges = F.array(*[F.lit(int(c)) for c in (low or 0, *cuts, high or 0)])
    coarse = F.size(F.filter(held, lambda c: c < F.col("doc_id")))
    # A range between two cuts is divided evenly.
    left, right = F.get(edges, coarse), F.get(edges, coarse + 1)
    inner = F.least(F.floor((F.col("doc_id") - left).cast("double") / F.greatest((right - left).cast("double"), F.lit(1.0)) * fine), F.lit(fine - 1))
    # Descending: the least bucket has the greatest ids; null ids come after all.
    bucket = F.coalesce((len(cuts) + 1) * fine - 1 - (coarse * fine + F.greatest(inner, F.lit(0))), F.lit((len(cuts) + 1) * fine)).cast("int")
    firsts = sorted((r["bucket"], r["first"]) for r in ids.select(bucket.alias("bucket"), "doc_id").groupBy("bucket").agg(F.max("doc_id").alias("first")).collect())
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("bucket", bucket)
    if not firsts:
        return rows.select("bucket", F.lit(False).alias("tail"), "doc_id", "text")
    # At most one entry a bucket: a bucket's first id and the bucket before it (before the first: the last).
    before = F.create_map(*[x for i, (b, _) in enumerate(firsts) for x in (F.lit(b), F.lit(firsts[i - 1][0]))])
    first = F.create_map(*[x for b, f in firsts for x in (F.lit(b), F.lit(f).cast("bigint"))])
    twice = F.col("doc_id").eqNullSafe(F.try_element_at(first, F.col("bucket")))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("tail"))
    tail = F.struct(F.try_element_at(before, F.col("bucket")).alias("bucket"), F.lit(True).alias("tail"))
    return rows.select("doc_id", "text", F.explode(F.when(twice, F.array(own, tail)).otherwise(F.array(own))).alias("to")).select("to.bucket", "to.tail", "doc_id", "text").repartition(parts, "bucket").sortWithinPartitions("bucket", "tail", F.desc_nulls_last("doc_id"), F.xxhash64("text"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of (doc_id, text), and of its edit by the next document."""
    bound_batches(docs.sparkSession)

    def rows(pairs: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
        # A text that is one row's next is the following row's own.
        place: dict[int, int] = {}
        texts: list[str] = []
        for _, text, after in pairs:
            for t in (text, after):
                if id(t) not in place:
                    place[id(t)] = len(texts)
                    texts.append(t)
        changed = [edited(text, after) for _, text, after in pairs]
        made = fingerprints(texts + changed)
        own, new = made[[place[id(t)] for _, t, _ in pairs]], made[len(texts) :]
        following = made[[place[id(t)] for _, _, t in pairs]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([i for i, _, _ in pairs], pa.int64()),
                pa.array([len(t) for _, t, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                pa.array([shown(x) for x in own], pa.string()),
                pa.array([shown(x) for x in new], pa.string()),
                pa.array(likeness(own, new)),
                pa.array(likeness(own, following)),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int | None, str] | None = None
        pairs: list[tuple[int | None, str, str]] = []
        size = 0
        for batch in batches:
            for bucket, tail, doc_id, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held is not None and held[0] == bucket:
                    pairs.append((held[1], held[2], text))
                    size += len(text)
                    if len(pairs) >= TOGETHER or size > 4 * BLOCK:
                        yield rows(pairs)
                        pairs, size = [], 0
                held = None if tail else (bucket, doc_id, text)
        if pairs:
            yield rows(pairs)

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs).mapInArrow(run, schema)


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint every document and its edit."""
    return fingerprint_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
