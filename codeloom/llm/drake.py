"""Centroid clustering with Drake's adaptive bounds.

Each vector keeps an upper bound of the distance to its own centroid, lower
bounds of the distances to its few nearest other centroids, and one lower bound
of all remaining ones. When centroids move, the bounds move with them. A vector
whose upper bound is strictly below every lower bound stays; else its own
distance is computed exactly, then those of its listed centroids; and when the
best of these is not strictly below the remaining bound, all centroids are
scanned. Bounds carry a margin far above their rounding, and every decision
that they do not certify is taken by exact integer distances, the smaller
number winning ties, so the result is that of the plain scan. The number of
listed centroids adapts: a round keeps as many as the one before needed.

The vectors are one table in the shared folder, read and written once a round;
sums of centroids are kept exactly and changed by the vectors that moved. Only
centroids, sums and counts (a row a cluster) come to the driver.

Cases: null vectors, vectors of another length and those with a null or
non-finite component are left out; a null id stands for an empty one in the
hash; repeated rows are vectors of their own; equal hashes are ordered by the
vector; with fewer vectors than clusters each starts a cluster, equal ones
leaving the later empty; an empty cluster stays where it is; an empty table
gives none; extra columns are ignored. A component beyond 2^27 is an error,
since distances would not fit a long; so is an inertia that does not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm._tables import table
from codeloom.plans.shared import materialize, remove_table

DIM, CLUSTERS, ROUNDS, SEED = 64, 40, 5, 2
LARGEST = 1 << 27
#: Up to here all sums of products are integers below 2^53, which doubles hold exactly.
DOUBLE_EXACT = 1 << 22
#: Vectors worked on at a time.
ROWS = 2048
#: Bounds must differ by this share before they certify an order.
MARGIN = 1e-9

STATE = "vec_id bigint, v array<int>, cluster int, was int, distance bigint, upper double, near array<int>, lower array<double>, rest double, needed int"


def vectors(rows: DataFrame, dim: int = DIM) -> DataFrame:
    """(vec_id, v) of the whole vectors, each component floor(256 * x)."""
    whole = (F.size("embedding") == dim) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    small = F.forall("v", lambda x: F.abs(x) <= LARGEST)
    checked = F.when(small, F.col("v").cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST}")))
    # The size test guards what follows: a null or short array is never looked into.
    kept = rows.filter(F.coalesce(F.when(F.col("embedding").isNotNull(), whole), F.lit(False)))
    return kept.select(F.col("vec_id").cast("bigint").alias("vec_id"), scaled.alias("v")).select("vec_id", checked.alias("v"))


def starts(kept: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The first centroids: the vectors with the least hashes."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(hashed.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    return np.array([r.v for r in rows], np.int64)


def squared(v: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row to every centre."""
    if max(np.abs(v).max(initial=0), np.abs(centers).max(initial=0)) <= DOUBLE_EXACT:
        x, c = v.astype(float), centers.astype(float)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((v - c) ** 2).sum(1) for c in centers], 1)


def squared_of(v: np.ndarray, centers: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Exact squared distances of row i to the centres ``which[i]``."""
    return ((v[:, None, :] - centers[which]) ** 2).sum(2)


@dataclass
class Bounds:
    """The bounds of some vectors: near and lower have a column for each listed centre, lower ascending."""

    cluster: np.ndarray
    upper: np.ndarray
    near: np.ndarray
    lower: np.ndarray
    rest: np.ndarray

    @classmethod
    def none(cls, n: int) -> Bounds:
        return cls(np.full(n, -1, np.int32), np.full(n, np.inf), np.zeros((n, 0), np.int32), np.zeros((n, 0)), np.full(n, -np.inf))

    def put(self, at: np.ndarray, other: Bounds) -> None:
        for name in ("cluster", "upper", "near", "lower", "rest"):
            getattr(self, name)[at] = getattr(other, name)

    def fitted(self, width: int) -> Bounds:
        """The first ``width`` listed centres; what is dropped lowers the remaining bound."""
        if self.near.shape[1] <= width:
            return self
        return Bounds(self.cluster, self.upper, self.near[:, :width].copy(), self.lower[:, :width].copy(), np.minimum(self.rest, self.lower[:, width:].min(1)))


def below(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Certainly a < b."""
    return a * (1 + MARGIN) + MARGIN < b


def scan(v: np.ndarray, centers: np.ndarray, width: int) -> tuple[Bounds, np.ndarray]:
    """Exact bounds by all distances, and the squared distance to the nearest centre."""
    all_squared = squared(v, centers)
    order = np.argsort(all_squared, 1, kind="stable")
    ranked = np.take_along_axis(all_squared, order, 1)
    root = np.sqrt(ranked.astype(float))
    width = min(width, len(centers) - 1)
    rest = root[:, width + 1] if width + 1 < len(centers) else np.full(len(v), np.inf)
    return Bounds(order[:, 0].astype(np.int32), root[:, 0], order[:, 1 : width + 1].astype(np.int32), root[:, 1 : width + 1], rest), ranked[:, 0]


def assign(v: np.ndarray, old: Bounds, centers: np.ndarray, drift: np.ndarray, width: int) -> tuple[Bounds, np.ndarray]:
    """The bounds after the centres moved by ``drift``, and how many listed centres each vector needed (-1: a scan)."""
    needed = np.zeros(len(v), np.int32)
    if not len(v):
        return old, needed
    if old.cluster[0] < 0:
        return scan(v, centers, width)[0], np.full(len(v), -1, np.int32)
    new = old.fitted(width)
    new = Bounds(new.cluster.copy(), new.upper + drift[new.cluster], new.near.copy(), new.lower - drift[new.near], new.rest - drift.max())
    order = np.argsort(new.lower, 1, kind="stable")
    new.near, new.lower = np.take_along_axis(new.near, order, 1), np.take_along_axis(new.lower, order, 1)
    least = np.minimum(new.rest, new.lower[:, 0]) if new.lower.shape[1] else new.rest
    open_ = np.flatnonzero(~below(new.upper, least))
    new.upper[open_] = np.sqrt(squared_of(v[open_], centers, new.cluster[open_, None])[:, 0].astype(float))
    open_ = open_[~below(new.upper[open_], least[open_])]
    # What the listed centres can decide: the own distance is below all others.
    listed = open_[below(new.upper[open_], new.rest[open_])]
    if len(listed) and new.near.shape[1]:
        needed[listed] = (~below(new.upper[listed, None], new.lower[listed])).sum(1)
        which = np.concatenate([new.cluster[listed, None], new.near[listed]], 1)
        exact = squared_of(v[listed], centers, which)
        ranked = np.lexsort((which, exact), axis=1)
        which, root = np.take_along_axis(which, ranked, 1), np.sqrt(np.take_along_axis(exact, ranked, 1).astype(float))
        new.put(listed, Bounds(which[:, 0], root[:, 0], which[:, 1:], root[:, 1:], new.rest[listed]))
    unsure = np.setdiff1d(open_, listed)
    if len(unsure):
        scanned, _ = scan(v[unsure], centers, new.near.shape[1])
        new.put(unsure, scanned)
        needed[unsure] = -1
    return new, needed


def _round(state: DataFrame, centers: np.ndarray, drift: np.ndarray, width: int, last: bool) -> DataFrame:
    """``STATE`` after one assignment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            n = batch.num_rows
            v = np.asarray(batch["v"].flatten()).astype(np.int64).reshape(n, -1)
            if "cluster" in batch.schema.names:
                near, lower = (np.asarray(batch[c].flatten()).reshape(n, -1) for c in ("near", "lower"))
                old = Bounds(*(np.asarray(batch[c]) for c in ("cluster", "upper")), near, lower, np.asarray(batch["rest"]))
            else:
                old = Bounds.none(n)
            new, needed = assign(v, old, centers, drift, width)
            distance = squared_of(v, centers, new.cluster[:, None])[:, 0] if last else np.zeros(n, np.int64)
            lists = np.arange(n + 1, dtype=np.int32) * new.near.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["vec_id"],
                    batch["v"],
                    pa.array(new.cluster, pa.int32()),
                    pa.array(old.cluster, pa.int32()),
                    pa.array(distance),
                    pa.array(new.upper),
                    pa.ListArray.from_arrays(lists, pa.array(new.near.ravel(), pa.int32())),
                    pa.ListArray.from_arrays(lists, pa.array(new.lower.ravel(), pa.float64())),
                    pa.array(new.rest),
                    pa.array(needed),
                ],
                [c.split()[0] for c in STATE.split(", ")],
            )

    return state.mapInArrow(run, STATE)


def _moved(state: DataFrame, dim: int) -> list[tuple[int, int, list[int]]]:
    """(cluster, change of count, change of sums) by the vectors that moved: a row a cluster."""
    signed = F.explode(F.array(F.struct(F.col("cluster").alias("k"), F.lit(1).cast("bigint").alias("s")), F.struct(F.col("was").alias("k"), F.lit(-1).cast("bigint").alias("s"))))
    moves = state.filter("cluster <> was").select("v", signed.alias("m")).select("v", "m.k", "m.s").filter("k >= 0")
    sums = moves.groupBy("k").agg(F.sum("s").alias("n"), *[F.sum(F.col("s") * F.get("v", F.lit(i))).alias(f"x{i}") for i in range(dim)])
    return [(r[0], r[1], list(r[2:])) for r in sums.collect()]


def cluster_vectors(kept: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM, width: int | None = None) -> DataFrame:
    """A row for each of (vec_id, v): cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = kept.sparkSession
    state = materialize(kept, "drake-vectors")
    centers = starts(state, clusters, seed)
    count = len(centers)
    if not count:
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    width = max(count // 4, 1) if width is None else width
    totals, sizes = [[0] * dim for _ in range(count)], [0] * count
    drift = np.zeros(count)
    for i in range(rounds + 1):
        after = materialize(_round(state, centers, drift, width, i == rounds), "drake-state")
        remove_table(state)
        state = after
        if i == rounds:
            break
        for k, n, sums in _moved(state, dim):
            sizes[k] += n
            totals[k] = [a + b for a, b in zip(totals[k], sums, strict=True)]
        most = state.agg(F.max("needed")).first()[0]
        if i and most >= 0:
            width = min(width, max(most, count // 8, 1))
        moved = np.array([[t // sizes[k] for t in totals[k]] if sizes[k] else centers[k].tolist() for k in range(count)], np.int64)
        drift = np.sqrt(((moved - centers) ** 2).sum(1).astype(float)) * (1 + MARGIN / 100)
        centers = moved
    inertia = {r.cluster: r.inertia for r in state.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    facts = [(k, inertia.get(k, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for k, c in enumerate(centers)]
    # A row a cluster, whatever the input.
    known = F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"))
    return state.select("vec_id", "cluster", "distance").join(known, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster every whole vector of ``embeddings``."""
    return cluster_vectors(vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding")))


def _sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM) -> str:
    """The plain scan, a step a round."""
    parts = [
        f"""whole AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})""",
        "x AS MATERIALIZED (SELECT r, unnest(v) AS x, unnest(range(len(v))) AS i FROM whole)",
        f"""c0 AS MATERIALIZED (SELECT k, unnest(v) AS c, unnest(range(len(v))) AS i
  FROM (SELECT v, row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS k FROM whole) WHERE k < {clusters})""",
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT r, k, sum((x - c) * (x - c)) AS d FROM x JOIN c{n} USING (i) GROUP BY r, k) GROUP BY r)")
        if n < rounds:
            parts.append(f"""m{n} AS (SELECT k, i, sum(x) AS s, count(*) AS n FROM a{n} JOIN x USING (r) GROUP BY k, i),
c{n + 1} AS MATERIALIZED (SELECT k, i, coalesce((s - ((s % n) + n) % n) // n, c)::BIGINT AS c FROM c{n} LEFT JOIN m{n} USING (k, i))""")
    return f"""WITH {", ".join(parts)},
digests AS (SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
SELECT vec_id, k::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN whole USING (r) JOIN digests USING (k)"""


OP13_SQL = _sql()
