"""Clusters against SQL's plain scan, and bounds against exact distances."""

import numpy as np
import pytest
from tests.llm.oracle import both

from codeloom.llm import drake

SCHEMA = "vec_id bigint, embedding array<float>, label int, cluster int, v string"


def plain(v, centers, rounds):
    """Lloyd's rounds in Python's integers."""
    for _ in range(rounds):
        near = [min(range(len(centers)), key=lambda k: (sum((a - b) ** 2 for a, b in zip(x, centers[k], strict=True)), k)) for x in v]
        centers = [[sum(c) // len(own) for c in zip(*own, strict=True)] if (own := [x for x, n in zip(v, near, strict=True) if n == k]) else centers[k] for k in range(len(centers))]
    return centers, [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(centers)) for x in v]


def rows(n, seed=1, spread=0.3):
    rnd = np.random.default_rng(seed)
    heart = rnd.normal(0, 1, (9, 64))
    return [(i, [float(x) for x in heart[i % 9] + rnd.normal(0, spread, 64)], 0, 1, "x") for i in range(n)]


def test_given_vectors_match_sql(spark):
    got, asked = both(spark, "op13_centroid_clusters", "/root/testdata/sf0.01", "embeddings")
    assert got == asked


def test_odd_vectors_match_sql(spark, folder):
    good = rows(130)
    bad = [(900, None, 0, 1, "x"), (901, [1.0] * 63, 0, 1, "x"), (902, [1.0] * 65, 0, 1, "x"), (903, [float("nan")] + [1.0] * 63, 0, 1, "x"), (904, [float("-inf")] + [1.0] * 63, 0, 1, "x"), (905, [None] + [1.0] * 63, 0, 1, "x"), (906, [], 0, 1, "x")]
    path = folder(embeddings=(good + bad + good[:30] + good[:3] + [(None, [0.1] * 64, 0, 1, "x"), (-5, [-0.001] * 64, 0, 1, "x")], SCHEMA))
    got, asked = both(spark, "op13_centroid_clusters", path, "embeddings")
    assert got == asked and sum(got.values()) == 165


def test_fewer_vectors_than_clusters(spark, folder):
    got, asked = both(spark, "op13_centroid_clusters", folder(embeddings=(rows(7) + rows(2), SCHEMA)), "embeddings")
    assert got == asked


@pytest.mark.parametrize("width", [1, 3, 7])
def test_rounds_match_a_plain_scan(width):
    rnd = np.random.default_rng(width)
    v = rnd.integers(-6, 7, (500, 3))
    centers = v[:8].copy()
    bounds, drift = drake.Bounds.none(len(v)), np.zeros(8)
    kept = scans = 0
    for i in range(8):
        bounds, needed = drake.assign(v, bounds, centers, drift, width)
        exact = ((v[:, None] - centers) ** 2).sum(2)
        assert (bounds.cluster == exact.argmin(1)).all()
        root = np.sqrt(exact)
        assert (bounds.upper >= root.min(1) - 1e-6).all()
        assert (bounds.lower <= np.take_along_axis(root, bounds.near.astype(int), 1) + 1e-6).all()
        others = np.ones_like(root, bool)
        np.put_along_axis(others, np.c_[bounds.cluster[:, None], bounds.near].astype(int), False, 1)
        assert (bounds.rest <= np.where(others, root, np.inf).min(1) + 1e-6).all()
        kept, scans = kept + (needed == 0).sum() * (i > 0), scans + (needed < 0).sum() * (i > 0)
        moved = np.array([np.floor_divide(v[bounds.cluster == k].sum(0), max((bounds.cluster == k).sum(), 1)) if (bounds.cluster == k).any() else centers[k] for k in range(8)])
        drift, centers = np.sqrt(((moved - centers) ** 2).sum(1)), moved
    assert kept > 0 and scans < 7 * len(v)


def test_ties_take_the_smaller_number(spark):
    """Equal centroids, and vectors half way between two."""
    v = [[0], [0], [2], [1], [1], [4], [3], [-1], [-2]]
    kept = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "vec_id bigint, v array<int>")
    for width in (1, 2, 5):
        out = {r.vec_id: r for r in drake.cluster_vectors(kept, 4, 3, 2, 1, width).collect()}
        _, want = plain(v, drake.starts(kept, 4).tolist(), 3)
        assert [(out[i].distance, out[i].cluster) for i in range(len(v))] == want
        assert out[0].inertia == sum(d for d, _ in want)


def test_large_components_are_exact(spark):
    rnd = np.random.default_rng(2)
    v = rnd.integers(-(1 << 24), 1 << 24, (60, 64)).tolist()
    kept = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "vec_id bigint, v array<int>")
    out = {r.vec_id: r for r in drake.cluster_vectors(kept, 5, 2).collect()}
    _, want = plain(v, drake.starts(kept, 5).tolist(), 2)
    assert [(out[i].distance, out[i].cluster) for i in range(60)] == want


def test_too_large_a_component_is_told(spark, folder):
    path = folder(embeddings=([(1, [1e9] * 64, 0, 1, "x")], SCHEMA))
    with pytest.raises(Exception, match="beyond"):
        drake.op13_centroid_clusters(spark, path).collect()


def test_empty(spark, folder):
    assert drake.op13_centroid_clusters(spark, folder(embeddings=([], SCHEMA))).collect() == []
    assert drake.op13_centroid_clusters(spark, folder(embeddings=([(1, None, 0, 1, "x")], SCHEMA))).collect() == []
