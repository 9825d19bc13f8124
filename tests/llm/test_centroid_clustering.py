"""Centroid clustering against plain loops of whole numbers."""

import hashlib
import math

import numpy as np
import pytest
from registrum.llm import centroid_clustering as cc
from registrum.llm.queries import QUERIES
from test_llm import empty

SCHEMA = "vec_id long, embedding array<float>, x string, cluster string, distance string"


def brute(data, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in data if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in named[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        sums = {j: [v for (_, v), o in zip(kept, own, strict=True) if o == j] for j in set(own)}
        centroids = [[sum(x) // len(sums[j]) for x in zip(*sums[j], strict=True)] if j in sums else c for j, c in enumerate(centroids)]
    found = [(i, *nearest(v)) for i, v in kept]
    total = sum(d for _, d, _ in found)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, sum(x for _, x, y in found if y == j), total, digest[j]) for i, d, j in found), key=repr)


def test_registered_query(spark, small):
    rows = QUERIES["op13_centroid_clustering"](spark, small)
    assert rows.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert dict(rows.dtypes)["cluster"] == "int" and dict(rows.dtypes)["inertia"] == "bigint"
    data = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert sorted(map(tuple, rows.collect()), key=repr) == brute(data)


def shaped(spark, data):
    return spark.createDataFrame([(i, v, "x", "c", "d") for i, v in data], SCHEMA)


def test_defined_cases(spark):
    pick = np.random.default_rng(6)
    data = [(i, pick.normal(size=64).astype(np.float32).tolist()) for i in range(40)]
    data += [(50, None), (51, [1.0] * 63), (52, [1.0] * 63 + [None]), (53, [float("nan")] * 64), (54, [float("inf")] + [0.0] * 63), (None, [0.5] * 64)]
    data += [(60 + i, [0.25] * 64) for i in range(30)] + [(60, [0.25] * 64)]  # equal vectors, equal centroids, repeated ids
    docs = shaped(spark, data)
    found, centroids = cc.clusters(docs)
    got = sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, cc.digests(centroids)[r.cluster]) for r in found.collect()), key=repr)
    assert got == brute(data)
    few, _ = cc.clusters(shaped(spark, data[:3]))
    assert sorted(r.distance for r in few.collect()) == [0, 0, 0]
    assert cc.clusters(empty(docs))[0].count() == 0
    assert cc.clusters(shaped(spark, [(None, [0.5] * 64)]))[0].count() == 0
    with pytest.raises(Exception, match="not below"):
        cc.clusters(shaped(spark, [(1, [3e9] * 64)]))


def test_search_is_exact_and_passes_over():
    """Nearest by all distances, ties to the smaller number, for centroids that often tie."""
    pick = np.random.default_rng(7)
    for high in (2, 9, 1 << 26):
        centroids = pick.integers(-high, high, (50, 64))
        centroids[20:30] = centroids[:10]
        x = np.vstack([pick.integers(-high, high, (500, 64)), centroids])
        number, distance = cc.Search(centroids).nearest(x)
        every = ((x[:, None] - centroids) ** 2).sum(2)
        assert (distance == every.min(1)).all() and (number == every.argmin(1)).all()
