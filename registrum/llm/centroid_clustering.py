"""Centroid clustering of whole-number vectors, by equal-average equal-variance search.

Vectors with exactly ``DIMENSIONS`` finite components become whole numbers floor(1024 * x).
Starts are the vectors whose ids have the smallest SHA-256. Each round assigns every vector
to the nearest centroid (squared distance, ties to the smaller number) and moves centroids to
the floor of the mean of their vectors; all arithmetic is exact.

Search. Centroids are sorted by the sum of their components. A vector starts at its own sum
and scans outward, always to the nearer of the next two. With S the sum of components and
W = d * (sum of squares) - S ** 2 (d times the squared deviation), d times the squared
distance is at least (S - S') ** 2, and at least that plus (sqrt W - sqrt W') ** 2. Once the
first bound exceeds the best distance the scan ends, if the second does the centroid is passed over;
what is left gets its distance in whole numbers. Roots are lowered by one before they reject,
so rounding never does. All vectors of a batch scan in step.

Per round one pass over the vectors adds up count and sums per centroid and task; the driver
sees ``k`` rows of ``DIMENSIONS`` sums. Rounds end early once nothing moves, which changes nothing.

Defined cases: null vectors, other lengths and vectors with a null or non-finite component are
left out; a component beyond ``BOUND`` in size is an error, as distances would leave 64 bits.
Rows with the same ``vec_id`` count each (ties between starts go to the smaller vector); rows with a null ``vec_id`` are clustered but never
start. Equal vectors may make equal centroids, of which the smaller number takes all. With
fewer than ``k`` vectors to start from there are fewer centroids; without any, no rows. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registrum.llm.common import batches, only, shared_folder, written

CENTROIDS, ROUNDS, SEED, DIMENSIONS, SCALE = 8, 10, 3, 64, 1024
#: Components stay below this size, so that 64 squared differences fit 63 bits.
BOUND = 1 << 17


def whole(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the vectors that are kept."""
    size = F.size("embedding") == DIMENSIONS
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))

    def number(x):
        big = F.raise_error(F.lit(f"a component is not below {BOUND} in size")).cast("int")
        return F.when(F.abs(x) >= BOUND, big).otherwise(F.floor(x.cast("double") * SCALE).cast("int"))

    return only(vectors, "vec_id", "embedding").where(size & finite).select("vec_id", F.transform("embedding", number).alias("x"))


def starts(kept: DataFrame, k: int = CENTROIDS) -> np.ndarray:
    order = F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.where("vec_id IS NOT NULL").orderBy(order, "x").limit(k).select("x").collect()
    return np.array([r["x"] for r in rows], np.int64).reshape(-1, DIMENSIONS)


class Search:
    """Nearest of some centroids."""

    def __init__(self, centroids: np.ndarray):
        self.order = np.argsort(centroids.sum(1), kind="stable")
        self.centroids = centroids[self.order]
        self.sums, self.roots = spread(self.centroids)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and squared distance, for each row."""
        sums, roots = spread(x)
        best = np.full(len(x), np.iinfo(np.int64).max)
        number = np.full(len(x), len(self.centroids))
        high = np.searchsorted(self.sums, sums)
        low = high - 1
        rows = np.arange(len(x))
        far = np.float64(np.inf)
        while len(rows):
            below = np.where(low[rows] >= 0, sums[rows] - self.sums[low[rows]], far)
            above = np.where(high[rows] < len(self.sums), self.sums[np.minimum(high[rows], len(self.sums) - 1)] - sums[rows], far)
            apart = np.minimum(below, above)  # whole numbers below 2 ** 53, so exact
            going = (apart < far) & bounded(apart, 0.0, best[rows])
            rows, down, apart = rows[going], (below <= above)[going], apart[going]
            at = np.where(down, low[rows], high[rows])
            low[rows[down]] -= 1
            high[rows[~down]] += 1
            able = bounded(apart, np.maximum(np.abs(roots[rows] - self.roots[at]) - 1, 0), best[rows])
            tried, at = rows[able], at[able]
            distance = ((x[tried] - self.centroids[at]) ** 2).sum(1)
            closer = (distance < best[tried]) | (distance == best[tried]) & (self.order[at] < number[tried])
            best[tried[closer]], number[tried[closer]] = distance[closer], self.order[at[closer]]
        return number, best


def spread(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the components, and root of d times the squared deviation, of each row."""
    sums = x.sum(1)
    centred = x - sums[:, None] / DIMENSIONS
    return sums, np.sqrt(DIMENSIONS * (centred**2).sum(1))


def bounded(apart: np.ndarray, roots: np.ndarray | float, best: np.ndarray) -> np.ndarray:
    """Whether the bounds leave room for a distance up to ``best``; rounding errs to the side of room."""
    return (apart**2 + roots**2) * (1 - 1e-12) <= DIMENSIONS * best.astype(np.float64)


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, DIMENSIONS).astype(np.int64)


def moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round."""
    search = Search(centroids)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches(rows):
            x = matrix(batch)
            number, _ = search.nearest(x)
            for c in np.unique(number):
                sums[c] += x[number == c].sum(0)
            counts += np.bincount(number, minlength=len(counts))
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(counts[full]), pa.array(list(sums[full]), pa.list_(pa.int64()))], ["cluster", "count", "sums"])

    parts = kept.select("x").mapInArrow(run, "cluster int, count long, sums array<long>").select("cluster", "count", F.posexplode("sums").alias("i", "sum"))
    total = F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum")
    out = centroids.copy()
    for r in parts.groupBy("cluster", "i").agg(F.sum("count").alias("count"), total).collect():
        out[r["cluster"], r["i"]] = int(r["sum"]) // r["count"]
    return out


def assigned(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    search = Search(centroids)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            number, distance = search.nearest(matrix(batch))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return kept.mapInArrow(run, f"vec_id {dict(kept.dtypes)['vec_id']}, cluster int, distance long")


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, cluster_inertia, inertia) of every vector, and the centroids."""
    folder = shared_folder(vectors.sparkSession)
    kept = written(whole(vectors), f"{folder}/vectors")
    centroids = starts(kept, k)
    for _ in range(rounds):
        now = moved(kept, centroids) if len(centroids) else centroids
        if (now == centroids).all():
            break
        centroids = now
    if not len(centroids):
        none = kept.where("false").select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")])
        return none, centroids
    found = written(assigned(kept, centroids), f"{folder}/assigned")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()
    total = sum(int(r["own"]) for r in sums)
    own = F.element_at(F.create_map(*[F.lit(v) for r in sums for v in (r["cluster"], int(r["own"]))]), F.col("cluster"))
    return found.withColumn("cluster_inertia", own.cast("long")).withColumn("inertia", F.lit(total).cast("long")), centroids


def digests(centroids: np.ndarray) -> list[str]:
    return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
