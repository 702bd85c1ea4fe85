"""Centroid clustering by annulus search, in whole numbers.

A vector's components become floor(scale * x). Each round assigns every vector to its nearest centroid and moves each
centroid to the floor of its vectors' mean. Centroids are sorted by norm. A vector's distance to the centroid it was in is
an upper bound u of the distance to its nearest one (in the first round: to the centroid that is nearest by norm). Since two
points are no nearer than their norms, only centroids whose norms are within the annulus [|x| - u, |x| + u] can be as near:
a binary search finds them, and they are compared exactly, those at its edges, and so every tie, included. Norms are rounded,
so the annulus is wider by more than their error; distances and sums are exact.

Vectors are a table in the shared folder, rewritten with their cluster each round, so a lost executor costs its own tasks.
A task sums its vectors by cluster; what the driver gets is ``k`` centroids' sums, whatever the table's size, and a cluster
with a third of all vectors is no task of its own.

Edge cases: vectors of another length than ``width``, null ones and ones with null or non-finite components take no part;
neither do rows with null vec_id, which have no hash, nor vectors with a component beyond ``REACH``, whose distances aren't
sure to be longs; repeated rows are vectors each; with fewer vectors than ``k`` there are as many centroids; an empty table
gives no rows; extra columns are not read.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut, uncut

K, ROUNDS, WIDTH, SCALE, SEED = 16, 3, 64, 64, "1:"
#: Greatest component (after scaling): a squared distance of WIDTH such components is below 2**63.
REACH = 1 << 27
_STATE = "vec_id long, v array<long>, cluster int, distance long"


def whole(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors that take part, as whole numbers."""
    x = F.col("embedding").cast("array<double>")
    near = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(REACH / scale)))
    kept = vectors.where(F.col("vec_id").isNotNull() & (F.size(x) == width) & near)
    return kept.select(F.col("vec_id").cast("long"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), -1)


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(1)


@dataclass
class Centroids:
    """Centroids and their order by norm."""

    at: np.ndarray  # a row of whole numbers each

    def __post_init__(self):
        norms = np.sqrt((self.at.astype(np.float64) ** 2).sum(1))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]

    def annulus(self, norms: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds, in the order by norm, of the centroids that can be within ``bound`` of a vector of each norm."""
        slack = 1e-9 * (norms + bound + self.norms[-1]) + 1e-9  # far above the rounding error of the three
        return np.searchsorted(self.norms, norms - bound - slack, "left"), np.searchsorted(self.norms, norms + bound + slack, "right")

    def nearest(self, x: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Each row's nearest centroid (ties: the smaller number), the squared distance, and how many distances were computed."""
        norms = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        if before is None:
            right = np.searchsorted(self.norms, norms).clip(0, len(self.norms) - 1)
            left = (right - 1).clip(0)
            before = self.order[np.where(np.abs(self.norms[left] - norms) <= np.abs(self.norms[right] - norms), left, right)]
        best, least = before.astype(np.int64), _square(x, self.at[before])
        low, high = self.annulus(norms, np.sqrt(least.astype(np.float64)))
        compared = len(x)
        for j in range(int(low.min(initial=0)), int(high.max(initial=0))):
            c = self.order[j]
            rows = np.flatnonzero((low <= j) & (j < high) & (before != c))
            if len(rows):
                compared += len(rows)
                d = _square(x[rows], self.at[c])
                nearer = (d < least[rows]) | ((d == least[rows]) & (c < best[rows]))
                best[rows[nearer]], least[rows[nearer]] = c, d[nearer]
        return best, least, compared


def _assigned(centroids: Centroids):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                before = batch["cluster"].to_numpy() if "cluster" in batch.schema.names else None
                best, least, _ = centroids.nearest(_matrix(batch["v"]), before)
                yield pa.record_batch([batch["vec_id"], batch["v"], pa.array(best, pa.int32()), pa.array(least, pa.int64())], names=["vec_id", "v", "cluster", "distance"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's sums by cluster: the components' as exact decimals in text, since they may outgrow a long."""
    sums: dict[int, list] = {}
    for batch in batches:
        if not len(batch):
            continue
        x, own = _matrix(batch["v"]), batch["cluster"].to_numpy()
        by = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.diff(own[by], prepend=-1))
        for c, s, n in zip(own[by][first].tolist(), np.add.reduceat(x[by], first, axis=0), np.diff(np.append(first, len(own))).tolist(), strict=True):
            held = sums.setdefault(c, [0, np.zeros(x.shape[1], object)])
            held[0] += n
            held[1] = held[1] + s.astype(object)
    rows = [(c, i, str(v)) for c, (n, s) in sums.items() for i, v in enumerate([n, *s])]
    yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], names=["cluster", "i", "s"])


def _moved(state: DataFrame, centroids: Centroids) -> Centroids:
    """Centroids at the floors of their vectors' means; empty ones stay."""
    sums = state.mapInArrow(_summed, "cluster int, i int, s string").groupBy("cluster", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = {(r["cluster"], r["i"]): int(r["s"]) for r in sums.collect()}
    at = centroids.at.copy()
    for c in {c for c, _ in found}:
        at[c] = [found[c, i + 1] // found[c, 0] for i in range(at.shape[1])]
    return Centroids(at)


def seeds(vectors: DataFrame, k: int = K, seed: str = SEED) -> Centroids | None:
    """The ``k`` vectors with the least hashes of seed and vec_id; None without vectors."""
    order = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.orderBy(order, "vec_id", "v").limit(k).select("v").collect()
    return Centroids(np.array([r["v"] for r in rows], np.int64)) if rows else None


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, Centroids | None]:
    """(vec_id, v, cluster, distance) of every vector that takes part, and the centroids after ``rounds`` moves."""
    spark = vectors.sparkSession
    state = cut(whole(vectors, width, scale))
    centroids = seeds(state, k, seed)
    if centroids is None:
        return spark.createDataFrame([], _STATE), None
    for left in range(rounds, -1, -1):
        after = cut(state.mapInArrow(_assigned(centroids), _STATE))
        uncut(state)
        state = after
        if left:
            centroids = _moved(state, centroids)
    return state, centroids


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def clustered(vectors: DataFrame, **parameters) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256); parameters as of :func:`clusters`."""
    state, centroids = clusters(vectors, **parameters)
    # a row for each of the k centroids, as long as no sum outgrows a long
    inertia = {r["cluster"]: int(r["s"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = sum(inertia.values())
    table = vectors.sparkSession.createDataFrame([(c, s, total, digest(centroids.at[c])) for c, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
