"""Centroid clustering: whole runs against brute force in whole numbers, ties, the annulus itself, odd vectors."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dispatchlake.llm import annulus as op

SCHEMA = "vec_id long, embedding array<float>, label int"


def naive(rows: list[tuple], k: int, rounds: int, width: int) -> tuple[list[tuple], list[list[int]]]:
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    at = [v for _, _, v in sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), i, v) for i, v in kept)[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for left in range(rounds, -1, -1):
        own = [min((square(v, c), n) for n, c in enumerate(at)) for _, v in kept]
        if left:
            for n in range(len(at)):
                mine = [v for (_, v), (_, c) in zip(kept, own, strict=True) if c == n]
                if mine:
                    at[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted((i, c, d) for (i, _), (d, c) in zip(kept, own, strict=True)), at


def vectors(n: int, width: int, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    middles = [[rng.uniform(-2, 2) for _ in range(width)] for _ in range(7)]
    return [(i, [float(np.float32(x + rng.gauss(0, 0.4))) for x in rng.choice(middles)]) for i in range(n)]


@pytest.mark.parametrize(("k", "rounds", "width"), [(16, 3, 64), (5, 4, 3), (40, 2, 2), (1, 1, 4), (3, 0, 2)])
def test_against_brute_force(spark, k, rounds, width):
    rows = vectors(300, width)
    rows += [(1000 + i, rows[0][1]) for i in range(100)]  # a hot cluster of copies
    rows += [(2000 + i, [i % 3 / 64.0] * width) for i in range(30)]  # many ties
    found, centroids = op.clusters(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(4), k, rounds, width)
    want, at = naive(rows, k, rounds, width)
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in found.collect()) == want
    assert centroids.at.tolist() == at


def test_the_annulus_holds_every_nearest_centroid_and_leaves_others_out():
    rng = np.random.default_rng(4)
    centroids = op.Centroids(np.concatenate([rng.integers(-2000, 2000, (60, 3)) * 10 ** rng.integers(0, 4, (60, 1)), [[3, 4, 0], [0, 0, 5], [5, 0, 0], [-5, 0, 0]]]))
    x = np.concatenate([rng.integers(-3000, 3000, (500, 3)), rng.integers(-3, 4, (200, 3)), [[0, 0, 0]]])
    every = ((x[:, None].astype(object) - centroids.at[None].astype(object)) ** 2).sum(2)
    for before in (None, rng.integers(0, 64, len(x)), every.argmin(1)):
        best, least, compared = centroids.nearest(x, before)
        assert [(int(d), int(c)) for d, c in zip(least, best, strict=True)] == [min((int(d), c) for c, d in enumerate(row)) for row in every]
    assert compared < 0.5 * every.size  # bounds from the vectors' own clusters spare most distances


def test_large_components_are_exact(spark):
    top = (op.REACH - 1) / 64
    rows = [(i, [s * top] * 64) for i, s in enumerate((1, -1, 1, -1, 0.5))]
    found = op.clustered(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA.replace("float", "double")), k=2).collect()
    want, _ = naive(rows, 2, op.ROUNDS, 64)
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in found) == want
    assert {r["inertia"] for r in found} == {sum(d for _, _, d in want)}


def test_odd_vectors_and_columns(spark):
    good = vectors(40, 64)
    odd = [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 65), (104, [None] + [1.0] * 63), (105, [float("nan")] * 64), (106, [float("inf")] + [0.0] * 63), (None, good[0][1]), (107, [0.0] * 64), (108, [1e30] * 64), good[3], good[3]]
    table = spark.createDataFrame([(*r, 1) for r in good + odd], SCHEMA).withColumns({"cluster": F.lit("theirs"), "v": F.lit(2), "distance": F.lit(None)})
    found = op.clustered(table)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    rows = found.collect()
    want, at = naive([*good, (107, [0.0] * 64), good[3], good[3]], 16, 3, 64)
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in rows) == want
    for r in rows:
        assert r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, at[r["cluster"]])).encode()).hexdigest()


def test_few_vectors_and_none(spark):
    few = vectors(3, 64)
    assert sorted((r["vec_id"], r["distance"]) for r in op.clustered(spark.createDataFrame([(*r, 0) for r in few], SCHEMA)).collect()) == [(0, 0), (1, 0), (2, 0)]
    assert op.clustered(spark.createDataFrame([], SCHEMA)).collect() == []
