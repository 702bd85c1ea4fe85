"""The permutation index: odd vectors, exactness of what it returns, recall against brute force."""

import math

import numpy as np
import pytest

from dispatchlake.llm import ann as op

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows: dict[int, np.ndarray], asked: list[int], k: int) -> dict[int, list[tuple]]:
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids], np.float64)
    out = {}
    for q in asked:
        d = np.sqrt(((x - np.asarray(rows[q], np.float64)) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), d[i]) for i in order]
    return out


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 1.0]), (8, [5.0, 5.0, 5.0]), (9, []), (100, [3.0, 0.0]), (200, [0.0, 0.0]), (None, [1.0, 1.0])]
    table = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in op.nearest(table, table.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()]
    five = math.sqrt(5)
    assert got == [(0, 1, 1, 1.0), (0, 2, 7, 1.0), (0, 3, 100, 2.0), (100, 1, 0, 2.0), (100, 2, 1, five), (100, 3, 7, five)]


@pytest.mark.parametrize(("rerank", "least"), [(op.RERANK, op.LEAST), (1.0, 1)])
def test_recall_and_exact_scores(spark, rerank, least):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in table.collect() if r["embedding"] and all(x is not None and math.isfinite(x) for x in r["embedding"]) and any(r["embedding"])}
    asked = [i for i in rows if i % 100 == 0]
    want = brute(rows, asked, 10)
    found = {}
    for r in op.nearest(table, table.where("vec_id % 100 = 0"), rerank=rerank, least=least).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(found) == set(asked)
    for q in asked:
        assert sorted(found[q]) == list(range(1, 11))
        for i, score in found[q].values():
            assert math.isclose(score, np.linalg.norm(rows[i] - rows[q]), rel_tol=1e-12)
    hits = sum(len({i for i, _ in found[q].values()} & {i for i, _ in want[q]}) for q in asked)
    assert op.LEAST < len(rows)  # not all of them are compared exactly
    assert hits >= (1.0 if rerank == 1 else 0.9) * 10 * len(asked)


def test_recall_where_a_tenth_of_a_block_is_compared(spark):
    """Blocks of more vectors than LEAST / RERANK, of made-up clusters that overlap."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 64))[rng.integers(0, 30, 12_000)] * 0.6 + rng.normal(size=(12_000, 64))
    rows = {i: v for i, v in enumerate(x.astype(np.float32))}
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in rows.items()], SCHEMA).repartition(2)
    want = brute(rows, [i for i in rows if i % 100 == 0], 10)
    got: dict[int, set] = {}
    for r in op.nearest(table, table.where("vec_id % 100 = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert sum(len(got[q] & {i for i, _ in w}) for q, w in want.items()) >= 0.9 * 10 * len(want)


def test_sets_of_queries_are_answered_one_after_another(spark, monkeypatch):
    source = spark.read.parquet(f"{DATA}/embeddings.parquet")
    table = spark.createDataFrame(source.limit(120).collect(), source.schema)
    asked = table.where("vec_id % 5 = 0")
    asked = asked.unionByName(asked.limit(3))
    want = sorted(map(tuple, op.nearest(table, asked).collect()))
    monkeypatch.setattr(op, "QUERY_SET", 6)
    found = op.nearest(table, asked)
    assert len({r[0] for r in want}) > 18
    # the result is read from the shared folder: no set's vectors are in its plan
    assert "MapInArrow" not in found._jdf.queryExecution().toString()
    assert sorted(map(tuple, found.collect())) == want


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert op.nearest(none, none).collect() == []
