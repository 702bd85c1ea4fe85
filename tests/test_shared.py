"""Tables in the shared folder, and connected components over them."""

import random

import pytest
from pyspark.sql import functions as F

from dispatchlake.operators import graphs
from dispatchlake.sources import shared as storage


def test_a_cut_table_has_the_same_rows_and_goes_when_it_is_told_to(spark):
    table = spark.range(100).withColumn("odd", F.col("id") % 2 == 1)
    found = storage.cut(table)
    assert found.dtypes == table.dtypes and sorted(found.collect()) == sorted(table.collect())
    (folder,) = {f.rpartition("/")[0] for f in found.inputFiles()}
    assert storage.shared_folder(spark).removeprefix("file://") in folder
    storage.uncut(found)
    with pytest.raises(Exception, match="(?i)not.?exist|not.?found|no such"):
        spark.read.parquet(folder).count()
    empty = storage.cut(table.where("id < 0"))
    assert empty.collect() == []


def test_appended_rows_are_read_together(spark):
    path = f"{storage.shared_folder(spark)}/appended-test"
    for k in range(3):
        storage.append(spark.range(k, k + 1), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [0, 1, 2]


class Elsewhere:
    """A session on a cluster that names no shared folder."""

    class sparkContext:
        master = "spark://host:7077"
        applicationId = "x"

        @staticmethod
        def getConf():
            return {}


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_folder(Elsewhere)


def brute_components(edges: list[tuple]) -> dict:
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("kind", ["random", "path", "hub", "repeats"])
def test_components_against_union_find(spark, kind):
    rng = random.Random(kind)
    edges = {
        "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(330)],
        "path": [(k, k + 1) for k in rng.sample(range(60), 60)],
        "hub": [(-7, k) for k in range(500)] + [(k, 1000 + k) for k in range(0, 500, 50)],
        "repeats": [(1, 2), (2, 1), (1, 1), (5, 5), (3, 4), (4, 3), (4, 3)],
    }[kind]
    got = {r["node"]: r["component"] for r in graphs.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = brute_components([e for e in edges if e[0] != e[1]])
    assert {x: got.get(x, x) for x in want} == want


def test_components_of_nothing(spark):
    assert graphs.components(spark.createDataFrame([], "u long, v long")).collect() == []
