"""Neighbours at every latitude: grid cells against all pairs; days merged as by the plain rules wherever they are."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from dispatchlake.functions import geo
from dispatchlake.operators import ledger, merge

from .test_operators import DAY, naive_merge

LATITUDES = (0.0, 37.7, -37.7, 59.9, 60.1, 75.0, 85.0, -88.0, 89.99, 89.9999, -89.9999)


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * geo.EARTH_M * math.asin(math.sqrt(min(1, h)))


def points(seed: int) -> list[tuple[float, float]]:
    """Clusters some ten metres across at many latitudes, and on both sides of the date line."""
    rng = random.Random(seed)
    out = []
    for lat in LATITUDES:
        for lng in (29.0, 180.0, -0.00001):
            for _ in range(8):
                y = max(-90.0, min(90.0, lat + rng.uniform(-0.0004, 0.0004)))
                x = lng + rng.uniform(-0.0004, 0.0004) / max(1e-6, math.cos(math.radians(y)))
                out.append((y, (x + 180) % 360 - 180))
    return out


def test_near_points_are_those_of_all_pairs(spark):
    where = points(1)
    table = spark.createDataFrame([(DAY, i, *p) for i, p in enumerate(where)], "business_date date, stop_id long, lat double, lng double")
    found = {(r["a"], r["b"]) for r in ledger.near_points(table, 30.0).collect()}
    want = {(i, j) for i in range(len(where)) for j in range(i + 1, len(where)) if metres(where[i], where[j]) < 30}
    assert found == want and len(want) > 100


def scans_of(spark, where, seed=2):
    rng = random.Random(seed)
    names = ["doc_no", "name", "phone", "product", "pieces", "district", "lat", "lng", "confidence", "grade", "warnings", "raw_text"]
    rows = [dict(zip(names, (rng.choice([None, None, f"d{rng.randrange(80)}"]), rng.choice([None, "ALI", "ali", "İpek"]), None, rng.choice([None, "A", "B"]), rng.choice([None, 1, 3]), rng.choice(["x", None]), *p, rng.choice([0, 40, 80]), "red", None, f"t{i}"), strict=True)) for i, p in enumerate(where)]
    schema = "business_date date, ts timestamp_ntz, stop_id int, doc_no string, name string, phone string, product string, pieces int, district string, lat double, lng double, confidence int, grade string, warnings array<string>, raw_text string"
    return rows, spark.createDataFrame([(DAY, dt.datetime(2024, 1, 5, 9) + dt.timedelta(seconds=i), i, *r.values()) for i, r in enumerate(rows)], schema)


@pytest.mark.parametrize("split", [False, True])
def test_days_are_merged_by_the_plain_rules_at_every_latitude(spark, split):
    where = points(3)
    random.Random(5).shuffle(where)
    rows, table = scans_of(spark, where)
    got = sorted(merge.merge_scans(merge.scans(table), split).collect(), key=lambda r: r["stop_id"])
    want = naive_merge(rows)
    assert len(got) == len(want) < len(rows)
    for g, w in zip(got, want, strict=True):
        assert [g[k] or None for k in ("doc_no", "name", "product", "pieces", "lat", "lng", "confidence", "frames")] == [w[k] or None for k in ("doc_no", "name", "product", "pieces", "lat", "lng", "confidence", "frames")]


def test_two_scans_sixteen_metres_apart_at_75_degrees(spark):
    rows, table = scans_of(spark, [(75.0, 29.0), (75.0, 29.00055)], seed=1)
    table = table.drop("doc_no", "name")
    assert metres((75.0, 29.0), (75.0, 29.00055)) < 16
    assert merge.merge_scans(merge.scans(table)).count() == 1


def test_whole_days_of_the_given_table(spark):
    from dispatchlake.sources import proxies

    # the plain rules here compare letters alone
    stops = proxies.stops(spark, "/root/testdata/sf0.01").withColumn("name", F.regexp_replace("name", " +", " "))
    table = merge.scans(stops).orderBy("business_date", "ts", "scan_id")
    days: dict = {}
    for r in table.collect():
        days.setdefault(r["business_date"], []).append(r.asDict())
    got: dict = {}
    for r in merge.merge_scans(table).collect():
        got.setdefault(r["business_date"], {})[r["stop_id"]] = r
    for day in sorted(days)[:6]:
        want = naive_merge(days[day])
        assert sorted(got[day]) == list(range(1, len(want) + 1))
        for i, w in enumerate(want, 1):
            assert [got[day][i][k] or None for k in ("doc_no", "name", "product", "pieces", "lat", "lng", "confidence", "frames", "grade")] == [w[k] or None for k in ("doc_no", "name", "product", "pieces", "lat", "lng", "confidence", "frames", "grade")]
