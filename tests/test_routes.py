"""Routes: by a matrix of times, with gaps and legs that differ by direction, and of any length."""

import itertools
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dispatchlake.operators import route, tours

DAY = "2024-01-05"
STOP = "business_date string, stop_id long, status string, quarter string, lat double, lng double"


def stops_of(spark, points, quarters=None):
    rows = [(DAY, i, "pending", (quarters or {}).get(i), float(lat), float(lng)) for i, (lat, lng) in enumerate(points, 1)]
    return spark.createDataFrame(rows, STOP).withColumn("business_date", F.to_date("business_date"))


def start_of(spark):
    return spark.sql(f"SELECT DATE '{DAY}' AS business_date, 37.0 AS start_lat, 29.0 AS start_lng")


def times_of(spark, entries):
    rows = [(a, b, float(s) if s is not None else None) for (a, b), s in entries.items()]
    return spark.createDataFrame(rows, "a long, b long, seconds double").selectExpr(f"DATE '{DAY}' AS business_date", "*")


def test_a_matrix_changes_the_order(spark):
    stops = stops_of(spark, [(37.01, 29.0), (37.02, 29.0), (37.03, 29.0)])
    straight = route.build_routes(stops, start_of(spark)).first()
    assert (straight["stop_ids"], straight["matrix_source"], straight["gaps"]) == ([1, 2, 3], "straight line", 0)
    # over the mountain: 2 is reached by way of 3 only
    seconds = {(a, b): 60 for a in (None, 1, 2, 3) for b in (None, 1, 2, 3) if a != b} | {(1, 2): 3600, (None, 2): 3600}
    timed = route.build_routes(stops, start_of(spark), times_of(spark, seconds)).first()
    assert timed["stop_ids"] != [1, 2, 3] and timed["matrix_source"] == "matrix" and abs(timed["total_min"] - 3) < 1e-9
    assert (timed["stop_ids"].index(2) > 0) and timed["stop_ids"][timed["stop_ids"].index(2) - 1] == 3
    assert timed["total_m"] > straight["total_m"] - 1e-6  # metres stay an estimate along the route


def test_gaps_are_estimated(spark):
    stops = stops_of(spark, [(37.01, 29.0), (37.02, 29.0), (37.03, 29.0)])
    seconds = {(None, 1): 60, (1, 2): 60, (2, 1): None, (9, 1): 5}  # nothing leads to 3; 9 isn't on the route
    found = route.build_routes(stops, start_of(spark), times_of(spark, seconds)).first()
    assert sorted(found["stop_ids"]) == [1, 2, 3] and found["gaps"] == 1 and found["matrix_source"] == "matrix"
    legs, gaps = route.timed_legs([None, 1, 2, 3], pd.DataFrame([(None, 1, 60.0), (1, 2, 60.0), (2, 1, None)], columns=["a", "b", "seconds"]), np.full((4, 4), 7.0))
    assert gaps == 1 and legs[0, 1] == legs[1, 2] == route.SPEED_M_PER_MIN and legs[2, 1] == legs[3, 0] == 7.0


def test_routes_beyond_the_cap_have_no_matrix(spark):
    n = route.MATRIX_POINTS
    stops = stops_of(spark, [(37 + i / 1000, 29.0) for i in range(n)])
    found = route.build_routes(stops, start_of(spark), times_of(spark, {(1, 2): 60.0})).first()
    assert found["matrix_source"] == "straight line" and sorted(found["stop_ids"]) == list(range(1, n + 1))


def test_short_routes_with_legs_that_differ_by_direction_are_the_shortest():
    rng = np.random.default_rng(5)
    for n in (3, 5, 8):
        legs = rng.random((n + 1, n + 1)) * 5000
        groups = [None, *rng.choice(np.array(["a", "b", None], object), n)]
        order, method = route.solve(legs, groups)
        best = min(route.cost(list(p), legs, groups) for p in itertools.permutations(range(1, n + 1)))
        assert method == "exact" and abs(route.cost(order, legs, groups) - best) < 1e-6


@pytest.mark.parametrize(("n", "grouped", "places"), [(300, False, 0), (1500, False, 0), (1500, True, 0), (1500, True, 12), (2, False, 0), (1, True, 0)])
def test_long_routes_are_about_as_short_as_over_all_pairs(n, grouped, places):
    rng = np.random.default_rng(n)
    lat, lng = 37.7 + rng.random(n + 1) / 10, 29 + rng.random(n + 1) / 10
    if places:
        lat, lng = 37.7 + rng.integers(0, places, n + 1) / 100, 29 + rng.integers(0, places, n + 1) / 100
    groups = [None, *[f"{int(a * 79)} {int(b * 79)}" if grouped else None for a, b in zip(lat[1:] - 37.7, lng[1:] - 29, strict=True)]]
    legs = route.matrix(lat, lng)
    order = tours.tour(lat, lng, groups, route.ROAD_FACTOR, route.SPLIT_M)
    assert sorted(order) == list(range(1, n + 1))
    assert route.cost(order, legs, groups) <= 1.03 * route.cost(route.solve(legs, groups)[0], legs, groups)
    assert abs(route._along(lat, lng, order) - sum(legs[a, b] for a, b in zip([0, *order[:-1]], order, strict=True))) < 1e-3


def test_twenty_thousand_stops():
    rng = np.random.default_rng(3)
    lat, lng = 37.7 + rng.random(20_001) / 3, 29 + rng.random(20_001) / 3
    begin = time.perf_counter()
    order = tours.tour(lat, lng, [None, *[f"{int(a * 30)} {int(b * 30)}" for a, b in zip(lat[1:] - 37.7, lng[1:] - 29, strict=True)]], route.ROAD_FACTOR, route.SPLIT_M)
    assert sorted(order) == list(range(1, 20_001)) and time.perf_counter() - begin < 60
