"""Ordering stops into a route (own design; the objective's constants are given).

An open path from the start. A leg costs its matrix entry (the metres that would be driven in that time, so legs may differ by
direction), or ROAD_FACTOR times the straight line; every further run of a quarter that was left before costs SPLIT_M. Up to
EXACT stops the order is optimal (dynamic programming over subsets would ignore runs, so it is a branch-and-bound); up to DENSE, or with
a matrix, nearest neighbour, then 2-opt and moves of single stops, while any of them helps; longer routes go by candidate
neighbours (``tours``), in space that grows with the stops. Ties go to the earlier stop.

A run costs half its price where it begins and half where it ends, so the whole objective is a sum over the path's
edges, and what a change saves is known from the edges that it replaces.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_M, metres
from .ledger import DAY
from .tours import tour

# Fixed values.
ROAD_FACTOR, SPLIT_M = 1.35, 1000.0
EXACT = 8
#: Stops up to which all pairs of a route are looked at.
DENSE = 200
SPEED_M_PER_MIN = 500.0
#: Most points, with the start, of which the road service is asked for a matrix (its own cap isn't known).
MATRIX_POINTS = 50
ROUTE_SCHEMA = "stop_ids array<long>, split_groups array<string>, total_m double, total_min double, method string, matrix_source string, gaps int"


def matrix(lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    """Road metres between all points of one route, estimated."""
    p, q = np.radians(lat), np.radians(lng)
    h = np.sin((p[:, None] - p) / 2) ** 2 + np.cos(p)[:, None] * np.cos(p) * np.sin((q[:, None] - q) / 2) ** 2
    return ROAD_FACTOR * 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(1, h)))


def cost(order: list[int], legs: np.ndarray, groups: list[str | None]) -> float:
    """Metres along ``order`` (indices from 1; 0 is the start) and the price of split groups."""
    total, at, seen, last = 0.0, 0, set(), None
    for i in order:
        total += legs[at, i]
        g = groups[i]
        if g is not None and g != last and g in seen:
            total += SPLIT_M
        if g is not None:
            seen.add(g)
        at, last = i, g
    return total


def _exact(legs: np.ndarray, groups: list[str | None]) -> list[int]:
    n = len(legs) - 1
    best: tuple[float, list[int]] = (math.inf, [])
    least = np.where(np.eye(n + 1, dtype=bool), math.inf, legs).min(0)

    def extend(order: list[int], total: float, free: list[int], seen: frozenset, last: str | None) -> None:
        nonlocal best
        if not free:
            if total < best[0] - 1e-9:
                best = (total, order)
            return
        if total + sum(least[i] for i in free) >= best[0]:
            return
        at = order[-1] if order else 0
        for i in sorted(free, key=lambda i: (legs[at, i], i)):
            g = groups[i]
            more = legs[at, i] + (SPLIT_M if g is not None and g != last and g in seen else 0)
            extend([*order, i], total + more, [j for j in free if j != i], seen | {g} if g is not None else seen, g)

    extend([], 0.0, list(range(1, n + 1)), frozenset(), None)
    return best[1]


def _edges(legs: np.ndarray, groups: list[str | None]) -> np.ndarray:
    """The price of each edge; the last point is the path's end. Along a path they add up to its ``cost`` and the price of each group's first run."""
    n = len(legs)
    numbers: dict[str, int] = {}
    group = np.array([-1 if g is None else numbers.setdefault(g, len(numbers)) for g in groups] + [-1])
    own = group >= 0
    out = SPLIT_M / 2 * np.where(group[:, None] == group, 0.0, own[:, None] * 1.0 + own)
    out[:n, :n] += legs
    return out


def _improved(path: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A path from the first point to the last that no 2-opt and no move of a single stop makes cheaper."""
    n = len(path) - 2

    def turning(path: np.ndarray) -> np.ndarray:
        # what the edges up to each place cost more when they are walked the other way
        return np.concatenate(([0.0], np.cumsum(edges[path[1:], path[:-1]] - edges[path[:-1], path[1:]])))

    while True:
        better = False
        turned = turning(path)
        for i in range(n - 1):
            # path[i + 1..j] turned round
            a, b, c, d = path[i], path[i + 1], path[i + 2 : n + 1], path[i + 3 :]
            more = edges[a, c] + edges[b, d] - edges[a, b] - edges[c, d] + turned[i + 2 : n + 1] - turned[i + 1]
            k = int(more.argmin())
            if more[k] < -1e-6:
                path[i + 1 : i + 3 + k] = path[i + 1 : i + 3 + k][::-1].copy()
                turned, better = turning(path), True
        for i in range(1, n + 1):
            stop, rest = path[i], np.delete(path, i)
            added = edges[rest[:-1], stop] + edges[stop, rest[1:]] - edges[rest[:-1], rest[1:]]
            k = int(added.argmin())
            if added[k] < added[i - 1] - 1e-6:
                path, better = np.insert(rest, k + 1, stop), True
        if not better:
            return path


def solve(legs: np.ndarray, groups: list[str | None]) -> tuple[list[int], str]:
    """The order of the points 1..n, and the method."""
    n = len(legs) - 1
    if n <= EXACT:
        return _exact(legs, groups), "exact"
    open_, at, order = np.append(np.inf, np.zeros(n)), 0, []
    for _ in range(n):
        at = int((legs[at] + open_).argmin())  # ties to the earlier stop
        open_[at] = np.inf
        order.append(at)
    path = _improved(np.array([0, *order, n + 1]), _edges(legs, [None, *groups[1:]]))
    return path[1:-1].tolist(), "nearest neighbour, 2-opt"


def split_groups(order: list[int], groups: list[str | None]) -> list[str]:
    runs: dict[str, int] = {}
    last = None
    for i in order:
        g = groups[i]
        if g is not None and g != last:
            runs[g] = runs.get(g, 0) + 1
        last = g
    return sorted(g for g, n in runs.items() if n > 1)


def _along(lat: np.ndarray, lng: np.ndarray, order: list[int]) -> float:
    """Road metres along a route, estimated."""
    p, q = np.radians(lat[[0, *order]]), np.radians(lng[[0, *order]])
    h = np.sin(np.diff(p) / 2) ** 2 + np.cos(p[1:]) * np.cos(p[:-1]) * np.sin(np.diff(q) / 2) ** 2
    return float((ROAD_FACTOR * 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(1, h)))).sum())


def timed_legs(ids: list[int | None], rows: pd.DataFrame, estimated: np.ndarray) -> tuple[np.ndarray, int]:
    """Legs out of a matrix's ``rows`` (a, b, seconds), as metres at SPEED_M_PER_MIN; missing ones are estimated. And how many points no row connects."""
    place = {i: k for k, i in enumerate(ids)}
    found = np.full(estimated.shape, np.nan)
    for a, b, seconds in zip(rows["a"], rows["b"], rows["seconds"], strict=True):
        k, m = place.get(None if pd.isna(a) else int(a)), place.get(None if pd.isna(b) else int(b))
        if k is not None and m is not None and k != m and not pd.isna(seconds):
            found[k, m] = seconds / 60 * SPEED_M_PER_MIN
    alone = np.isnan(found).all(0) & np.isnan(found).all(1)
    return np.where(np.isnan(found), estimated, found), int(alone.sum())


def _route(keys: list[str]):
    def run(key: tuple, rows: pd.DataFrame, times: pd.DataFrame) -> pd.DataFrame:
        columns = [*keys, *(c.split()[0] for c in ROUTE_SCHEMA.split(", "))]
        if not len(rows):
            return pd.DataFrame(columns=columns)
        rows = rows.sort_values("stop_id", kind="stable")
        lat = np.concatenate(([rows["start_lat"].iloc[0]], rows["lat"]))
        lng = np.concatenate(([rows["start_lng"].iloc[0]], rows["lng"]))
        groups: list[str | None] = [None, *[g if isinstance(g, str) and g else None for g in rows["quarter"]]]
        ids, gaps = rows["stop_id"].tolist(), 0
        timed = len(times) > 0 and len(ids) + 1 <= MATRIX_POINTS
        if timed or len(ids) <= DENSE:
            legs = matrix(lat, lng)
            if timed:
                legs, gaps = timed_legs([None, *ids], times, legs)
            order, method = solve(legs, groups)
            length = float(sum(legs[a, b] for a, b in zip([0, *order[:-1]], order, strict=True)))
        else:
            order, method = tour(lat, lng, groups, ROAD_FACTOR, SPLIT_M), "candidates, 2-opt"
            length = _along(lat, lng, order)
        found = [[ids[i - 1] for i in order], split_groups(order, groups), _along(lat, lng, order), length / SPEED_M_PER_MIN, method, "matrix" if timed else "straight line", gaps]
        return pd.DataFrame([[*key, *found]], columns=columns)

    return run


def build_routes(stops: DataFrame, starts: DataFrame, times: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """A route per day (or ``keys``) over its pending stops with coordinates.

    ``starts``: business_date, start_lat, start_lng. ``times``: keys, a, b, seconds from stop a to stop b, null for the start; routes
    within the cap of points that have rows there are ordered by time, all others by the straight line. total_m is the estimate along the route
    in either case; total_min comes from the matrix where it has entries; gaps: points that no entry connects.
    """
    keys = keys or [DAY]
    rows = stops.where("status = 'pending' and lat is not null").join(starts.where("start_lat is not null"), DAY)
    points = [F.col(c).cast("double").alias(c) for c in ("lat", "lng", "start_lat", "start_lng")]
    rows = rows.select(*keys, F.col("stop_id").cast("long"), "quarter", *points)
    if times is None:
        times = rows.where("false").select(*keys, F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("seconds"))
    times = times.select(*keys, F.col("a").cast("long"), F.col("b").cast("long"), F.col("seconds").cast("double"))
    # routes beyond the cap have no use for their rows
    times = times.join(within_matrix_cap(rows, keys).where("within_cap"), keys, "left_semi").withColumnsRenamed({k: f"of_{k}" for k in keys})
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + ", " + ROUTE_SCHEMA
    return rows.groupBy(*keys).cogroup(times.groupBy(*[f"of_{k}" for k in keys])).applyInPandas(_route(keys), schema)


def within_matrix_cap(points: DataFrame, keys: list[str], most: int = MATRIX_POINTS) -> DataFrame:
    """For each route of the points: whether they and the start are few enough for a matrix."""
    return points.groupBy(*keys).agg((F.count("*") + 1 <= most).alias("within_cap"))


def points_matrix(points: DataFrame, keys: list[str], most: int = MATRIX_POINTS) -> DataFrame:
    """(keys, a, b, metres) of all ordered pairs of a route's points; routes beyond the cap have no matrix."""
    small = within_matrix_cap(points, keys, most).where("within_cap").select(*keys)
    rows = points.join(small, keys, "left_semi").select(*keys, "stop_id", "lat", "lng")
    a, b = (rows.select(*keys, F.col("stop_id").alias(s), F.col("lat").alias(f"{s}_lat"), F.col("lng").alias(f"{s}_lng")) for s in ("a", "b"))
    return a.join(b, keys).where("a <> b").select(*keys, "a", "b", metres(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng")).alias("metres"))


def start_points(days: DataFrame, *ranked: tuple[str, DataFrame]) -> DataFrame:
    """The first of the ranked candidates (name, table of business_date, lat, lng) that has coordinates."""
    rows = days.select(DAY)
    for name, table in ranked:
        rows = rows.join(table.where("lat is not null").groupBy(DAY).agg(F.min(F.struct("lat", "lng")).alias(name)), DAY, "left")
    picked = F.coalesce(*[F.when(F.col(n).isNotNull(), F.struct(F.lit(n).alias("source"), F.col(f"{n}.lat").alias("lat"), F.col(f"{n}.lng").alias("lng"))) for n, _ in ranked])
    return rows.withColumn("s", picked).select(DAY, F.col("s.lat").alias("start_lat"), F.col("s.lng").alias("start_lng"), F.col("s.source").alias("start_source"))
