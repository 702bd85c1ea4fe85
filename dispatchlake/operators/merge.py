"""Merging scans into a day's stops: an ordered fold per day, in batch and on a stream.

Whether a scan merges depends on stops that earlier scans have changed already, so no aggregation gives the same
result in general. A day is one fold: on a stream its state is the day's stops, in batch only what decides which stop a scan joins (the
stops' fields are aggregated by Spark). Scans can only meet in one stop if they are connected by equal document numbers or neighbouring grid cells, since a stop always stands where one of its
scans did; so in batch connected components can be folded apart (``split``), and stops numbered afterwards, by their first scans.
That pays where days are very long and scattered; where one component holds most of a day it costs rounds for nothing. Looking up a stop
is by document number, else by the points in its grid cells, so n scans cost about n lookups, not n squared, and stops at one point cost
one. :func:`by_document_number` is
the set form for scans that all have document numbers and coordinates.
"""

import math
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce
from operator import and_
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import DEGREE_M, EARTH_M, around, cell
from ..functions.text import plain_name, trimmed
from ..sources.shared import cut
from .graphs import components
from .ledger import DAY, NEAR_M

# Fixed values.
PARTS = ("district", "quarter", "road", "door", "flat", "floor")
#: The list of all stops at a point, beside those by plain name and without one (null).
_ANY = 0

_SCAN = ["scan_id", "doc_no", "name", "plain", "phone", "product", "pieces", *PARTS, "lat", "lng", "precision", "confidence", "grade", "road_offset_m", "warnings", "raw_text"]
STOP_SCHEMA = (
    "business_date date, stop_id int, doc_no string, name string, phone string, product string, pieces int, frames int, "
    "district string, quarter string, road string, door string, flat string, floor string, lat double, lng double, "
    "precision string, confidence int, grade string, road_offset_m double, warnings array<string>, raw_text string, status string, merged_on string"
)


def _missing(x: Any) -> bool:
    return x is None or x == "" or (isinstance(x, float) and math.isnan(x))


def _listed(x: Any) -> list:
    return [] if x is None or isinstance(x, float) else list(x)


def _or(a: Any, b: Any) -> Any:
    return b if _missing(a) or a == 0 else a


def _distance(a: tuple, b: tuple) -> float:
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * EARTH_M * math.asin(math.sqrt(min(1.0, h)))


class Matcher:
    """Which stop each scan of a day joins, and what is taken from it: of a stop only its number, place, plain name and confidence are kept.

    Stops at one point are listed by plain name, in order of insertion, so a scan looks at the points near it, not at the stops there.
    """

    def __init__(self):
        self.by_doc: dict[str, int] = {}
        self.cells: dict[tuple[int, int], dict[tuple, dict[Any, list[int]]]] = {}
        self.points: list[tuple | None] = []
        self.plains: list[str | None] = []
        self.confidences: list[int] = []
        self.products: list[list | None] = []  # length of the product, and its parts
        self.same: dict[str, str] = {}

    def _cell(self, point: tuple, up: int = 0, right: int = 0) -> tuple[int, int]:
        """The point's cell, or one beside it; cells are as wide as NEAR_M at least, at any latitude (as in ``geo.cell``)."""
        step = NEAR_M / DEGREE_M
        row = math.floor(point[0] / step) + up
        widest = (abs(row) + 2) * step
        columns = 1 if widest >= 90 else max(1, math.floor(math.cos(math.radians(widest)) * 360 / step))
        return row, (min(math.floor(point[1] % 360 / 360 * columns), columns - 1) + right) % columns

    def _list(self, i: int, keys: tuple) -> None:
        if self.points[i] is not None:
            here = self.cells.setdefault(self._cell(self.points[i]), {}).setdefault(self.points[i], {})
            for k in keys:
                insort(here.setdefault(k, []), i)

    def _unlist(self, i: int, keys: tuple) -> None:
        if self.points[i] is None:
            return
        cell_ = self._cell(self.points[i])
        here = self.cells[cell_][self.points[i]]
        for k in keys:
            here[k].pop(bisect_left(here[k], i))
            if not here[k]:
                del here[k]
        if not here:
            del self.cells[cell_][self.points[i]]
            if not self.cells[cell_]:
                del self.cells[cell_]

    def _near(self, point: tuple, plain: str | None) -> int | None:
        """The first stop by insertion within NEAR_M whose name is missing or the same."""
        found = None
        for c in {self._cell(point, up, right) for up in (-1, 0, 1) for right in (-1, 0, 1)}:
            for p, here in self.cells.get(c, {}).items():
                firsts = [here[k][0] for k in ((_ANY,) if plain is None else (plain, None)) if k in here]
                if firsts and (found is None or min(firsts) < found) and _distance(p, point) < NEAR_M:
                    found = min(firsts)
        return found

    def add(self, doc: str | None, plain: str | None, point: tuple | None, product: str | None, confidence: int | None) -> int:
        i = len(self.points)
        plain = plain if plain is None else self.same.setdefault(plain, plain)
        self.points.append(point)
        self.plains.append(plain)
        self.confidences.append(confidence or 0)
        self.products.append(None)
        self._adds(i, product)
        if doc:
            self.by_doc.setdefault(doc, i)
        self._list(i, (_ANY, plain))
        return i

    def _adds(self, i: int, product: str | None) -> bool:
        """Whether the product is put behind the stop's, as it isn't the same."""
        if _missing(product):
            return False
        product = self.same.setdefault(product, product)
        had = self.products[i]
        if had is None:
            self.products[i] = [len(product), [product]]
        elif had[0] == len(product) and " + ".join(had[1]) == product:
            return False
        else:
            had[0] += len(product) + 3
            had[1].append(product)
        return True

    def take(self, doc: str | None, plain: str | None, lat: float | None, lng: float | None, product: str | None, confidence: int | None) -> tuple[int, str | None, bool, bool, bool]:
        """The stop's place in the day; how it was found (null: it is new); whether the scan is better, gives the place, adds its product.

        ``doc`` without white space at its ends, ``plain`` null where the name is missing.
        """
        point = None if _missing(lat) or _missing(lng) else (lat, lng)
        at, how = (self.by_doc.get(doc), "doc_no") if doc else (None, None)
        if at is None and point is not None:
            at, how = self._near(point, plain), "near"
        if at is None:
            return self.add(doc, plain, point, product, confidence), None, False, True, not _missing(product)
        better = (confidence or 0) > self.confidences[at]
        if plain is not None and plain != self.plains[at]:
            self._unlist(at, (self.plains[at],))
            self.plains[at] = self.same.setdefault(plain, plain)
            self._list(at, (self.plains[at],))
        placed = better and not _missing(lat)
        if placed:
            if point != self.points[at]:
                self._unlist(at, (_ANY, self.plains[at]))
                self.points[at] = point
                self._list(at, (_ANY, self.plains[at]))
            self.confidences[at] = confidence or 0
        return at, how, better, placed, self._adds(at, product)


def _number(doc: Any) -> str | None:
    return None if _missing(doc) else str(doc).strip()


def _plain(name: Any, plain: Any) -> str | None:
    return None if _missing(name) else "" if _missing(plain) else plain


class DayStops:
    """A day's stops as a stream keeps them while scans are merged into them."""

    def __init__(self, stops: list[dict] | None = None):
        self.stops: list[dict] = []
        self.matcher = Matcher()
        self.next_id = 1
        for s in stops or []:
            point = None if _missing(s["lat"]) or _missing(s["lng"]) else (s["lat"], s["lng"])
            self.matcher.add(s["doc_no"], _plain(s["name"], s["plain"]), point, s["product"], s["confidence"])
            self._add(s)

    def _add(self, s: dict) -> None:
        self.stops.append(s)
        self.next_id = max(self.next_id, s["stop_id"] + 1)

    def merge(self, scan: dict) -> None:
        doc = _number(scan["doc_no"])
        at, how, better, placed, adds = self.matcher.take(doc, _plain(scan["name"], scan["plain"]), scan["lat"], scan["lng"], scan["product"], scan["confidence"])
        if how is None:
            new = {k: (None if _missing(scan[k]) else scan[k]) for k in _SCAN if k not in ("scan_id", "warnings")}
            new |= {"doc_no": doc, "stop_id": self.next_id, "pieces": int(_or(scan["pieces"], 1)), "frames": 1, "precision": _or(scan["precision"], "yok"), "confidence": 0 if _missing(scan["confidence"]) else int(scan["confidence"]), "grade": _or(scan["grade"], "red"), "warnings": _listed(scan["warnings"]), "status": "pending", "merged_on": None}
            self._add(new)
            return
        s = self.stops[at]
        if not _missing(scan["name"]):
            s["name"], s["plain"] = scan["name"], scan["plain"]
        s["phone"] = _or(scan["phone"], s["phone"])
        if adds:
            s["product"] = f"{s['product']} + {scan['product']}" if not _missing(s["product"]) else scan["product"]
        s["pieces"] = int(max(_or(s["pieces"], 1), _or(scan["pieces"], 1)))
        for part in PARTS:
            if not _missing(scan[part]) and (better or _missing(s[part])):
                s[part] = scan[part]
        if placed:
            for k in ("lat", "lng", "precision", "grade", "road_offset_m"):
                s[k] = None if _missing(scan[k]) else scan[k]
            s["warnings"] = _listed(scan["warnings"])
            s["confidence"] = int(_or(scan["confidence"], 0))
        s["frames"] += 1
        s["merged_on"] = how

    def table(self, day: Any) -> pd.DataFrame:
        columns = [c.split()[0] for c in STOP_SCHEMA.split(", ")]
        out = pd.DataFrame([{c: s.get(c) for c in columns} for s in self.stops], columns=columns)
        out[DAY] = day
        return out


def _records(rows: pd.DataFrame) -> list[dict]:
    return rows.astype(object).where(rows.notna(), None).to_dict("records")


def scans(stops: DataFrame, number: Column | None = None) -> DataFrame:
    """The columns of the fold from any table that has some of them; ``number`` (stop_id unless given) sorts scans of the same time."""
    have = {c: F.col(c) if c in stops.columns else F.lit(None) for c in _SCAN if c not in ("plain", "scan_id")}
    kinds = {"pieces": "int", "confidence": "int", "lat": "double", "lng": "double", "road_offset_m": "double", "warnings": "array<string>"}
    return stops.select(DAY, "ts", (F.col("stop_id").cast("long") if number is None else number).alias("scan_id"), *[c.cast(kinds.get(n, "string")).alias(n) for n, c in have.items()], plain_name(F.col("name")).alias("plain"))


def connected(scans_: DataFrame) -> DataFrame:
    """The scans with ``component``: no stop can hold scans of two of them."""
    y, x = cell(F.col("lat"), F.col("lng"), NEAR_M)
    number = trimmed(F.col("doc_no").cast("string"))
    rows = scans_.withColumns({"_y": y, "_x": x, "_doc": F.when(number != "", F.xxhash64(DAY, F.lit("number"), number))})
    rows = rows.withColumn("_cell", F.when(F.col("lat").isNotNull(), F.xxhash64(DAY, F.lit("cell"), "_y", "_x")))
    tied = rows.where("_doc is not null and _cell is not null").select(F.col("_doc").alias("u"), F.col("_cell").alias("v")).distinct()
    cells = rows.where("_cell is not null").select(DAY, F.col("_y").alias("cell_lat"), F.col("_x").alias("cell_lng"), "_cell").distinct()
    points = rows.where("_cell is not null").select(DAY, "lat", "lng", F.col("_cell").alias("u")).distinct()
    beside = points.select(DAY, "u", F.inline(around(F.col("lat"), F.col("lng"), NEAR_M))).distinct().join(cells.withColumnRenamed("_cell", "v"), [DAY, "cell_lat", "cell_lng"])
    found = components(tied.unionByName(beside.where("u <> v").select("u", "v")))
    rows = rows.withColumn("node", F.coalesce("_cell", "_doc", F.xxhash64(DAY, F.lit("scan"), "scan_id"))).join(found, "node", "left")
    return rows.withColumn("component", F.coalesce("component", "node")).drop("node", "_y", "_x", "_doc", "_cell")


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scans in the order of their days, each with its stop; of a day only what the matcher keeps is held."""
    day, matcher, n = None, Matcher(), 0
    for batch in batches:
        rows = [batch.column(c).to_pylist() for c in (DAY, "component", "doc_no", "name", "plain", "lat", "lng", "product", "confidence")]
        docs, found = [], []
        for when, part, doc, name, plain, *rest in zip(*rows, strict=True):
            if (when, part) != day:
                day, matcher, n = (when, part), Matcher(), 0
            n += 1
            docs.append(_number(doc))
            found.append((n, *matcher.take(docs[-1], _plain(name, plain), *rest)))
        if found:
            made = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(docs, pa.string()), *made], [*batch.schema.names, "number", "n", "at", "how", "better", "placed", "adds"])


def _full(name: str, kind: str) -> Column:
    return F.nullif(name, F.lit("")) if kind == "string" else F.when(~F.isnan(name), F.col(name)) if kind == "double" else F.col(name)


def merge_scans(scans_: DataFrame, split: bool = False) -> DataFrame:
    """Stops of each day after its scans, in order of arrival (ts, then scan_id); ``split``: components of a day apart.

    The fold only says which stop a scan joins and what is taken from it; scans pass by it sorted, a batch at a time. The stops' fields are
    aggregations of what was taken: most are the last or the first of some scans.
    """
    parts = connected(scans_) if split else scans_.withColumn("component", F.lit(0).cast("long"))
    order = [F.asc_nulls_last(c) for c in (DAY, "component", "ts", "scan_id")]
    sorted_ = parts.repartition(DAY, "component").sortWithinPartitions(*order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_.schema.fields)
    taken = sorted_.mapInArrow(_taken, f"{schema}, number string, n long, at int, how string, better boolean, placed boolean, adds boolean")
    # written, so the sorted scans' shuffle files can go before stops are aggregated
    taken = cut(taken.drop("doc_no", "plain", *(() if split else ("ts", "scan_id"))))

    new, n = F.col("how").isNull(), F.col("n")
    f = {c: _full(c, kind) for c, kind in taken.dtypes}
    last = lambda c, *where: F.max_by(c, F.when(reduce(and_, where, c.isNotNull()), n))
    place = F.struct(
        f["lat"].alias("lat"), f["lng"].alias("lng"), F.when(new, F.coalesce(f["precision"], F.lit("yok"))).otherwise(f["precision"]).alias("precision"), F.coalesce("confidence", F.lit(0)).alias("confidence"),
        F.when(new, F.coalesce(f["grade"], F.lit("red"))).otherwise(f["grade"]).alias("grade"), f["road_offset_m"].alias("road_offset_m"), F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"),
    )
    products = F.array_sort(F.collect_list(F.when(F.col("adds"), F.struct("n", "product"))))
    fields = {
        "doc_no": F.min_by("number", n), "name": last(f["name"]), "phone": last(f["phone"]), "product": F.nullif(F.array_join(F.transform(products, lambda x: x["product"]), " + "), F.lit("")),
        "pieces": F.max(F.coalesce(F.nullif("pieces", F.lit(0)), F.lit(1))), "frames": F.count("*").cast("int"),
        **{p: F.coalesce(last(f[p], F.col("better")), F.min_by(f[p], F.when(f[p].isNotNull(), n))) for p in PARTS},
        "raw_text": F.min_by(f["raw_text"], n), "merged_on": F.max_by("how", n), "status": F.lit("pending"),
    }
    stops = taken.groupBy(DAY, "component", "at").agg(*[c.alias(k) for k, c in fields.items()], F.max_by(place, F.when(F.col("placed"), n)).alias("place"), *([F.min_by(F.struct("ts", "scan_id"), n).alias("first")] if split else []))
    number = F.row_number().over(Window.partitionBy(DAY).orderBy(F.asc_nulls_last("first.ts"), F.asc_nulls_last("first.scan_id"))) if split else F.col("at") + 1
    columns = [c.split() for c in STOP_SCHEMA.split(", ")]
    stops = stops.select("*", "place.*").withColumn("stop_id", number)
    return stops.select(*[F.col(c).cast(kind).alias(c) for c, kind in columns])


def by_document_number(scans_: DataFrame) -> DataFrame:
    """The set form: one stop per document number, for scans that have numbers and coordinates, without rule of nearness."""
    w = Window.partitionBy(DAY, "doc_no").orderBy("ts", "scan_id")
    best = F.max_by(F.struct("lat", "lng", "precision", "grade"), F.struct(F.coalesce("confidence", F.lit(0)), -F.col("n")))
    return (
        scans_.where("doc_no is not null and lat is not null")
        .withColumn("n", F.row_number().over(w))
        .groupBy(DAY, "doc_no")
        .agg(F.max_by("name", F.when(F.nullif("name", F.lit("")).isNotNull(), F.col("n"))).alias("name"), F.max_by("phone", F.when(F.nullif("phone", F.lit("")).isNotNull(), F.col("n"))).alias("phone"), F.max(F.coalesce(F.nullif("pieces", F.lit(0)), F.lit(1))).alias("pieces"), F.max(F.coalesce("confidence", F.lit(0))).alias("confidence"), best.alias("b"), F.count("*").alias("frames"))
        .select(DAY, "doc_no", "name", "phone", "pieces", "confidence", "b.lat", "b.lng", "b.precision", "b.grade", "frames")
    )
