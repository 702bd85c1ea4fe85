"""Merging without whole days in memory: scans pass by in batches, and fields are aggregated as a stream's state has them."""

import datetime as dt
import random

import pyarrow as pa

from dispatchlake.operators import merge

from .test_operators import DAY, merged, scan

KEYS = {merge.DAY: pa.date32(), "component": pa.int64(), "doc_no": pa.string(), "name": pa.string(), "plain": pa.string(), "lat": pa.float64(), "lng": pa.float64(), "product": pa.string(), "confidence": pa.int32()}


def test_a_day_passes_by_a_batch_at_a_time():
    read = []

    def batches():
        for k in range(3):
            read.append(k)
            rows = [{merge.DAY: DAY + dt.timedelta(days=k // 2), "component": 0, "doc_no": f" d{i % 2} "} for i in range(4)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema(KEYS.items()))

    for k, batch in enumerate(merge._taken(batches())):
        assert read == list(range(k + 1))
        assert batch.column("n").to_pylist() == [4 * (k % 2) + i for i in range(1, 5)]
        assert batch.column("at").to_pylist() == [0, 1, 0, 1] and batch.column("number").to_pylist() == ["d0", "d1"] * 2


def test_names_of_signs_alone_are_equal(spark):
    base = {"lat": 37.0, "lng": 29.0}
    assert len(merged(spark, scan(1, **base, name="?!"), scan(2, **base, name="--"))) == 1
    assert len(merged(spark, scan(1, **base, name="?!"), scan(2, **base, name="A"))) == 2


def test_products_that_are_the_same_as_the_whole(spark):
    of = lambda *products: merged(spark, *[scan(i, doc_no="d", product=p) for i, p in enumerate(products)])[0]["product"]
    assert of("A", "A", None, "") == "A" and of("", None) is None and of(None, "B") == "B"
    assert of("A", "B", "A + B", "A + B") == "A + B" and of("A", "B", "B") == "A + B + B"


def test_batch_is_as_the_streams_state(spark):
    rng = random.Random(6)
    of = lambda *values: rng.choice(values)
    rows = [scan(n, doc_no=of(None, "", " d1", "d1 ", f"d{rng.randrange(9)}"), name=of(None, "", "ALI", "ali", "?", "İpek"), phone=of(None, "", "1", "2"), product=of(None, "", "A", "B"), pieces=of(None, 0, -2, 3), district=of(None, "", "x", "y"), lat=of(None, float("nan"), 37.0, 37.0002, 37.0004), lng=of(29.0, 29.0003), confidence=of(None, 0, 40, 80, n), grade=of(None, "", "green")) for n in range(59)]
    table = merge.scans(spark.createDataFrame(rows, "business_date date, ts timestamp_ntz, stop_id int, doc_no string, name string, phone string, product string, pieces int, district string, lat double, lng double, confidence int, grade string"))
    day = merge.DayStops()
    for r in table.orderBy("ts", "scan_id").collect():
        day.merge({k: None if v != v else v for k, v in r.asDict().items()})
    want = day.table(DAY)
    got = sorted(merge.merge_scans(table).collect(), key=lambda r: r["stop_id"])
    assert len(got) == len(want) < 40
    for g, w in zip(got, merge._records(want), strict=True):
        assert g.asDict() == w
