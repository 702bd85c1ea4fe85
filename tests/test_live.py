"""Streams with state: restarts, days that close at 04:00, photos that are let go."""

import datetime as dt

import pytest

from dispatchlake.streaming import live

POSITION = "business_date date, ts timestamp_ntz, lat double, lng double"
TARGET = "business_date date, stop_id long, lat double, lng double, since timestamp_ntz, until timestamp_ntz"
FIRST, SECOND = dt.date(2024, 1, 5), dt.date(2024, 1, 6)


def at(day: dt.date, hour: int, minute: int = 0) -> dt.datetime:
    return dt.datetime.combine(day, dt.time(hour, minute))


class Source:
    """Folders that rows are added to, and a stream of events over them that can be run again and again."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder

    def add(self, positions=(), targets=()):
        for name, rows, schema in (("positions", positions, POSITION), ("targets", targets, TARGET)):
            self.spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"file://{self.folder}/{name}")

    def run(self):
        read = lambda name, schema: self.spark.readStream.schema(schema).parquet(f"file://{self.folder}/{name}")
        found = live.run_available(live.arrival_events(read("positions", POSITION), read("targets", TARGET)), f"file://{self.folder}/out")
        return sorted(((r["kind"], r["stop_id"], r["ts"]) for r in found.collect()), key=repr)


@pytest.fixture
def source(spark, tmp_path):
    return Source(spark, tmp_path)


def test_a_stop_is_asked_about_once_over_restarts(source):
    source.add([(FIRST, at(FIRST, 9, m), 37.0005, 29.0) for m in (1, 2)], [(FIRST, 1, 37.0, 29.0, at(FIRST, 9), None)])
    assert source.run() == [("arrived", 1, at(FIRST, 9, 1))]
    source.add([(FIRST, at(FIRST, 9, 3), 37.0005, 29.0)])  # the target comes from the state
    assert source.run() == [("arrived", 1, at(FIRST, 9, 1))]
    source.add([(FIRST, at(FIRST, 9, 6), 38.0005, 29.0)], [(FIRST, 2, 38.0, 29.0, at(FIRST, 9, 5), at(FIRST, 9, 7))])
    assert source.run() == [("arrived", 1, at(FIRST, 9, 1)), ("arrived", 2, at(FIRST, 9, 6))]


def test_a_day_closes_at_four_and_is_forgotten(source):
    near = lambda day, hour: (day, at(day, hour), 37.0005, 29.0)
    source.add([near(FIRST, 9)], [(FIRST, 1, 37.0, 29.0, at(FIRST, 8), None)])
    assert source.run() == [("arrived", 1, at(FIRST, 9))]
    source.add([(SECOND, at(SECOND, 4, 30), 30.0, 29.0)])  # the watermark is at 03:30
    assert source.run() == [("arrived", 1, at(FIRST, 9))]
    source.add([(SECOND, at(SECOND, 6), 30.0, 29.0)])
    closed = [("arrived", 1, at(FIRST, 9)), ("closed", None, at(SECOND, 4))]
    assert source.run() == closed
    source.add([near(FIRST, 10)])  # too late
    assert source.run() == closed


def test_bounds_missing_values_and_windows_of_targets(source):
    rows = [(FIRST, at(FIRST, 9, m), lat, lng) for m, lat, lng in ((0, 37.0, 29.0), (1, None, 29.0), (2, 37.0 + 121 / 111_195, 29.0), (3, 37.0 + 119 / 111_195, 29.0))]
    source.add([*rows, (None, at(FIRST, 9), 37.0, 29.0), (FIRST, None, 37.0, 29.0)], [(FIRST, 1, 37.0, 29.0, at(FIRST, 9, 1), None), (FIRST, 2, None, None, at(FIRST, 9, 4), None)])
    assert source.run() == [("arrived", 1, at(FIRST, 9, 3))]


def test_photos_of_a_day_beyond_the_last_six_are_let_go(spark, tmp_path):
    schema = "business_date date, frame string"

    def add(*frames):
        spark.createDataFrame([(FIRST, f) for f in frames] + [(SECOND, "only")] * (not frames), schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")

    def run():
        found = live.run_available(live.retry_frames(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")), f"file://{tmp_path}/out")
        return sorted((r["frame"], r["status"]) for r in found.collect())

    add("a", "b", "c", "d")
    assert run() == [(f, "kept") for f in "abcd"]
    add("e", "f", "g", "h")
    assert run() == sorted([(f, "kept") for f in "abcdefgh"] + [("a", "evicted"), ("b", "evicted")])
    add()
    assert ("only", "kept") in run()


def test_live_positions_of_followed_days(spark, tmp_path):
    positions = spark.createDataFrame([(FIRST, at(FIRST, 9), 37.0, 29.0), (SECOND, at(SECOND, 9), 37.0, 29.0)], POSITION.replace("timestamp_ntz", "timestamp"))
    positions.write.parquet(f"file://{tmp_path}/in")
    days = spark.createDataFrame([(FIRST, "closed"), (SECOND, "open")], "business_date date, status string")
    pending = spark.createDataFrame([(FIRST,), (SECOND,), (SECOND,)], "business_date date")
    stream = live.live_stream(spark.readStream.schema(positions.schema).parquet(f"file://{tmp_path}/in"), days, pending)
    assert [r["business_date"] for r in live.run_available(stream, f"file://{tmp_path}/out").collect()] == [SECOND]
