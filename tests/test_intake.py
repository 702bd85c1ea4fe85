"""From texts to stops: the whole way, on texts whose stops are known."""

import datetime as dt

import pytest

from dispatchlake.operators import intake
from dispatchlake.plans import registry

DAY = dt.date(2024, 1, 5)


@pytest.fixture(scope="module")
def tables(spark):
    places = spark.createDataFrame([("Kale", "Yeni", "Gül Sokak", "5", 37.0, 29.0), ("Kale", "Yeni", "Gül Sokak", "7", 37.5, 29.5)], "district string, quarter string, road string, door string, lat double, lng double")
    memory = spark.createDataFrame([("5321234567", "Tavas", "Çarşı", "1234", "12", "3", 38.0, 30.0, True, 4), ("5320000000", "x", "y", "z", "1", None, None, None, False, 1)], "phone_key string, district string, quarter string, road string, door string, flat string, lat double, lng double, corrected boolean, deliveries int")
    return places, memory


def test_texts_become_stops(spark, tables):
    at = lambda h, m: dt.datetime(2024, 1, 5, h, m)
    texts = [
        (1, at(9, 0), "Çıkış Belgesi: 1000001\nAlıcı: ALİ\nÜrün: masa\nKoli 3/1\nYeni mah. Gül sokak No:5 Kale"),
        (2, at(9, 1), "Çıkış Belgesi: 1000001\nÜrün: dolap\nYeni mah. Gül sokak Kale"),  # the same document again
        (3, at(9, 2), "Çıkış Belgesi: 1000002\nAlıcı: VELİ\nYeni mah. Gül sokak No:7 Kale\nÇıkış Belgesi: 1000003\nAlıcı: CAN\nTel 0532 123 45 67\nadres yok"),
        (4, at(9, 3), "  \n"), (5, at(9, 4), None), (6, at(9, 5), "kısa"),
        (7, dt.datetime(2024, 1, 6, 3, 59), "Çıkış Belgesi: 1000004\nTel 0532 000 00 00\nhiçbir yer"),
    ]
    found = intake.stops_of_texts(spark.createDataFrame(texts, "id int, ts timestamp_ntz, text string"), *tables, "id").orderBy("stop_id").collect()
    got = [(r["business_date"], r["doc_no"], r["name"], r["product"], r["pieces"], r["road"], r["door"], r["lat"], r["confidence"], r["grade"], r["precision"], r["frames"]) for r in found]
    assert got == [
        (DAY, "1000001", "ALİ", "masa + dolap", 3, "Gül Sokak", "5", 37.0, 100, "green", "kapi", 2),
        (DAY, "1000002", "VELİ", None, 1, "Gül Sokak", "7", 37.5, 100, "green", "kapi", 1),
        (DAY, "1000003", "CAN", None, 1, "1234", "12", 38.0, 100, "green", "kapi", 1),
        (DAY, "1000004", None, None, 1, None, None, None, 0, "red", "yok", 1),
    ]


def test_no_texts(spark, tables):
    assert intake.stops_of_texts(spark.createDataFrame([], "id int, ts timestamp_ntz, text string"), *tables, "id").collect() == []


def test_some_addresses_are_remembered(spark):
    kinds = {(r["from_memory"], r["precision"]) for r in registry.QUERIES["chain_texts_to_scans"](spark, "/root/testdata/sf0.001").select("from_memory", "precision").collect()}
    assert {(True, "kapi"), (False, "kapi"), (False, "yol")} <= kinds


def test_only_the_last_step_is_left(spark, tables):
    """Steps are written one by one, so their shuffle files don't add up; texts of one time are in the order of key and place."""
    at = dt.datetime(2024, 1, 5, 9, 0)
    texts = spark.createDataFrame([(i, at, f"Çıkış Belgesi: {1000000 + i}\nadres yok\nÇıkış Belgesi: {2000000 + i}\nYeni mah. Gül sokak No:{5 + i % 2 * 2} Kale") for i in (10, 9, 2, 100)], "id int, ts timestamp_ntz, text string")
    stops = intake.stops_of_texts(texts, *tables, "id")
    plan = stops._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Window" not in plan
    found = sorted((r["stop_id"], r["doc_no"], r["frames"], r["door"]) for r in stops.collect())
    # the second documents of 100, 10 and 2 are at one place
    assert found == [(1, "1000002", 1, None), (2, "2000002", 3, "5"), (3, "1000009", 1, None), (4, "2000009", 1, "7"), (5, "1000010", 1, None), (6, "1000100", 1, None)]
