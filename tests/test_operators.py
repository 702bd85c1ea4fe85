"""The ledger's operators on small tables: edge cases of the rules, batch against stream."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from dispatchlake.functions import dates, geo, text
from dispatchlake.operators import gazetteer, ledger, memory, merge, ocr, report, route
from dispatchlake.plans import registry
from dispatchlake.sources import store
from dispatchlake.streaming import arrivals

DAY = dt.date(2024, 1, 5)


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("at", "day"),
    [("2024-01-05 03:59:59", "2024-01-04"), ("2024-01-05 04:00:00", "2024-01-05"), ("2024-03-01 03:00:00", "2024-02-29"), ("2024-01-01 00:00:00", "2023-12-31")],
)
def test_business_date(spark, at, day):
    assert str(one(spark, dates.business_date(F.col("t").cast("timestamp_ntz")), t=at)) == day


@pytest.mark.parametrize(("phone", "key"), [(None, None), ("", None), ("123456789", None), ("5321234567", "5321234567"), ("0 532 123 45 67", "5321234567"), ("+90 (532) 123-45-67", "5321234567")])
def test_phone_key(spark, phone, key):
    assert one(spark, text.phone_key(F.col("p").cast("string")), p=phone) == key


def test_distance(spark):
    far = one(spark, geo.metres(F.col("a"), F.col("b"), F.col("c"), F.col("d")), a=37.0, b=29.0, c=38.0, d=29.0)
    assert abs(far - 111_194.93) < 0.1
    assert one(spark, geo.metres(F.col("a").cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0)), a=None) is None
    assert one(spark, geo.metres_or_infinity(F.col("a").cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0)), a=None) == float("inf")


@pytest.mark.parametrize(
    ("field", "value", "want"),
    [
        (text.document_number, "Çıkış Belgesi: 1234567", "1234567"), (text.document_number, "No. 12345678 x", "12345678"), (text.document_number, "Teslimat No: 12_34567", "12_34567"), (text.document_number, "nothing", None),
        (text.phone, "tel 0532 123 45 67.", "0532 123 45 67"), (text.phone, "12345321234567899", "5321234567"), (text.recipient, "Alıcı:  Ali   Veli\nx", "Ali Veli"), (text.recipient, "SAYIN\nAYŞE FATMA", "AYŞE FATMA"),
        (text.recipient, "ALICI: Ali Veli", None), (text.product, "Ürün: dolap  ", "dolap"), (text.pieces, "parça 2/1", 2), (text.pieces, "ü2/1", 2), (text.pieces, "a2/1", 1), (text.pieces, "", 1),
    ],
)
def test_fields_of_texts(spark, field, value, want):
    assert one(spark, field(F.col("t")), t=value) == want


def scan(n: int, **values) -> tuple:
    fields = {"doc_no": None, "name": None, "phone": None, "product": None, "pieces": None, "district": None, "lat": None, "lng": None, "confidence": None, "grade": None}
    return (DAY, dt.datetime(2024, 1, 5, 9, n), n, *(fields | values).values())


SCAN = "business_date date, ts timestamp_ntz, stop_id int, doc_no string, name string, phone string, product string, pieces int, district string, lat double, lng double, confidence int, grade string"


def merged(spark, *rows):
    return sorted(merge.merge_scans(merge.scans(spark.createDataFrame(list(rows), SCAN))).collect(), key=lambda r: r["stop_id"])


STEP = 1 / geo.DEGREE_M


def test_merge_by_distance_and_name(spark):
    base = {"lat": 37.0, "lng": 29.0, "name": "ALI VELI", "confidence": 50}
    assert len(merged(spark, scan(1, **base), scan(2, **base | {"lat": 37.0 + 29.9 * STEP}))) == 1
    assert len(merged(spark, scan(1, **base), scan(2, **base | {"lat": 37.0 + 30.1 * STEP}))) == 2
    assert len(merged(spark, scan(1, **base), scan(2, **base | {"name": "Ayşe"}))) == 2
    assert len(merged(spark, scan(1, **base), scan(2, **base | {"name": None}))) == 1
    # numbers that differ don't keep neighbours apart; equal ones join distant scans
    assert len(merged(spark, scan(1, **base | {"doc_no": "a"}), scan(2, **base | {"doc_no": "b"}))) == 1
    assert len(merged(spark, scan(1, doc_no="a", lat=37.0, lng=29.0), scan(2, doc_no="a", lat=38.0, lng=29.0))) == 1


def test_merge_of_fields(spark):
    (row,) = merged(
        spark,
        scan(1, doc_no="a", product="A", pieces=2, district="x", lat=37.0, lng=29.0, confidence=50, grade="yellow"),
        scan(2, doc_no="a", product="B", pieces=1, district="y", confidence=90, grade="green", name="N"),
        scan(3, doc_no="a", product="A", phone="1", confidence=50, lat=38.0, lng=29.0),
    )
    assert (row["product"], row["pieces"], row["frames"], row["name"], row["phone"]) == ("A + B + A", 2, 3, "N", "1")
    # better confidence without coordinates changes the address, not the place or the confidence
    assert (row["district"], row["lat"], row["confidence"], row["grade"]) == ("y", 37.0, 50, "yellow")


def delivery(n: int, **values) -> tuple:
    fields = {"phone": "05321234567", "name": "A", "district": "d", "quarter": "q", "road": "r", "door": "1", "flat": None, "lat": 37.0, "lng": 29.0, "confidence": 80, "corrected": False}
    return (dt.datetime(2024, 1, 5, 9, n), n, *(fields | values).values())


DELIVERY = "ts timestamp_ntz, stop_id int, phone string, name string, district string, quarter string, road string, door string, flat string, lat double, lng double, confidence int, corrected boolean"


def test_memory_keeps_what_was_corrected(spark):
    rows = [delivery(1), delivery(2, road="fixed", lat=37.5, corrected=True), delivery(3, road="later", lat=38.0, name="B"), delivery(4, phone="12"), delivery(5, lat=None)]
    (m,) = memory.learn(spark.createDataFrame(rows, DELIVERY)).collect()
    assert (m["road"], m["lat"], m["name"], m["corrected"], m["deliveries"]) == ("fixed", 37.5, "B", True, 3)
    last = memory.exact_history(spark.createDataFrame(rows, DELIVERY)).orderBy(F.desc("stop_id")).first()
    assert (last["deliveries"], last["memory_lat"], last["is_corrected"]) == (3, 37.5, True)


def test_summary_of_a_day_without_stops(spark):
    days = spark.createDataFrame([(DAY, "open")], "business_date date, status string")
    none = spark.createDataFrame([], "business_date date, status string, pieces int, grade string")
    row = ledger.day_summary(days, none).first()
    assert (row["total"], row["pieces"], row["red"]) == (0, 0, 0)


def test_opening_a_day_twice_closes_nothing(spark):
    days = spark.createDataFrame([(DAY, "open", None, None, None)], "business_date date, status string, opened_at timestamp_ntz, closed_at timestamp_ntz, note string")
    at = F.lit("2024-01-06 08:00:00").cast("timestamp_ntz")
    assert ledger.open_day(days, F.lit(DAY), at).collect() == days.collect()
    new = {r["business_date"].day: r["status"] for r in ledger.open_day(days, F.lit(dt.date(2024, 1, 6)), at).collect()}
    assert new == {5: "closed", 6: "open"}


def test_short_routes_are_the_shortest():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(5):
        legs = route.matrix(37 + rng.random(7) / 20, 29 + rng.random(7) / 20)
        groups = [None, "a", "b", "a", None, "b", "a"]
        order, method = route.solve(legs, groups)
        best = min(route.cost(list(p), legs, groups) for p in itertools.permutations(range(1, 7)))
        assert method == "exact" and abs(route.cost(order, legs, groups) - best) < 1e-6
    many = route.matrix(37 + rng.random(40) / 20, 29 + rng.random(40) / 20)
    order, _ = route.solve(many, [None] * 40)
    assert sorted(order) == list(range(1, 40))
    assert route.cost(order, many, [None] * 40) <= route.cost(list(range(1, 40)), many, [None] * 40)


def test_long_routes_are_improved_while_anything_helps():
    import numpy as np

    rng = np.random.default_rng(8)
    n = 120
    legs = route.matrix(37 + rng.random(n + 1) / 10, 29 + rng.random(n + 1) / 10)
    groups = [None, *[[None, "a", "b", "c", "d"][k] for k in rng.integers(0, 5, n)]]
    order, _ = route.solve(legs, groups)
    assert sorted(order) == list(range(1, n + 1))
    best = route.cost(order, legs, groups)
    for i in range(n):
        for j in range(i + 1, n):
            assert route.cost(order[:i] + order[i : j + 1][::-1] + order[j + 1 :], legs, groups) > best - 1e-3
        rest = order[:i] + order[i + 1 :]
        for k in range(n):
            assert route.cost([*rest[:k], order[i], *rest[k:]], legs, groups) > best - 1e-3


def test_export_names_nobody(spark):
    stops = spark.createDataFrame([(DAY, 1, None, 37.0, 29.0, "pending", 80, "green", "kapi", 0, "d", "", None, "5", "2", "SECRET", "0532")], "business_date date, stop_id int, seq int, lat double, lng double, status string, confidence int, grade string, precision string, pieces int, district string, quarter string, road string, door string, flat string, name string, phone string")
    routes = spark.createDataFrame([], "business_date date, start_lat double, start_lng double, total_m double")
    line = report.export_rows(stops, routes).first()["line"]
    assert line == "    ·.     —km  pending  37.00000,29.00000    " + " 80 green   kapi  p1 | d / no 5 / d2"


def test_best_reading_stops_at_the_first_good_one(spark):
    rows = spark.createDataFrame([(1, 0, 50.0), (1, 1, 70.0), (1, 2, 99.0), (2, 0, 10.0), (2, 1, 10.0)], "k int, attempt int, score double")
    assert {(r["k"], r["attempt"]) for r in ocr.best_reading(rows, "k").collect()} == {(1, 1), (2, 0)}


def test_districts_are_whole_words(spark):
    texts = spark.createDataFrame([(1, "Çal ilçesi"), (2, "çalı"), (3, None)], "k int, t string")
    districts = spark.createDataFrame([(7, "Çal", "cal")], "oid int, name string, search_key string")
    assert [(r["k"], r["oid"]) for r in gazetteer.named_districts(texts, districts, "k", "t").collect()] == [(1, 7)]


def test_store_versions(spark, tmp_path):
    tables = store.Store(spark, f"file://{tmp_path}")
    tables.create("days", "business_date date, status string")
    assert tables.read("days").count() == 0
    tables.write("days", spark.createDataFrame([(DAY, "open")], "business_date date, status string"))
    tables.write("days", tables.read("days").withColumn("status", F.lit("closed")))
    assert [r["status"] for r in tables.read("days").collect()] == ["closed"]


def stream(spark, df, folder, schema):
    df.repartition(1).write.parquet(str(folder))
    return spark.readStream.schema(schema).parquet(str(folder))


def test_one_prompt_per_stop_on_a_stream(spark, tmp_path):
    near, far = 37.0 + 119.9 * STEP, 37.0 + 120.5 * STEP
    rows = [(DAY, dt.datetime(2024, 1, 5, 9, i), lat, 29.0, 1, 37.0, 29.0) for i, lat in enumerate((far, near, 37.0, near))]
    schema = "business_date date, ts timestamp_ntz, lat double, lng double, stop_id long, stop_lat double, stop_lng double"
    positions = stream(spark, spark.createDataFrame(rows, schema), tmp_path / "in", schema)
    query = arrivals.arrival_stream(positions).writeStream.format("memory").queryName("asked").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r["stop_id"], r["ts"].minute) for r in spark.table("asked").collect()] == [(1, 1)]


def test_scans_merge_on_a_stream_as_in_batch(spark, tmp_path):
    rows = [scan(i, doc_no=f"d{i % 3}", product=f"p{i}", pieces=i, lat=37.0 + i, lng=29.0, confidence=i, grade="red") for i in range(1, 8)]
    scans = merge.scans(spark.createDataFrame(rows, SCAN))
    query = arrivals.merge_stream(stream(spark, scans, tmp_path / "in", scans.schema)).writeStream.format("memory").queryName("merged").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(repr, spark.table("merged").collect())) == sorted(map(repr, merge.merge_scans(scans).collect()))


def naive_merge(scans: list[dict]) -> list[dict]:
    """The rules of merging, looked up by going through all stops."""
    import math

    def metres(a: dict, b: dict) -> float:
        if None in (a["lat"], b["lat"]):
            return math.inf
        p, q = math.radians(a["lat"]), math.radians(b["lat"])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b["lng"] - a["lng"]) / 2) ** 2
        return 2 * geo.EARTH_M * math.asin(math.sqrt(h))

    plain = lambda name: (name or "").replace("I", "ı").replace("İ", "i").lower()
    stops: list[dict] = []
    for x in scans:
        same = next((s for s in stops if x["doc_no"] and s["doc_no"] == x["doc_no"]), None)
        if same is None:
            same = next((s for s in stops if metres(s, x) < 30 and (not x["name"] or not s["name"] or plain(s["name"]) == plain(x["name"]))), None)
        if same is None:
            stops.append({**x, "pieces": x["pieces"] or 1, "confidence": x["confidence"] or 0, "grade": x["grade"] or "red", "frames": 1, "warnings": x["warnings"] or []})
            continue
        better = (x["confidence"] or 0) > (same["confidence"] or 0)
        for k in ("name", "phone"):
            same[k] = x[k] or same[k]
        if x["product"]:
            same["product"] = f"{same['product']} + {x['product']}" if same["product"] and same["product"] != x["product"] else x["product"]
        same["pieces"] = max(same["pieces"], x["pieces"] or 1)
        if x["district"] and (better or not same["district"]):
            same["district"] = x["district"]
        if better and x["lat"] is not None:
            same |= {k: x[k] for k in ("lat", "lng", "confidence", "grade")} | {"warnings": x["warnings"] or []}
        same["frames"] += 1
    return stops


def test_merging_is_that_of_the_plain_rules(spark):
    import random

    rng = random.Random(4)
    names = ["doc_no", "name", "phone", "product", "pieces", "district", "lat", "lng", "confidence", "grade", "warnings", "raw_text"]
    rows = []
    for n in range(300):
        placed = rng.random() < 0.8
        lat, lng = (37 + rng.randrange(6) * 0.0004 + rng.random() * 0.0002, 29 + rng.randrange(3) * 0.0005) if placed else (None, None)
        pick = lambda *values: rng.choice(values)
        rows.append(dict(zip(names, (pick(None, None, "", f"d{rng.randrange(60)}"), pick(None, "", "ALI", "ali", "İpek"), pick(None, "", "1", "2"), pick(None, "A", "B"), pick(None, 0, 1, 3), pick(None, "", "x", "y"), lat, lng, pick(None, 0, 40, 80), pick(None, "green", "yellow"), pick(None, ["w"], ["v", "w"]), f"t{n}"), strict=True)))
    schema = "business_date date, ts timestamp_ntz, stop_id int, doc_no string, name string, phone string, product string, pieces int, district string, lat double, lng double, confidence int, grade string, warnings array<string>, raw_text string"
    table = spark.createDataFrame([(DAY, dt.datetime(2024, 1, 5, 9) + dt.timedelta(seconds=n), n, *r.values()) for n, r in enumerate(rows)], schema)
    got = sorted(merge.merge_scans(merge.scans(table)).collect(), key=lambda r: r["stop_id"])
    want = naive_merge(rows)
    assert [r["stop_id"] for r in got] == list(range(1, len(want) + 1)) and 20 < len(want) < 280
    for g, w in zip(got, want, strict=True):
        assert [g[k] or None for k in ("doc_no", *names[1:7], "frames")] == [w[k] or None for k in ("doc_no", *names[1:7], "frames")]
        assert (g["lng"], g["confidence"], g["grade"], g["warnings"], g["raw_text"]) == (w["lng"], w["confidence"], w["grade"], w["warnings"], w["raw_text"])


def test_a_text_is_split_at_its_document_numbers(spark):
    one_ = "Çıkış Belgesi: 123456\na b"
    cases = {"": [], "no number": ["no number"], one_: [one_], f"head\n{one_}\nTeslimat No: 99_9999\nc\nx Sipariş No. 1234567": ["head", one_, "Teslimat No: 99_9999\nc", "x Sipariş No. 1234567"], "Belgesi 12": ["Belgesi 12"]}
    for value, want in cases.items():
        assert one(spark, text.documents_of(F.col("t")), t=value) == want


def test_changes_leave_other_stops_alone(spark):
    at = dt.datetime(2024, 1, 5, 12)
    stops = spark.createDataFrame([(DAY, 1, "delivered", "x", at, at, 37.0, 5, False, "red", 10), (DAY, 2, "pending", None, None, None, 37.0, 5, False, "red", 10)], "business_date date, stop_id int, status string, status_reason string, finished_at timestamp_ntz, updated_at timestamp_ntz, lat double, pieces int, corrected boolean, grade string, confidence int")
    changes = spark.createDataFrame([(DAY, 2, "failed", "", dt.datetime(2024, 1, 5, 13))], "business_date date, stop_id int, new_status string, reason string, at timestamp_ntz")
    got = {r["stop_id"]: (r["status"], r["status_reason"], r["finished_at"], r["updated_at"]) for r in ledger.set_status(stops, changes).collect()}
    assert got == {1: ("delivered", "x", at, at), 2: ("failed", None, dt.datetime(2024, 1, 5, 13), dt.datetime(2024, 1, 5, 13))}
    fixes = spark.createDataFrame([(DAY, 2, {"lat": None, "pieces": "3"})], "business_date date, stop_id int, fields map<string,string>")
    got = {r["stop_id"]: (r["lat"], r["pieces"], r["grade"], r["updated_at"]) for r in ledger.correct_stops(stops, fixes, F.lit("2024-01-06 00:00:00").cast("timestamp_ntz")).collect()}
    assert got == {1: (37.0, 5, "red", at), 2: (None, 3, "green", dt.datetime(2024, 1, 6))}


def test_memory_grows_as_it_would_from_the_whole_history(spark):
    rows = [delivery(1), delivery(2, road="fixed", lat=37.5, corrected=True), delivery(3, road="later", lat=38.0, name="B"), delivery(4, road="again", corrected=True, flat="2"), delivery(5, phone="05327654321", door="")]
    whole = memory.learn(spark.createDataFrame(rows, DELIVERY)).orderBy("phone_key").collect()
    for cut in range(6):
        before, after = (spark.createDataFrame(part, DELIVERY) for part in (rows[:cut], rows[cut:]))
        assert memory.upsert(memory.learn(before), after).orderBy("phone_key").collect() == whole


def test_two_writers_get_two_versions(spark, tmp_path):
    tables = store.Store(spark, f"file://{tmp_path}")
    tables.create("t", "k int, v string")
    assert store.lookup(tables.read("t"), "k", 1).collect() == []
    first, second = tables._claim("t"), tables._claim("t")
    assert (first, second) == (1, 2)
    tables.write("t", spark.createDataFrame([(1, "a")], "k int, v string"))
    assert [tuple(r) for r in store.lookup(tables.read("t"), "k", 1).collect()] == [(1, "a")]


def test_gazetteer_packages_are_read_by_district(spark, tmp_path):
    places = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "oid int, road string")
    store.write_gazetteer(places, f"file://{tmp_path}/g")
    asked = spark.createDataFrame([(1,), (1,), (9,)], "oid int")
    assert sorted(r["road"] for r in store.read_districts(spark, f"file://{tmp_path}/g", asked).collect()) == ["a", "b"]


def test_packages_that_no_text_names_are_pruned(spark, tmp_path):
    store.write_gazetteer(spark.range(400).selectExpr("cast(id % 19 + 1 as int) as oid", "cast(id as string) as road"), f"file://{tmp_path}/g")
    districts = spark.createDataFrame([(1, "A", "aa"), (2, "B", "bb")], "oid int, name string, search_key string")
    districts.write.parquet(f"file://{tmp_path}/d")
    texts = spark.createDataFrame([(1, "x AA y")], "k int, t string")
    named = gazetteer.named_districts(texts, spark.read.parquet(f"file://{tmp_path}/d").where("oid > 0"), "k", "t")
    found = store.read_districts(spark, f"file://{tmp_path}/g", named)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and {r["oid"] for r in found.collect()} == {1}


def test_photos_and_pasted_texts(spark, tmp_path):
    for i in range(8):
        (tmp_path / f"p{i}.jpg").write_bytes(b"x" * (1024 * i + 600))
    frames = store.photos(spark, f"file://{tmp_path}")
    rows = frames.orderBy("file").collect()
    assert [(r["frame_id"], r["file"], r["kilobytes"]) for r in rows][:3] == [("k1", "p0.jpg", 1), ("k2", "p1.jpg", 2), ("k3", "p2.jpg", 3)] and bytes(rows[1]["content"]) == b"x" * 1624
    kept = store.frames_to_retry(frames.withColumn("day", F.lit(1)), "day", "file")
    assert sorted(r["file"] for r in kept.collect()) == [f"p{i}.jpg" for i in range(2, 8)]
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.txt").write_text("one\ntwo")
    assert [tuple(r) for r in store.pasted_texts(spark, f"file://{tmp_path}/t").collect()] == [("a.txt", "one\ntwo")]


def test_an_export_is_written_by_day(spark, tmp_path):
    days = spark.createDataFrame([(DAY, "open")], "business_date date, status string")
    stops = spark.createDataFrame([(DAY, 1, None, None, None, "pending", 80, "green", "kapi", 0, "d", "", None, "5", "2")], "business_date date, stop_id int, seq int, lat double, lng double, status string, confidence int, grade string, precision string, pieces int, district string, quarter string, road string, door string, flat string")
    routes = spark.createDataFrame([], "business_date date, start_lat double, start_lng double, total_m double")
    report.write_export(days, stops, routes, f"file://{tmp_path}/out", "1.0")
    (file,) = (tmp_path / "out/day=2024-01-05").glob("*.txt")
    assert file.read_text().splitlines()[:3] == ["", "═══ 2024-01-05  (open)  1 durak", "  rota: çıkarılmamış"]


def test_districts_are_broadcast_and_not_the_words_of_texts(spark, tmp_path):
    """Files of short texts are smaller than the words made from them; districts made in the session have no known size."""
    spark.range(100).selectExpr("id AS k", "concat('cal ', id) AS t").write.parquet(f"file://{tmp_path}/t")
    districts = spark.createDataFrame([(7, "Çal", "cal"), (8, "Kale", "kale")], "oid int, name string, search_key string")
    loaded = spark.createDataFrame([(8,)], "oid int")
    found = gazetteer.named_districts(spark.read.parquet(f"file://{tmp_path}/t"), districts, "k", "t", loaded)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan and "SortMergeJoin" not in plan
    assert {r["oid"] for r in found.collect()} == {7} and found.count() == 100


def test_names_at_one_place_are_not_paired(spark, tmp_path):
    """A thousand customers at one door: no pairs of their names, and none of their places is collected in the driver."""
    spark.range(1000).selectExpr("id AS stop_id", "DATE '2024-01-05' AS business_date", "CASE WHEN id IN (500, 700) THEN NULL ELSE concat('n', id % 300) END AS name", "37.0D AS lat", "29.0D AS lng", "cast(NULL AS string) AS doc_no").write.parquet(f"file://{tmp_path}/s")
    found = ledger.same_stop(spark.read.parquet(f"file://{tmp_path}/s"))
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    name = lambda i: None if i in (500, 700) else i % 300
    want = {i: next(j for j in range(i) if None in (name(i), name(j)) or name(i) == name(j)) for i in range(300, 1000)}
    assert {r["stop_id"]: r["same_as"] for r in found.collect()} == want


def test_readings_meet_before_their_words_are_made(spark):
    plan = registry.QUERIES["m12_join_readings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" in plan and "transform(" not in plan[plan.index("Join ") :]


def test_pages_are_drawn_by_arrays_with_every_pixel(spark, tmp_path):
    text = "".join(chr(97 + i % 26) if i % 6 else " \n"[i % 4 == 0] for i in range(300)) + "ğ😀z"
    spark.createDataFrame([(9, text), (5, ""), (6, None)], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    table = registry._pages(spark, f"file://{tmp_path}")
    assert "MapInArrow" in table._jdf.queryExecution().executedPlan().toString()
    found = {r["doc_id"]: r["grey"] for r in table.collect()}
    assert set(found) == {9, 5} and set(found[5]) == {230} and len(found[5]) == 120 * 44
    for i, grey in enumerate(found[9]):
        place = i // 120 - 20 - math.copysign(math.floor(abs((i % 120 - 60) * math.tan(math.radians(4))) + 0.5), i % 120 - 60)
        at = int(place // 4) * 120 + i % 120
        assert grey == (20 if place >= 0 and place % 4 < 2 and at < len(text) and text[at] not in " \n" else 230)
