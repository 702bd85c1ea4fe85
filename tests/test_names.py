"""Names by index: every name within the edits, runs of words in texts, and addresses out of whole texts."""

import math
import random

import pytest

from dispatchlake.operators import gazetteer, names


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def typo(rng: random.Random, s: str, n: int) -> str:
    for _ in range(n):
        i = rng.randint(0, len(s))
        s = rng.choice([s[:i] + rng.choice("abc ") + s[i:], s[:i] + s[i + 1 :], s[:i] + rng.choice("abcx") + s[i + 1 :]])
    return s


@pytest.mark.parametrize("share", [0.25, 0.4])
def test_all_names_within_the_edits_are_found(spark, share):
    """Against every pair: typos anywhere, the first letters too, of short, long, empty and repetitive names."""
    rng = random.Random(9)
    known = sorted({"".join(rng.choices("abc ", k=rng.randint(0, 16))) for _ in range(150)} | {"", "aaaaaaaa", "ataturk caddesi", "x"})
    asked = sorted({typo(rng, rng.choice(known), rng.randint(0, 5)) for _ in range(250)} | set(known))
    block = lambda s: len(s) % 2
    a = spark.createDataFrame([(block(n), w) for w in asked for n in ("", "x")] + [(0, None)], "k int, w string").distinct()
    n = spark.createDataFrame([(block(x), x) for x in known] + [(1, None)], "k int, n string")
    found = {(r["k"], r["w"], r["n"]): r["edits"] for r in names.within_edits(a, n, ["k"], "w", "n", share).collect()}
    want = {(block(x), w, x): e for w in asked for x in known if (e := edits(w, x)) <= math.floor(share * len(x))}
    asked_in = {(r["k"], r["w"]) for r in a.collect()}
    assert found == {k: e for k, e in want.items() if k[:2] in asked_in} and sum(e > 0 for e in found.values()) > 50


def test_no_pairs_are_made(spark):
    plan = names.within_edits(spark.createDataFrame([(1, "a")], "k int, w string"), spark.createDataFrame([(1, "a")], "k int, n string"), ["k"], "w", "n", 0.25)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def naive_runs(words: list[str], known: list[tuple[str, str]], after: int) -> list[tuple]:
    out = []
    for kind in {k for k, _ in known}:
        hits = [(i, len(n.split())) for k, n in known if k == kind and n for i in range(len(words)) if words[i : i + len(n.split())] == n.split()]
        out += [(kind, " ".join(words[i : i + n]), i, n, tuple(words[i + n : i + n + after])) for i, n in hits if not any((j, m) != (i, n) and j <= i and j + m >= i + n for j, m in hits)]
    return sorted(out)


def test_runs_of_words(spark):
    rng = random.Random(4)
    vocabulary = list("abcd")
    known = sorted({(k, " ".join(rng.choices(vocabulary, k=rng.randint(1, 4)))) for k in ("road", "quarter") for _ in range(12)} | {("road", "")})
    texts = [(i, rng.choices(vocabulary + ["x", "y"], k=rng.randint(0, 40))) for i in range(60)] + [(100, [""]), (101, []), (102, None)]
    rows = names.runs_of_words(spark.createDataFrame(texts, "id int, words array<string>"), spark.createDataFrame(known + known[:2], "kind string, name string"), "id", "words", 3).collect()
    got = {}
    for r in rows:
        got.setdefault(r["id"], []).append((r["kind"], r["name"], r["begin"], r["size"], tuple(r["after"])))
    want = {i: w for i, ws in texts if (w := naive_runs(ws or [], known, 3))}
    assert {i: sorted(v) for i, v in got.items()} == want


@pytest.fixture(scope="module")
def places(spark):
    rows = [
        ("Kale", "Yeni", "Gül Sokak", "5", 1.0, 2.0), ("Kale", "Yeni", "Gül Sokak", "7", 1.1, 2.1), ("Kale", "Yeni Şafak", "Gül", "5", 1.2, 2.2), ("Tavas", "Yeni", "Gül Sokak", "5", 3.0, 4.0),
        ("Tavas", "Çarşı", "1234", "12", 5.0, 6.0), ("Tavas", "Çarşı", None, None, 5.5, 6.5),
    ]
    return spark.createDataFrame(rows, "district string, quarter string, road string, door string, lat double, lng double")


def resolved(spark, places, texts, words=None):
    rows = [(i, t, (words or {}).get(i)) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "id int, text string, ocr array<struct<text string, confidence double>>")
    found = gazetteer.resolve_texts(table, places, "id", ocr_words="ocr").collect()
    return {r["id"]: r for r in found}


def test_addresses_of_texts(spark, places):
    texts = [
        "SAYIN X\nYENİ Mah. GÜL SOKAK No:7 KALE", "yeni mah gül sokak no 5", "yeni şafak mah. gül no 5 kale", "Gül Sokak 5, Tavas", "gül sokak 5", "yeni mah. gül sokak no 99 kale", "çarşı 1234 sokak no: 12 daire 3 tavas", None, "", "kale yeni",
        "gül sokak 5 tavas ... yeni mah gül sokak 7 tavas",
    ]
    r = resolved(spark, places, texts)
    short = {i: (x["district"], x["quarter"], x["road"], x["door"], x["confidence"], x["precision"], x["grade"]) for i, x in r.items()}
    assert short[0] == ("Kale", "Yeni", "Gül Sokak", "7", 100, "kapi", "green")
    assert short[1][1:] == ("Yeni", "Gül Sokak", "5", 90, "kapi", "green")
    assert short[2] == ("Kale", "Yeni Şafak", "Gül", "5", 100, "kapi", "green")  # the longer quarter, not the one within it
    assert short[3] == ("Tavas", "Yeni", "Gül Sokak", "5", 70, "kapi", "yellow")
    assert short[4] == short[7] == short[8] == short[9] == (None, None, None, None, 0, "yok", "red")
    assert short[5] == ("Kale", "Yeni", "Gül Sokak", None, 70, "yol", "yellow")
    assert short[6] == ("Tavas", "Çarşı", "1234", "12", 100, "kapi", "green")
    assert len(r) == len(texts)


def test_a_doubtful_door_is_not_green(spark, places):
    text = "5 adet yeni mah gül sokak no:5 kale"
    sure = [(w, 95.0) for w in text.split()]
    doubtful = [(w, 20.0 if w == "no:5" else 95.0) for w in text.split()]
    other = [(w, 20.0 if i == 0 else 95.0) for i, w in enumerate(text.split())]  # the other 5 was read badly
    r = resolved(spark, places, [text] * 6, {0: sure, 1: doubtful, 2: other, 3: None, 4: [], 5: [("kale", 10.0), (None, 3.0)]})
    assert [(r[i]["grade"], r[i]["door_confidence"]) for i in range(6)] == [("green", 95.0), ("yellow", 20.0), ("green", 95.0), ("green", None), ("green", None), ("green", None)]


def test_empty_tables(spark, places):
    none = spark.createDataFrame([], "id int, text string")
    assert gazetteer.resolve_texts(none, places, "id").collect() == []
    some = spark.createDataFrame([(1, "yeni mah gül sokak 5")], "id int, text string")
    assert [r["precision"] for r in gazetteer.resolve_texts(some, places.limit(0), "id").collect()] == ["yok"]


def test_texts_are_neither_broadcast_nor_shuffled_to_find_names(spark, places, tmp_path):
    """Names made in the session have no known size, and a text's file is far smaller than the rows of its words."""
    spark.range(200).selectExpr("id", "concat('yeni mah gül sokak no ', id % 9, ' kale') AS text", "array(named_struct('text', 'kale', 'confidence', 1.0D)) AS ocr").write.parquet(f"file://{tmp_path}/t")
    texts = spark.read.parquet(f"file://{tmp_path}/t").selectExpr("*", "split(text, ' ') AS words")
    known = spark.createDataFrame([("road", "gül sokak"), ("quarter", "yeni")], "kind string, name string")
    plan = names.runs_of_words(texts, known, "id", "words", 3)._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan and "SortMergeJoin" not in plan
    found = gazetteer.resolve_texts(texts, places, "id", ocr_words="ocr")
    assert "BuildLeft" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 200


def test_a_common_road_is_not_tried_in_every_district(spark):
    """A road of 500 districts, of which the text names one or none: the greatest named place counts, as of all that could be tried."""
    rows = [(f"D{i:03}", "Yeni", "Gül Sokak", str(i % 7), float(i), 1.0) for i in range(500)]
    places = spark.createDataFrame(rows, "district string, quarter string, road string, door string, lat double, lng double")
    texts = spark.createDataFrame([(1, "yeni gül sokak 3"), (2, "yeni gül sokak 3 d010"), (3, "yeni gül sokak 5 d010"), (4, "gül sokak 3 d010 d003"), (5, "yeni gül sokak 99")], "id int, text string")
    found = {r["id"]: (r["district"], r["door"], r["confidence"]) for r in gazetteer.resolve_texts(texts, places, "id").collect()}
    assert found == {1: ("D493", "3", 90), 2: ("D010", "3", 100), 3: ("D495", "5", 90), 4: ("D010", "3", 70), 5: ("D499", None, 60)}
    plan = gazetteer.resolve_texts(texts, places, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "area" in plan and "has_district" not in plan


def test_a_question_is_asked_once(spark):
    """A thousand texts with one address, whose road is in 40 quarters of the district: rows shuffled don't grow with texts times quarters."""
    def shuffled() -> int:
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty()
        gateway = spark.sparkContext._gateway
        stages = context.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    rows = [("Kale", f"Q{i:02}", "Gül Sokak", str(i % 7), float(i), 1.0) for i in range(40)]
    places = spark.createDataFrame(rows, "district string, quarter string, road string, door string, lat double, lng double")
    texts = spark.range(1000).selectExpr("id", "concat('q', 10 + id % 2, ' gül sokak 3 kale') AS text")
    before = shuffled()
    found = {(r["quarter"], r["door"], r["confidence"]) for r in gazetteer.resolve_texts(texts, places, "id").collect()}
    assert found == {("Q10", "3", 100), ("Q38", "3", 70)}  # a quarter that is named counts as much as a door; of equal ones the greatest
    assert shuffled() - before < 10_000
