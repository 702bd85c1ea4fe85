"""Small documents with every odd case: nulls, empty and very long texts, repeated rows, ties, clashing columns."""

import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, shard string, _n long, mark long, c0 string, row int"


def made_documents() -> list[tuple]:
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)] + ["Çok", "ünlü", "naïve", "日本語", "MIT", "End."]
    sentence = lambda n: " ".join(rng.choices(words, k=n))
    shared, common = sentence(60), sentence(20)
    texts: list[str | None] = [None, "", "   \t\n", "one", "two words", sentence(12), sentence(13)]
    texts += [sentence(rng.randint(5, 120)) for _ in range(40)]
    texts += [sentence(10) + " " + shared + " " + sentence(10) for _ in range(5)]
    texts += [common + " " + sentence(30) for _ in range(12)]
    texts += [texts[20]] * 6 + [texts[21] + " tail"] * 3
    texts += [sentence(20_000), "z" * 5_000, "a a a a " * 30, shared + " " + shared, "x\x0by\x0cz q r"]
    rows = [(i, t, "en", ["hot", "web", None][min(2, i % 5 // 2)] if i % 7 else "hot", len(t or ""), 0.5, "s", 3, 4, "c", 5) for i, t in enumerate(texts)]
    rows += [rows[30], rows[30], (None, sentence(40), None, "web", 0, None, None, None, None, None, None), (None,) * 11, (-5, texts[25], "en", "web", 0, 0.0, "s", 1, 1, "c", 1)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(made_documents(), COLUMNS).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
