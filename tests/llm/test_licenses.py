"""Licence scans: base places against a plain search, and labels of whole notices."""

import re
from collections import Counter

import pytest

from dispatchlake.llm import licenses as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = [
    None, "", "MIT", "mit License", "MIT-license, mit LICENSE! Apache\tlicense", "general public license general public license", "submit license", "mit mit license license",
    "x " * 5000 + "MIT license " + "y " * 5000, "Released under the MIT License.", "Licensed under CC-BY-SA 4.0", "licensed under cc by nc 4.0 here", "under the terms of the GNU Lesser General Public License",
    "Redistribution and use in source and binary forms, with or without modification, are permitted", "mİt license", "MIT lıcense", "K mit license",
]


def base(text: str | None) -> tuple:
    ws = WORD.findall((text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in op.BASE.items():
        p = phrase.split()
        at = [i for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, labels string, words int")


def test_base_places(texts):
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in op.scan(texts).collect()}
    assert got == {i: base(t) for i, t in enumerate(TEXTS)}


def test_base_places_of_odd_documents(docs):
    got = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in op.scan(docs).collect())
    assert got == Counter((r["doc_id"], *base(r["text"])) for r in docs.collect())


def test_labels_of_notices(texts):
    rows = {r["doc_id"]: r for r in op.scan(texts).collect()}
    for i, label in ((9, "mit"), (10, "cc-by-sa"), (11, "cc-by-nc"), (12, "gpl,lgpl"), (13, "bsd")):
        assert rows[i]["labels"] == label, TEXTS[i]
    for r in rows.values():
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        assert (r["score"] > 0) == bool(r["labels"])


@pytest.mark.parametrize("n", range(len(op.TEMPLATES)))
def test_every_template_is_found_and_needs_its_key_phrases(spark, n):
    label, text, keys = op.TEMPLATES[n]
    broken = text
    for phrase in keys.split("/"):
        broken = broken.replace(phrase.strip(), " ".join(phrase.strip().split()[:-1] + ["zzz"]))
    table = spark.createDataFrame([(1, f"a b {text} c"), (2, f"a b {broken} c"), *[(i, "nothing here at all") for i in range(3, 30)]], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in op.scan(table).where("doc_id < 3").collect()}
    assert label in rows[1]["labels"].split(",")
    assert rows[2]["labels"] == rows[2]["base_labels"]


def test_a_file_with_all_notices_has_all_their_labels(spark):
    notices = " | ".join(text for _, text, _ in op.TEMPLATES)
    words = " ".join(sorted({w for _, text, _ in op.TEMPLATES for w in text.split()}))
    texts = [notices, *[f"{words} {text}" for _, text, _ in op.TEMPLATES]]
    table = spark.createDataFrame([*enumerate(texts), *[(i, "nothing here at all") for i in range(50, 90)]], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in op.scan(table).where("doc_id < 50").collect()}
    assert set(rows[0]["labels"].split(",")) == {label for label, _, _ in op.TEMPLATES} and rows[0]["score"] == 1
    for k, (label, text, _) in enumerate(op.TEMPLATES, 1):
        assert label in rows[k]["labels"].split(",") and rows[k]["score"] > 0.999, text


def test_empty_table(no_docs):
    assert op.scan(no_docs).collect() == []


def brute_scan(text: str | None, weight: dict[str, float]) -> tuple[str, float]:
    """All alignments of all templates with the file, by going through every place."""
    ws = WORD.findall((text or "").translate(LOWER))
    labels, best = set(base(text)[4].split(",")) - {""}, 0.5 if base(text)[1] else 0.0
    for label, notice, keys in op.TEMPLATES:
        template = notice.split()
        rare = sorted(set(template), key=lambda w: (-weight[w], w))[: op.RARE]
        whole = sum(weight[w] for w in template)
        for start in range(-len(template), len(ws)):
            at = lambda k, start=start: ws[start + k] if 0 <= start + k < len(ws) else None
            if not any(at(k) == w and w in rare for k, w in enumerate(template)):
                continue
            share = sum(weight[w] for k, w in enumerate(template) if at(k) == w) / whole
            places = [(next(i for i in range(len(template)) if template[i : i + len(p)] == p), p) for p in (k.split() for k in keys.split("/"))]
            if share >= op.AGREE and all([at(i + k) for k in range(len(p))] == p for i, p in places):
                labels.add(label)
                best = max(best, share)
    return ",".join(sorted(labels)), min(best, 1.0)


def test_labels_and_scores_against_every_alignment(spark, docs, texts):
    import math
    import random

    rng = random.Random(6)
    notices = [t.split() for _, t, _ in op.TEMPLATES]
    made = []
    for i in range(60):
        words = rng.choices(["x", "license", "free", "the", "of"], k=rng.randint(0, 6))
        for t in rng.sample(notices, rng.randint(1, 3)):
            words += [w if rng.random() > 0.08 else "zz" for w in t[rng.randint(0, 2) :]] + ["y"]
        made.append((1000 + i, " ".join(words)))
    table = docs.select("doc_id", "text").unionByName(texts.select("doc_id", "text")).unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    weight = op.idf(table)
    rows = table.collect()
    frequent = Counter(w for r in rows for w in set(WORD.findall((r["text"] or "").translate(LOWER))))
    assert all(math.isclose(x, math.log(1 + (len(rows) + 1) / (1 + frequent[w]))) for w, x in weight.items())
    got = Counter((r["doc_id"], r["labels"], round(r["score"], 9)) for r in op.scan(table).collect())
    assert got == Counter((r["doc_id"], *(lambda x: (x[0], round(x[1], 9)))(brute_scan(r["text"], weight))) for r in rows)
