"""Substring dedup against a brute-force search of all windows."""

import re
from collections import Counter

import pytest

from dispatchlake.llm import substring_dedup as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows: list[tuple], length: int) -> list[tuple]:
    least: dict[tuple, int] = {}
    split = [(i, WORD.findall(t or "")) for i, t, *_ in rows]
    for i, ws in split:
        if i is not None:
            for k in range(len(ws) - length + 1):
                w = tuple(ws[k : k + length])
                least[w] = min(least.get(w, i), i)
    out = []
    for i, ws in split:
        gone = set()
        if i is not None:
            for k in range(len(ws) - length + 1):
                if least[tuple(ws[k : k + length])] < i:
                    gone.update(range(k, k + length))
        out.append((i, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return out


@pytest.mark.parametrize(("length", "seed_words"), [(13, 6), (5, 2), (4, 4)])
def test_same_as_brute_force(docs, length, seed_words):
    got = [tuple(r)[:4] for r in op.substring_dedup(docs, length, seed_words).collect()]
    assert Counter(got) == Counter(brute([tuple(r) for r in docs.collect()], length))


def test_spans_are_the_maximal_repeats(docs):
    for r in op.substring_dedup(docs).collect():
        assert sum(s["last"] - s["first"] + 1 for s in r["spans"]) == r["n_removed"]
        assert all(s["last"] - s["first"] + 1 >= 13 for s in r["spans"])
        assert all(a["last"] + 1 < b["first"] for a, b in zip(r["spans"], r["spans"][1:], strict=False))


def test_rows_that_share_a_doc_id_lose_their_own_words_only(spark):
    t = lambda p, n: " ".join(f"{p}{i}" for i in range(n))
    shared, other = t("s", 30), t("o", 25)
    rows = [(1, shared), (1, t("u", 40)), (2, t("v", 60) + " " + shared), (2, shared), (2, t("w", 30)), (2, other), (3, other + " " + t("x", 20)), (3, other), (4, t("v", 60) + " " + other)]
    got = [tuple(r)[:4] for r in op.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()]
    assert Counter(got) == Counter(brute(rows, 13))


def test_copies_of_a_hot_document_fall_to_the_smallest(spark):
    text = " ".join(f"t{i}" for i in range(50))
    rows = spark.range(1000).selectExpr("id as doc_id", f"'{text}' as text").repartition(7)
    assert {(r["n_removed"], r["doc_id"] == 0) for r in op.substring_dedup(rows).collect()} == {(0, True), (50, False)}


def test_empty_table(no_docs):
    assert op.substring_dedup(no_docs).collect() == []
