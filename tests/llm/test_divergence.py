"""Source divergence: whole reports against a plain one, over every tiling; exact quotients; odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dispatchlake.llm import divergence as op


def naive(rows: list[tuple], least: int = op.LEAST, top: int = op.TOP) -> list[tuple]:
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = sorted(t for t, n in held.items() if n >= least)
        sources = sorted({d[1] for d in docs if d[0] == lang})
        n = {s: Counter(t for d in docs if d[:2] == (lang, s) for t in d[2] if held[t] >= least) for s in sources}
        whole = {s: sum(c.values()) + 5 * len(kept) for s, c in n.items()}
        of_lang = sum(n.values(), Counter())
        p = {s: [1 + 10**9 * (n[s][t] + 5) // whole[s] for t in kept] for s in sources}
        q = [1 + 10**9 * (of_lang[t] + 5) // (sum(of_lang.values()) + 5 * len(kept)) for t in kept]
        for s in sources:
            pairs = [(o, sum(abs(a - b) for a, b in zip(p[s], p[o], strict=True))) for o in sources if o != s]
            terms = [(t, a - b) for t, a, b in zip(kept, p[s], q, strict=True) if n[s][t] and a > b]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def made() -> list[tuple]:
    rng = random.Random(8)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["Éa", "éa", "ß", "日本", "😀x", "DON'T", "a1b"]
    rows = []
    for i in range(500):
        lang, source = rng.choice(["en", "en", "en", "fr", "", None]), rng.choice(["hot", "hot", "hot", *(f"s{j}" for j in range(14)), "ü", "😀", "", None])
        rows.append((lang, source, " ".join(rng.choices(words, [1 + (j * (len(source or "") + 1)) % 5 for j in range(len(words))], k=rng.randint(0, 60)))))
    rows += [("xx", "a", "only few words here"), ("xx", "b", None), ("xx", None, ""), ("yy", "alone", "one"), ("en", "empty of words", "12 34 !!"), (None, None, None), ("en", "hot", "long words " * 20_000), rows[3], rows[3]]
    return rows


def rows_of(found):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in found.collect())


@pytest.mark.parametrize(("block", "chunk", "chunks"), [(op.BLOCK, op.CHUNK, op.CHUNKS), (3, 10, 2), (1, 7, 1), (5, 1000, 3)])
def test_reports_are_the_plain_ones_however_they_are_tiled(spark, block, chunk, chunks):
    rows = made()
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    assert rows_of(op.audit(docs, 8, 12, block, chunk, chunks)) == naive(rows, 8, 12)


def test_probabilities_are_exact_beyond_64_bits(spark):
    rng = random.Random(1)
    whole = [rng.randint(1, 9 * 10**15) for _ in range(300)] + [7, 9 * 10**15]
    n = [rng.randint(0, w) for w in whole[:-2]] + [2, 9 * 10**15 - 5]
    want = [1 + 10**9 * (a + 5) // b for a, b in zip(n, whole, strict=True)]
    assert op.probability(np.array(n), np.array(whole)).tolist() == want
    table = spark.createDataFrame(list(zip(range(len(n)), n, whole, strict=True)), "i int, n long, whole long")
    assert [r[0] for r in table.orderBy("i").select(op._probability(F.col("n"), F.col("whole"))).collect()] == want


def test_long_texts_are_read_in_parts(monkeypatch):
    monkeypatch.setattr(op, "_PIECE", 10)
    text = "abc déf ghi 12 jklmnopqrstuvwxyz abcdefghijklmnopq, end é".encode()
    assert [t for p in op._pieces(text) for t in op._TERM.findall(p)] == op._TERM.findall(text)


def test_odd_rows_and_clashing_columns(docs):
    table = docs.withColumns({c: F.lit("theirs") for c in ("term", "n", "docs", "no", "block", "chunk", "span", "i", "j", "at", "item", "value", "rank", "v", "total")})
    assert rows_of(op.audit(table, 3)) == naive([(r["lang"], r["source"], r["text"]) for r in docs.collect()], 3)


def test_empty_tables(no_docs):
    assert op.audit(no_docs).collect() == []
