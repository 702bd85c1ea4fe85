"""Line dedup: bitmaps and kept texts against a plain fold, hot keys that fill many ranges, odd rows."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dispatchlake.llm import line_dedup as op


def key_of(line: str) -> str:
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(str.maketrans(op._UPPER, op._LOWER))


def naive(rows: list[tuple], least: int = op.LEAST, documents: int = op.DOCUMENTS) -> dict:
    """Of (doc_id, text): the kept text and numbers of lines and of dropped ones."""
    held = defaultdict(set)
    for doc, text in rows:
        if doc is not None:
            for line in (text or "").split("\n"):
                held[key_of(line)].add(doc)
    out = {}
    for doc, text in rows:
        lines = (text or "").split("\n")
        gone = [doc is not None and len(k := key_of(x)) >= least and len(held[k]) >= documents and doc != max(held[k]) for x in lines]
        out[doc, text] = (len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g))
    return out


def rows_of(found):
    return Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in found.collect())


@pytest.fixture(scope="module")
def made():
    rng = random.Random(3)
    shared = [f"shared line number {i} {'x' * (i % 9)}" for i in range(60)] + ["short", "", "exactly twenty chars", "nineteen characters", "ÇÖK UZUN BİR SATIR ÇÖK", "çÖk uzun bir satir çÖk"]
    rows: list[tuple] = []
    for i in range(400):
        lines = [rng.choice(shared) for _ in range(rng.randint(1, 8))] + [f"line {i} alone of its document"] * (i % 3)
        lines = [rng.choice(["", " ", "\t\x0b", "\r"]) + rng.choice([x, x.upper(), x.title()]) + rng.choice(["", "  ", "\x0c"]) for x in lines]
        rows.append((i, "\n".join(["the line that nearly every document holds"] * (1 + i % 4 // 3) + lines)))
    rows += [(400, None), (401, ""), (402, "\n\n"), (403, "\n".join([shared[0]] * 5_000)), (404, "y" * 50_000), (5, rows[5][1]), (6, "another text of six\n" + shared[1]), (None, "\n".join(shared)), (None, None), (-7, "\n".join(shared[:10]))]
    return rows


@pytest.mark.parametrize("parts", [1, 4, 37])
def test_kept_text_against_a_plain_fold(spark, made, parts):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        docs = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
        want = naive(made)
        assert rows_of(op.dedup(docs)) == Counter((doc, *want[doc, text]) for doc, text in made)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("need", [2, 3, 5])
def test_ranges_of_any_cut_give_the_same_rows(made, need):
    """The stream over sorted rows, cut anywhere into ranges and batches, against counts."""
    rng = random.Random(need)
    rows = sorted({(k, k + 1, -d, t, p) for k, d, t, p in ((rng.randint(0, 6) ** 2, rng.randint(0, 9), 0, rng.randint(0, 3)) for _ in range(150))})
    rows = [(a, b, -d, t, p) for a, b, d, t, p in rows]
    for _ in range(40):
        # ranges are cut between documents of a key, batches anywhere
        cuts = sorted(i for i in rng.sample(range(1, len(rows)), 6) if rows[i][:3] != rows[i - 1][:3])
        gone, opened, count, top = [], [], Counter(), {}
        for s, e in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            size = rng.randint(1, 30)
            parts = [pa.record_batch([pa.array([r[c] for r in rows[i : min(i + size, e)]], pa.int32() if c == 4 else pa.int64()) for c in range(5)], names=["k1", "k2", "doc_id", "text_key", "place"]) for i in range(s, e, size)]
            for out in op._streamed(need)(iter(parts)):
                for r in out.to_pylist():
                    if r["kind"] == op._COUNT:
                        count[r["k1"]] += r["documents"]
                        top[r["k1"]] = max(top.get(r["k1"], r["doc_id"]), r["doc_id"])
                    else:
                        (gone if r["kind"] == op._GONE else opened).append((r["k1"], r["doc_id"], r["place"]))
        gone += [x for x in opened if count[x[0]] >= need and x[1] != top[x[0]]]
        docs = defaultdict(set)
        for k, _, d, _, _ in rows:
            docs[k].add(d)
        assert sorted(gone) == sorted((k, d, p) for k, _, d, _, p in rows if len(docs[k]) >= need and d != max(docs[k]))


def test_bitmaps_say_which_lines_stay(spark, made):
    docs = spark.createDataFrame(made, "doc_id long, text string")
    want = naive(made)
    maps = {(r["doc_id"], r["n_lines"], r["n_dropped"]): op.unpacked(r["keep"], r["n_lines"]) for r in op.keep_bitmaps(docs).collect()}
    assert len(maps) == len({(d, *want[d, t][:2]) for d, t in made if want[d, t][1]})
    for doc, text in made:
        n, dropped, kept = want[doc, text]
        if dropped:
            keep = maps[doc, n, dropped]
            assert len(keep) == n and (~keep).sum() == dropped
            assert "\n".join(x for x, k in zip(text.split("\n"), keep, strict=True) if k) == kept


def test_odd_rows_and_clashing_columns(docs):
    table = docs.withColumns({"n_lines": F.lit("theirs"), "keep": F.lit(b"k"), "places": F.lit(1), "_doc": F.lit("d"), "text_key": F.lit(0)})
    found = op.dedup(table)
    rest = [c for c in table.columns if c not in ("text", "n_lines")]
    assert found.columns == [*rest, "n_lines", "n_dropped", "kept_text"]
    want = naive([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert rows_of(found) == Counter((r["doc_id"], *want[r["doc_id"], r["text"]]) for r in docs.collect())
    assert Counter(tuple(r[c] for c in rest) for r in found.collect()) == Counter(tuple(r[c] for c in rest) for r in table.collect())


def test_empty_tables_and_wrong_parameters(no_docs, docs):
    assert op.dedup(no_docs).collect() == [] and op.keep_bitmaps(no_docs).collect() == []
    with pytest.raises(ValueError, match="two documents"):
        op.dropped_lines(docs, documents=1)
