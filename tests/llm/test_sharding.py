"""Sharding: what each law promises, and splitters against a whole sort."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from dispatchlake.llm import sharding as op


def check(rows, docs, shards):
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert {r["law"] for r in rows} <= {"bytes"} and {r["grown_shard"] for r in rows} <= {None}
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("shards", [1, 2, 16])
def test_every_row_once_with_gapless_slots(docs, shards):
    found = op.shard(docs, shards)
    assert set(docs.columns) - {"shard"} <= set(found.columns)
    check(found.collect(), docs.collect(), shards)


def test_sizes_are_near_equal_even_with_a_hot_group(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text over and over").otherwise(F.concat(F.lit("text "), F.repeat(F.col("id").cast("string"), (F.col("id") % 9).cast("int")))).alias("text"))
    found = op.shard(docs, carry=False)
    check(found.collect(), docs.collect(), 16)
    sizes = [r["b"] for r in found.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) < 0.01 * sum(sizes) / 16


def test_splitters_are_where_a_sort_puts_them(spark):
    rows = spark.range(3000).select(F.xxhash64("id").alias("_k1"), F.lit(0).cast("long").alias("_k2"), F.col("id").alias("_k3"), (F.col("id") % 50 + 1).alias("_size"))
    found = op.splitters(rows, 8, tolerance=0.01)
    order = sorted((r["_k1"], r["_size"]) for r in rows.collect())
    total = sum(s for _, s in order)
    for i, key in enumerate(found, 1):
        below = sum(s for k, s in order if k < key[0] or (k == key[0] and key[-1]))
        assert abs(below - total * i / 8) <= max(50, 0.01 * total / 8)


def test_empty_table(no_docs):
    assert op.shard(no_docs).collect() == []
