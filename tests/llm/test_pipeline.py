"""The pipeline: each stage on its own input against its operator's own judgement, and the whole run."""

import inspect
import os
from collections import Counter

import pytest

import corpus_pipeline
from dispatchlake.llm import decontaminate, simhash, toxicity

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "mixing", "sharding"]
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in corpus_pipeline.STAGES)


def test_toxicity(spark, documents):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    bad = {r["doc_id"] for r in toxicity.score(documents, toxicity.train(documents, labels)).collect() if r["score"] >= toxicity.THRESHOLD}
    kept = corpus_pipeline.drop_toxic(spark, documents, DATA)
    assert kept.columns == documents.columns
    assert Counter(kept.collect()) == Counter(r for r in documents.collect() if r["doc_id"] not in bad)


def test_near_dedup(spark, documents):
    kept = corpus_pipeline.near_dedup(spark, documents, DATA)
    assert kept.columns == documents.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["component_id"] for r in simhash.simhash(documents).collect()}
    assert set(kept.collect()) <= set(documents.collect())


def test_decontamination(spark, documents):
    benchmark = spark.read.parquet(f"{DATA}/benchmark.parquet")
    bad = {r["doc_id"] for r in decontaminate.contamination(documents, benchmark).where("contaminated").collect()}
    kept = corpus_pipeline.decontaminated(spark, documents, DATA)
    assert bad and kept.columns == documents.columns
    assert Counter(kept.collect()) == Counter(r for r in documents.collect() if r["doc_id"] not in bad)


def test_mixing_and_sharding_keep_whole_rows(spark, documents):
    mixed = corpus_pipeline.mixed(spark, documents, DATA)
    assert mixed.columns == documents.columns
    assert set(mixed.collect()) <= set(documents.collect())
    placed = corpus_pipeline.sharded(spark, mixed, DATA)
    assert placed.count() == mixed.count() and set(documents.columns) <= set(placed.columns)


def test_run(spark):
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert rows and len({r["shard"] for r in rows}) == 16
    for s in range(16):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_documents(spark, docs, name):
    """Nulls in every column, empty and very long texts, copies, repeated rows and ids, columns with clashing names."""
    stage = dict(corpus_pipeline.STAGES)[name]
    found = stage(spark, docs, DATA)
    rows, everything = found.collect(), Counter(docs.collect())
    if name == "sharding":
        kept = Counter(tuple(r[c] for c in docs.columns if c != "shard") for r in rows)
        assert kept == Counter(tuple(r[c] for c in docs.columns if c != "shard") for r in everything.elements())
        return
    assert found.columns == docs.columns
    assert set(rows) <= set(everything)
    if name == "toxicity":  # none of these words marks the labelled texts
        assert Counter(rows) == everything
    elif name == "simhash_near_dedup":
        marks = {(r["doc_id"], r["mark"]): r["component_id"] for r in simhash.simhash(docs).collect()}
        assert Counter(r["doc_id"] for r in rows if r["doc_id"] is not None) == Counter(set(marks.values()) - {None})
    elif name == "decontamination":
        benchmark = spark.read.parquet(f"{DATA}/benchmark.parquet")
        bad = {r["doc_id"] for r in decontaminate.contamination(docs, benchmark).where("contaminated").collect()}
        assert Counter(rows) == Counter({r: n for r, n in everything.items() if r["doc_id"] not in bad})
    else:
        assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in everything}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_an_empty_table(spark, no_docs, name):
    found = dict(corpus_pipeline.STAGES)[name](spark, no_docs, DATA)
    assert found.collect() == [] and set(no_docs.columns) <= set(found.columns)
