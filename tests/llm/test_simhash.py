"""SimHash fingerprints and components against brute force over all pairs."""

import numpy as np
import pytest
import xxhash

from dispatchlake.llm import simhash as op


def mark_of(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(marks: list[int], radius: int) -> list[int]:
    """The index of each entry's component, by repeated merging."""
    group = list(range(len(marks)))
    arr = np.array(marks, np.uint64)
    for i in range(len(marks)):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= radius):
            a, b = group[i], group[j]
            if a != b:
                group = [min(a, b) if g in (a, b) else g for g in group]
    return group


def test_fingerprints_and_components(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    marks = [mark_of(t) for _, t in rows]
    group = components(marks, op.RADIUS)
    least = {g: min((i for (i, _), h in zip(rows, group, strict=True) if h == g and i is not None), default=None) for g in set(group)}
    want = sorted(((i, m, least[g]) for (i, _), m, g in zip(rows, marks, group, strict=True)), key=repr)
    got = sorted(((r["doc_id"], r["mark"] % (1 << 64), r["component_id"]) for r in op.simhash(docs).collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("bucket", [8192, 16])
def test_no_link_is_lost(spark, bucket):
    """Random marks, chains and dense balls; small buckets force the deeper levels."""
    rng = np.random.default_rng(4)
    marks = list(rng.integers(0, 1 << 63, 200, dtype=np.uint64))
    for base in marks[:30]:
        x = base
        for _ in range(8):
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                x = x ^ np.uint64(1 << int(bit))
            marks.append(x)
    marks += [np.uint64((1 << int(i)) | (1 << int(j))) for i, j in rng.integers(0, 64, (150, 2))]
    marks = np.unique(np.array(marks, np.uint64))
    table = spark.createDataFrame([(int(m),) for m in marks.view(np.int64)], "mark long")
    edges = op.near_edges(table, 4, bucket).collect()
    index = {int(m): i for i, m in enumerate(marks.view(np.int64))}
    group = list(range(len(marks)))
    for e in edges:
        u, v = index[e["u"]], index[e["v"]]
        assert np.bitwise_count(marks[u] ^ marks[v]) <= 4
        a, b = group[u], group[v]
        group = [min(a, b) if g in (a, b) else g for g in group]
    assert group == components([int(m) for m in marks], 4)


def test_masks_cover_every_pair_within_the_radius():
    rng = np.random.default_rng(1)
    for level in (0, 1):
        masks = [m % (1 << 64) for m in op.masks(4, level)]
        for _ in range(500):
            bits = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(m & bits == 0 for m in masks)


def test_near_dedup_keeps_one_whole_row_of_each_component(docs):
    kept = op.near_dedup(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    everything = set(docs.collect())
    assert set(rows) <= everything and len(rows) == len(set(rows))
    of = {(r["doc_id"], r["mark"]): r["component_id"] for r in op.simhash(docs).collect()}
    assert len(rows) == len({c if c is not None else m for (_, m), c in of.items()})
    assert {r["doc_id"] for r in rows if r["doc_id"] is not None} == {c for c in of.values() if c is not None}


def test_empty_table(no_docs):
    assert op.simhash(no_docs).collect() == []
    assert op.near_dedup(no_docs).collect() == []
