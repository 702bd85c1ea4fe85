"""Language-model scoring: exact counts and base scores, a proper distribution, better than the base on held-out texts."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dispatchlake.llm import lm as op

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text: str | None) -> list[str]:
    return [*(w for w in (text or "").translate(LOWER).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w), "\n"]


def held(i: int | None) -> bool:
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


@pytest.mark.parametrize("head_words", [op.HEAD, 50])
def test_counts_and_base_scores(docs, head_words):
    rows = docs.collect()
    counts = Counter(t for r in rows if r["doc_id"] is not None and not held(r["doc_id"]) for t in tokens(r["text"]))
    n_all, v_all = sum(counts.values()), len(counts)
    want = []
    for r in rows:
        ts = tokens(r["text"])
        want.append((r["doc_id"], held(r["doc_id"]), len(ts), sum(counts[t] > 0 for t in ts), n_all, sum(math.log10((counts[t] + 1) / (n_all + v_all + 1)) for t in ts)))
    got = [tuple(r)[:6] for r in op.scored(docs, head_words).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)


def test_scores_are_log_probabilities(docs):
    rows = op.scored(docs).collect()
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in rows)


def trained(docs, head_words):
    learn = docs.where("doc_id is not null").where(f"{op.fold()} <> 2").select("text")
    counts = learn.mapInArrow(op._counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    n = counts.agg(F.sum("n")).first()[0]
    model, table = op.train(learn, counts, n, head_words)
    (row,) = table.collect()  # so few tokens are one shard
    return model, op.Shard(model, op.unpacked_keys(row["keys"]), op.unpacked(row["n"])), {r["word"].encode(): r["n"] for r in counts.collect()}


@pytest.mark.parametrize("head_words", [op.HEAD, 50])
def test_probabilities_of_what_may_follow_sum_to_one(docs, head_words):
    model, shard, counts = trained(docs, head_words)
    v = model.vocabulary
    rank = {w: i for i, w in enumerate(v.head)}
    number = {w: rank[w] if w in rank else len(v.head) + op.shape(w) for w in counts}
    # and one unknown word of each class, under any of its buckets
    unknown = {int(model.classes[k]): k for k in range(len(v.head), v.start)}
    seen = np.array(sorted(number.values()))
    for before, skip in ((v.start, v.start), (0, v.start), (int(seen[3]), int(seen[1])), (int(seen[5]), int(seen[40])), (int(seen[-1]), 0)):
        score = lambda words: shard.scores(np.array([before << 38 | skip << 19 | w for w in words], np.int64))  # noqa: B023, E731
        words = list(counts)
        total = sum((counts[w] + 1) * 10**s for w, s in zip(words, score([number[w] for w in words]), strict=True))
        # in classes that no bucket has, the share of unknown words can't be asked for
        rest = 10 ** score(list(unknown.values()))
        missing = set(range(op.CLASSES)) - set(unknown)
        assert total + rest.sum() <= 1 + 1e-4
        if not missing or head_words == 50:
            assert total + rest.sum() > 0.97


def test_a_scores_parts_are_those_of_the_model(docs):
    """The documents' scores, summed up token by token with the model's own numbers."""
    model, shard, counts = trained(docs, 50)
    v = model.vocabulary
    rank = {w: i for i, w in enumerate(v.head)}
    want = []
    for r in docs.collect():
        words = op.tokens((r["text"] or "").encode())
        ids = [rank[w] if w in rank else len(v.head) + op.shape(w) for w in words]
        before = [v.start, *ids[:-1]]
        skip = [v.start, *before[:-1]]
        keys = np.array([a << 38 | b << 19 | w for a, b, w in zip(before, skip, ids, strict=True)], np.int64)
        want.append((len(words), float(shard.scores(keys).sum()) + sum(math.log10(counts.get(w, 0) + 1) for w in words)))
    got = [(r["n_tokens"], r["score"]) for r in op.scored(docs, 50).collect()]
    for (n, a), (m, b) in zip(sorted(got), sorted(want), strict=True):
        assert n == m and math.isclose(a, b, rel_tol=1e-4, abs_tol=1e-3)


def test_weights_do_not_depend_on_how_documents_are_dealt(docs):
    one, many = (sorted((r["n_tokens"], r["score"]) for r in op.scored(docs.repartition(n)).collect()) for n in (1, 7))
    assert all(n == m and math.isclose(a, b, rel_tol=1e-4, abs_tol=1e-3) for (n, a), (m, b) in zip(one, many, strict=True))


def test_the_head_is_bounded_whatever_the_ties(spark):
    rows = [(f"w{i}", 1 + (i % 3)) for i in range(30)] + [("x", 5_000), ("y", 5_001)]
    counts = spark.createDataFrame(rows, "word string, n long")
    assert op.head_of(counts, 2)[0] == [b"y", b"x"] and op.head_of(counts, 11)[0] == [b"y", b"x"]
    assert len(op.head_of(counts, 12)[0]) == 12 and len(op.head_of(counts, 100)[0]) == 32 and op.head_of(counts, 1)[0] in ([], [b"y"])


def test_blocks_come_back_as_they_were():
    rng = np.random.default_rng(1)
    assert np.array_equal(op.unpacked(op.packed(np.array([3, -1, 1 << 60]))), [3, -1, 1 << 60])
    for n, most in ((0, 5), (1, 5), (500, 3), (5000, 300_000)):
        a, b, w = rng.integers(0, most, (3, n))
        keys = np.unique(a << 38 | b << 19 | w)
        assert np.array_equal(op.unpacked_keys(op.packed_keys(keys)), keys)


def test_held_out_texts_are_likelier_than_by_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = op.scored(docs).where("held_out").collect()
    n = sum(r["n_tokens"] for r in rows)
    assert sum(r["score"] for r in rows) / n > sum(r["base_score"] for r in rows) / n + 0.3


def test_nothing_to_learn_from(no_docs, spark):
    assert op.scored(no_docs).collect() == []
    only_held = next(i for i in range(100) if held(i))
    row = op.scored(spark.createDataFrame([(only_held, "a b")], "doc_id long, text string")).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["held_out"], row["base_score"]) == (3, 0, 0, True, 0.0)


def test_words_are_read_many_texts_at_a_time(monkeypatch):
    texts = ["".join(map(chr, range(300))), None, "", " \t a B\x1cc\x85d ", "x", " \n", "İI É x"]
    monkeypatch.setattr(op, "READ", 8)
    got = [(words.type, words.to_pylist(), sizes.tolist()) for words, sizes in op.words_of(pa.array(texts))]
    assert len(got) > 2
    flat = iter([w.encode() for _, words, _ in got for w in words])
    assert [[next(flat) for _ in range(n)] for _, _, sizes in got for n in sizes] == [(t or "").encode().lower().split() for t in texts]


@pytest.mark.parametrize("head", [[b"b", op.END, b"a"], [b"b"], []])
def test_tokens_are_numbered_with_their_ends(head):
    vocabulary = op.Vocabulary(head, np.ones(len(head)), 10)
    number = lambda w: head.index(w) if w in head else len(head) + op.shape(w)
    ((words, sizes),) = op.words_of(pa.array(["A b", "", "zz b zz"]))
    at, other, rest = op._numbered(vocabulary, words)
    assert rest == [w for w in (b"a", b"b", b"zz", b"b", b"zz") if w not in head] and len(other) == len(rest)
    assert [x.tolist() for x in op._texts(vocabulary, at, sizes)] == [[number(w) for w in t] for t in ([b"a", b"b", op.END], [op.END], [b"zz", b"b", b"zz", op.END])]


def test_rows_are_summed_by_unit():
    rng = np.random.default_rng(1)
    for units in (rng.integers(0, 50, 999), np.sort(rng.zipf(1.3, 999) % 60), np.zeros(5, np.int64)):
        rows, out = rng.integers(0, 9, (len(units), 4)).astype(np.float32), np.ones((60, 4), np.float32)
        want = out.copy()
        np.add.at(want, units, rows)
        op._unit_sums(units, rows, out)
        assert (out == want).all()


def test_a_shard_scores_the_keys_of_its_counts_once(monkeypatch):
    """Asked for them again, it sums no logits; new keys among them don't change that, or the others' scores."""
    class Held:
        value = op.Vocabulary([b"a", b"b", b"c", op.END], np.array([9.0, 7.0, 5.0, 4.0]), 25)

    rng, shape = np.random.default_rng(1), (op.UNITS, op.CLASSES)
    one, two = (rng.normal(size=shape).astype(np.float32) for _ in range(2))
    classes = (np.arange(Held.value.start + 1) % op.CLASSES).astype(np.int8)
    model = op.Model(Held, classes, np.zeros(op.CLASSES, np.float32), np.full(op.CLASSES, 8.0), one, two)
    key = lambda before, skip, word: before << 2 * op._BITS | skip << op._BITS | word
    counted = np.array(sorted(key(i % 4, i // 4 % 3, i % 3) for i in range(12)), np.int64)
    shard = op.Shard(model, counted, np.arange(1, 13))
    asked = np.array(sorted([*counted.tolist(), key(0, 3, 1), key(2, 3, 0)]), np.int64)
    whole, seen, logits = shard._scores(asked), [], op.Model.logits
    monkeypatch.setattr(op.Model, "logits", lambda self, pairs: seen.append(len(pairs)) or logits(self, pairs))
    assert np.allclose(shard.scores(asked), whole, rtol=0, atol=1e-6) and sum(seen) == 2
    seen.clear()
    assert len(shard.scores(counted)) == 12 and not seen
