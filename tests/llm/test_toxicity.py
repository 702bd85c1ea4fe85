"""Toxicity: the kernel against enumeration, odd rows, disguised insults, held-out accuracy."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest

from dispatchlake.llm import toxicity as op

WORDS = ["garden", "river", "window", "market", "letter", "summer", "yellow", "stone", "bridge", "music", "paper", "doctor", "orange", "planet", "silver", "teacher"]
INSULTS = ["grunkel", "plodvast", "skreem"]


def slow_kernel(s: str, t: str, order: int, decay: float) -> float:
    total = 0.0
    for i in itertools.combinations(range(len(s)), order):
        for j in itertools.combinations(range(len(t)), order):
            if all(s[a] == t[b] for a, b in zip(i, j, strict=True)):
                total += decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def random_string(rng: random.Random, letters: str, least: int, most: int) -> str:
    return "".join(rng.choices(letters, k=rng.randint(least, most)))


def test_kernel_counts_gapped_subsequences():
    rng = random.Random(2)
    pairs = [(random_string(rng, "abc", 5, 5), random_string(rng, "abc", 6, 6)) for _ in range(30)]
    s, t = (np.array([[ord(c) for c in p[k]] for p in pairs]) for k in (0, 1))
    assert np.allclose(op.subsequence_kernel(s, t), [slow_kernel(a, b, op.ORDER, op.DECAY) for a, b in pairs], rtol=1e-4)


def test_the_table_of_subsequences_gives_the_kernel():
    """Every value, of near and of far strings and of strings with letters that no landmark has."""
    rng = random.Random(3)
    landmarks = [random_string(rng, "abcd^", 3, 9) for _ in range(9)]
    strings = [random_string(rng, "abcdxyé^", 3, 12) for _ in range(60)] + landmarks
    want = [[slow_kernel(a, b, 3, op.DECAY) / math.sqrt(slow_kernel(a, a, 3, op.DECAY) * slow_kernel(b, b, 3, op.DECAY)) for b in landmarks] for a in strings]
    kernel = op.Kernel(landmarks, 4)
    assert np.allclose(kernel(strings), want, atol=1e-4)


def test_the_machine_is_at_its_least():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(200, 5)), np.where(rng.random(200) < 0.3, 1.0, -1.0)
    cost = rng.random(200) * 3
    loss = lambda w: w @ w / 2 + cost @ np.maximum(0, 1 - y * (x @ w + op.PLAIN)) ** 2
    w = op.machine(x, y, cost)
    assert all(loss(w) <= loss(w + rng.normal(size=5) * 10.0 ** -k) for k in range(6) for _ in range(20))


def disguised(rng: random.Random, w: str) -> str:
    k = rng.randint(1, len(w) - 2)
    return rng.choice([w, w[:k] + "-" + w[k:], ".".join(w), w[:k] + w[k] + w[k:], w[:k] + "x" + w[k:], w.upper()])


@pytest.fixture(scope="module")
def sample(spark):
    rng = random.Random(5)
    rows, marks = [], []
    for i in range(900):
        ws = rng.choices(WORDS, k=rng.randint(5, 30))
        toxic = i % 6 == 0
        if toxic:
            ws.insert(rng.randint(0, len(ws)), disguised(rng, rng.choice(INSULTS)))
        rows.append((i, " ".join(ws), "x", 1.0))
        marks.append((i, 1, int(toxic)))
    rows += [(2000, None, None, None), (2001, "", None, None), (2002, "12 !! ?", None, None), (None, "garden", None, None), (3, rows[3][1], None, None), (2003, "river " * 20_000, None, None), (2004, "z" * 3000, None, None)]
    marks += [(None, 1, 1), (5, None, None), (2001, 0, 0), (12, 1, 0), (9999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic string, score double").repartition(4), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def model(sample):
    return op.train(*sample)


def test_disguised_insults_of_the_held_out_fold(sample, model):
    docs, labels = sample
    score = {}
    for r in op.score(docs, model).collect():
        score.setdefault(r["doc_id"], r["score"])
    truth = {r["doc_id"]: r["toxic"] for r in labels.where("doc_id < 900 and toxic is not null").collect() if r["doc_id"] not in (5, 12)}
    fold = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((score[i] >= op.THRESHOLD) == bool(truth[i]) for i in fold)
    assert right >= 0.95 * len(fold)


def test_every_row_has_a_score(sample, model):
    docs, _ = sample
    rows = op.score(docs, model).collect()
    assert sorted(map(repr, (r["doc_id"] for r in rows))) == sorted(map(repr, (r["doc_id"] for r in docs.collect())))
    assert all(0 <= r["score"] <= 1 and math.isfinite(r["score"]) for r in rows)
    of = {r["doc_id"]: r["score"] for r in rows}
    assert of[2000] == of[2001] == of[2002] < op.THRESHOLD and of[2003] < op.THRESHOLD


def test_toxic_rows_go_and_the_others_stay_whole(sample, model):
    docs, _ = sample
    kept = op.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    bad = {r["doc_id"] for r in op.score(docs, model).collect() if r["score"] >= op.THRESHOLD}
    assert sorted(map(repr, kept.collect())) == sorted(repr(r) for r in docs.collect() if r["doc_id"] not in bad)


def test_without_two_classes_nothing_is_toxic(sample, spark):
    docs, labels = sample
    for few in (labels.limit(0), labels.where("toxic = 0")):
        none = op.train(docs, few)
        assert none is None and {r["score"] for r in op.score(docs, none).collect()} == {0.0}
        assert op.drop_toxic(docs, none).count() == docs.count()
    assert op.score(docs.limit(0), op.train(docs.limit(0), labels)).collect() == []


def test_labels_of_the_held_out_fold_are_not_learned(sample, model):
    docs, labels = sample
    turned = labels.selectExpr("doc_id", "quality", f"if({op.fold()} = 2, 1 - toxic, toxic) as toxic")
    other = op.train(docs, turned)
    assert other.kernel.landmarks == model.kernel.landmarks and np.allclose(other.weights, model.weights) and np.allclose(other.curve, model.curve)


def test_without_a_significant_run_there_is_no_model(spark):
    """Two toxic texts of words that no other text has prove nothing."""
    rng = random.Random(4)
    rows = [(i, " ".join(random_string(rng, "abcdefghijklmnopqrstuvwxyz", 6, 6) for _ in range(30))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in (21, 35, 40))) for i in range(60)], "doc_id long, toxic int")
    assert op.train(docs, labels) is None


def test_length_decides_nothing(sample, model):
    """Random words stay clean however many they are; insults are found within any number of clean texts."""
    rng, windows = random.Random(6), model.windows()
    for n in (100, 1_000, 10_000):
        texts = [" ".join(random_string(rng, "abcdefghijklmnopqrstuvwxyz", 6, 6) for _ in range(n)) for _ in range(5)]
        assert (model.score(texts, windows) < op.THRESHOLD).all()
    clean = lambda n: " ".join(rng.choices(WORDS, k=n))
    assert (model.score([clean(50_000)], windows) < op.THRESHOLD).all()
    hidden = [f"{clean(rng.randint(0, 3000))} {disguised(rng, w)} {clean(rng.randint(0, 3000))}" for w in INSULTS for _ in range(15)]
    alone = model.score([t for t in hidden], windows)
    assert (alone >= op.THRESHOLD).sum() >= 40


def test_sf01_texts_with_clean_ones_appended(spark):
    """On the given labels: toxic texts are still found with 20 clean ones behind them, and few clean ones are flagged."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = op.train(docs, labels)
    rows = docs.join(labels, "doc_id").where(f"{op.fold()} = 2").select("doc_id", "text", "toxic").orderBy("doc_id").collect()
    windows = model.windows()
    scores = model.score([r["text"] for r in rows], windows)
    toxic = np.array([r["toxic"] for r in rows]) > 0
    assert (scores[toxic] >= op.THRESHOLD).mean() >= 0.88 and (scores[~toxic] >= op.THRESHOLD).mean() <= 0.01
    rng, clean = random.Random(3), [r["text"] for r in rows if not r["toxic"] and r["text"]]
    found = [r["text"] for r, s in zip(rows, scores, strict=True) if r["toxic"] and s >= op.THRESHOLD][:40]
    assert (model.score(["\n".join([t, *rng.choices(clean, k=20)]) for t in found], windows) >= op.THRESHOLD).sum() >= 36
    noise = [" ".join(random_string(rng, "abcdefghijklmnopqrstuvwxyz", 6, 6) for _ in range(10_000)) for _ in range(10)]
    assert (model.score(noise, windows) < op.THRESHOLD).all()


def naive_score(text: str | None, model: op.Model) -> float:
    """A text's score from the definitions: every unit of every window against every landmark, one by one."""
    landmarks = model.kernel.landmarks
    norm = {s: math.sqrt(sum(v * v for v in op.subsequences(s).values())) for s in landmarks}

    def values(unit: str) -> list[float]:
        own = op.subsequences(unit)
        size = math.sqrt(sum(v * v for v in own.values()))
        found = [sum(v * own[x] for x, v in op.subsequences(m).items()) / (size * norm[m]) for m in landmarks]
        return found

    low = (text or "").lower()
    scores = []
    for words in [low.split(), [m.group() for m in op._SPELLED.finditer(low)]]:
        line = [u for w in words for u in op.units(w)]
        for s in range(0, max(1, len(line) - op.WINDOW // 2), op.WINDOW // 2):
            units = [values(u) for u in sorted(set(line[s : s + op.WINDOW]))]
            margins = [float(np.dot(v, model.weights[:, 0])) + op.PLAIN for v in units]
            sums = np.sum([np.zeros(len(landmarks)), *[np.array(v) ** 4 for v in units]], axis=0)
            over = [m for m in margins if m > 0]
            x = [float(sums @ model.text_weights) + op.PLAIN, max([op.PLAIN, *margins]), math.log1p(len(over)), math.log1p(sum(over)), 1]
            scores.append(1 / (1 + math.exp(-min(40, max(-40, float(np.dot(x, model.curve)))))))
    return max(scores)


def test_scores_are_those_of_the_definitions(sample, model, monkeypatch):
    docs, _ = sample
    rows = docs.where("doc_id < 40 or doc_id between 2000 and 2002").select("doc_id", "text").collect()
    texts = [r["text"] for r in rows] + [" ".join([*WORDS * 20, "g r u n k e l", *WORDS * 9, "s-k-r-e-e-m", "x" * 70 + "plodvast" * 3])]
    want = [naive_score(t, model) for t in texts]
    assert np.allclose(model.score(texts, model.windows()), want, atol=2e-3)
    # the same in small parts, with little held
    for name, value in (("_PIECE", 50), ("_MEMBERS", 64), ("_CACHE", 5)):
        monkeypatch.setattr(op, name, value)
    windows = model.windows()
    assert np.allclose([model.score([t], windows)[0] for t in texts[:-1]], want[:-1], atol=2e-3)


def test_kernel_values_are_sums_over_shared_subsequences():
    kernel = op.Kernel(["^abc", "^cabbage", "zzz"], 1)
    strings = ["^abc", "^xyw", "^abcabbagez", "qqqq", "^zzzzzzz", "^bcabage"]

    def shared(a: str, b: str) -> float:
        x, y = op.subsequences(a), op.subsequences(b)
        return sum(v * y[k] for k, v in x.items())

    want = [[shared(s, m) / (shared(s, s) * shared(m, m)) ** 0.5 for m in kernel.landmarks] for s in strings]
    assert np.allclose(kernel(strings), want, atol=1e-5) and not kernel(["^xyw"]).any()
