"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

The probability of a token is that of its class given the two tokens before it, times that of the token in its class
given the token before it. Both factors are softmaxes over sums of feature weights:

* class: weights of the word before (n-gram), of the word before that (skip), and of the pair of both;
* word in its class: on top of its relative frequency, a weight of (word before, word). Of a word that is very frequent,
  it and a bucket of the word before that are the feature, so no feature gathers more than a part of a shard.

Weights of n-gram and skip features of the class are shared: ``UNITS`` rows, the most frequent words' own and hashed
buckets for the others. The pairs' and the in-class weights are sparse: one for every context that occurs in the
corpus, so their number grows with it. They live in shards by the hash of the word before. Words are known by number:
the ``HEAD`` most frequent, and for others one of ``SHAPES`` hashed buckets. Words beyond the head have no in-class
weight, but their relative frequency in the class.

1. Words are counted over all training documents.
2. (word before that, word before, word) of every training token are counted by task and shuffled by shard, as
   compressed blocks; a shard's counts are one row of a table.
3. Classes are clusters of units by the frequent words that stand before them.
4. In ``ROUNDS`` rounds every shard fits its pairs' weights to the shared ones by gradient steps, and gives the gradient of
   the shared ones over all its contexts; the sums over all shards move the shared weights. The first round is the
   features' own optimum. So the weights don't depend on how the documents are dealt to tasks.
5. The tokens of all documents go to the shards the same way; a shard fits its weights to its counts, scores what it
   gets, and sends each block's sums by document back.

Counts of words beyond the head come by a join on the word.

Edge cases: null and empty texts are the end token alone; rows with null doc_ids are scored and not learned from
(and not held out); with nothing to learn from, every token has c = 0 in a vocabulary of none; repeated rows are
learned from and scored one by one; extra columns are not read.
"""

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut, uncut
from .tokens import chunks, mixed

END = b"\n"  # no word holds white space
HEAD = 262_144
SHAPES = 4_096
#: Most frequent words with a row of shared weights of their own.
OWN = 12_288
UNITS = OWN + SHAPES + 1
PROFILE = 64
CLASSES = 32
ROUNDS = 2
#: Tokens that are sorted together in a task, and (about) those of a shard.
CHUNK, SHARD = 600_000, 1_000_000
#: Bytes of texts that are split at a time.
READ = 8_000_000
#: Precision of the weights' Gaussian priors: shared and pairs', and in-class.
RIDGE, RIDGE_WORD = 1.0, 0.3
PAIR_STEPS, WORD_STEPS = 4, 6
#: How much of the skip features' own optimum is taken at first.
SKIP = 0.5
_BITS = 19  # of a word's number
_MASK = (1 << _BITS) - 1
_PAIRS = 16_384  # contexts worked on at a time
_BLOCK = 512  # rows of a matrix that are sent together
_LN10 = math.log(10)


def fold() -> str:
    return "crc32(cast(cast(doc_id as string) as binary)) % 7"


def tokens(text: bytes) -> list[bytes]:
    """A text's tokens; many texts' are read by :func:`words_of`."""
    return [*text.lower().split(), END]


def words_of(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Lower-cased words of the texts, without their ends, some MB at a time, and how many each text has."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    for a, b in chunks(pc.binary_length(texts).to_pylist(), READ):
        found = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(a, b - a)))
        words, bounds = found.values, found.offsets.to_numpy()
        full = pc.binary_length(words).to_numpy() > 0
        if not full.all():  # white space at a text's ends
            bounds = np.concatenate(([0], np.cumsum(full)))[bounds]
            words = words.filter(pa.array(full))
        yield words, np.diff(bounds)


def shape(word: bytes) -> int:
    """The bucket of a word beyond the head."""
    return zlib.crc32(word[:2] + b" " + word[-2:]) % SHAPES


def packed(x: np.ndarray) -> bytes:
    """An array of numbers: its planes of bytes, compressed one by one; an empty plane is left out."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T
    compress = zstandard.ZstdCompressor(level=1).compress
    planes = [compress(p.tobytes()) if p.any() else b"" for p in raw]
    return np.array([len(x), *map(len, planes)], np.int32).tobytes() + b"".join(planes)


def unpacked(data: bytes, kind: type = np.int64) -> np.ndarray:
    width = np.dtype(kind).itemsize
    n, *sizes = np.frombuffer(data, np.int32, 1 + width).tolist()
    raw, at = np.zeros((n, width), np.uint8), 4 * (1 + width)
    for k, size in enumerate(sizes):
        if size:
            raw[:, k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at : at + size]), np.uint8)
        at += size
    return raw.view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Keys in order: steps of the word before, steps of the one before that (from 0 for each word before), and the words."""
    before, skip, word = (x.astype(np.int32) for x in (keys >> 2 * _BITS, keys >> _BITS & _MASK, keys & _MASK))
    step, steps = np.diff(before, prepend=np.int32(0)), np.diff(skip, prepend=np.int32(0))
    first = np.concatenate(([True], step[1:] != 0))[: len(keys)]
    steps[first] = skip[first]
    parts = [packed(step), packed(steps), packed(word)]
    return np.array([len(p) for p in parts], np.int32).tobytes() + b"".join(parts)


def unpacked_keys(data: bytes) -> np.ndarray:
    ends = 12 + np.cumsum(np.frombuffer(data, np.int32, 3))
    step, steps, word = (unpacked(data[a:b], np.int32).astype(np.int64) for a, b in zip((12, *ends[:-1]), ends, strict=True))
    if not len(word):
        return word
    first = np.flatnonzero(np.concatenate(([True], step[1:] != 0)))
    total = np.cumsum(steps)
    skip = total - np.repeat(total[first] - steps[first], np.diff(np.append(first, len(word))))
    return np.cumsum(step) << 2 * _BITS | skip << _BITS | word


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def summed() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
        return pa.record_batch({"word": table["word"].combine_chunks(), "n": table["n_sum"].combine_chunks()})

    for batch in batches:
        for words, sizes in words_of(batch["text"]):
            found = pc.value_counts(words)
            held += [pa.record_batch({"word": found.field(0), "n": found.field(1)}), pa.record_batch({"word": pa.array([END.decode()], words.type), "n": pa.array([len(sizes)], pa.int64())})]
            if sum(map(len, held)) > 400_000:
                held = [summed()]
                if len(held[0]) > 200_000:
                    yield held.pop()
    if held:
        yield summed()


def head_of(counts: DataFrame, most: int) -> tuple[list[bytes], np.ndarray]:
    """The most frequent words, at most ``most``: all with a count from a bound on, which a histogram of counts gives."""
    # counts below 1,024 have a bin of their own, greater ones 64 to a doubling: a few thousand bins at any size
    bin_ = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.lit(384) + F.floor(64 * F.log2("n"))).cast("long")
    bins = counts.groupBy(bin_.alias("bin")).agg(F.count("*").alias("words"), F.min("n").alias("least")).toArrow().sort_by([("bin", "descending")])
    fits = np.cumsum(bins["words"].to_numpy()) <= most
    if not fits.any():
        return [], np.zeros(0)
    least = int(bins["least"].to_numpy()[fits].min())
    found = counts.where(F.col("n") >= least).toArrow()
    words, n = [w.encode() for w in found["word"].to_pylist()], found["n"].to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    return [words[i] for i in order], n[order].astype(np.float64)


class Vocabulary:
    """Words by number: those of the head, then buckets, then what stands before a text."""

    def __init__(self, head: list[bytes], counts: np.ndarray, tokens_: int):
        if len(head) + SHAPES > _MASK:
            raise ValueError(f"at most {_MASK - SHAPES} words in the head")
        unit = np.array([i if i < OWN else OWN + shape(w) for i, w in enumerate(head)], np.int32)
        self._fill(head, counts, unit, max(1, -(-tokens_ // SHARD)))

    def _fill(self, head: list[bytes], counts: np.ndarray, unit: np.ndarray, shards: int) -> None:
        n = len(head)
        self.head, self.counts, self.shards, self.start = head, counts, shards, n + SHAPES
        self.unit = np.concatenate((unit, OWN + np.arange(SHAPES + 1, dtype=np.int32)))
        #: buckets of the word before the one before, so that none is more than a quarter of a shard
        self.split = np.ones(self.start + 1, np.int32)
        self.split[:n] = np.maximum(1, np.ceil(4 * counts / SHARD))

    def __getstate__(self) -> tuple:
        n = len(self.head)
        words = zstandard.ZstdCompressor().compress(b" ".join(self.head))  # no word holds a space
        return words, packed(self.counts.astype(np.int64)), packed(self.unit[:n]), self.shards

    def __setstate__(self, state: tuple) -> None:
        words, counts, unit, shards = state
        head = zstandard.ZstdDecompressor().decompress(words) if counts[:4] != bytes(4) else b""
        self._fill(head.split(b" ") if head else [], unpacked(counts).astype(np.float64), unpacked(unit, np.int32), shards)

    @cached_property
    def words(self) -> pa.Array:
        return pa.array(self.head, pa.binary()).cast(pa.string())

    @cached_property
    def end(self) -> int:
        """The number of a text's end."""
        return self.head.index(END) if END in self.head else len(self.head) + shape(END)

    def feature(self, pairs: np.ndarray) -> np.ndarray:
        """The in-class feature of a context (word before, word before that): the former, and a bucket of the latter."""
        before, skip = pairs >> _BITS, pairs & _MASK
        buckets = self.split[before].astype(np.int64)
        bucket = np.where(buckets > 1, (mixed(skip.astype(np.uint64)) % buckets.astype(np.uint64)).astype(np.int64), 0)
        return before << 24 | bucket

    def shard(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(self.feature(keys >> _BITS).astype(np.uint64)) % np.uint64(self.shards)).astype(np.int32)

    def by_shard(self, keys: np.ndarray) -> np.ndarray:
        """The keys' order by shard; equal ones stay as they are (16 bits are sorted by radix)."""
        return np.argsort(self.shard(keys).astype(np.uint16 if self.shards <= 1 << 16 else np.int32), kind="stable")


def _keys(rows: list[np.ndarray], start: int) -> np.ndarray:
    """(word before, word before that, word) of all tokens of the texts, as one number each."""
    w = np.concatenate(rows).astype(np.int64)
    first = np.cumsum([0, *map(len, rows[:-1])])
    one = np.concatenate(([start], w[:-1]))
    one[first] = start
    two = np.concatenate(([start], one[:-1]))
    two[first] = start
    return one << 2 * _BITS | two << _BITS | w


def _dealt(vocabulary: Vocabulary, keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Bounds of the keys of each shard; keys are in order of shards."""
    shards = vocabulary.shard(keys)
    bounds = np.flatnonzero(np.concatenate(([True], shards[1:] != shards[:-1], [True])))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield int(shards[a]), slice(a, b)


def _by_shard(vocabulary: Vocabulary, keys: np.ndarray) -> np.ndarray:
    """Their order by shard and key."""
    order = np.argsort(keys, kind="stable")
    return order[vocabulary.by_shard(keys[order])]


def _numbered(vocabulary: Vocabulary, words: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The words' numbers, and where which words beyond the head stand."""
    at = pc.index_in(words, vocabulary.words.cast(words.type)).fill_null(-1).to_numpy().astype(np.int64)
    other = np.flatnonzero(at < 0)
    rest = words.take(pa.array(other)).cast(pa.binary()).to_pylist()
    at[other] = [len(vocabulary.head) + shape(w) for w in rest]
    return at, other, rest


def _texts(vocabulary: Vocabulary, at: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """The numbers of each text's tokens, its end included."""
    ended = np.insert(at, np.cumsum(sizes), vocabulary.end)
    first = 0
    for last in np.cumsum(sizes + 1).tolist():
        yield ended[first:last]
        first = last


def _events(shared: Broadcast):
    """(shard, keys, n): counts of the task's training tokens by context and word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(_keys(held, vocabulary.start), return_counts=True)
            order = vocabulary.by_shard(keys)
            keys, n = keys[order], n[order]
            parts = list(_dealt(vocabulary, keys))
            return pa.record_batch({
                "shard": pa.array([s for s, _ in parts], pa.int32()),
                "keys": pa.array([packed_keys(keys[at]) for _, at in parts], pa.binary()),
                "n": pa.array([packed(n[at]) for _, at in parts], pa.binary()),
            })

        for batch in batches:
            for words, sizes in words_of(batch["text"]):
                for at in _texts(vocabulary, _numbered(vocabulary, words)[0], sizes):
                    held.append(at)
                    size += len(at)
                    if size >= CHUNK:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return run


def _summed_counts(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, m = np.concatenate(keys), np.concatenate(n)
    order = np.argsort(k, kind="stable")
    k, m = k[order], m[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[first], np.add.reduceat(m, first)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each shard; rows of a shard come together."""
    at, keys, n = None, [], []

    def flush() -> pa.RecordBatch:
        k, m = _summed_counts(keys, n)
        return pa.record_batch({"shard": pa.array([at], pa.int32()), "keys": pa.array([packed_keys(k)], pa.binary()), "n": pa.array([packed(m)], pa.binary())})

    for batch in batches:
        for shard, k, m in zip(batch["shard"].to_pylist(), batch["keys"], batch["n"], strict=True):
            if shard != at and keys:
                yield flush()
                keys, n = [], []
            at = shard
            keys.append(unpacked_keys(k.as_py()))
            n.append(unpacked(m.as_py()))
            if len(keys) > 1 and sum(map(len, keys)) > 4 * max(SHARD, len(keys[0])):
                keys, n = ([x] for x in _summed_counts(keys, n))
    if keys:
        yield flush()


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for k, m in zip(batch["keys"], batch["n"], strict=True):
            yield unpacked_keys(k.as_py()), unpacked(m.as_py())


def _sent(x: np.ndarray) -> pa.RecordBatch:
    """A matrix in blocks of rows."""
    blocks = [(i, x[i * _BLOCK : (i + 1) * _BLOCK].astype(np.float32)) for i in range(-(-len(x) // _BLOCK))]
    blocks = [(i, b) for i, b in blocks if b.any()]
    return pa.record_batch({"block": pa.array([i for i, _ in blocks], pa.int32()), "data": pa.array([packed(b.ravel()) for _, b in blocks], pa.binary())})


def _total(parts: DataFrame, shape_: tuple[int, int]) -> np.ndarray:
    """The sum of the tasks' matrices, added up block by block: of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch["block"].to_pylist(), batch["data"], strict=True):
                x = unpacked(data.as_py(), np.float32).astype(np.float64)
                held[i] = held[i] + x if i in held else x
        yield pa.record_batch({"block": pa.array(list(held), pa.int32()), "data": pa.array([x.tobytes() for x in held.values()], pa.binary())})

    out = np.zeros(shape_)
    # written and read, so that the tasks' matrices are of no more use
    sums = cut(parts.repartition(16, "block").mapInArrow(run, "block int, data binary"))
    found = sums.toArrow()
    uncut(sums)
    for i, data in zip(found["block"].to_pylist(), found["data"], strict=True):
        block = out[i * _BLOCK : (i + 1) * _BLOCK]
        block[:] = np.frombuffer(data.as_py()).reshape(block.shape)
    return out


def _profiles(shared: Broadcast):
    """For each unit, how often each frequent word stands right before it, and two before it, and the unit itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, width = shared.value, 2 * PROFILE + 1
        total = np.zeros(UNITS * width)
        for keys, n in _shards(batches):
            unit = vocabulary.unit[keys & _MASK].astype(np.int64) * width
            total += np.bincount(unit + 2 * PROFILE, n, len(total))
            for k, at in enumerate((keys >> 2 * _BITS, keys >> _BITS & _MASK)):
                low = np.flatnonzero(at < min(PROFILE, len(vocabulary.head)))
                total += np.bincount(unit[low] + k * PROFILE + at[low], n[low], len(total))
        yield _sent(total.reshape(UNITS, width))

    return run


def _classes(profiles: np.ndarray, end: int) -> np.ndarray:
    """Each unit's class: weighted k-means of profiles in the chi-squared metric; the end token's class is its own."""
    weight = profiles[:, -1]
    mean = profiles[:, :-1].sum(0) / max(1.0, weight.sum())
    x = (profiles[:, :-1] + 5 * mean) / (weight + 5)[:, None]
    x = (x - mean) / np.sqrt(mean + 1e-6)
    rng = np.random.default_rng(3)
    live = np.flatnonzero(weight > 0)
    k = CLASSES - 1
    if len(live) <= k:
        out = np.zeros(UNITS, np.int64)
        out[live] = np.arange(len(live))
    else:
        # spread first centres (k-means++), then Lloyd's rounds
        centres = [x[live[weight[live].argmax()]]]
        near = ((x[live] - centres[0]) ** 2).sum(1)
        for _ in range(k - 1):
            p = near * np.sqrt(weight[live])
            pick = rng.choice(len(live), p=p / p.sum()) if p.sum() > 0 else rng.integers(len(live))
            centres.append(x[live[pick]])
            near = np.minimum(near, ((x[live] - centres[-1]) ** 2).sum(1))
        c = np.array(centres)
        for _ in range(15):
            at = ((c**2).sum(1) - 2 * x[live] @ c.T).argmin(1)
            for j in range(k):
                own = at == j
                if own.any():
                    c[j] = np.average(x[live[own]], axis=0, weights=np.sqrt(weight[live[own]]))
        out = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
    if end >= 0:
        out[end] = k
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(1, keepdims=True)
    return x


@dataclass
class Model:
    """What all shards share: classes by number, sizes of the classes, weights of the n-gram and skip features."""

    shared: Broadcast  # the vocabulary, sent to executors once
    classes: np.ndarray
    bias: np.ndarray
    sizes: np.ndarray  # tokens and words of each class, and one
    one: np.ndarray
    two: np.ndarray

    @property
    def vocabulary(self) -> Vocabulary:
        return self.shared.value

    def logits(self, pairs: np.ndarray) -> np.ndarray:
        unit = self.vocabulary.unit
        out = self.one[unit[pairs >> _BITS]]
        out += self.two[unit[pairs & _MASK]]
        out += self.bias
        return out

    def contexts(self, keys: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Contexts of a shard, some at a time, and how often each class follows."""
        pair = keys >> _BITS
        first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        of = self.classes[keys & _MASK].astype(np.int64)
        for k in range(0, len(first), _PAIRS):
            part = first[k : k + _PAIRS]
            end = first[k + _PAIRS] if k + _PAIRS < len(first) else len(keys)
            row = np.repeat(np.arange(len(part)), np.diff(np.append(part, end)))
            found = np.bincount(row * CLASSES + of[part[0] : end], n[part[0] : end], len(part) * CLASSES)
            yield pair[part], found.reshape(-1, CLASSES).astype(np.float32)

    def fitted_pairs(self, pairs: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All logits, the contexts that have weights (they occur more than once), and these."""
        logits, n = self.logits(pairs), found.sum(1, keepdims=True)
        own = np.flatnonzero(n[:, 0] > 1)
        base, target, m = logits[own], found[own], n[own]
        weights = np.zeros_like(base)
        for _ in range(PAIR_STEPS):  # a bound on the curvature, so every step is uphill
            weights += (target - m * _softmax(base + weights) - RIDGE * weights) / (m / 2 + RIDGE)
        logits[own] += weights
        return logits, own, weights


def _unit_sums(units: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    if (units[1:] < units[:-1]).any():
        order = np.argsort(units.astype(np.uint16), kind="stable")  # few enough units for a radix sort
        units, rows = units[order], rows[order]
    bounds = np.flatnonzero(np.concatenate(([True], units[1:] != units[:-1], [True])))
    first, size = bounds[:-1], np.diff(bounds)
    sums = rows[first]
    # units of many rows one by one, the others' second rows together, then their third ones and so on
    many = size > 32
    for i in np.flatnonzero(many).tolist():
        sums[i] = rows[bounds[i] : bounds[i + 1]].sum(0)
    rest, k = np.flatnonzero(~many & (size > 1)), 1
    while len(rest):
        sums[rest] += rows[first[rest] + k]
        k += 1
        rest = rest[size[rest] > k]
    out[units[first]] += sums


def _gradient(model: Model, first_round: bool):
    """For each unit, as the word before and as the one before that: gradient and curvature of its classes' weights. At first: its counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2 * UNITS, CLASSES if first_round else 2 * CLASSES), np.float32)
        for keys, n in _shards(batches):
            for pairs, found in model.contexts(keys, n):
                rows = found
                if not first_round:
                    m = found.sum(1, keepdims=True)
                    p = _softmax(model.fitted_pairs(pairs, found)[0])
                    rows = np.concatenate((found - m * p, m * p * (1 - p)), axis=1)
                unit = model.vocabulary.unit
                _unit_sums(unit[pairs >> _BITS], rows, total[:UNITS])
                _unit_sums(unit[pairs & _MASK], rows, total[UNITS:])
        yield _sent(total)

    return run


class Shard:
    """The weights that a shard's counts decide: of pairs for classes, and of features for words."""

    def __init__(self, model: Model, keys: np.ndarray, n: np.ndarray):
        self.model = model
        pairs, weights = [np.zeros(0, np.int64)], [np.zeros((0, CLASSES), np.float32)]
        for p, found in model.contexts(keys, n) if len(keys) else ():
            _, own, w = model.fitted_pairs(p, found)
            pairs.append(p[own])
            weights.append(w)
        self.pairs, self.weights = np.concatenate(pairs), np.concatenate(weights)
        # features' words
        feature, word = model.vocabulary.feature(keys >> _BITS), keys & _MASK
        self.features, at = np.unique(feature, return_inverse=True)
        group = at * CLASSES + model.classes[word]
        self.groups, group = np.unique(group, return_inverse=True)
        total = np.bincount(group, n, len(self.groups))
        known = np.flatnonzero(word < len(model.vocabulary.head))
        self.words, first, of = np.unique(at[known] << _BITS | word[known], return_index=True, return_inverse=True)
        times, group, word = np.bincount(of, n[known], len(self.words)), group[known][first], word[known][first]
        share = (model.vocabulary.counts[word] + 1) / model.sizes[model.classes[word]]
        v = np.minimum(np.log(np.maximum(1, times / (total[group] * share))), times / RIDGE_WORD) if len(word) else np.zeros(0)
        for _ in range(WORD_STEPS):
            p = share * np.exp(v) / self._norm(share, v, group)[group]
            v += np.clip((times - total[group] * p - RIDGE_WORD * v) / (total[group] * p * (1 - p) + RIDGE_WORD), -1, 1)
        self.v, self.log_norm = v, np.log(self._norm(share, v, group))
        #: the counts' own keys are scored once, as they are asked for again and again
        self.keys, self.known = keys, self._scores(keys)

    def _norm(self, share: np.ndarray, v: np.ndarray, group: np.ndarray) -> np.ndarray:
        return 1 + np.bincount(group, share * (np.exp(v) - 1), len(self.groups))

    def scores(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the tokens' probabilities, less that of (count + 1): what the caller knows. ``keys`` in order."""
        at, ok = _found(self.keys, keys)
        out = np.empty(len(keys))
        out[ok] = self.known[at[ok]]
        if not ok.all():
            out[~ok] = self._scores(keys[~ok])
        return out

    def _scores(self, keys: np.ndarray) -> np.ndarray:
        model, pair, word = self.model, keys >> _BITS, keys & _MASK
        kind = model.classes[word].astype(np.int64)
        out = -np.log10(model.sizes)[kind]
        new = np.concatenate(([True], pair[1:] != pair[:-1]))[: len(pair)]
        first = np.flatnonzero(new)
        pairs, row, bounds = pair[first], np.cumsum(new) - 1, np.append(first, len(pair))
        for k in range(0, len(pairs), _PAIRS):
            part = pairs[k : k + _PAIRS]
            mine = slice(bounds[k], bounds[k + len(part)])
            logits = model.logits(part)
            at, ok = _found(self.pairs, part)
            logits[ok] += self.weights[at[ok]]
            logits -= logits.max(1, keepdims=True)
            logits -= np.log(np.exp(logits).sum(1, keepdims=True, dtype=np.float64)).astype(np.float32)
            out[mine] += logits[row[mine] - k, kind[mine]] / _LN10
        at, ok = _found(self.features, model.vocabulary.feature(pair))
        for table, values, key, sign in ((self.groups, self.log_norm, at * CLASSES + kind, -1), (self.words, self.v, at << _BITS | word, 1)):
            place, here = _found(table, key)
            here &= ok
            out[here] += sign * values[place[here]] / _LN10
        return out


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key would stand in a sorted table, and whether it does."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


_INFO = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_head", pa.int64()), ("log_head", pa.float64()), ("tail", pa.list_(pa.string())), ("times", pa.list_(pa.int32()))])
_SENT = "kind byte, shard int, chunk long, keys binary, n binary, docs binary"
_BACK = "kind byte, chunk long, docs binary, sums binary"
_OUT = "row long, doc_id long, held_out boolean, n_tokens long, n_head long, log_head double, tail array<string>, times array<int>, local double"
_COUNTS, _TOKENS, _TEXTS = 0, 1, 2


def _asked(shared: Broadcast):
    """The tokens of all documents for the shards, and a row for each chunk of documents with what is known of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        logs = np.log10(vocabulary.counts + 1.0)
        ends = [END] if vocabulary.end >= len(logs) else []
        chunk = TaskContext.get().partitionId() << 24  # a row is its chunk and 16 bits
        held: list[np.ndarray] = []
        info: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys = _keys(held, vocabulary.start)
            docs = np.repeat(np.arange(len(held), dtype=np.uint16), [len(h) for h in held])
            order = _by_shard(vocabulary, keys)
            keys, docs = keys[order], docs[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            n, kinds = np.diff(np.append(first, len(keys))), keys[first]
            bounds = np.append(first, len(keys))
            rows = [(_TOKENS, s, chunk, packed_keys(kinds[at]), packed(n[at]), packed(docs[bounds[at.start] : bounds[at.stop]])) for s, at in _dealt(vocabulary, kinds)]
            known = pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*info, strict=True), _INFO, strict=True)], schema=_INFO)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _INFO) as writer:
                writer.write_batch(known)
            rows.append((_TEXTS, int(mixed(np.array([chunk], np.uint64))[0] % np.uint64(vocabulary.shards)), chunk, None, None, sink.getvalue().to_pybytes()))
            kinds_ = (pa.int8(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            return pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds_, strict=True)], names=[c.split()[0] for c in _SENT.split(", ")])

        for batch in batches:
            of = zip(batch["doc_id"].to_pylist(), batch["held_out"].to_pylist(), strict=True)
            for words, sizes in words_of(batch["text"]):
                numbers, other, rest = _numbered(vocabulary, words)
                first = 0
                for at, last, (doc_id, held_out) in zip(_texts(vocabulary, numbers, sizes), np.searchsorted(other, np.cumsum(sizes)).tolist(), of):  # noqa: B905 (the batch's texts come in pieces)
                    tail, known = Counter(rest[first:last] + ends), at[at < len(logs)]
                    first = last
                    held.append(at)
                    info.append((doc_id, held_out, len(at), len(known), float(logs[known].sum()), [w.decode() for w in tail], list(tail.values())))
                    size += len(at)
                    if size >= CHUNK or len(held) == 65_535:
                        yield flush()
                        held, info, size, chunk = [], [], 0, chunk + 1
        if held:
            yield flush()

    return run


def _scored(model: Model):
    """Each chunk's sums by document. A shard's counts come first, then the tokens that it is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        for batch in batches:
            rows: list[tuple] = []
            for kind, number, chunk, keys, n, docs in zip(*(batch[i] for i in range(6)), strict=True):
                kind, number, chunk = kind.as_py(), number.as_py(), chunk.as_py()
                if number != at:
                    at, shard = number, None
                if kind == _COUNTS:
                    shard = Shard(model, unpacked_keys(keys.as_py()), unpacked(n.as_py()))
                elif kind == _TEXTS:
                    rows.append((0, chunk, docs.as_py(), None))
                else:
                    if shard is None:  # no training token is in it
                        shard = Shard(model, np.zeros(0, np.int64), np.zeros(0, np.int64))
                    score = np.repeat(shard.scores(unpacked_keys(keys.as_py())), unpacked(n.as_py()))
                    mine, place = np.unique(unpacked(docs.as_py(), np.uint16), return_inverse=True)
                    rows.append((1, chunk, packed(mine), packed(np.bincount(place, score, len(mine)).astype(np.float32))))
            kinds = (pa.int8(), pa.int64(), pa.binary(), pa.binary())
            if rows:
                yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _BACK.split(", ")])

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each chunk with their sums; a chunk's documents come before its sums."""
    at, known, sums = None, None, None

    def flush() -> pa.RecordBatch:
        return pa.record_batch({"row": pa.array((at << 16) + np.arange(len(known)), pa.int64()), **{f.name: known[f.name] for f in _INFO}, "local": pa.array(sums, pa.float64())})

    for batch in batches:
        for kind, chunk, docs, part in zip(*(batch[i] for i in range(4)), strict=True):
            if kind.as_py() == 0:
                if known is not None:
                    yield flush()
                at, known = chunk.as_py(), pa.ipc.open_stream(docs.as_py()).read_all().combine_chunks().to_batches()[0]
                sums = np.zeros(len(known))
            else:
                sums[unpacked(docs.as_py(), np.uint16)] += unpacked(part.as_py(), np.float32)
    if known is not None:
        yield flush()


def _class_sums(classes: np.ndarray, shared: Broadcast):
    """Tokens and words of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            at = classes[_numbered(vocabulary, batch["word"])[0]]
            n += np.bincount(at, batch["n"].to_numpy(), CLASSES).astype(np.int64)
            v += np.bincount(at, minlength=CLASSES)
        yield pa.record_batch({"class": np.arange(CLASSES, dtype=np.int32), "n": n, "v": v})

    return run


def train(learn: DataFrame, counts: DataFrame, n_tokens: int, head_words: int = HEAD, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The shared weights, and the table of the shards' counts."""
    head, head_counts = head_of(counts, head_words)
    vocabulary = Vocabulary(head, head_counts, n_tokens)
    shared = learn.sparkSession.sparkContext.broadcast(vocabulary)  # a bounded number of words
    events = learn.select("text").mapInArrow(_events(shared), "shard int, keys binary, n binary")
    table = cut(events.repartition(vocabulary.shards, "shard").sortWithinPartitions("shard").mapInArrow(_merged, "shard int, keys binary, n binary"))

    matrix = "block int, data binary"
    profiles = _total(table.select("keys", "n").mapInArrow(_profiles(shared), matrix), (UNITS, 2 * PROFILE + 1))
    classes = _classes(profiles, head.index(END) if END in head[:OWN] else -1)[vocabulary.unit].astype(np.int8)
    sizes = counts.mapInArrow(_class_sums(classes, shared), "class int, n long, v long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    in_class, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in sizes:
        in_class[r["class"]], kinds[r["class"]] = r["n"], r["v"]
    prior = (in_class + 1) / (in_class.sum() + CLASSES)
    zero = np.zeros((UNITS, CLASSES), np.float32)
    model = Model(shared, classes, np.log(prior).astype(np.float32), in_class + kinds + 1, zero, zero)
    for k in range(rounds):
        sums = _total(table.select("keys", "n").mapInArrow(_gradient(model, k == 0), matrix), (2 * UNITS, CLASSES if k == 0 else 2 * CLASSES))
        if k == 0:
            # each feature's own optimum, drawn to the prior by some counts
            step = np.log((sums + 4 * prior) / (sums.sum(1, keepdims=True) + 4)) - np.log(prior)
            step[UNITS:] *= SKIP
        else:
            now = np.concatenate((model.one, model.two))
            step = np.clip((sums[:, :CLASSES] - RIDGE * now) / (2 * sums[:, CLASSES:] + RIDGE), -1, 1)
        model.one, model.two = model.one + step[:UNITS].astype(np.float32), model.two + step[UNITS:].astype(np.float32)
    return model, table


def scored(docs: DataFrame, head_words: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    held_out = F.coalesce(F.expr(f"{fold()} = 2"), F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long"), "text").withColumn("held_out", held_out)
    learn = docs.where("doc_id is not null and not held_out").select("text")
    counts = cut(learn.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    n_all, v_all = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    model, table = train(learn, counts, n_all, head_words, rounds)

    shards = model.vocabulary.shards
    none = F.lit(None).cast("binary")
    known = table.select(F.lit(_COUNTS).cast("byte").alias("kind"), "shard", F.lit(None).cast("long").alias("chunk"), "keys", "n", none.alias("docs"))
    asked = docs.mapInArrow(_asked(model.shared), _SENT).unionByName(known).repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    back = asked.mapInArrow(_scored(model), _BACK).repartition(shards, "chunk").sortWithinPartitions("chunk", "kind")
    texts = cut(back.mapInArrow(_gathered, _OUT))
    # words beyond the head: their counts come by a join
    tail = texts.select("row", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("row", F.col("t.tail").alias("word"), F.col("t.times").alias("times"))
    tail = tail.join(counts, "word").groupBy("row").agg(F.sum("times").alias("n_tail"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("log_tail"))
    both = texts.drop("tail", "times").join(tail, "row", "left")
    logs = F.col("log_head") + F.coalesce("log_tail", F.lit(0.0))
    return both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(math.log10(n_all + v_all + 1))).alias("base_score"),
        (logs + F.col("local")).alias("score"),
    )
