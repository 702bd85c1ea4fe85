"""Toxicity: a subsequence string-kernel support vector machine with Nystroem landmarks.

A text is judged by its units: its words without outer punctuation, with the signs between their letters taken out, and runs
of single letters read as one word, so an insult may be gapped or have characters put in. The gap-weighted subsequence
kernel (Lodhi et al. 2002: all common subsequences of ``ORDER`` characters, each character of their span costing a factor
``DECAY``) compares a unit with the landmarks, by the subsequences themselves: those of the landmarks are a table, and a unit's
own are looked up in it. The Nystroem map turns the kernel values into features of two linear machines with (squared) hinge loss.
One is trained on units, which weigh by the shares of toxic and of clean texts that have them. The other is trained on windows:
a window's kernel value with a landmark is the sum of its different units' to the fourth power, which is a kernel too (a sum of
products), where a near match outweighs many far ones.

Texts of any length are judged alike: by windows of ``WINDOW`` units, each half over the one before. A window has its own
margin, the worst of its units' margins, and how many of its different units are on the wrong side, and how far; a logistic
curve over these gives its score, and a text has the score of its worst window. Nothing adds up over a long text, and no
clean surrounding outweighs an insult.

Fitting uses at most ``SAMPLE`` labelled rows (least hashes of doc_id first). The machines are trained on all of them. So that
the curve doesn't read machines that know its rows, ``FOLDS`` further pairs of machines are each trained without one fold, and
the curve is fitted on every row by the pair that hasn't seen it. Landmarks are a cover of the toxic texts by character runs that mark them significantly (all runs with evidence above
``GAIN`` that are ``LIFT`` times as frequent), and the harmless units nearest to those. Without a significant run there is no model.
The machine of units is trained on every unit that is as near as ``NEAR`` to a landmark; windows are chosen by the machine itself,
each text's worst one, in ``ROUNDS`` rounds.

Edge cases: null and empty texts have no unit and get the score of the least margins; rows whose labels are null
aren't learned from, and of several labels of a document the greatest counts; with no toxic or no clean labelled
row, or too few for a significant run, all scores are 0; null doc_ids are never learned from and are not held out; repeated
rows are scored one by one; very long texts are read in parts; extra columns are not read.
"""

import math
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut

#: Parameters of the fit: labelled rows that it uses (least hashes of doc_id first),
SAMPLE = 6_000
#: evidence (of Chernoff's bound) and excess that make a character run a mark of toxic texts,
GAIN, LIFT = 12.0, 2.0
#: the model's size, nearness of the units that it is trained on, and the price of a training error.
LANDMARKS, HARMLESS = 96, 40
NEAR, COST = 0.3, 30.0
ROUNDS, FOLDS = 4, 3
ORDER = 3
DECAY = 0.6
THRESHOLD = 0.3
#: Units of a window, an even number.
WINDOW = 128
#: Longer words are judged in overlapping parts.
UNIT = 24
START = "^"
#: Margin of what is like no landmark, and of what is more harmless still: almost all units are harmless.
PLAIN = -1.0
_NONE = -1
#: Texts judged at a time, words held, characters read and members of windows reduced at a time.
TEXTS, _CACHE, _PIECE, _MEMBERS = 128, 600_000, 1 << 20, 1 << 20
_LETTERS = re.compile(r"[\W_]+")
_SPELLED = re.compile(r"(?<!\S)(?:[^\W\d_][ .\-_*]+){2,}[^\W\d_](?!\w)")


def units(word: str) -> list[str]:
    """What is judged of a white-space-separated, lower-cased word; its start is marked, as a character of its own."""
    bare = _LETTERS.sub("", word)
    if len(bare) < ORDER:
        return []
    bare = START + bare
    if len(bare) <= UNIT:
        return [bare]
    return [bare[i : i + UNIT] for i in range(0, len(bare) - UNIT // 2, UNIT // 2)]


def pieces(text: str) -> Iterator[str]:
    """``text`` in parts that end where a word does."""
    at = 0
    while len(text) - at > _PIECE:
        end = re.compile(r"\s").search(text, at + _PIECE)
        if not end:
            break
        yield text[at : end.start()]
        at = end.start()
    yield text[at:]


def words_of(text: str | None) -> Iterator[list[str]]:
    """A text's words, part by part; last, always, its runs of single letters."""
    spelled: list[str] = []
    for part in pieces((text or "").lower()):
        yield part.split()
        spelled += [m.group() for m in _SPELLED.finditer(part)]
    yield spelled


def units_of(text: str | None) -> set[str]:
    return {u for ws in words_of(text) for w in set(ws) for u in units(w)}


def subsequence_kernel(s: np.ndarray, t: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """The kernel of each row of ``s`` with the same row of ``t``: code points, padded with values that differ."""
    n, width = t.shape
    v = np.arange(width)
    # weight of a match at place w of t, seen from the prefix of length v+1
    reach = np.where(v[None, :] >= v[:, None], decay ** (v[None, :] - v[:, None] + 2.0), 0).astype(np.float32)
    partial = [np.ones((n, width + 1), np.float32)] + [np.zeros((n, width + 1), np.float32) for _ in range(order - 1)]
    total = np.zeros(n, np.float32)
    for u in range(s.shape[1]):
        same = (t == s[:, u : u + 1]).astype(np.float32)
        total += decay * decay * (same * partial[-1][:, :-1]).sum(1)
        for i in range(order - 1, 0, -1):
            partial[i] *= decay
            partial[i][:, 1:] += (same * partial[i - 1][:, :-1]) @ reach
    return total


def subsequences(string: str) -> Counter:
    """The weight of each subsequence of ORDER characters (three)."""
    out: Counter = Counter()
    for i in range(len(string)):
        for j in range(i + 1, len(string)):
            for k in range(j + 1, len(string)):
                out[string[i] + string[j] + string[k]] += DECAY ** (k - i + 1)
    return out


class Kernel:
    """Normalised kernel values with a set of landmarks: sums over the landmarks' own subsequences."""

    def __init__(self, landmarks: list[str], marks: int):
        """``marks``: so many of the landmarks, the first ones, mark toxic texts."""
        self.landmarks, self.marks = landmarks, marks
        chars = sorted(set("".join(landmarks)))
        self.size = len(chars) + 1  # 0: a character that no landmark has
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(c) for c in chars]] = np.arange(1, self.size)
        weights = [subsequences(m) for m in landmarks]
        every = sorted(set().union(*weights))
        #: the row of a subsequence in the table; row 0 is of no weight
        self.row = np.zeros(self.size**3, np.int32)
        self.table = np.zeros((len(every) + 1, len(landmarks)), np.float32)
        for at, x in enumerate(every, 1):
            a, b, c = (int(self.number[ord(q)]) for q in x)
            self.row[(a * self.size + b) * self.size + c] = at
            self.table[at] = [w[x] for w in weights]
        self.table /= np.array([math.sqrt(sum(v * v for v in w.values())) or 1.0 for w in weights], np.float32)

    def __call__(self, strings: list[str]) -> np.ndarray:
        out = np.zeros((len(strings), len(self.landmarks)), np.float32)
        long = np.fromiter(map(len, strings), np.int64, len(strings))
        for n in np.unique(long):  # strings of one length together: nothing is padding
            which = np.flatnonzero(long == n)
            for at in range(0, len(which), 8192):
                rows = which[at : at + 8192]
                codes = np.frombuffer("".join(strings[i] for i in rows).encode("utf-32-le", "surrogatepass"), np.int32).reshape(len(rows), n)
                own = np.sqrt(subsequence_kernel(codes, codes))
                out[rows] = self._shared(self.number[codes]) / np.maximum(own, 1e-12)[:, None]
        return out

    def _shared(self, x: np.ndarray) -> np.ndarray:
        """What rows of numbered characters share with each landmark."""
        out = np.zeros((len(x), len(self.landmarks)), np.float32)
        i, j, k = _triples(x.shape[1])
        weight = (DECAY ** (k - i + 1.0)).astype(np.float32)
        size = max(1, (1 << 20) // max(1, len(i)))
        for at in range(0, len(x), size):
            part = x[at : at + size]
            part, mine = np.ascontiguousarray(part.T), out[at : at + size]
            for found, heavy in zip(self.row[(part[i] * self.size + part[j]) * self.size + part[k]], weight, strict=True):
                (hit,) = found.nonzero()
                if len(hit):  # one triple of places of all rows at a time: sums of many short runs would cost more
                    mine[hit] += self.table[found[hit]] * heavy
        return out


@lru_cache(maxsize=UNIT + 2)
def _triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places i < j < k of a string of ``n``."""
    i, j, k = np.meshgrid(np.arange(n), np.arange(n), np.arange(n), indexing="ij")
    keep = (i < j) & (j < k)
    return i[keep], j[keep], k[keep]


class Windows:
    """Values of the windows of texts: sums and extremes over their different units. A unit is judged once."""

    def __init__(self, judge: Callable[[list[str]], np.ndarray], machines: int, width: int):
        """``judge``: of each unit its margins by each machine, and ``width`` values to add up."""
        self.judge, self.machines, self.width = judge, machines, width
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # of a word: its unit, _NONE, or below that the place of its parts
        self.parts: list[list[int]] = []
        self.units: dict[str, int] = {"": 0}  # no unit: it is in every window
        self.values = np.zeros((1, self.machines + self.width), np.float32)
        self.values[0, : self.machines] = PLAIN

    def _learn(self, words: set[str]) -> None:
        new = {w: units(w) for w in words if w not in self.known}
        fresh = list({u for us in new.values() for u in us if u not in self.units})
        if fresh:
            self.units.update(zip(fresh, range(len(self.values), len(self.values) + len(fresh)), strict=True))
            self.values = np.concatenate([self.values, self.judge(fresh)])
        for w, us in new.items():
            if len(us) == 1:
                self.known[w] = self.units[us[0]]
            elif us:
                self.known[w] = _NONE - 1 - len(self.parts)
                self.parts.append([self.units[u] for u in us])
            else:
                self.known[w] = _NONE

    def _numbers(self, words: list[str]) -> np.ndarray:
        """The units of the words, in order."""
        found = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        found = found[found != _NONE]
        if len(found) and found.min() < _NONE:
            found = np.concatenate([[n] if n >= 0 else self.parts[_NONE - 1 - n] for n in found.tolist()])
        return found

    def _reduced(self, members: list[int], sizes: list[int]) -> np.ndarray:
        """Of each window: the sums, and by each machine margin of its worst unit, units on the wrong side, how far, and nearness of all."""
        first = np.cumsum([0, *sizes[:-1]])
        v = self.values[members].astype(np.float64)
        out = [np.add.reduceat(v[:, self.machines :], first, axis=0)]
        for m in v[:, : self.machines].T:
            over = np.maximum(m, 0)
            out += [np.maximum.reduceat(m, first), np.add.reduceat((over > 0).astype(np.float64), first), np.add.reduceat(over, first), np.add.reduceat(m - PLAIN, first)]
        return np.column_stack(out)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The windows' values, and each text's first window; every text has one."""
        if len(self.known) > _CACHE:
            self._forget()
        out, members, sizes, first, half = [], [], [], [0], WINDOW // 2
        for group in _groups(texts):
            if len(group) > 1:
                split = [list(words_of(t)) for t in group]
                self._learn({w for parts in split for ws in parts for w in ws})
            else:  # a very long text goes part by part
                split = [words_of(group[0])]
            for parts in split:
                numbers = []
                for ws in parts:
                    if len(group) == 1:
                        self._learn(set(ws))
                    numbers.append(self._numbers(ws))
                n = 0
                # runs of single letters have windows of their own
                for line in (np.concatenate(numbers[:-1]), numbers[-1]):
                    if n and not len(line):
                        continue
                    for s in range(0, max(1, len(line) - half), half):
                        window = {0, *line[s : s + WINDOW].tolist()}
                        members.extend(window)
                        sizes.append(len(window))
                        n += 1
                        if len(members) > _MEMBERS:
                            out.append(self._reduced(members, sizes))
                            members, sizes = [], []
                first.append(first[-1] + n)
        if members:
            out.append(self._reduced(members, sizes))
        return np.concatenate(out), np.array(first[:-1])


def _groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Texts that make up a few parts together; a longer one alone."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t or "") > 4 * _PIECE:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t or "")
    if held:
        yield held


_judged: dict[str, Windows] = {}


@dataclass
class Model:
    kernel: Kernel
    weights: np.ndarray  # of the kernel values, a column for each machine of units: the Nystroem map and the machine's weights in one
    text_weights: np.ndarray | None = None  # the same of the machine of windows
    curve: np.ndarray | None = None  # of a window's features, and a constant
    name: str = ""  # of a whole model, so that a worker's tasks share what they have judged

    def judge(self, strings: list[str]) -> np.ndarray:
        """Of each unit: its margins, and what it adds to its window's kernel values (without a machine of windows) or margin."""
        values = self.kernel(strings)
        sharp = (values * values) ** 2
        adds = sharp if self.text_weights is None else (sharp @ self.text_weights)[:, None]
        return np.column_stack([np.maximum(values @ self.weights + PLAIN, PLAIN), adds]).astype(np.float32)

    def windows(self) -> Windows:
        """With what this process has judged already, if the model has a name."""
        if self.name not in _judged:
            _judged.clear()  # one model's at a time
            new = self._windows()
            if not self.name:
                return new
            _judged[self.name] = new
        return _judged[self.name]

    def _windows(self) -> Windows:
        return Windows(self.judge, self.weights.shape[1], 1 if self.text_weights is not None else len(self.weights))

    def score(self, texts: list[str | None], windows: Windows) -> np.ndarray:
        values, first = windows(texts)
        return 1 / (1 + np.exp(-np.clip(np.maximum.reduceat(features(values[:, 0], values[:, 1:]) @ self.curve, first), -40, 40)))


def features(margin: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """What the curve reads of windows: their margin, their units' worst, units on the wrong side, how far, and a constant."""
    return np.column_stack([margin + PLAIN, rest[:, 0], np.log1p(rest[:, 1]), np.log1p(rest[:, 2]), np.ones(len(margin))])


def _runs(unit: str) -> set[str]:
    return {unit[i : i + n] for n in (4, 5, 6, 8) for i in range(len(unit) - n + 1)} | {unit}


def _counted(parts_of: Callable[[str | None], set[str]]):
    """Toxic and clean documents of the task and of each fold that have each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, bool], Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for fold_ in {f for f, _ in seen}:
                toxic, clean = seen.get((fold_, True), Counter()), seen.get((fold_, False), Counter())
                keys = list(toxic.keys() | clean.keys())
                yield pa.record_batch({"part": pa.array(keys, pa.string()), "fold": pa.array([fold_] * len(keys), pa.int32()), "toxic": pa.array([toxic[k] for k in keys], pa.int64()), "clean": pa.array([clean[k] for k in keys], pa.int64())})
            seen.clear()

        for batch in batches:
            for text, toxic, fold_ in zip(*(batch[c].to_pylist() for c in ("text", "toxic", "fold")), strict=True):
                seen.setdefault((fold_, toxic > 0), Counter()).update(parts_of(text))
                if sum(map(len, seen.values())) > 300_000:
                    yield from flush()
        yield from flush()

    return run


def _marked(runs: set[str]):
    """(runs): of each text, those that it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set().union(*map(_runs, units_of(t))) & runs) for t in batch["text"].to_pylist()]
            yield pa.record_batch({"runs": pa.array(found, pa.list_(pa.string()))})

    return run


def _near(kernel: Kernel, least: float):
    """Units at least so near to a mark, with their nearness and their kernel values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = kernel(batch["part"].to_pylist())
            near = values[:, : kernel.marks].max(1, initial=0)
            keep = np.flatnonzero(near >= least)
            part = batch.take(pa.array(keep))
            yield pa.record_batch({**{c: part[c] for c in ("part", "toxic", "clean")}, "near": pa.array(near[keep], pa.float32()), "found": pa.array(values[keep].tolist(), pa.list_(pa.float32()))})

    return run


def machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """A linear machine with squared hinge loss and its threshold given, y * (w x + PLAIN) >= 1, by Newton's method on the rows within the margin."""
    wanted, w = 1 - PLAIN * y, np.zeros(x.shape[1])
    loss = lambda w: w @ w / 2 + cost @ np.maximum(0, wanted - y * (x @ w)) ** 2
    now = loss(w)
    for _ in range(100):
        short = wanted - y * (x @ w)
        on = short > 0
        slope = w - 2 * ((cost * y * short)[on] @ x[on])
        step = np.linalg.solve(np.eye(len(w)) + 2 * (x[on] * cost[on][:, None]).T @ x[on], slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now - 1e-4 * size * (slope @ step):
            size /= 2
        after = loss(w - size * step)
        if after >= now:
            break
        w, before, now = w - size * step, now, after
        if before - now < 1e-9 * max(1.0, before):
            break
    return w


def _nystroem(gram: np.ndarray) -> np.ndarray:
    value, vector = np.linalg.eigh(gram.astype(np.float64))
    keep = value > 1e-4
    return vector[:, keep] / np.sqrt(value[keep])


def cover(held: list[set[str]], strength: dict[str, float], most: int) -> list[str]:
    """Runs that don't overlap and cover the texts, each up to three times, strongest first."""
    open_, out = [3] * len(held), []
    while strength and len(out) < most:
        covers = Counter(r for runs, left in zip(held, open_, strict=True) if left for r in runs if r in strength)
        if not covers:
            break
        best = max(covers, key=lambda r: (covers[r] * strength[r], len(r), r))
        out.append(best)
        open_ = [left - (best in runs and left > 0) for runs, left in zip(held, open_, strict=True)]
        strength = {r: v for r, v in strength.items() if r not in best and best not in r and not any(best[i : i + 4] in r for i in range(len(best) - 3))}
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a curve with Platt's targets (drawn in by one count), by damped Newton steps."""
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    target = np.where(y > 0, hi, lo)
    w, ridge = np.zeros(x.shape[1]), 1e-2 * np.eye(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        q = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * q[:, None]).T @ x + ridge, x.T @ (p - target) + ridge @ w)
        step *= min(1.0, 1.0 / max(1e-9, np.abs(step).max()))
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fold() -> str:
    return "crc32(cast(cast(doc_id as string) as binary)) % 4"


def _margin(weights: np.ndarray):
    return sum(F.get("sums", F.lit(i)) * float(w) for i, w in enumerate(weights))


def _fit_windows(fit: DataFrame, number: int, size: int, toxic: int, clean: int, gram: np.ndarray) -> np.ndarray:
    """Weights of a machine of windows. A round trains it on each text's worst window by the round before, and on clean ones' worst so far."""
    nystroem = _nystroem(gram)
    weights, known = None, None
    for _ in range(ROUNDS):
        worst = F.col("rest")[4 * number + 3] if weights is None else _margin(weights)
        rows = fit.groupBy("doc_id", "toxic").agg(F.max_by("sums", worst).alias("sums")).orderBy("doc_id").toArrow()
        y = np.where(rows["toxic"].to_numpy() > 0, 1.0, -1.0)
        x = rows["sums"].combine_chunks().flatten().to_numpy().reshape(len(y), size) @ nystroem
        share = np.where(y > 0, 1 / toxic, 1 / clean)
        more, known = known, x[y < 0]
        if more is not None:
            share = np.concatenate([np.where(y > 0, share, share / 2), np.full(len(more), 0.5 / clean)])
            x, y = np.vstack([x, more]), np.concatenate([y, -np.ones(len(more))])
        weights = nystroem @ machine(x, y, COST * share)
    return weights


def _fit_curve(windows: DataFrame, weights: list[np.ndarray], folds: bool) -> np.ndarray:
    """The curve, over each text's worst window by the curve itself; a fold's rows are read by the machines without it."""

    def read(k: int):
        rest = [F.col("rest")[4 * k + i] for i in range(3)]
        return F.array(_margin(weights[k]) + PLAIN, rest[0], F.log1p(rest[1]), F.log1p(rest[2]), F.lit(1.0))

    x = read(FOLDS)
    for k in range(FOLDS if folds else 0):
        x = F.when(F.col("fold") == k, read(k)).otherwise(x)
    values = cut(windows.select("doc_id", "toxic", x.alias("x")))
    curve = np.array([1.0, 1.0, 0.0, 0.0, 0.0])
    for _ in range(ROUNDS):
        worst = sum(F.col("x")[i] * float(c) for i, c in enumerate(curve))
        rows = values.groupBy("doc_id", "toxic").agg(F.max_by("x", worst).alias("x")).orderBy("doc_id").collect()
        curve = _logistic(np.array([r["x"] for r in rows]), np.array([float(r["toxic"] > 0) for r in rows]))
    return curve


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model, from at most ``sample`` labelled rows outside the held-out fold; None if a class, or a significant run, is missing."""
    chosen = labels.where(f"doc_id is not null and toxic is not null and {fold()} <> 2").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # of many more labelled rows, a part by hash that holds the sample's several times over: the rest isn't sorted
    part = max(1, chosen.count() // (4 * sample))
    chosen = chosen.where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(part)) == 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    of_fold = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").repartition(24, "doc_id")
    texts = cut(texts.select(F.col("doc_id").cast("long"), "text", F.col("toxic").cast("int"), of_fold.alias("fold")))
    seen = {(r["fold"], r["toxic"]): r["count"] for r in texts.groupBy("fold", (F.col("toxic") > 0).alias("toxic")).count().collect()}
    if len({t for _, t in seen}) < 2:
        return None
    folds = len(seen) == 2 * FOLDS  # else there are too few rows to leave any out
    # rows of each class without each fold, and of all
    n_toxic, n_clean = ([sum(n for (f, c), n in seen.items() if c == toxic and f != k) for k in [*range(FOLDS), None]] for toxic in (True, False))
    base = n_toxic[-1] / (n_toxic[-1] + n_clean[-1])
    counted = "part string, fold int, toxic long, clean long"
    counts = texts.mapInArrow(_counted(lambda t: set().union(*map(_runs, units_of(t)))), counted).groupBy("part").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    both = F.col("toxic") + F.col("clean")
    share = F.least(F.col("toxic") / both, F.lit(1 - 1e-9))
    # Chernoff's bound on so large a toxic share by chance
    gain = both * (share * F.log(share / base) + (1 - share) * F.log((1 - share) / (1 - base)))
    marks = counts.where((F.col("toxic") >= 1) & (share > LIFT * base) & (gain > GAIN)).select("part", (share / base).alias("lift")).orderBy("part").collect()
    if not marks:
        return None
    strength = {r["part"]: math.log(r["lift"]) for r in marks}
    held = [set(r["runs"]) for r in texts.where("toxic > 0").mapInArrow(_marked(set(strength)), "runs array<string>").collect()]
    landmarks = cover(sorted(held, key=sorted), strength, LANDMARKS - HARMLESS)
    by_fold = [F.array(*[F.sum(F.when(F.col("fold") != k, F.col(c)).otherwise(0)) for k in range(FOLDS)], F.sum(c)).alias(c) for c in ("toxic", "clean")]
    parts = cut(texts.mapInArrow(_counted(units_of), counted).groupBy("part").agg(*by_fold))
    schema = "part string, toxic array<long>, clean array<long>, near float, found array<float>"
    # harmless units by how much they would weigh if they were taken for a landmark
    every = F.col("clean")[FOLDS]
    hard = parts.where(every > 0).mapInArrow(_near(Kernel(landmarks, len(landmarks)), 0.0), schema).orderBy(F.desc(F.col("near") * every), F.desc("near"), "part").limit(HARMLESS).collect()
    kernel = Kernel(landmarks + [r["part"] for r in hard if r["part"] not in landmarks], len(landmarks))
    size = len(kernel.landmarks)
    gram = kernel(kernel.landmarks).astype(np.float64)
    gram = (gram + gram.T) / 2
    nystroem = _nystroem(gram)
    near = parts.mapInArrow(_near(kernel, NEAR), schema).orderBy("part").toArrow()
    values, toxic, clean = (near[c].combine_chunks().flatten().to_numpy().reshape(len(near), -1) for c in ("found", "toxic", "clean"))

    def of_units(k: int) -> np.ndarray:
        ill, well = toxic[:, k] / n_toxic[k], clean[:, k] / n_clean[k]
        bad, good = ill > well, well > 0  # what toxic texts have of a unit beyond what any text has
        x = np.vstack([values[bad], values[good]]) @ nystroem
        return nystroem @ machine(x, np.repeat([1.0, -1.0], [bad.sum(), good.sum()]), COST * np.concatenate([(ill - well)[bad], well[good]]))

    used = [*range(FOLDS if folds else 0), FOLDS]  # machines without a fold, and those of all
    weights = {k: of_units(k) for k in used}
    model = Model(kernel, np.column_stack([weights.get(k, weights[FOLDS]) for k in range(FOLDS + 1)]))
    windows = cut(texts.mapInArrow(_windowed(model), "doc_id long, toxic int, fold int, sums array<double>, rest array<double>"))
    of_windows = {k: _fit_windows(windows.where(F.col("fold") != k), k, size, n_toxic[k], n_clean[k], gram**4) for k in used}
    curve = _fit_curve(windows, [of_windows.get(k) for k in range(FOLDS + 1)], folds)
    return Model(kernel, weights[FOLDS][:, None], of_windows[FOLDS], curve, uuid.uuid4().hex)


def _windowed(model: Model):
    """Every window of the texts: its kernel values, and what its words' margins say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = model.windows()
        for batch in batches:
            for k in range(0, len(batch), TEXTS):
                part = batch.slice(k, TEXTS)
                values, first = windows(part["text"].to_pylist())
                rows = part.take(pa.array(np.repeat(np.arange(len(part)), np.diff(np.append(first, len(values))))))
                size = len(model.weights)
                yield pa.record_batch({**{c: rows[c] for c in ("doc_id", "toxic", "fold")}, "sums": pa.array(values[:, :size].tolist(), pa.list_(pa.float64())), "rest": pa.array(values[:, size:].tolist(), pa.list_(pa.float64()))})

    return run


def _scored(model: Model):
    """Batches of few texts, and their scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        windows = model.windows()
        for batch in batches:
            for k in range(0, len(batch), TEXTS):
                part = batch.slice(k, TEXTS)
                yield part, model.score(part["text"].to_pylist(), windows)

    return run


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) of every row."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _scored(model)(batches):
            yield pa.record_batch({"doc_id": part["doc_id"], "score": pa.array(found, pa.float64())})

    return docs.mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all columns, whose score is below the threshold."""
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _scored(model)(batches):
            yield part.filter(pa.array(found < threshold))

    return docs.mapInArrow(run, docs.schema)
