"""Substring dedup: seed and extend on winnowed anchors.

A window is ``length`` consecutive words. Its seed is the least hash of the ``seed_words``-word runs inside
it, so that two equal windows always have the same seed (winnowing's guarantee). Consecutive windows with one seed
are a stretch: the seed extended to both sides as far as it stays the least.

1. Seeds of each document. A task sees which seeds several of its documents share, and passes only one row a seed
   on to the shuffle, where seeds of several tasks meet. Seeds that lie in one document only can't begin a repeat
   and go.
2. Each document is extended around its shared seeds. A stretch whose words are also those of a smaller document's
   stretch is matched whole, so copies cost a row a stretch. Only where a seed has different stretches the
   extension goes on word by word, over the windows of each different stretch (read from its first document once more).
3. Overlapping matched windows join to maximal repeats, which are taken out.

No step pairs documents: a stretch or window meets only the smallest doc_id that has it, so a passage in a third
of all rows costs a row each. Equality of windows and stretches is that of 64-bit hashes of their words together
with the 64-bit hash of their seed.

Edge cases: null or empty text has no words and stays empty; texts shorter than a window lose nothing; rows
with a null doc_id are returned whole and are no source of repeats; rows that share a doc_id are one document
as to repeats (not smaller than each other), each loses its own words, and they are returned one by one; extra columns
are not read.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import cut, uncut
from .tokens import NON_SPACE, Words, chunks, mixed, sequence_hashes, sliding_min, span_hashes, utf8

LENGTH = 13
SEED_WORDS = 6
#: Seeds that a task compares among themselves before it passes them on.
CHUNK_SEEDS = 2_000_000
LONE, SHARED, MORE = 0, 1, 2


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Words]]:
    texts = utf8(batch["text"])
    for first, last in chunks([len(t) for t in texts]):
        yield first, last, Words(texts[first:last], NON_SPACE)


def _windows(words: Words, length: int, seed_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows that lie in one text, their seeds, and the words' hashes."""
    hashes = words.hashes()
    seeds = sliding_min(sequence_hashes(hashes, seed_words), length - seed_words + 1)
    at = np.flatnonzero(words.text_of[: len(seeds)] == words.text_of[length - 1 :]) if len(seeds) else np.zeros(0, int)
    return at, seeds[at], hashes


def _seeds(length: int, seed_words: int):
    """(seed, doc_id, kind): one row for each seed and chunk of documents, LONE or SHARED if several of them have it; MORE for the others."""

    def reduced(seeds: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((docs, seeds))
        seeds, docs = seeds[order], docs[order]
        fresh = np.ones(len(seeds), bool)
        fresh[1:] = (seeds[1:] != seeds[:-1]) | (docs[1:] != docs[:-1])
        seeds, docs = seeds[fresh], docs[fresh]
        first = np.ones(len(seeds), bool)
        first[1:] = seeds[1:] != seeds[:-1]
        alone = first & np.append(first[1:], True)
        kind = np.where(alone, LONE, np.where(first, SHARED, MORE)).astype(np.int8)
        back = np.argsort(docs, kind="stable")
        return pa.record_batch({"seed": seeds[back].view(np.int64), "doc_id": docs[back], "kind": kind[back]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            ids = batch["doc_id"].to_numpy(zero_copy_only=False)
            for first, _, words in _batches(batch):
                at, seeds, _ = _windows(words, length, seed_words)
                docs = ids[first + words.text_of[at]].astype(np.int64)
                new = np.ones(len(at), bool)
                new[1:] = (seeds[1:] != seeds[:-1]) | (docs[1:] != docs[:-1])
                held.append((seeds[new], docs[new]))
            if sum(len(s) for s, _ in held) > CHUNK_SEEDS:
                yield reduced(*map(np.concatenate, zip(*held, strict=True)))
                held = []
        if held:
            yield reduced(*map(np.concatenate, zip(*held, strict=True)))

    return run


def _stretches(length: int, seed_words: int):
    """(seed, words, doc_id, text, place, n): the stretches of shared seeds; words is a hash, place the first word, n the number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"].to_numpy(zero_copy_only=False)
            keys = batch["key"].to_numpy()
            shared, bounds = batch["seeds"].flatten().to_numpy().view(np.uint64), batch["seeds"].offsets.to_numpy()
            bounds = bounds - bounds[0]
            for first, last, words in _batches(batch):
                at, seeds, hashes = _windows(words, length, seed_words)
                if not len(at):
                    continue
                row = first + words.text_of[at]
                new = np.ones(len(at), bool)
                new[1:] = (seeds[1:] != seeds[:-1]) | (row[1:] != row[:-1])
                begin = np.flatnonzero(new)
                size = np.diff(np.append(begin, len(at)))
                # a seed is looked up among those of its own document
                mine = np.repeat(np.arange(first, last), np.diff(bounds[first : last + 1]))
                keep = np.isin(seeds[begin] ^ mixed(row[begin].astype(np.uint64)), shared[bounds[first] : bounds[last]] ^ mixed(mine.astype(np.uint64)))
                begin, size = begin[keep], size[keep]
                whole = span_hashes(hashes, at[begin], at[begin] + size + length - 1).view(np.int64)
                yield pa.record_batch({"seed": seeds[begin].view(np.int64), "words": whole, "doc_id": ids[row[begin]].astype(np.int64), "key": keys[row[begin]], "place": (at[begin] - words.offsets[row[begin] - first]).astype(np.int32), "n": size.astype(np.int32)})

    return run


def _opened(length: int):
    """(seed, window, doc_id, key, place): each window, as a hash, of the stretches given for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"].to_numpy(zero_copy_only=False)
            keys = batch["key"].to_numpy()
            given, bounds = batch["stretches"].flatten(), batch["stretches"].offsets.to_numpy()
            seed, place, size = (given.field(k).to_numpy() for k in range(3))
            bounds = bounds - bounds[0]
            for first, last, words in _batches(batch):
                mine = slice(bounds[first], bounds[last])
                row = np.repeat(np.arange(last - first), np.diff(bounds[first : last + 1]))
                n = size[mine].astype(np.int64)
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(words.offsets[row] + place[mine], n) + inner
                windows = sequence_hashes(words.hashes(), length).view(np.int64)
                out = pa.record_batch({"seed": np.repeat(seed[mine], n), "window": windows[at], "doc_id": np.repeat(ids[first + row], n).astype(np.int64), "key": np.repeat(keys[first + row], n), "place": (np.repeat(place[mine], n) + inner).astype(np.int32)})
                for k in range(0, len(out), 100_000):
                    yield out.slice(k, 100_000)

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, seed_words: int = SEED_WORDS) -> DataFrame:
    """(doc_id, key, place, n): runs of n windows, by the first one's first word, whose words all start in smaller documents too.

    Places are those of one text: rows that share a doc_id are told apart by ``key``, the hash of the text.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")
    keyed = docs.withColumn("key", text_key())
    seeds = cut(docs.mapInArrow(_seeds(length, seed_words), "seed long, doc_id long, kind byte"))
    # at most a row for each seed and chunk, however many documents share it
    met = seeds.where(F.col("kind") != MORE).withColumn("n", F.count("*").over(Window.partitionBy("seed"))).where((F.col("n") > 1) | (F.col("kind") == SHARED))
    hits = cut(met.select("doc_id", "seed").unionByName(seeds.where(F.col("kind") == MORE).select("doc_id", "seed")))
    uncut(seeds)
    by_doc = hits.groupBy("doc_id").agg(F.collect_set("seed").alias("seeds"))
    found = cut(keyed.join(by_doc, "doc_id").mapInArrow(_stretches(length, seed_words), "seed long, words long, doc_id long, key long, place int, n int"))
    uncut(hits)
    key = ["seed", "words"]
    # the aggregates are written, so that adaptive execution can split the joins' hot keys: both sides are plain exchanges
    first = found.groupBy(*key).agg(F.min("doc_id").alias("low"), F.count("*").alias("times"))
    # stretches of a seed that has several different ones
    several = cut(found.groupBy("seed").agg(F.min("words").alias("a"), F.max("words").alias("b")).where("a < b").select("seed", F.lit(True).alias("mixed")))
    first = cut(first.join(several, "seed", "left").withColumn("mixed", F.coalesce("mixed", F.lit(False))).where("mixed or times > 1"))
    uncut(several)
    open_ = F.col("mixed") & (F.col("doc_id") == F.col("low"))
    settled = cut(found.join(first, key).where(open_ | (F.col("doc_id") > F.col("low"))).select(F.when(open_, F.col("seed")).alias("open"), "doc_id", "key", "place", "n"))
    uncut(found)
    uncut(first)
    stretches = settled.where("open is not null").groupBy("doc_id", "key").agg(F.collect_list(F.struct("open", "place", "n")).alias("stretches"))
    single = cut(keyed.join(stretches, ["doc_id", "key"]).mapInArrow(_opened(length), "seed long, window long, doc_id long, key long, place int"))
    least = cut(single.groupBy("seed", "window").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high"))
    single = single.join(least, ["seed", "window"]).where("doc_id > low").select("doc_id", "key", "place", F.lit(1).alias("n"))
    return settled.where("open is null").select("doc_id", "key", "place", "n").unionByName(single)


def text_key() -> Column:
    return F.xxhash64(F.col("text"), F.lit(1))


def _kept(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_text": [], "spans": []}
            for text, spans in zip(utf8(batch["text"]), batch["repeats"].to_pylist(), strict=True):
                words = text.split()
                gone = np.zeros(len(words) + 1, np.int32)
                if spans:
                    at = np.array([(s["place"], s["n"]) for s in spans])
                    np.add.at(gone, at[:, 0], 1)
                    np.add.at(gone, np.minimum(at.sum(1) + length - 1, len(words)), -1)
                gone = np.cumsum(gone)[:-1] > 0
                edges = np.flatnonzero(np.diff(gone, prepend=False, append=False)).reshape(-1, 2)
                out["n_words"].append(len(words))
                out["n_removed"].append(int(gone.sum()))
                out["kept_text"].append(b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode())
                out["spans"].append([{"first": int(a), "last": int(b) - 1} for a, b in edges])
            spans = pa.array(out["spans"], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))
            yield pa.record_batch({"doc_id": batch["doc_id"], "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "kept_text": pa.array(out["kept_text"], pa.string()), "spans": spans})

    return run


def substring_dedup(docs: DataFrame, length: int = LENGTH, seed_words: int = SEED_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text and the maximal repeats removed, as word spans."""
    repeats = repeated_spans(docs, length, seed_words).groupBy("doc_id", "key").agg(F.collect_list(F.struct("place", "n")).alias("repeats"))
    whole = docs.select(F.col("doc_id").cast("long"), "text").withColumn("key", text_key()).join(repeats, ["doc_id", "key"], "left")
    return whole.mapInArrow(_kept(length), "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<first:long,last:long>>")

