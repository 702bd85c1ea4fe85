"""Line dedup: line hashes in ranges, sorted by document and place within, read as a stream; bitmaps come back, not text.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of ``least`` code points or more that
``documents`` documents hold lose their lines everywhere but in the greatest doc_id that holds them. Two 64-bit hashes stand
for a key, so texts stay where they are: lines are dealt by ranges of (key, doc_id, place), sorted within, greatest doc_id
first, and each range is read once, front to back. A key's first document keeps its lines; those of the second wait until a
third document appears; later ones go at once. So a task holds one document's lines of one key, however many lines the key
has, and a key that fills many ranges is no heavier than many keys. Only what the next range decides is left open: the first
two documents of a range's first key and the second of its last. These rows, and each range's number of documents and
greatest doc_id for the two keys, are joined by key afterwards: a few rows a range.

Each document's dropped places become a bitmap (a bit a line, 1: kept, first line in the highest bit), compressed by zlib.

Edge cases: a null or empty text is one empty line; null doc_ids hold nothing: their lines aren't counted and all stay;
rows with the same doc_id are one document to the count, and each text of them has its own bitmap (repeated rows share
one); lines of one document that repeat stay or go together; extra columns are not read by :func:`keep_bitmaps`, and come
along in :func:`dedup`, where columns that clash with the added ones are replaced.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import cut

#: Code points that a key needs, and documents that must hold it.
LEAST, DOCUMENTS = 20, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = " \t\n\x0b\x0c\r"
#: Kinds of rows that a range returns.
_GONE, _OPEN, _COUNT = 0, 1, 2
_FOUND = "kind byte, k1 long, k2 long, doc_id long, text_key long, place int, documents long"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashed(docs: DataFrame, least: int) -> DataFrame:
    """(k1, k2, doc_id, text_key, place): every line whose key is long enough."""
    lines = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.posexplode(lines_of(F.col("text"))).alias("place", "line"))
    key = F.translate(F.btrim("line", F.lit(_SPACE)), _UPPER, _LOWER)
    keyed = lines.where(F.length("line") >= least).select("doc_id", "text_key", "place", key.alias("key")).where(F.length("key") >= least)
    return keyed.select(F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2"), "doc_id", "text_key", "place")


class _Range:
    """One range's rows, in order, batch by batch."""

    def __init__(self, need: int):
        self.need = need
        self.key: tuple[int, int] | None = None
        self.doc: int | None = None
        self.top = self.seen = 0  # the key's first document here, and how many so far
        self.first = True  # the key is the range's first: rows before this range may hold it
        self.wait: list[pa.RecordBatch] = []  # rows of documents that more documents would condemn

    def _rows(self, kind: int, rows: pa.RecordBatch) -> pa.RecordBatch:
        n = len(rows)
        return pa.record_batch([pa.array(np.full(n, kind, np.int8)), *(rows[c] for c in ("k1", "k2", "doc_id", "text_key", "place")), pa.nulls(n, pa.int64())], names=_NAMES)

    def _count(self) -> pa.RecordBatch:
        one = lambda v: pa.array([v], pa.int64())
        return pa.record_batch([pa.array([_COUNT], pa.int8()), one(self.key[0]), one(self.key[1]), one(self.top), one(None), pa.nulls(1, pa.int32()), one(self.seen)], names=_NAMES)

    def leave(self, last: bool) -> Iterator[pa.RecordBatch]:
        """What is to say when a key's rows end here."""
        if self.key is None:
            return
        if self.first or last:
            yield self._count()
            for rows in self.wait:
                yield self._rows(_OPEN, rows)
        self.wait.clear()

    def read(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        k1, k2, doc = (batch[c].to_numpy() for c in ("k1", "k2", "doc_id"))
        new_key = np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))
        starts = np.flatnonzero(new_key | np.concatenate(([True], doc[1:] != doc[:-1])))
        ends = np.append(starts[1:], len(doc))
        gone: list[tuple[int, int]] = []
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):  # a run: one document's lines of one key
            key, d = (int(k1[s]), int(k2[s])), int(doc[s])
            if key != self.key:
                yield from self.leave(last=False)
                self.first = self.key is None
                self.key, self.doc, self.top, self.seen = key, d, d, 1
            elif d != self.doc:
                self.doc = d
                self.seen += 1
                if self.seen == self.need and not self.first:  # what waited goes, now that there are enough
                    for rows in self.wait:
                        yield self._rows(_GONE, rows)
                    self.wait.clear()
            if self.seen >= self.need:
                gone.append((s, e))
            elif self.first or self.seen > 1:
                self.wait.append(batch.slice(s, e - s))
        if gone:
            place = np.zeros(len(doc) + 1, np.int64)
            np.add.at(place, [s for s, _ in gone], 1)
            np.add.at(place, [e for _, e in gone], -1)
            yield self._rows(_GONE, batch.filter(pa.array(np.cumsum(place[:-1]) > 0)))


_NAMES = ["kind", "k1", "k2", "doc_id", "text_key", "place", "documents"]


def _streamed(need: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = _Range(need)
        for batch in batches:
            if len(batch):
                yield from at.read(batch)
        yield from at.leave(last=True)

    return run


def dropped_lines(docs: DataFrame, least: int = LEAST, documents: int = DOCUMENTS) -> DataFrame:
    """(doc_id, text_key, place) of every line that goes; text_key is ``xxhash64(text)``, place counts from 0."""
    if documents < 2:
        raise ValueError("a key must be held by two documents at least")
    lines = cut(_hashed(docs, least))  # ranges are found from this table, so texts are split once
    order = ["k1", "k2", F.desc("doc_id"), "text_key", "place"]
    found = cut(lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_streamed(documents), _FOUND))
    gone = found.where(F.col("kind") == _GONE)
    # a few rows a range: keys that ranges share
    shared = found.where(F.col("kind") == _COUNT).groupBy("k1", "k2").agg(F.sum("documents").alias("n"), F.max("doc_id").alias("top")).where(F.col("n") >= documents)
    late = found.where(F.col("kind") == _OPEN).drop("documents").join(shared, ["k1", "k2"]).where("doc_id <> top")
    return gone.select("doc_id", "text_key", "place").unionByName(late.select("doc_id", "text_key", "place"))


def _packed(n: int, places: list[int] | None) -> bytes:
    keep = np.ones(n, np.uint8)
    if places is not None:
        keep[places] = 0
    return zlib.compress(np.packbits(keep).tobytes())


def unpacked(bitmap: bytes, n: int) -> np.ndarray:
    """Which of ``n`` lines a bitmap keeps."""
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n).astype(bool)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = [_packed(n, p) for n, p in zip(batch["n_lines"].to_pylist(), batch["places"].to_pylist(), strict=True)]
        yield pa.record_batch([batch["doc_id"], batch["text_key"], batch["n_lines"], pa.array([len(p or ()) for p in batch["places"].to_pylist()], pa.int64()), pa.array(maps, pa.binary())], names=["doc_id", "text_key", "n_lines", "n_dropped", "keep"])


def keep_bitmaps(docs: DataFrame, least: int = LEAST, documents: int = DOCUMENTS) -> DataFrame:
    """(doc_id, text_key, n_lines, n_dropped, keep): a bitmap for each document that loses lines; all lines of the others stay."""
    # a document's places are as many as its lines, which its text holds in one row too
    places = dropped_lines(docs, least, documents).groupBy("doc_id", "text_key").agg(F.collect_set("place").alias("places"))
    sizes = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.size(lines_of(F.col("text"))).cast("long").alias("n_lines")).distinct()
    return sizes.join(places, ["doc_id", "text_key"]).mapInArrow(_bitmaps, "doc_id long, text_key long, n_lines long, n_dropped long, keep binary")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, kept, sizes = batch["_text"].to_pylist(), [], []
        for text, bitmap in zip(texts, batch["keep"].to_pylist(), strict=True):
            lines = (text or "").split("\n")
            sizes.append(len(lines))
            kept.append(text or "" if bitmap is None else "\n".join(x for x, k in zip(lines, unpacked(bitmap, len(lines)), strict=True) if k))
        rest = [c for c in batch.schema.names if c not in ("_text", "keep", "n_dropped")]
        yield pa.record_batch([*(batch[c] for c in rest), pa.array(sizes, pa.int64()), batch["n_dropped"].fill_null(0), pa.array(kept, pa.string())], names=[*rest, "n_lines", "n_dropped", "kept_text"])


def dedup(docs: DataFrame, least: int = LEAST, documents: int = DOCUMENTS) -> DataFrame:
    """Every row of ``docs`` with n_lines, n_dropped and kept_text; the text goes into it and leaves the row."""
    added = ("text", "n_lines", "n_dropped", "kept_text")
    rest = [c for c in docs.columns if c not in added]
    # the input's columns go by number within, so that no name of theirs can clash
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)], F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_key"), F.col("text").alias("_text"))
    maps = keep_bitmaps(docs, least, documents).select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), "n_dropped", "keep")
    joined = rows.join(maps, ["_doc", "_key"], "left").drop("_doc", "_key")
    kinds = ", ".join([*(f"c{i} {joined.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(rest))), "n_lines long, n_dropped long, kept_text string"])
    found = joined.mapInArrow(_kept, kinds)
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], "n_lines", "n_dropped", "kept_text")
