"""Source divergence audit: how the sources of each language differ in their words, by two-dimensional tiles of group blocks.

A group is a source within a language. Terms (runs of letters, A-Z lower-cased) that ``least`` documents of the language have
are kept; there are V of them. A group gives a term the probability p = 1 + floor(10**9 * (n + 5) / (N + 5 V)), where n is how
often it has the term and N the sum of n over all kept terms; the language's own p is made the same way. Two groups diverge by
the sum of abs(p - q) over all kept terms, those included that neither has.

Counting combines within a task before anything is shuffled, so a hot source is as many rows as a task has distinct terms. Kept
terms are dealt into chunks of about ``chunk``, numbered within; a group's counts in a chunk are one packed vector, with absent
terms left out. The groups of a language form blocks of ``block``. Every packed vector is replicated to the tasks of its block
with every block: a tile is one block by one block (a block with itself too) over a span of ``chunks`` chunks. Its task reads
chunk after chunk, makes the two blocks' dense matrices of p for that chunk alone, and adds to its submatrix of pairs. So a task
holds two blocks by one chunk, however large vocabulary and corpus are, and tiles, spans and languages are spread over the
cluster. A term that neither of two groups has adds the difference of their p of nothing: all V terms are counted that way
at first, and a chunk adds what its terms differ from that. All arithmetic is in whole numbers.

Edge cases: null text, lang and source are empty strings (and an empty source is a group); groups without terms, and languages
without kept terms, have their pairs; repeated rows are documents each; ties go by the item's UTF-8 bytes; an empty table has no
rows; extra columns are not read; N may be up to 9 * 10**15.
"""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import cut

LEAST = 30
SMOOTH, SCALE = 5, 1_000_000_000
TOP = 50
#: Groups in a block; terms in a chunk; chunks that one task of a tile reads.
BLOCK, CHUNK, CHUNKS = 64, 4096, 16
_TERM, _OTHER = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")
#: Bytes of text taken at a time, and terms held, before counts are passed on.
_PIECE, _HELD = 1 << 20, 300_000


def _pieces(data: bytes) -> Iterator[bytes]:
    """``data`` in parts that end where no term goes on."""
    at = 0
    while len(data) - at > _PIECE:
        end = _OTHER.search(data, at + _PIECE)
        if not end:
            break
        yield data[at : end.start()]
        at = end.start()
    yield data[at:]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's counts: occurrences, and documents, of each term of each group."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            keys = list(n)
            size = len(keys)
            yield pa.record_batch({"lang": pa.array([lang] * size, pa.string()), "source": pa.array([source] * size, pa.string()), "term": pa.array(keys, pa.binary()).cast(pa.string()), "n": pa.array(n.values(), pa.int64()), "docs": pa.array([docs[k] for k in keys], pa.int64())})
        held.clear()

    for batch in batches:
        size = 0
        for lang, source, text in zip(*(batch[c].to_pylist() for c in ("lang", "source", "text")), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(n)
            seen: set[bytes] = set()
            for piece in _pieces(text.encode().lower()):
                terms = _TERM.findall(piece)
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
            size += len(n)
        if sum(len(n) for n, _ in held.values()) > _HELD:
            yield from flush()
    yield from flush()


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term in every group."""
    read = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return read.mapInArrow(_counted, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (n + SMOOTH) / whole), in steps that stay within 64 bits."""
    quotient, rest = np.divmod(n + SMOOTH, whole)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, whole)
        quotient = quotient * 1000 + more
    return quotient + 1


def _probability(n: Column, whole: Column) -> Column:
    """The same as a column."""
    return F.call_function("div", (n.cast("decimal(20,0)") + SMOOTH) * F.lit(SCALE).cast("decimal(10,0)"), whole.cast("decimal(20,0)")) + 1


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells = [(np.array([c["at"] for c in x], np.uint32).tobytes(), np.array([c["n"] for c in x], np.int64).tobytes()) for x in batch["cells"].to_pylist()]
        rest = [c for c in batch.schema.names if c != "cells"]
        yield pa.record_batch([*(batch[c] for c in rest), pa.array([a for a, _ in cells], pa.binary()), pa.array([n for _, n in cells], pa.binary())], names=[*rest, "at", "n"])


class Tile:
    """A block of groups by a block of groups over a span of chunks."""

    def __init__(self, lang: str, i: int, j: int, span: int):
        self.lang, self.i, self.j, self.span = lang, i, j, span
        self.names: list[str] = []
        self.blocks: list[int] = []
        self.whole: list[int] = []
        self.v = 0
        self.place: dict[int, int] = {}
        self.sums: np.ndarray | None = None

    def group(self, no: int, block: int, source: str, n: int, v: int) -> None:
        self.place[no] = len(self.names)
        self.names.append(source)
        self.blocks.append(block)
        self.whole.append(n + SMOOTH * v)
        self.v = v

    def _ready(self) -> None:
        if self.sums is None:
            blocks = np.array(self.blocks)
            self.rows, self.cols = np.flatnonzero(blocks == self.i), np.flatnonzero(blocks == self.j)
            self.totals = np.maximum(np.array(self.whole, np.int64), 1)
            self.nothing = probability(np.zeros(len(blocks), np.int64), self.totals) if self.v else np.zeros(len(blocks), np.int64)
            self.apart = np.abs(self.nothing[self.rows][:, None] - self.nothing[self.cols])
            self.sums = self.apart * self.v if self.span == 0 else np.zeros_like(self.apart)

    def add(self, chunk: list[tuple[int, bytes, bytes]]) -> None:
        """One chunk's packed vectors."""
        self._ready()
        cells = [(self.place[no], np.frombuffer(at, np.uint32), np.frombuffer(n, np.int64)) for no, at, n in chunk]
        width = int(max(at.max() for _, at, _ in cells)) + 1
        p = np.repeat(self.nothing[:, None], width, axis=1)
        for k, at, n in cells:
            p[k, at] = probability(n, self.totals[k])
        right = p[self.cols]
        for r, k in enumerate(self.rows):
            self.sums[r] += np.abs(right - p[k]).sum(1)
        self.sums -= self.apart * width

    def rows_out(self) -> pa.RecordBatch:
        self._ready()
        r, c = np.nonzero(np.ones(self.sums.shape, bool) if self.i != self.j else np.triu(np.ones(self.sums.shape, bool), 1))
        names = np.array(self.names, object)
        return pa.record_batch({"lang": pa.array([self.lang] * len(r), pa.string()), "source": pa.array(names[self.rows[r]], pa.string()), "item": pa.array(names[self.cols[c]], pa.string()), "value": pa.array(self.sums[r, c], pa.int64())})


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles in order: within each the groups first (chunk -1), then chunk after chunk."""
    tile: Tile | None = None
    chunk, held = -1, []
    for batch in batches:
        for r in batch.to_pylist():
            key = (r["lang"], r["i"], r["j"], r["span"])
            if tile is None or key != (tile.lang, tile.i, tile.j, tile.span) or r["chunk"] != chunk:
                if held:
                    tile.add(held)
                held, chunk = [], r["chunk"]
            if tile is None or key != (tile.lang, tile.i, tile.j, tile.span):
                if tile is not None:
                    yield tile.rows_out()
                tile = Tile(*key)
            if r["chunk"] < 0:
                tile.group(r["no"], r["block"], r["source"], r["total"], r["v"])
            else:
                held.append((r["no"], r["at"], r["n"]))
    if held:
        tile.add(held)
    if tile is not None:
        yield tile.rows_out()


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, block: int = BLOCK, chunk: int = CHUNK, chunks: int = CHUNKS) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair``, the group's divergence from each other source of its language; part
    ``term``, the ``top`` kept terms that it has more of than its language, by how much more."""
    table = cut(counts(docs))
    by_term = table.groupBy("lang", "term").agg(F.sum("n").alias("of_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).select("lang", "term", "of_lang")
    spans = by_term.groupBy("lang").agg(F.count("*").alias("v"), F.sum("of_lang").alias("lang_total"))
    # chunks by hash, places within a chunk by term: a window holds about ``chunk`` terms (and a task chunks, not a language)
    placed = by_term.join(spans.select("lang", F.ceil(F.col("v") / chunk).cast("int").alias("n_chunks")), "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("n_chunks")).cast("int"))
    placed = placed.repartition("lang", "chunk").withColumn("at", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
    kept = cut(table.select("lang", "source", "term", "n").join(placed, ["lang", "term"]))
    # one row a group: all groups that occur, with or without kept terms
    groups = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(spans, "lang", "left")
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = cut(groups.select("lang", "source", number.alias("no"), *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("total", "v", "lang_total")]).withColumn("block", F.floor(F.col("no") / block).cast("int")))
    blocks = groups.groupBy("lang").agg((F.max("block") + 1).alias("n_blocks"), F.greatest(F.ceil(F.ceil(F.max("v") / chunk) / chunks), F.lit(1)).cast("int").alias("n_spans"))
    vectors = kept.join(groups.select("lang", "source", "no", "block"), ["lang", "source"]).groupBy("lang", "no", "block", "chunk").agg(F.collect_list(F.struct("at", "n")).alias("cells"))
    vectors = vectors.mapInArrow(_packed, "lang string, no int, block int, chunk int, at binary, n binary").withColumn("span", F.floor(F.col("chunk") / chunks).cast("int"))
    heads = groups.join(blocks.select("lang", "n_spans"), "lang").select("lang", "no", "block", "source", "total", "v", F.lit(-1).alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("n_spans") - 1)).alias("span"))
    every = vectors.unionByName(heads, allowMissingColumns=True).join(blocks.select("lang", "n_blocks"), "lang")
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    tiles = every.withColumn("other", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "n_blocks")
    keys = ["lang", "i", "j", "span"]
    sums = tiles.repartition(*keys).sortWithinPartitions(*keys, "chunk", "no").mapInArrow(_tiled, "lang string, source string, item string, value long")
    half = cut(sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    pairs = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    wholes = groups.select("lang", "source", (F.col("total") + SMOOTH * F.col("v")).alias("whole"), (F.col("lang_total") + SMOOTH * F.col("v")).alias("lang_whole"))
    more = kept.join(wholes, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (_probability(F.col("n"), F.col("whole")) - _probability(F.col("of_lang"), F.col("lang_whole"))).alias("value"))
    terms = more.where("value > 0").withColumn("rank", rank).where(F.col("rank") <= top)
    shown = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int"))
    return shown(pairs.withColumn("rank", rank), "pair").unionByName(shown(terms, "term"))
