"""Benchmark decontamination: suffix arrays of the training words, searched for every benchmark suffix.

Each batch of documents is a shard. Its words, numbered in the order of their hashes, are one sequence in which
a document's end sorts below every word; prefix doubling sorts the shard's suffixes to the depth of a window.
Every suffix of every benchmark item is then found by binary search: the range of the array's suffixes that begin with
a whole window gives every place of it. Places that go on word by word in both, document and item, are one match; so
each document gets its longest verbatim matches whole, and where they stand. A shard's results concern its own
documents alone, so nothing is shuffled.

The benchmark goes to the tasks in blocks of at most ``block_words`` words, a pass over the documents for each
(one, unless the benchmark is larger); what the passes find is merged by row.

Edge cases: a null or empty text has no words, no hits and is never contaminated; a null or empty item matches
nothing; an item shorter than a window is one window; items with null item_id count for hits, not for ids;
repeated rows are judged one by one; extra columns are not read.
"""

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import append, cut, shared_folder
from .tokens import ALNUM, Words, chunks, utf8

WINDOW = 13
BLOCK_WORDS = 2_000_000
#: Bytes of text in a shard's suffix array.
SHARD_BYTES = 6 << 20


class Items:
    """A block of benchmark items: the words' hashes, each suffix's item and window length (0: no window starts there)."""

    def __init__(self, rows: list, window: int):
        words = Words([(r["text"] or "").encode().lower() for r in rows], ALNUM)
        self.ids = [r["item_id"] for r in rows]
        self.hashes, self.item = words.hashes(), words.text_of
        left = words.offsets[1:][words.text_of] - np.arange(len(words))
        size = np.diff(words.offsets)[words.text_of]
        self.begin = words.offsets  # each item's first word
        self.length = np.where(left >= window, window, np.where((size < window) & (left == size), size, 0))


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of ``codes`` (0 ends a document), sorted by their first ``depth`` entries at least."""
    order = np.argsort(codes, kind="stable")
    first = np.concatenate(([True], codes[order][1:] != codes[order][:-1]))
    ranks = np.empty(len(codes), np.int64)  # the place of the first suffix that is equal so far
    ranks[order] = np.maximum.accumulate(np.where(first, np.arange(len(codes)), 0))
    have = 1
    while have < depth:
        # only runs of suffixes that are still equal are sorted anew
        sorted_ranks = ranks[order]
        tied = np.zeros(len(order), bool)
        same = (sorted_ranks[1:] == sorted_ranks[:-1]) & (codes[order[1:]] != 0)
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            break
        part = order[at]
        after = part + have
        second = np.where(after < len(codes), ranks[np.minimum(after, len(codes) - 1)], 0)
        key = ranks[part] * (len(codes) + 1) + second
        by = np.argsort(key, kind="stable")
        order[at] = part[by]
        key = key[by]
        first = np.concatenate(([True], key[1:] != key[:-1]))
        group = ranks[order[at]]
        begins = np.concatenate(([True], group[1:] != group[:-1]))
        base = np.repeat(np.flatnonzero(begins), np.diff(np.append(np.flatnonzero(begins), len(at))))
        lead = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        fresh = group + (lead - base)
        ranks[order[at]] = fresh
        have *= 2
    return order


def _search(codes: np.ndarray, order: np.ndarray, pattern: np.ndarray, length: np.ndarray, right: bool) -> np.ndarray:
    """Places in ``order`` before (or past) the suffixes that begin with the first ``length`` entries of each pattern row."""
    low, high = np.zeros(len(pattern), np.int64), np.full(len(pattern), len(order), np.int64)
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        at = order[np.minimum(mid, len(order) - 1)]
        less, equal = np.zeros(len(pattern), bool), np.ones(len(pattern), bool)
        for k in range(pattern.shape[1]):
            here = codes[np.minimum(at + k, len(codes) - 1)]
            use = equal & (k < length)
            less |= use & (here < pattern[:, k])
            equal &= ~use | (here == pattern[:, k])
        up = less | (equal if right else False)
        low, high = np.where(open_ & up, mid + 1, low), np.where(open_ & ~up, mid, high)
    return low


def _match(words: Words, items: Items, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """For a shard: covered words, (text, item) pairs of windows found, and the matches from their first to their last word."""
    hashes = words.hashes()
    known, codes = np.unique(hashes, return_inverse=True)
    ends = words.offsets[1:]
    n_texts = len(ends)
    # one closing 0 after each text
    seq = np.zeros(len(codes) + n_texts + 1, np.int64)
    where = np.arange(len(codes)) + words.text_of
    seq[where] = codes + 1
    order = suffix_array(seq, window)
    text_of = np.repeat(np.arange(n_texts + 1), np.append(np.diff(words.offsets) + 1, 1))
    found = np.searchsorted(known, items.hashes)
    found = np.where((found < len(known)) & (known[np.minimum(found, max(len(known) - 1, 0))] == items.hashes), found + 1, -1) if len(known) else np.full(len(items.hashes), -1)
    # suffixes that begin a window, and the window's words
    live = np.flatnonzero((items.length > 0) & (found > 0))
    pattern = found[np.minimum(live[:, None] + np.arange(window), max(len(found) - 1, 0))]
    whole = ((pattern > 0) | (np.arange(window) >= items.length[live, None])).all(1)
    live, pattern = live[whole], pattern[whole]
    low = _search(seq, order, pattern, items.length[live], right=False)
    high = _search(seq, order, pattern, items.length[live], right=True)
    count = high - low
    at = order[np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())]
    suffix = np.repeat(live, count)
    size, item = items.length[suffix], items.item[suffix]
    covered = np.zeros(len(seq) + window + 1, np.int32)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + size, -1)
    hit = np.cumsum(covered)[where] > 0
    pairs = np.unique(text_of[at] * (len(items.ids) + 1) + item) if len(at) else np.zeros(0, np.int64)
    # windows that follow each other in both are one match
    by = np.lexsort((at, at - suffix))
    at, suffix, size, item = at[by], suffix[by], size[by], item[by]
    first = np.ones(len(at), bool)
    first[1:] = (at[1:] != at[:-1] + 1) | (suffix[1:] != suffix[:-1] + 1) | (item[1:] != item[:-1])
    begin = np.flatnonzero(first)
    matches = {"text": text_of[at[begin]], "item": item[begin], "first": at[begin] - text_of[at[begin]], "item_first": suffix[begin] - items.begin[item[begin]], "n": np.diff(np.append(begin, len(at))) + size[begin] - 1}
    return hit, pairs // (len(items.ids) + 1), pairs % (len(items.ids) + 1), matches


_SPAN = pa.struct([("first", pa.int64()), ("last", pa.int64())])
_MATCH = pa.struct([("item_id", pa.int64()), ("first", pa.int64()), ("item_first", pa.int64()), ("n", pa.int64())])


def _judged(items: Items, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_pylist()
            for first, last in chunks(sizes, SHARD_BYTES):
                words = Words([t.lower() for t in utf8(batch["text"][first:last])], ALNUM)
                hit, text, item, matches = _match(words, items, window)
                spans, ids, found = ([[] for _ in range(last - first)] for _ in range(3))
                turn = words.text_of[1:] != words.text_of[:-1]
                begin, end = hit.copy(), hit.copy()
                begin[1:] &= turn | ~hit[:-1]
                end[:-1] &= turn | ~hit[1:]
                for a, b in zip(np.flatnonzero(begin), np.flatnonzero(end), strict=True):
                    k = words.text_of[a]
                    spans[k].append({"first": int(a - words.offsets[k]), "last": int(b - words.offsets[k])})
                for t, i in zip(text, item, strict=True):
                    if items.ids[i] is not None:
                        ids[t].append(items.ids[i])
                for t, i, at, item_at, n in zip(*(matches[c].tolist() for c in ("text", "item", "first", "item_first", "n")), strict=True):
                    found[t].append({"item_id": items.ids[i], "first": at - int(words.offsets[t]), "item_first": item_at, "n": n})
                yield pa.record_batch({
                    "doc_id": batch["doc_id"][first:last],
                    "n_words": np.diff(words.offsets).astype(np.int64),
                    "items": pa.array(ids, pa.list_(pa.int64())),
                    "spans": pa.array(spans, pa.list_(_SPAN)),
                    "matches": pa.array(found, pa.list_(_MATCH)),
                    **{c: batch[c][first:last] for c in batch.schema.names if c.startswith("_row")},
                })

    return run


def _blocks(benchmark: DataFrame, block_words: int) -> list[DataFrame]:
    """The items in parts of about ``block_words`` words; one part unless the benchmark is larger."""
    benchmark = benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null")
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // (4 * block_words)) or 1
    return [benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, items found, hit spans of words, n_hit, matches, longest_match, contaminated.

    ``matches``: the verbatim matches of a window's length or more (or of a whole shorter item), each with its item, its
    first word in the document and in the item, and its words; ``longest_match``: the words of the longest, 0 without one.
    A document is contaminated if a twentieth of its words or more are hit.
    """
    schema = "doc_id long, n_words long, items array<long>, spans array<struct<first:long,last:long>>, matches array<struct<item_id:long,first:long,item_first:long,n:long>>"
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    blocks = _blocks(benchmark, block_words)
    if len(blocks) > 1:
        docs = cut(docs.withColumn("_row", F.monotonically_increasing_id()))
        schema += ", _row long"
    if len(blocks) == 1:
        out = docs.mapInArrow(_judged(Items(blocks[0].collect(), window), window), schema)
    else:
        # a block's pass is written before the next block is collected
        path = f"{shared_folder(docs.sparkSession)}/passes-{uuid.uuid4().hex}"
        for block in blocks:
            out = docs.mapInArrow(_judged(Items(block.collect(), window), window), schema)
            append(out, path)
        out = docs.sparkSession.read.schema(out.schema).parquet(path)
        out = out.groupBy("_row", "doc_id", "n_words").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("matches")).alias("matches")).drop("_row")
    # spans of one pass don't overlap; those of several are joined word by word
    words = "size(array_distinct(flatten(transform(spans, s -> sequence(s.first, s.last)))))" if len(blocks) > 1 else "aggregate(spans, 0L, (a, s) -> a + s.last - s.first + 1)"
    longest = F.coalesce(F.array_max(F.transform("matches", lambda m: m["n"])), F.lit(0).cast("long"))
    return out.withColumns({"longest_match": longest, "n_hit": F.expr(f"cast({words} as long)")}).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns."""
    blocks = _blocks(benchmark, block_words)
    if len(blocks) == 1:
        return docs.mapInArrow(_clean(Items(blocks[0].collect(), window), window), docs.schema)
    # columns go by number within, so that no name can clash
    names = docs.columns
    keyed = cut(docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], F.monotonically_increasing_id().alias("row")))
    ids = contamination(keyed.select(F.col("row").alias("doc_id"), F.col(f"c{names.index('text')}").alias("text")), benchmark, window, block_words)
    bad = ids.where("contaminated").select(F.col("doc_id").alias("row"))
    return keyed.join(bad, "row", "left_anti").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def _clean(items: Items, window: int):
    judged = _judged(items, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.record_batch({"doc_id": pa.array(range(len(batch)), pa.int64()), "text": batch["text"]})
            keep = []
            for found in judged(iter([rows])):
                for n, spans in zip(found["n_words"].to_pylist(), found["spans"].to_pylist(), strict=True):
                    n_hit = sum(s["last"] - s["first"] + 1 for s in spans)
                    keep.append(not (n_hit and 20 * n_hit >= n))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run
