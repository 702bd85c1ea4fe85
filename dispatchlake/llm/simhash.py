"""SimHash near-dedup by covering locality-sensitive hashing.

A fingerprint bit is 1 if it is set in over half the XXH64 hashes of the text's word shingles. Fingerprints link
when at most ``radius`` bits differ. To find all links without comparing all pairs, every bit position gets a
random vector of radius+1 bits, and each non-zero vector v gives a mask of the positions whose vector has an odd
product with v. At most ``radius`` differing positions can't span the whole space, so for some v all of them are
masked out: every linking pair is equal under at least one of the 2**(radius+1) - 1 masks, and meets in that
table.

Work is on distinct fingerprints, so exact copies cost nothing. A bucket of more than ``bucket`` fingerprints is
dealt anew under a second, independent family of masks on top of the first, and so on: each level fixes about
half of the bits that were still free, and b fixed bits leave at most 2**(64-b) distinct fingerprints, so buckets
shrink to the bound whatever the data; nothing is dropped. In a bucket, fingerprints are gathered around hubs, and
only groups whose hubs are near enough are compared; just a spanning forest of the links is emitted.

Edge cases: null or empty texts have no shingles and the fingerprint zero, linked like any other; fewer words
than a shingle: the whole sequence is the one shingle; rows with a null doc_id get their fingerprint and the
component of the others with it, else null; repeated rows are returned one by one; extra columns are not read.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graphs import components
from .storage import cut
from .tokens import utf8

SHINGLE = 4
RADIUS = 4
BUCKET = 8192
LEVELS = 4


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[k : k + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = np.array([fingerprint(t) for t in utf8(batch["text"])], np.uint64)
        yield pa.record_batch({"doc_id": batch["doc_id"], "mark": marks.view(np.int64)})


def masks(radius: int, level: int) -> list[int]:
    """The covering family of a level, as signed 64-bit masks. Positions' vectors are balanced over all values."""
    n = 1 << (radius + 1)
    vectors = np.random.default_rng(1000 + level).permutation(np.arange(64) % n)
    out = []
    for v in range(1, n):
        bits = sum(1 << i for i in range(64) if bin(int(vectors[i]) & v).count("1") % 2)
        out.append(bits - (1 << 64) if bits >> 63 else bits)
    return out


def _tables(marks: DataFrame, radius: int, level: int) -> DataFrame:
    """``marks`` once for each mask of the level; the bucket's name grows by the mask's number and the masked bits."""
    dealt = [F.struct(F.lit(i).cast("long").alias("t"), F.col("mark").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks(radius, level))]
    exploded = marks.withColumn("x", F.explode(F.array(*dealt)))
    return exploded.select("mark", F.xxhash64(F.lit(level), *(["bucket"] if level else []), "x.t", "x.bits").alias("bucket"))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def links(marks: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of distinct ``marks`` at distance ``radius`` or less, as pairs of indices."""
    n = len(marks)
    group = np.full(n, -1)
    hubs: list[int] = []
    members: list[np.ndarray] = []
    out = []
    while len(free := np.flatnonzero(group < 0)):
        hub = free[0]
        ball = free[_popcount(marks[free] ^ marks[hub]) <= radius]
        group[ball] = len(hubs)
        hubs.append(hub)
        members.append(ball)
        out += [(int(hub), int(x)) for x in ball if x != hub]
    parent = np.arange(len(hubs))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    # members of two balls can be near only if their hubs are within 3 radii
    centres = marks[hubs]
    for i in range(len(hubs) - 1):
        for j in i + 1 + np.flatnonzero(_popcount(centres[i + 1 :] ^ centres[i]) <= 3 * radius):
            a, b = root(i), root(j)
            if a == b:
                continue
            mine, theirs = members[i], members[j]
            # only those on the side of the other hub can reach over
            mine = mine[_popcount(marks[mine] ^ centres[j]) <= 2 * radius]
            theirs = theirs[_popcount(marks[theirs] ^ centres[i]) <= 2 * radius]
            for k in range(0, len(mine), 256):
                near = _popcount(marks[mine[k : k + 256], None] ^ marks[theirs][None, :]) <= radius
                if near.any():
                    x, y = np.argwhere(near)[0]
                    out.append((int(mine[k + x]), int(theirs[y])))
                    parent[max(a, b)] = min(a, b)
                    break
    return out


def _bucket_links(radius: int):
    def run(bucket: pd.DataFrame) -> pd.DataFrame:
        marks = np.unique(bucket["mark"].to_numpy())
        found = links(marks.view(np.uint64), radius)
        at = np.array(found, np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": marks[at[:, 0]], "v": marks[at[:, 1]]})

    return run


def near_edges(marks: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column mark) whose components are those of all links."""
    out = None
    for level in range(LEVELS):
        dealt = cut(_tables(marks, radius, level))
        sizes = cut(dealt.groupBy("bucket").count().where("count > 1"))
        pairs = dealt.join(sizes.where("count = 2").select("bucket"), "bucket").groupBy("bucket").agg(F.min("mark").alias("u"), F.max("mark").alias("v"))
        pairs = pairs.where((F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius) & (F.col("u") < F.col("v"))).select("u", "v")
        small = dealt.join(sizes.where((F.col("count") > 2) & (F.col("count") <= bucket)).select("bucket"), "bucket")
        found = pairs.unionByName(small.groupBy("bucket").applyInPandas(_bucket_links(radius), "u long, v long"))
        out = found if out is None else out.unionByName(found)
        large = sizes.where(F.col("count") > bucket).select("bucket")
        if level == LEVELS - 1 or large.isEmpty():
            # the last level fixes about 60 of 64 bits; should a bucket still be large, it is compared whole
            if level == LEVELS - 1:
                rest = dealt.join(large, "bucket")
                out = out.unionByName(rest.groupBy("bucket").applyInPandas(_bucket_links(radius), "u long, v long"))
            return out.distinct()
        marks = dealt.join(large, "bucket")
    raise AssertionError


def _grouped(marked: DataFrame, radius: int, bucket: int) -> DataFrame:
    """(mark, group, component_id) of every fingerprint; ``group`` names the component even where no doc_id does."""
    distinct = cut(marked.groupBy("mark").agg(F.min("doc_id").alias("first")))
    found = components(near_edges(distinct.select("mark"), radius, bucket))
    named = distinct.join(found.withColumnRenamed("node", "mark"), "mark", "left").withColumn("group", F.coalesce("component", "mark"))
    least = named.groupBy("group").agg(F.min("first").alias("component_id"))
    return cut(named.join(least, "group").select("mark", "group", "component_id"))


def simhash(docs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """One row per document: doc_id, mark (the fingerprint as a long), component_id."""
    marked = cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints, "doc_id long, mark long"))
    return marked.join(_grouped(marked, radius, bucket), "mark").select("doc_id", "mark", "component_id")


def _with_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = np.array([fingerprint(t) for t in utf8(batch["text"])], np.uint64)
        yield batch.drop_columns(["text"]).append_column("mark", pa.array(marks.view(np.int64)))


def near_dedup(docs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """The rows of ``docs``, whole, of one document of each component: that of its smallest doc_id.

    A component whose doc_ids are all null keeps one row. Of rows with one doc_id and component, one stays.
    """
    names = docs.columns
    marked = cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints, "doc_id long, mark long"))
    groups = _grouped(marked, radius, bucket)
    odd = cut(marked.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id"))
    kept = marked.join(groups, "mark").where("doc_id = component_id").select("doc_id").join(odd, "doc_id", "left_anti")
    plain = docs.join(kept, "doc_id", "left_semi").select(*names)
    # rows that share a doc_id or have none are told apart by their own fingerprints; columns go by number within
    doubtful = docs.where("doc_id is null").unionByName(docs.join(odd, "doc_id", "left_semi").select(*names))
    doubtful = doubtful.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], F.col("doc_id").cast("long").alias("id"), "text")
    fields = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names))
    doubtful = doubtful.mapInArrow(_with_marks, f"{fields}, id long, mark long").join(groups, "mark")
    doubtful = doubtful.where("id <=> component_id").dropDuplicates(["group"])
    return plain.unionByName(doubtful.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)]))


def as_hex(mark: Column) -> Column:
    return F.lower(F.lpad(F.hex(mark), 16, "0"))
