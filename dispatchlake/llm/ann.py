"""Approximate nearest neighbours by a permutation index.

Pivots are a bounded sample of the vectors. A vector is represented by its ``prefix`` nearest pivots in order; this index
is a table, made once. A block of it posts its vectors in one inverted file per pivot. A query looks up the files of its own
``search`` nearest pivots only, and each posting found lowers the vector's footrule distance (the sum over these pivots of
the difference of their places, where a pivot beyond the prefix counts as place ``prefix``). The best share ``rerank`` of
each block (``LEAST`` at least), with all that tie with the last, are ranked by exact Euclidean distance.

Every vector is indexed. Queries go to the blocks in sets of about ``QUERY_SET``: one set is collected, its pass over
the index is written to the shared folder, and only then the next is collected, so the driver holds one set however
many queries there are. A block returns ``k`` rows a query, so nothing near queries x vectors is ever shuffled. A query for which a block's files
hold fewer than ``k`` vectors is compared with that whole block.

Recall of ten neighbours on 51,282 vectors of 64 numbers, against brute force: see the README.

Edge cases: vectors that are null, empty, zero, of another length than most, or hold null or non-finite
components take no part, as queries or candidates; null vec_ids neither; equal distances go to the smaller
vec_id; repeated rows are one candidate per vec_id and vector; with fewer candidates than ``k`` all are returned;
extra columns are not read.
"""

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import append, cut, shared_folder

K = 10
PIVOTS = 256
PREFIX = 64
#: Pivots whose files a query looks up.
SEARCH = 32
#: Share of a block, and the least number of its vectors, that are compared exactly.
RERANK, LEAST = 0.1, 256
QUERY_SET = 4096
#: Vectors in a block of the index.
BLOCK = 8192


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): vectors as doubles, without those that take no part."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(v, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & some).select(F.col("vec_id").cast("long"), v.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Each row's nearest pivots, nearest first; ties to the earlier pivot."""
    out = np.empty((len(x), min(prefix, len(pivots))), np.int32)
    norms = (pivots**2).sum(1)
    for k in range(0, len(x), 4096):
        out[k : k + 4096] = np.argsort(norms - 2 * (x[k : k + 4096] @ pivots.T), axis=1, kind="stable")[:, : out.shape[1]]
    return out


def _pivots(index: DataFrame, n: int, pivots: int) -> np.ndarray:
    """Different vectors, least hashes first, from a part of the table that has them in plenty: all of it is never sorted or made distinct."""
    hashed = F.xxhash64("v")
    for part in (max(1, n // (64 * pivots)), 1):
        rows = index.where(F.pmod(hashed, F.lit(part)) == 0).select("v").distinct().orderBy(hashed, "v").limit(pivots).collect()
        if len(rows) == pivots or part == 1:
            break
    return np.array([r[0] for r in rows])


def _indexed(pivots: np.ndarray, prefix: int):
    """Each vector with the numbers of its nearest pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                order = nearest_pivots(_matrix(batch["v"]), pivots, prefix).astype(np.int16)
                yield batch.append_column("pivots", pa.array([o.tobytes() for o in order], pa.binary()))

    return run


def search_block(ids: np.ndarray, x: np.ndarray, order: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, query_order: np.ndarray, n_pivots: int, k: int, rerank: float, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its id, and ids and distances of the block's nearest found. ``order``: each row's nearest pivots."""
    width = order.shape[1]
    by = np.argsort(order.ravel(), kind="stable")
    bounds = np.searchsorted(order.ravel()[by], np.arange(n_pivots + 1))
    rows, places = (by // width).astype(np.int64), (by % width).astype(np.int64)
    most = max(least, int(rerank * len(x)))
    for qid, q, own in zip(query_ids, queries, query_order, strict=True):
        # a pivot in both prefixes replaces an absence by the difference of its places
        gain, seen = np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        for place, pivot in enumerate(own):
            s = slice(bounds[pivot], bounds[pivot + 1])
            gain[rows[s]] += (width - place) - np.abs(places[s] - place)
            seen[rows[s]] = True
        found = np.flatnonzero(seen & (ids != qid))
        if len(found) < k:
            found = np.flatnonzero(ids != qid)
        elif len(found) > most:
            # all that tie with the last are reranked too
            last = np.partition(gain[found], len(found) - most)[len(found) - most]
            found = found[gain[found] >= last]
        distance = np.concatenate([np.sqrt(((x[found[i : i + 65536]] - q) ** 2).sum(1)) for i in range(0, len(found), 65536)]) if len(found) else np.zeros(0)
        best = np.lexsort((ids[found], distance))[:k]
        yield qid, ids[found[best]], distance[best]


def _searched(query_ids: np.ndarray, queries: np.ndarray, query_order: np.ndarray, n_pivots: int, k: int, rerank: float, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            ids = np.concatenate([b["vec_id"].to_numpy() for b in held])
            x = np.concatenate([_matrix(b["v"]) for b in held])
            order = np.frombuffer(b"".join(o for b in held for o in b["pivots"].to_pylist()), np.int16).reshape(len(ids), -1)
            held.clear()
            found = list(search_block(ids, x, order, query_ids, queries, query_order, n_pivots, k, rerank, least))
            sizes = [len(d) for _, _, d in found]
            return pa.record_batch({
                "query_id": np.repeat(query_ids, sizes),
                "vec_id": np.concatenate([np.asarray(i, np.int64) for _, i, _ in found]),
                "score": np.concatenate([d for _, _, d in found]),
            })

        for batch in batches:
            if len(batch):
                held.append(batch)
            if sum(map(len, held)) >= BLOCK:
                yield block()
        if held:
            yield block()

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, pivots: int = PIVOTS, prefix: int = PREFIX, search: int = SEARCH, rerank: float = RERANK, least: int = LEAST) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of ``vectors`` found for each row of ``queries``."""
    spark = vectors.sparkSession
    index = usable(vectors)
    schema = "query_id long, rank int, vec_id long, score double"
    widths = index.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if not widths:
        return spark.createDataFrame([], schema)
    width = widths["width"]
    index = index.where(F.size("v") == width)
    points = _pivots(index, widths["count"], pivots)
    index = cut(index.mapInArrow(_indexed(points, prefix), "vec_id long, v array<double>, pivots binary"))
    asked = usable(queries).where(F.size("v") == width).distinct()
    sets = -(-asked.count() // QUERY_SET)
    if sets == 0:
        return spark.createDataFrame([], schema)
    # sets stand together in the files, so reading one skips most of the others
    place = F.pmod(F.xxhash64("vec_id", "v"), F.lit(sets)).alias("set")
    asked = cut(asked.select("*", place).repartitionByRange("set").sortWithinPartitions("set")) if sets > 1 else asked.select("*", F.lit(0).alias("set"))
    path = f"{shared_folder(spark)}/found-{uuid.uuid4().hex}"
    for i in range(sets):  # each set is bounded; a pass over the index answers it
        rows = asked.where(F.col("set") == i).select("vec_id", "v").collect()
        if not rows and sets > 1:
            continue
        ids, x = np.array([r["vec_id"] for r in rows], np.int64), np.array([r["v"] for r in rows])
        found = index.mapInArrow(_searched(ids, x, nearest_pivots(x, points, search), len(points), k, rerank, least), "query_id long, vec_id long, score double")
        if sets > 1:
            append(_ranked(found, k).drop("rank"), path)
    if sets > 1:  # rows of one vec_id may be in several sets
        found = spark.read.schema(found.schema).parquet(path)
    return _ranked(found, k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
