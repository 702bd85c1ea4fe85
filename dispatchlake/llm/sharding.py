"""Sharding by histogram sort, with DataFrame operations only.

Rows are ordered by a composite key: the hash of the text, then the hash of the doc_id, then a row number, so
equal texts are neighbours and yet a group of copies of any size can be divided. The splitters, one between each
two shards, are found by counting: every round sums the exact bytes of the rows below candidate boundaries (in
one aggregation for all splitters; its result has a fixed number of rows per splitter), keeps the cell in which each
splitter's target lies, and divides that cell anew, until a cell is within tolerance of its target. Then rows go
to their shards by comparison with the splitters, and one exchange numbers them.

Edge cases: a null text has no bytes (size 1, CRC of the empty string) and is ordered like an empty one; null
doc_ids are kept, with null as their key; an empty table gives an empty result; repeated rows get slots of their
own; columns of the input that clash with the added ones are not carried on.
"""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import cut

SHARDS = 16
#: Cells into which a round divides the cell of a splitter.
PROBES = 1024
#: A splitter is settled when its cell holds no more than this share of a shard.
TOLERANCE = 0.002
#: Rows that are numbered together.
SLOT_ROWS = 100_000
_KEYS = ("_k1", "_k2", "_k3")


@dataclass
class _Splitter:
    """The search for the key below which ``target`` bytes lie."""

    target: float
    below: int = 0  # bytes of rows that sort before the cell
    fixed: list[int] = field(default_factory=list)  # values of the leading keys, once a cell has a single one
    low: int = -(1 << 63)
    high: int = (1 << 63) - 1
    settled: tuple[int, ...] | None = None

    def cell(self) -> tuple:
        return (*self.fixed, self.low, self.high)


def _probe(cell: tuple) -> Column:
    """For a row in the cell: which of PROBES equal parts it is in, and its key at the cell's level; null for other rows."""
    *fixed, low, high = cell
    name = _KEYS[len(fixed)]
    shift = max(0, (high - low).bit_length() - 50)  # keeps the product below in a long
    width = (high >> shift) - (low >> shift) + 1
    part = F.expr(f"((shiftright({name}, {shift}) - ({low >> shift}L)) * {PROBES}L) div {width}L")
    inside = F.col(name).between(F.lit(low), F.lit(high))
    for key, value in zip(_KEYS, fixed, strict=False):
        inside &= F.col(key) == F.lit(value)
    return F.when(inside, F.struct(F.array(*map(F.lit, cell)).alias("cell"), part.alias("part"), F.col(name).alias("key")))


def _counted(rows: DataFrame, cells: list[tuple]) -> dict[tuple, list[tuple]]:
    """For each cell (they don't overlap) its non-empty parts in order: number, bytes, least and greatest key."""
    sums = rows.select("_size", F.coalesce(*map(_probe, cells)).alias("c")).where("c is not null")
    sums = sums.groupBy("c.cell", "c.part").agg(F.sum("_size").alias("bytes"), F.min("c.key").alias("least"), F.max("c.key").alias("greatest"))
    out: dict[tuple, list[tuple]] = {cell: [] for cell in cells}
    for r in sums.collect():  # at most PROBES rows for each of at most as many cells as splitters
        out[tuple(r["cell"])].append((r["part"], r["bytes"], r["least"], r["greatest"]))
    return {cell: sorted(parts) for cell, parts in out.items()}


def splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, ...]]:
    """Keys that begin the shards 1, 2, ...; ``rows`` has _k1, _k2, _k3 and _size."""
    total = rows.agg(F.sum("_size")).first()[0] or 0
    found = [_Splitter(total * (i + 1) / shards) for i in range(shards - 1)]
    slack = max(1.0, tolerance * total / shards)
    while total and (open_ := [s for s in found if s.settled is None]):
        counts = _counted(rows, sorted({s.cell() for s in open_}))
        for s in open_:
            cells = counts[s.cell()]
            for i, (_, size, least, greatest) in enumerate(cells):
                if s.below + size >= s.target or i == len(cells) - 1:
                    break
                s.below += size
            s.low, s.high = least, greatest
            over = s.below + size - s.target
            if size <= slack or (least == greatest and len(s.fixed) == len(_KEYS) - 1):
                # the cell goes to the side that comes nearer to the target
                past = over <= s.target - s.below
                rest = 2 - len(s.fixed)
                s.settled = (*s.fixed, greatest, *[(1 << 63) - 1] * rest, True) if past else (*s.fixed, least, *[-(1 << 63)] * rest, False)
            elif least == greatest:
                s.fixed.append(least)
                s.low, s.high = -(1 << 63), (1 << 63) - 1
    return [s.settled for s in found if s.settled]


def _at_or_after(key: tuple[int, ...]) -> Column:
    """Whether a row sorts at the splitter or after it; the last entry says that the splitter's own row still lies before."""
    *values, past = key
    k1, k2, k3 = (F.col(k) for k in _KEYS)
    v1, v2, v3 = (F.lit(v) for v in values)
    last = (k3 > v3) if past else (k3 >= v3)
    return (k1 > v1) | ((k1 == v1) & ((k2 > v2) | ((k2 == v2) & last)))


def _slots(rows: DataFrame, n_rows: int) -> DataFrame:
    """Number the rows of each shard from 0: counts of parts first, then places within the parts.

    Parts hold about SLOT_ROWS rows and are dealt by a hash of the row's own key, so copies don't gather.
    """
    parts = max(1, -(-n_rows // SLOT_ROWS))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("_k2", "_k3"), F.lit(parts)))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "_part").count().select("shard", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("shard", "_part").orderBy(*_KEYS))
    return rows.withColumn("_place", place).join(starts, ["shard", "_part"]).withColumn("slot", F.col("_start") + F.col("_place") - 1).drop("_part", "_place", "_start")


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, carry: bool = True) -> DataFrame:
    """Shards of near-equal bytes. Adds size, text_crc32, law, shard, slot and grown_shard; ``carry``: keep all columns, else doc_id."""
    added = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    kept = [c for c in docs.columns if c not in added] if carry else ["doc_id"]
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = cut(
        docs.select(
            *[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)],  # by number, so that no name can clash
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("_k1"),
            F.xxhash64(F.col("doc_id").cast("long")).alias("_k2"),
            F.monotonically_increasing_id().alias("_k3"),
        )
    )
    found = splitters(keyed.select(*_KEYS, F.col("size").alias("_size")), shards, tolerance)
    number = F.lit(0)
    for key in found:
        number = number + _at_or_after(key).cast("int")
    placed = keyed.withColumn("law", F.lit("bytes")).withColumn("shard", number)
    return _slots(placed, keyed.count()).withColumn("grown_shard", F.lit(None).cast("int")).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], *added)
