"""Temperature mixing of sources, with DataFrame operations only.

Token shares p of the sources are raised to an exponent a >= 0 and normalised: w ~ p**a. Entropy falls as a grows: below 1
small sources gain, above 1 large ones do. The exponent at which entropy meets the target is found by bisection, after
doubling the upper end until entropy is below it; a round evaluates a grid of exponents in one aggregation over the table
of sources and keeps the bracket in which the condition turns. The largest repetition (w * budget / tokens) is least at
a = 1, so where the exponent exceeds the limit on repetitions, a second bisection moves it towards 1 until the limit is met.

The weights are realised as block permutations. A source's documents are hashed into blocks; epoch e orders the
blocks by a hash of (seed, e, source, block), and documents within a block by their own hash. ``mix_order`` is both in one
number, so within an epoch the sources interleave by it. Whole epochs take every document; the last, partial one takes
blocks in this same order while they fit in what is left of the source's budget, and of the block that doesn't fit,
documents in order while they fit. So a source's tokens miss its budget by less than a document.

Per source, only block sums (at most ``blocks``), and hashes and tokens of one block's documents are ever ordered together;
rows with their texts are only filtered.

Edge cases: a null source is a source of its own; a null or empty text has no tokens and comes along with the
whole epochs only; a corpus without tokens is returned as it is, once; repeated rows are separate documents, of which a
partial epoch takes all or none; where several sources have the same greatest share, entropy can't fall below theirs, and the
exponent ends at ``SHARPEST``; where even a = 1 exceeds the limit on repetitions, a is 1; columns that clash with the added
ones (epoch, source_weight, mix_order) are replaced.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import cut

#: Wanted entropy, as a share of the greatest possible (equal weights).
ENTROPY = 0.95
#: No source is repeated more often than this.
MAX_EPOCHS = 4.0
BLOCKS = 4096
SEED = 17
#: Greatest exponent that is tried.
SHARPEST = 1024.0
_GRID, _ROUNDS = 32, 10
_DOCUMENT_BITS = 28


def tokens(text: Column) -> Column:
    """Number of white-space-separated words; null has none."""
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("long")


def _tried(shares: DataFrame, low: float, step: float, n: int) -> DataFrame:
    """Of each exponent low + i * step: z, sum of u log u and greatest u / p, where u is p**a up to a factor."""
    tried = shares.select("p", "top_p", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("i")).withColumn("u", F.pow(F.col("p") / F.col("top_p"), F.lit(low) + F.col("i") * step))
    return tried.groupBy("i").agg(F.sum("u").alias("z"), F.sum(F.when(F.col("u") > 0, F.col("u") * F.log("u")).otherwise(0.0)).alias("ulogu"), F.max(F.col("u") / F.col("p")).alias("top"), F.count("*").alias("n"))


def _turn(shares: DataFrame, low: float, high: float, holds: Column, rising: bool) -> float:
    """Where in [low, high] the condition turns: the greatest exponent that holds, or the least if ``rising``."""
    for _ in range(_ROUNDS):
        step = (high - low) / _GRID
        good = {r["i"] for r in _tried(shares, low, step, _GRID).where(holds).select("i").collect()}
        if rising:
            at = min(good, default=_GRID)
            if at == 0:
                return low
            low, high = low + (at - 1) * step, low + at * step
        else:
            at = max((i for i in range(_GRID + 1) if i in good), default=0)
            if at == _GRID:
                return high
            low, high = low + at * step, low + (at + 1) * step
    return high if rising else low


def exponent(shares: DataFrame, repeats: float, entropy: float, max_epochs: float) -> float:
    """The exponent for ``shares`` (p, top_p). ``repeats``: budget by tokens of the corpus."""
    # entropy of w is log z - sum(u log u) / z
    enough = F.log("z") - F.col("ulogu") / F.col("z") >= entropy * F.log("n") - 1e-12
    within = F.col("top") / F.col("z") * repeats <= max_epochs + 1e-12
    at = lambda a, holds: bool(_tried(shares, a, 0.0, 0).where(holds).count())
    high = 1.0
    while high < SHARPEST and at(high, enough):
        high *= 2
    a = _turn(shares, 0.0, high, enough, rising=False)
    if at(a, within):
        return a
    return _turn(shares, a, 1.0, within, rising=True) if a < 1 else _turn(shares, 1.0, a, within, rising=False)


def weights(sources: DataFrame, budget: float | None = None, entropy: float = ENTROPY, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``sources`` (source, tokens, documents) with share, weight, exponent and target tokens.

    ``budget``: tokens of the mix; None: as many as the corpus has.
    """
    total, top = sources.agg(F.sum("tokens"), F.max("tokens")).first()
    if not total:
        return sources.select("*", F.lit(0.0).alias("share"), F.lit(0.0).alias("weight"), F.lit(1.0).alias("exponent"), F.lit(0.0).alias("target"))
    budget = float(budget if budget is not None else total)
    shares = cut(sources.where("tokens > 0").select((F.col("tokens") / total).alias("p"), F.lit(top / total).alias("top_p")))
    a = exponent(shares, budget / total, entropy, max_epochs)
    z = _tried(shares, a, 0.0, 0).first()["z"]
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / top, F.lit(a)) / z).otherwise(0.0)
    return sources.select("*", (F.col("tokens") / total).alias("share"), weight.alias("weight"), F.lit(a).alias("exponent")).withColumn("target", F.col("weight") * budget)


def _block_place(seed: int, epoch: str) -> Column:
    """Where a block stands in an epoch: a number of 64 - _DOCUMENT_BITS bits."""
    return F.shiftright(F.xxhash64(F.lit(seed), epoch, "_s", "_none", "_b"), _DOCUMENT_BITS)


def _document_place() -> Column:
    """Where a document stands in its block: a number of _DOCUMENT_BITS bits."""
    return F.shiftrightunsigned("_h", 64 - _DOCUMENT_BITS)


def mix(docs: DataFrame, budget: float | None = None, entropy: float = ENTROPY, max_epochs: float = MAX_EPOCHS, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """The mixed corpus: a row for each time a document is taken, with epoch (from 0), source_weight and mix_order."""
    added = ("epoch", "source_weight", "mix_order")
    kept = [c for c in docs.columns if c not in added]
    # the input's columns go by number within, so that no name of theirs can clash
    carried = [F.col(c).alias(f"c{i}") for i, c in enumerate(kept)]
    counted = docs.select(*carried, tokens(F.col("text")).alias("_n"), F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_none"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("_h"))
    counted = counted.withColumn("_b", F.pmod("_h", F.lit(blocks)).cast("int"))
    sizes = cut(counted.groupBy("_s", "_none", "_b").agg(F.sum("_n").alias("n"), F.count("*").alias("docs")))
    sources = sizes.groupBy("_s", "_none").agg(F.sum("n").alias("tokens"), F.sum("docs").alias("documents"))
    plan = cut(weights(sources, budget, entropy, max_epochs))
    passes = F.when(F.col("tokens") > 0, F.floor(F.col("target") / F.col("tokens"))).otherwise(1).cast("int")
    plan = plan.withColumn("_whole", passes).withColumn("_rest", F.when(F.col("tokens") > 0, F.floor(F.col("target") - passes * F.col("tokens"))).otherwise(0).cast("long"))
    plan = plan.select("_s", "_none", F.col("weight").alias("source_weight"), "_whole", "_rest")
    # the partial epoch: tokens of the blocks that come before each block
    prior = Window.partitionBy("_s", "_none").orderBy("_order", "_b").rowsBetween(Window.unboundedPreceding, -1)
    room = sizes.join(plan, ["_s", "_none"]).withColumn("_order", _block_place(seed, "_whole")).withColumn("_left", F.col("_rest") - F.coalesce(F.sum("n").over(prior), F.lit(0)))
    fate = F.when((F.col("_rest") == 0) | (F.col("_left") <= 0), "none").when(F.col("_left") >= F.col("n"), "all").otherwise("some")
    fates = room.select("_s", "_none", "_b", "source_weight", "_whole", "_left", fate.alias("_fate"))
    placed = counted.join(fates, ["_s", "_none", "_b"])
    # of the block that fits in part: the last document that fits, by hashes and tokens alone
    key = F.struct(_document_place().alias("place"), F.col("_h").alias("hash"))
    within = Window.partitionBy("_s", "_none").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    fitting = placed.where("_fate = 'some'").select("_s", "_none", key.alias("key"), "_n", "_left").withColumn("so_far", F.sum("_n").over(within)).where("so_far <= _left")
    last = fitting.groupBy("_s", "_none").agg(F.max("key").alias("_last"))
    settled = placed.join(last, ["_s", "_none"], "left").withColumn("_fate", F.when(F.col("_fate") != "some", F.col("_fate")).when(key <= F.col("_last"), "all").otherwise("none"))
    taken = F.expr("if(_fate = 'all', _whole + 1, _whole)")
    epochs = F.explode(F.when(taken > 0, F.sequence(F.lit(0), taken - 1)).otherwise(F.array().cast("array<int>")))
    # where in its epoch a block, and in its block a document, stands
    mixed = settled.withColumn("epoch", epochs).withColumn("mix_order", F.shiftleft(_block_place(seed, "epoch"), _DOCUMENT_BITS) + _document_place())
    return mixed.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], *added)
