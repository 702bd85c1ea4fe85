"""Numeric kernels around document readings: scores, choice of readings, scales, crops and grey levels.

A reading has text, confidence, words array<struct<text, confidence, ...>> and lines.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values.
LETTERS = "A-Za-zÇĞİÖŞÜçğıöşü"
READABLE, ENOUGH = 70, 70
TARGET_WIDTH, MOST_GROWTH, MOST_PIXELS, ZOOM_BELOW = 2480, 4.0, 4_200_000.0, 0.95
BLANK_DELTA = 6
TAIL, GREY_RANGE = 0.02, 8
MANUAL_WIDTH, MANUAL_HEIGHT = 20, 12
PROBE_FACTOR, PROBE_LEAST, FEW_WORDS = 1.4, 3, 12


def readable_words(text: Column, words: Column) -> Column:
    """Confident words with a run of three letters; without words, a twentieth of the text's letters; no text: 0."""
    good = F.size(F.filter(words, lambda w: (w["confidence"] >= READABLE) & F.coalesce(w["text"], F.lit("")).rlike(f"[{LETTERS}]{{3,}}")))
    letters = F.length(F.regexp_replace(text, f"[^{LETTERS}]", "")) / 20
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0.0).when(F.coalesce(F.size(words), F.lit(0)) <= 0, letters).otherwise(good.cast("double"))


def best_reading(attempts: DataFrame, key: str, score: str = "score", order: str = "attempt", enough: int = ENOUGH) -> DataFrame:
    """The best of the attempts up to the first that is good enough; the earliest wins ties."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    tried = attempts.withColumn("_done", F.coalesce(F.max(F.col(score) >= enough).over(before), F.lit(False))).where("not _done").drop("_done")
    return tried.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), order))).where("_n = 1").drop("_n")


def joined(a: Column, b: Column) -> Column:
    """Two readings as one: texts by a line break, greater confidence, words and lines of both; a missing one changes nothing."""
    both = F.struct(
        F.concat(F.coalesce(a["text"], F.lit("")), F.lit("\n"), F.coalesce(b["text"], F.lit(""))).alias("text"),
        F.greatest(F.coalesce(a["confidence"], F.lit(0.0)), F.coalesce(b["confidence"], F.lit(0.0))).alias("confidence"),
        F.concat(F.coalesce(a["words"], F.array()), F.coalesce(b["words"], F.array())).alias("words"),
        F.concat(F.coalesce(a["lines"], F.array()), F.coalesce(b["lines"], F.array())).alias("lines"),
    )
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def scale(width: Column, height: Column, target: Column | None = None, shrink: Column | None = None) -> Column:
    """How much a frame is enlarged: to the target width, at most MOST_GROWTH times and MOST_PIXELS pixels."""
    wanted = (target if target is not None else F.lit(TARGET_WIDTH)) / width
    out = F.least(wanted, F.lit(MOST_GROWTH), F.sqrt(F.lit(MOST_PIXELS) / (width * height)))
    return out * shrink if shrink is not None else out


def output_size(width: Column, height: Column, factor: Column) -> Column:
    side = lambda x: F.greatest(F.lit(1), F.floor(x * factor + 0.5)).cast("int")
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def zoom_helps(width: Column, height: Column) -> Column:
    return scale(width, height) < ZOOM_BELOW


def frame_size(degrees: Column, width: Column, height: Column) -> Column:
    turned = F.pmod(degrees, F.lit(360)).isin(90, 270)
    return F.struct(F.when(turned, height).otherwise(width).alias("width"), F.when(turned, width).otherwise(height).alias("height"))


def crop_in_source(x0: Column, y0: Column, x1: Column, y1: Column, degrees: Column, width: Column, height: Column) -> Column:
    """A rectangle of the upright frame in the coordinates of the picture as taken; width and height are the picture's."""
    turn = F.pmod(degrees, F.lit(360))
    rect = lambda a, b, c, d: F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"))
    upright, half = rect(x0, y0, x1, y1), rect(width - x1, height - y1, width - x0, height - y0)
    right, left = rect(y0, height - x1, y1, height - x0), rect(width - y1, x0, width - y0, x1)
    return F.when(turn == 90, right).when(turn == 180, half).when(turn == 270, left).otherwise(upright)


def box_is_large_enough(width: Column, height: Column) -> Column:
    return (width >= MANUAL_WIDTH) & (height >= MANUAL_HEIGHT)


def is_blank(patches: Column) -> Column:
    """``patches``: arrays of pixels struct<r, a>. Blank unless any opaque pixel's red differs by more than BLANK_DELTA from that of the first opaque one of all patches."""
    opaque = F.filter(F.flatten(patches), lambda x: x["a"] > 0)
    return ~F.exists(opaque, lambda x: F.abs(x["r"] - F.get(opaque, 0)["r"]) > BLANK_DELTA)


def grey(r: Column, g: Column, b: Column) -> Column:
    return F.floor((299 * r + 587 * g + 114 * b) / 1000).cast("int")


def histogram(pixels: DataFrame, key: str, level: str) -> DataFrame:
    return pixels.groupBy(key, level).agg(F.count("*").alias("n"))


def clip_levels(hist: DataFrame, key: str, level: str) -> DataFrame:
    """First levels, from below and from above, at which more than TAIL of the pixels are passed."""
    up = Window.partitionBy(key).orderBy(level).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(key).orderBy(F.desc(level)).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(Window.partitionBy(key))
    rows = hist.withColumns({"_up": F.sum("n").over(up), "_down": F.sum("n").over(down), "_total": total})
    return rows.groupBy(key).agg(F.min(F.when(F.col("_up") > TAIL * F.col("_total"), F.col(level))).alias("low"), F.max(F.when(F.col("_down") > TAIL * F.col("_total"), F.col(level))).alias("high"))


def stretched(level: Column, low: Column, high: Column) -> Column:
    """A grey level spread over 0..255 between the clips, if they lie more than GREY_RANGE apart."""
    wide = F.bround((level - low) * (F.lit(255.0) / (high - low)))  # bytes take halves to the even side
    return F.when(high - low > GREY_RANGE, F.least(F.lit(255), F.greatest(F.lit(0), wide))).otherwise(level).cast("int")


def _in_frame(rows: DataFrame, key: str, item: str) -> DataFrame:
    place = {c: F.col(f"o.{c[0]}") + F.coalesce(F.col(f"{item}.{c}"), F.lit(0.0)) / F.col("f") for c in ("x0", "y0", "x1", "y1")}
    return rows.withColumns(place)


def _lines(blocks: str) -> Column:
    return F.flatten(F.transform(blocks, lambda b: F.flatten(F.transform(b["paragraphs"], lambda p: p["lines"]))))


def flat_words(tree: DataFrame, key: str, blocks: str, origin: Column, factor: Column) -> DataFrame:
    """Words of a tree of blocks, paragraphs, lines and words, with boxes in the frame: origin + box / factor."""
    nested = F.flatten(F.transform(_lines(blocks), lambda line: line["words"]))
    rows = tree.select(key, F.posexplode(nested).alias("pos", "w"), origin.alias("o"), factor.alias("f"))
    return _in_frame(rows, key, "w").select(key, "pos", F.col("w.text").alias("text"), F.col("w.confidence").alias("confidence"), "x0", "y0", "x1", "y1")


def flat_lines(tree: DataFrame, key: str, blocks: str, origin: Column, factor: Column) -> DataFrame:
    """Its lines, the same way; a line without text has an empty one."""
    rows = tree.select(key, F.posexplode(_lines(blocks)).alias("pos", "l"), origin.alias("o"), factor.alias("f"))
    return _in_frame(rows, key, "l").select(key, "pos", F.coalesce("l.text", F.lit("")).alias("text"), "x0", "y0", "x1", "y1")


#: Stages of reading a page, in the order in which they are tried; of equal scores the first is kept.
STAGES = ("manual", "page", "region1", "region2", "page180", "region180_1", "region180_2")


def cascade(attempts: DataFrame, key: str) -> DataFrame:
    """Which stages of reading a page are run, and the one whose reading is kept.

    ``attempts``: a row per stage (STAGES and probe180) with score and words (readable words), and zoom on the page's
    row; a stage without a row can't be run. A box chosen by hand is the only stage. Regions count only below ENOUGH
    and where zoom helps, the second only if the first isn't enough; the upside-down page only if the page has few words
    and the probe clearly more.
    """
    of = lambda stage, c: F.max(F.when(F.col("stage") == stage, F.col(c)))
    rows = attempts.groupBy(key).agg(*[of(s, "score").alias(s) for s in STAGES], of("page", "words").alias("page_words"), of("probe180", "words").alias("probe_words"), F.coalesce(F.bool_or("zoom"), F.lit(False)).alias("zoom"))

    def regions(before: Column, asked: Column, one: str, two: str) -> tuple[Column, Column, Column]:
        """Whether each is run, and the score after both."""
        first = asked & F.col("zoom") & (before < ENOUGH) & F.col(one).isNotNull()
        after = F.greatest(before, F.when(first, F.col(one)))
        second = first & (after < ENOUGH) & F.col(two).isNotNull()
        return first, second, F.greatest(after, F.when(second, F.col(two)))

    by_hand = F.col("manual").isNotNull()
    page = F.coalesce("page", F.lit(0.0))
    first, second, so_far = regions(page, ~by_hand, "region1", "region2")
    few = F.coalesce("page_words", F.lit(0))
    turned = ~by_hand & (so_far < ENOUGH) & (few < FEW_WORDS) & (F.coalesce("probe_words", F.lit(0)) > F.greatest(F.lit(PROBE_LEAST), PROBE_FACTOR * few))
    over = F.coalesce("page180", F.lit(0.0))
    third, fourth, _ = regions(over, turned, "region180_1", "region180_2")
    run = (by_hand, ~by_hand, first, second, turned, third, fourth)
    tried = F.filter(F.array(*[F.when(r, F.struct(F.coalesce(s, F.lit(0.0)).alias("score"), F.lit(-i).alias("n"), F.lit(s).alias("stage"))) for i, (s, r) in enumerate(zip(STAGES, run, strict=True))]), lambda x: x.isNotNull())
    out = rows.select(key, tried.alias("t"), turned.alias("turned"), first.alias("zoomed"))
    return out.select(key, F.array_max("t")["score"].alias("score"), F.array_max("t")["stage"].alias("kept"), "turned", "zoomed", F.transform("t", lambda x: x["stage"]).alias("stages"))
