"""Names found by index: within some edits of a name, and as runs of words in whole texts. Only equi joins, no pairs.

Edits. A name of n characters may be off by k = floor(share * n). It is cut into k + 1 pieces; whatever is within k edits of it
holds one of the pieces unchanged (k edits can't touch k + 1 pieces), at most k places from where the name has it. So names
are indexed by their pieces, with n and the piece's number, and a word looks up its own substrings at those places.

Runs. Names are paths of a trie of words. A text's words look up the trie's first steps; only places that begin a name go on, with
as many words as the longest name from there has, to look up whole names. Of names of one kind within one another the longest counts.
The names are written first, so Spark knows their size: while they are few, it broadcasts them, and the words of texts stay where they are.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import cut


def _cuts(n: str, k: str) -> str:
    """SQL of the pieces of ``n`` characters for ``k`` edits: number, begin (from 0) and size; the last ones are longer by one."""
    plain = f"({k} + 1 - {n} % ({k} + 1))"
    return f"transform(sequence(0, {k}), i -> struct(i AS i, cast(i * ({n} div ({k} + 1)) + greatest(0, i - {plain}) AS int) AS begin, cast({n} div ({k} + 1) + if(i >= {plain}, 1, 0) AS int) AS size))"


def within_edits(asked: DataFrame, names: DataFrame, keys: list[str], word: str, name: str, share: float) -> DataFrame:
    """(keys, word, name, edits): the different words and names of equal keys that are within ``share`` of the name's length.

    Null words and names match nothing; empty ones each other.
    """
    own = names.select(*keys, name).where(F.col(name).isNotNull()).distinct().withColumn("_n", F.length(name)).withColumn("_k", F.floor(F.col("_n") * share).cast("int"))
    index = own.withColumn("_c", F.explode(F.expr(_cuts("_n", "_k")))).select(*keys, name, "_n", F.col("_c.i").alias("_i"), F.expr(f"substr({name}, _c.begin + 1, _c.size)").alias("_piece"))
    words = asked.select(*keys, word).where(F.col(word).isNotNull()).distinct().withColumn("_w", F.length(word))
    # lengths of names that so long a word can be meant for
    lengths = F.sequence(F.floor(F.col("_w") / (1 + share)).cast("int"), F.ceil(F.col("_w") / (1 - share)).cast("int"))
    tried = words.withColumn("_n", F.explode(lengths)).withColumn("_k", F.floor(F.col("_n") * share).cast("int")).where("abs(_w - _n) <= _k").withColumn("_c", F.explode(F.expr(_cuts("_n", "_k"))))
    # a piece shifted by s has |s| edits before it and as many after it as bring the length right
    tried = tried.withColumn("_s", F.explode(F.expr("filter(sequence(-_k, _k), s -> abs(s) + abs(_w - _n - s) <= _k AND _c.begin + s >= 0 AND _c.begin + s + _c.size <= _w)")))
    tried = tried.select(*keys, word, "_n", F.col("_c.i").alias("_i"), F.expr(f"substr({word}, _c.begin + _s + 1, _c.size)").alias("_piece")).distinct()
    pairs = tried.join(index, [*keys, "_n", "_i", "_piece"]).select(*keys, word, name, "_n").distinct()
    return pairs.withColumn("edits", F.levenshtein(word, name)).where(F.col("edits") <= F.floor(F.col("_n") * share)).drop("_n")


def runs_of_words(texts: DataFrame, names: DataFrame, key: str, words: str, after: int) -> DataFrame:
    """(key, kind, name, begin, size, after): names found as runs of words; ``after``: so many words that follow.

    ``texts``: key, words (array); ``names``: kind, name (words joined by one space). Begin counts from 0. Names without
    words are in no text.
    """
    known = cut(names.select("kind", "name").where("name <> ''").distinct().withColumn("_words", F.size(F.split("name", " "))))
    longest = known.agg(F.max("_words")).first()[0] or 1
    steps = known.groupBy(F.split("name", " ")[0].alias("_first")).agg(F.max("_words").alias("_depth"))
    # a place takes along as many words as a name may need, not its text
    places = texts.select(key, words, F.posexplode(words).alias("begin", "_first")).select(key, "begin", "_first", F.slice(words, F.col("begin") + 1, longest + after).alias("_next")).join(steps, "_first")
    sizes = F.explode(F.sequence(F.lit(1), F.least("_depth", F.size("_next"))))
    grams = places.select(key, "begin", "_next", sizes.alias("size")).withColumn("name", F.concat_ws(" ", F.slice("_next", F.lit(1), F.col("size"))))
    found = grams.join(known.drop("_words"), "name").select(key, "kind", "name", "begin", "size", F.slice("_next", F.col("size") + 1, F.lit(after)).alias("after"))
    # a longer name of the kind that begins no later and ends no earlier; dealt out by key, so what follows by key stays where it is
    before = Window.partitionBy(key, "kind").orderBy("begin", F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("begin") + F.col("size")
    return found.repartition(key).withColumn("_end", F.max(end).over(before)).where(F.col("_end").isNull() | (F.col("_end") < end)).drop("_end")
