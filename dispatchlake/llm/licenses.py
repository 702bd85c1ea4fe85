"""Licence scans: a positional rare-token index, with DataFrame operations only.

Every licence is a template: the words of a sentence that its notices share, and the key phrases that must stand
in it. The document frequency of the templates' words is counted over all documents; each template is indexed
under its rarest words, as postings (word, template, place in the template). All occurrences of indexed words in a
file meet these postings; the difference of the two places is an alignment of the template with the file. The index
has a fixed size, so the alignments of a file are at most a fixed multiple of its words. Along each alignment the template is compared word by word: the share
of its IDF weight that agrees is the alignment's score, and all key phrases must stand where the template has
them. The label of an alignment that passes both is given.

The base phrases (mit license, ...) are found at their exact places through the same postings of their words.

All of it is a projection of each row; only the counts of the templates' words are shuffled.

Edge cases: null and empty texts have no words and no labels, score 0; a text of any length is one array of
words; ties between templates give all their labels; repeated rows are scanned one by one; documents without a
doc_id are returned with null; extra columns are not read.
"""

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases whose places are counted, and the label of each.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Label, words of the notice, key phrases that must stand in it (separated by /).
TEMPLATES = [
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted / free of charge"),
    ("apache", "licensed under the apache license version 2 0", "apache license / version 2 0"),
    ("gpl", "licensed under the gnu general public license version", "gnu general public license"),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license", "under the terms / gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution / international license"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", "cc0 1 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use / source and binary forms"),
    ("bsd", "released under the bsd license", "bsd license"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", "permission to use / with or without fee"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software / public domain"),
    ("epl", "under the terms of the eclipse public license v 2 0", "eclipse public license"),
    ("proprietary", "all rights reserved no part of this work may be reproduced without permission", "all rights reserved / without permission"),
]
#: Each template is indexed under so many of its rarest words.
RARE = 4
#: Least share of a template's IDF weight that must agree.
AGREE = 0.6
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, with A-Z lower-cased and no other letter."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), _SPLIT), "")


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def idf(docs: DataFrame) -> dict[str, float]:
    """log(1 + documents / documents with it) of every word of the templates, over all documents."""
    vocabulary = sorted({w for _, t, _ in TEMPLATES for w in t.split()})
    count, frequent = docs.count(), {}
    found = docs.select(F.explode(F.array_intersect(words(F.col("text")), _strings(vocabulary))).alias("w")).groupBy("w").count()
    frequent = {r["w"]: r["count"] for r in found.collect()}  # at most the vocabulary
    return {w: log(1 + (count + 1) / (1 + frequent.get(w, 0))) for w in vocabulary}


def _index(weight: dict[str, float]) -> dict[str, list[tuple[int, int]]]:
    """Postings of each indexed word: (template, place)."""
    out: dict[str, list[tuple[int, int]]] = {}
    for n, (_, text, _) in enumerate(TEMPLATES):
        template = text.split()
        for word in sorted(set(template), key=lambda w: (-weight[w], w))[:RARE]:
            out.setdefault(word, []).extend((n, i) for i, w in enumerate(template) if w == word)
    return out


def _keys(n: int) -> list[tuple[int, list[str]]]:
    """Places of a template's key phrases."""
    template = TEMPLATES[n][1].split()
    out = []
    for phrase in TEMPLATES[n][2].split("/"):
        p = phrase.split()
        out.append((next(i for i in range(len(template)) if template[i : i + len(p)] == p), p))
    return out


def _base_places(posts: Column, phrase: list[str]) -> Column:
    """Places where the phrase's words stand in a row. Every word of the phrase is posted, so neighbours are neighbours in ``posts``."""

    def starts(x: Column, j: Column) -> Column:
        here = x["w"] == phrase[0]
        for k, word in enumerate(phrase[1:], 1):
            other = F.get(posts, j + k)
            here &= (other["w"] == word) & (other["i"] == x["i"] + k)
        return F.when(here, x["i"])

    return F.array_compact(F.transform(posts, starts))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    weight = idf(docs)
    index = _index(weight)
    posted = sorted(set(index) | {w for p in BASE for w in p.split()})
    at = F.transform(F.col("words"), lambda w, i: F.when(w.isin(posted), F.struct(w.alias("w"), i.alias("i"))))
    rows = docs.select(F.col("doc_id").cast("long"), words(F.col("text")).alias("words")).withColumn("posts", F.array_compact(at))
    places = {p: _base_places(F.col("posts"), p.split()) for p in BASE}
    rows = rows.withColumns({f"base{k}": v for k, v in enumerate(places.values())})

    # an alignment is a number, start * templates + template: distinct numbers are found by hashing, structs pair by pair
    n = F.lit(len(TEMPLATES))
    postings = F.create_map(*[x for w, ps in sorted(index.items()) for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(i).alias("i")) for t, i in ps]))])
    indexed = F.filter("posts", lambda x: x["w"].isin(sorted(index)))
    aligned = F.flatten(F.transform(indexed, lambda x: F.transform(postings[x["w"]], lambda p: (x["i"] - p["i"]).cast("long") * n + p["t"])))
    rows = rows.withColumn("aligned", F.transform(F.array_distinct(aligned), lambda a: F.struct(F.pmod(a, n).cast("int").alias("t"), F.floor(a / n).cast("int").alias("start"))))

    templates = F.array(*[F.struct(F.lit(label).alias("label"), _strings(text.split()).alias("words"), F.array(*[F.lit(weight[w]) for w in text.split()]).alias("weights"), F.lit(sum(weight[w] for w in text.split())).alias("whole"), F.array(*[F.struct(F.lit(k).alias("at"), _strings(p).alias("words")) for k, p in _keys(n)]).alias("keys")) for n, (label, text, _) in enumerate(TEMPLATES)])

    def judged(a: Column) -> Column:
        t = F.get(templates, a["t"])
        agrees = F.zip_with(F.transform(t["words"], lambda w, k: F.coalesce(F.get(F.col("words"), a["start"] + k) == w, F.lit(False))), t["weights"], lambda same, x: F.when(same, x).otherwise(0.0))
        share = F.aggregate(agrees, F.lit(0.0), lambda s, x: s + x) / t["whole"]
        keys = F.forall(t["keys"], lambda k: (a["start"] + k["at"] >= 0) & (F.slice(F.col("words"), F.greatest(a["start"] + k["at"], F.lit(0)) + 1, F.size(k["words"])) == k["words"]))
        return F.struct(t["label"].alias("label"), F.when(keys, share).otherwise(0.0).alias("share"))

    rows = rows.withColumn("found", F.filter(F.transform("aligned", judged), lambda x: x["share"] >= AGREE))
    base = [F.col(f"base{k}") for k in range(len(BASE))]
    every = F.flatten(F.array(*base))
    base_labels = F.array_compact(F.array(*[F.when(F.size(b) > 0, F.lit(label)) for b, label in zip(base, BASE.values(), strict=True)]))
    labels = F.array_union(base_labels, F.transform("found", lambda x: x["label"]))
    best = F.greatest(F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0)), F.when(F.size(every) > 0, 0.5).otherwise(0.0))
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        reduce(lambda a, b: a + b, [F.size(b) for b in base]).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.least(best, F.lit(1.0)).alias("score"),
    )
