"""Mixing: exponents against direct evaluation, budgets to within a document, whole epochs."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from dispatchlake.llm import mixing as op


def entropy(w):
    return -sum(x * math.log(x) for x in w if x > 0)


@pytest.mark.parametrize(("share", "most"), [(0.95, 4.0), (0.7, 100.0), (1.0, 2.0), (0.2, 1.5)])
def test_weights_meet_the_entropy_or_the_limit(spark, share, most):
    tokens = {"a": 100_000, "b": 20_000, "c": 5_000, "d": 100, "none": 0}
    table = spark.createDataFrame([(s, n, 1) for s, n in tokens.items()], "source string, tokens long, documents long")
    rows = op.weights(table, None, share, most).collect()
    total, live = sum(tokens.values()), 4
    a = rows[0]["exponent"]
    w = {r["source"]: r["weight"] for r in rows}
    assert w["none"] == 0 and math.isclose(sum(w.values()), 1, rel_tol=1e-9)
    p = {s: n / total for s, n in tokens.items() if n}
    z = sum(x**a for x in p.values())
    assert all(math.isclose(w[s], x**a / z, rel_tol=1e-9) for s, x in p.items())
    assert max(w[s] / p[s] for s in p) <= most * (1 + 1e-6)
    meets = math.isclose(entropy(w.values()), share * math.log(live), rel_tol=1e-6, abs_tol=1e-9)
    assert meets or math.isclose(max(w[s] / p[s] for s in p), most, rel_tol=1e-6)


def test_budgets_hold_to_within_a_document(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, "rare").otherwise("web").alias("source"), F.repeat(F.lit("x "), (F.col("id") % 40).cast("int")).alias("text"))
    counted = docs.withColumn("n", op.tokens(F.col("text")))
    total = {r["source"]: (r["n"], r["most"]) for r in counted.groupBy("source").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()}
    mixed = op.mix(docs).withColumn("n", op.tokens(F.col("text"))).collect()
    budget = sum(n for n, _ in total.values())
    got, weight = Counter(), {}
    epochs = defaultdict(Counter)
    for r in mixed:
        got[r["source"]] += r["n"]
        weight[r["source"]] = r["source_weight"]
        epochs[r["source"], r["doc_id"]][r["epoch"]] += 1
    for s, (_, most) in total.items():
        assert 0 <= weight[s] * budget - got[s] <= most
    assert all(set(c.values()) == {1} and set(c) == set(range(len(c))) for c in epochs.values())


def test_the_exposed_order_is_the_permutation_that_was_budgeted(spark):
    """A source's partial epoch is the beginning of its order in that epoch, up to the first document that doesn't fit."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise("web").alias("source"), F.repeat(F.lit("x "), (F.col("id") % 9 + 1).cast("int")).alias("text"))
    rows = op.mix(docs, blocks=64).collect()
    n = {r["doc_id"]: r["doc_id"] % 9 + 1 for r in docs.collect()}
    assert len({(r["epoch"], r["mix_order"]) for r in rows}) == len(rows)
    every = docs.withColumn("_h", F.xxhash64(F.lit(op.SEED), "doc_id", "text")).withColumn("_b", F.pmod("_h", F.lit(64)).cast("int")).withColumnsRenamed({"source": "_s"}).withColumn("_none", F.lit(False))
    for source in ("hot", "web"):
        mine = [r for r in rows if r["source"] == source]
        last = max(r["epoch"] for r in mine)
        order = every.where(F.col("_s") == source).withColumn("e", F.lit(last)).withColumn("at", F.shiftleft(op._block_place(op.SEED, "e"), op._DOCUMENT_BITS) + op._document_place())
        want = [(r["doc_id"], r["at"]) for r in order.orderBy("at").collect()]
        taken = {r["doc_id"]: r["mix_order"] for r in mine if r["epoch"] == last}
        assert all(taken[i] == at for i, at in want if i in taken)
        budget = mine[0]["source_weight"] * sum(n.values()) - last * sum(n[i] for i, _ in want)
        assert [i for i, _ in want[: len(taken)]] == sorted(taken, key=taken.get)
        assert sum(n[i] for i in taken) <= budget < sum(n[i] for i, _ in want[: len(taken) + 1])


def test_odd_rows_and_clashing_columns(docs):
    table = docs.withColumn("epoch", F.lit("theirs"))
    found = op.mix(table)
    assert dict(found.dtypes)["epoch"] == "int"
    rows = found.collect()
    assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.collect()}
    assert sorted(map(repr, rows)) == sorted(map(repr, op.mix(table.repartition(3)).collect()))


def test_empty_tables(no_docs, spark):
    assert op.mix(no_docs).collect() == []
    assert [r["epoch"] for r in op.mix(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")).collect()] == [0, 0]


def test_equal_shares_have_no_lower_entropy(spark):
    table = spark.createDataFrame([(s, 500, 5) for s in "abc"], "source string, tokens long, documents long")
    rows = op.weights(table, None, 0.5, 4.0).collect()
    assert all(math.isclose(r["weight"], 1 / 3) for r in rows) and rows[0]["exponent"] == op.SHARPEST
    assert op.weights(table, 1_500 * 9.0, 0.5, 4.0).first()["exponent"] == 1.0  # nine repetitions at least, whatever the weights


def naive_mix(rows: list, seed_places: dict, entropy_share: float = op.ENTROPY, most: float = op.MAX_EPOCHS) -> Counter:
    """(row number, epoch) of every row taken. ``rows``: source, tokens, hash, block; ``seed_places``: of (source, block, epoch)."""
    tokens_of = defaultdict(int)
    for source, n, _, _ in rows:
        tokens_of[source] += n
    total, live = sum(tokens_of.values()), [s for s, n in tokens_of.items() if n]
    p = {s: tokens_of[s] / total for s in live}
    top = max(p.values())

    def w(a):
        u = {s: (x / top) ** a for s, x in p.items()}
        return {s: x / sum(u.values()) for s, x in u.items()}

    low, high = 0.0, op.SHARPEST
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if entropy(w(middle).values()) >= entropy_share * math.log(len(live)) else (low, middle)
    a = low
    if max(w(a)[s] / p[s] for s in live) > most:
        near, far = 1.0, a
        for _ in range(200):
            middle = (near + far) / 2
            near, far = (middle, far) if max(w(middle)[s] / p[s] for s in live) <= most else (near, middle)
        a = near
    out = Counter()
    for s, n in tokens_of.items():
        mine = [(i, *r) for i, r in enumerate(rows) if r[0] == s]
        target = w(a)[s] * total if n else 0.0
        whole = int(target // n) if n else 1
        left = int(target - whole * n) if n else 0
        for i, *_ in mine:
            out.update((i, e) for e in range(whole))
        order = sorted(mine, key=lambda r: (seed_places[s, r[4], whole], r[4], (r[3] % 2**64) >> (64 - op._DOCUMENT_BITS), r[3]))
        k = 0
        while left > 0 and k < len(order):
            same = [r for r in order[k:] if r[3:] == order[k][3:]]  # repeated rows go together
            left -= sum(r[2] for r in same)
            if left < 0:
                break
            out.update((r[0], whole) for r in same)
            k += len(same)
    return out, a


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01", "sf0.1"])
def test_given_tables_are_really_mixed(spark, folder):
    """The target is met by an exponent that isn't 1, documents repeat and are left out, and the rows are those of a plain mix."""
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")
    mixed = op.mix(docs).select("doc_id", "source", "epoch", "source_weight").collect()
    every = docs.select("doc_id", "source", op.tokens(F.col("text")).alias("n"), F.xxhash64(F.lit(op.SEED), "doc_id", "text").alias("h")).withColumn("b", F.pmod("h", F.lit(op.BLOCKS)).cast("int")).collect()
    weight = {r["source"]: r["source_weight"] for r in mixed}
    total = Counter()
    for r in every:
        total[r["source"]] += r["n"]
    assert math.isclose(entropy(weight.values()), op.ENTROPY * math.log(len(weight)), rel_tol=1e-6)
    assert any(not math.isclose(weight[s], n / sum(total.values()), rel_tol=0.01) for s, n in total.items())
    taken = Counter(r["doc_id"] for r in mixed)
    assert max(taken.values()) > 1 and len(taken) < len(every)
    blocks = spark.createDataFrame([(s, b, e) for s, b in {(r["source"], r["b"]) for r in every} for e in range(5)], "_s string, _b int, e int").withColumn("_none", F.lit(False))
    places = {(r["_s"], r["_b"], r["e"]): r["place"] for r in blocks.select("*", op._block_place(op.SEED, "e").alias("place")).collect()}
    want, a = naive_mix([(r["source"], r["n"], r["h"], r["b"]) for r in every], places)
    assert abs(a - 1) > 0.1
    assert Counter((r["doc_id"], r["epoch"]) for r in mixed) == Counter({(every[i]["doc_id"], e): n for (i, e), n in want.items()})
