"""Decontamination against a brute-force search of all windows."""

import re
import tracemalloc
from collections import Counter

import pytest

from dispatchlake.llm import decontaminate as op
from dispatchlake.llm.tokens import ALNUM, Words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def brute(docs: list[tuple], items: list[tuple], window: int) -> list[tuple]:
    windows: dict[tuple, set] = {}
    for item, text in items:
        ws = words(text)
        n = min(window, len(ws))
        for k in range(len(ws) - n + 1 if n else 0):
            windows.setdefault(tuple(ws[k : k + n]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for i, text, *_ in docs:
        ws, hit, found = words(text), set(), set()
        for n in sizes:
            for k in range(len(ws) - n + 1):
                if (at := windows.get(tuple(ws[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= at
        out.append((i, len(ws), len(hit), tuple(sorted(x for x in found if x is not None)), bool(hit) and 20 * len(hit) >= len(ws)))
    return out


@pytest.fixture(scope="module")
def items(spark, docs):
    texts = [r["text"] for r in docs.where("doc_id is not null").orderBy("doc_id").collect()]
    rows = [(1, texts[30][:200]), (2, texts[50].upper()), (3, "W5"), (4, None), (5, ""), (6, "...!"), (7, "one"), (8, texts[50]), (8, texts[31]), (None, texts[32]), (9, "日本語 w1"), (10, "a a a a a a a a a a a a a a")]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("window", [13, 4, 1])
def test_same_as_brute_force(docs, items, window):
    got = [(r["doc_id"], r["n_words"], r["n_hit"], tuple(sorted(set(r["items"]))), r["contaminated"]) for r in op.contamination(docs, items, window).collect()]
    assert Counter(got) == Counter(brute([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()], window))


@pytest.mark.parametrize("block_words", [op.BLOCK_WORDS, 100])
def test_matches_are_the_longest_and_where_they_stand(docs, items, block_words):
    window = 13
    split = [(r["item_id"], words(r["text"])) for r in items.collect()]

    def brute_matches(ws: list[str]) -> Counter:
        out: Counter = Counter()
        for item, other in split:
            least = min(window, len(other))
            for i in range(len(ws) * bool(other)):
                for j in range(len(other)):
                    if ws[i] != other[j] or i and j and ws[i - 1] == other[j - 1]:
                        continue
                    n = 0
                    while i + n < len(ws) and j + n < len(other) and ws[i + n] == other[j + n]:
                        n += 1
                    if n >= least:
                        out[item, i, j, n] += 1
        return out

    short = docs.where("text is null or length(text) < 3000")
    texts = [words(r["text"]) for r in short.collect()]
    want = Counter(tuple(sorted(brute_matches(ws).items(), key=repr)) for ws in texts)
    rows = op.contamination(short, items, block_words=block_words).collect()
    assert Counter(tuple(sorted(Counter(map(tuple, r["matches"])).items(), key=repr)) for r in rows) == want
    assert all(r["longest_match"] == max((m["n"] for m in r["matches"]), default=0) for r in rows)
    assert max(r["longest_match"] for r in rows) > 3 * window


def test_blocks_of_items_give_the_same(docs, items):
    one = [(r["doc_id"], r["n_hit"], tuple(sorted(set(r["items"])))) for r in op.contamination(docs, items).collect()]
    many = [(r["doc_id"], r["n_hit"], tuple(sorted(set(r["items"])))) for r in op.contamination(docs, items, block_words=100).collect()]
    assert Counter(one) == Counter(many)


def test_blocks_of_items_are_searched_one_after_another(docs, items):
    found = op.contamination(docs, items, block_words=100)
    # the result is read from the shared folder: no block's items are in its plan
    assert "MapInArrow" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("block_words", [op.BLOCK_WORDS, 100])
def test_contaminated_rows_go_and_the_others_stay_whole(docs, items, block_words):
    bad = Counter(r["doc_id"] for r in op.contamination(docs, items).where("contaminated").collect())
    kept = op.decontaminate(docs, items, block_words=block_words)
    assert kept.columns == docs.columns
    everything = Counter(docs.collect())
    assert Counter(kept.collect()) == Counter({r: n for r, n in everything.items() if r["doc_id"] not in bad})


def test_empty_tables(docs, no_docs, items):
    assert op.contamination(no_docs, items).collect() == []
    assert {r["n_hit"] for r in op.contamination(docs, items.limit(0)).collect()} == {0}


def test_hashes_are_made_in_little_memory():
    """Of some MB of words, and of one word longer than what is hashed at a time, as of each word alone."""
    text = b"w" * 600_000 + b" " + b" ".join(b"w%d" % (i % 5000) for i in range(1_000_000))
    found = Words([text], ALNUM)
    tracemalloc.start()
    hashes = found.hashes()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(hashes) + (40 << 20)
    for i in (0, 1, 2, 5000, 77_777, 1_000_000):
        assert hashes[i] == Words([text[found.starts[i] : found.ends[i]]], ALNUM).hashes()[0]
