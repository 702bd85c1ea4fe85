"""Main text of pages: reading markup, and what the host's suffix array takes away and keeps."""

import random
import time

import pytest

from dispatchlake.llm import html_text as op

SCHEMA = "page_id long, url string, html string, text string, blocks int"


def text_of(page: str | None) -> str:
    return op.article_text(op.blocks(page)) or ""


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<html><body><nav>Home</nav><article><h1>T &amp; U</h1><p>one\n two<br>three<p>four</article><footer>f</footer>", "T & U\n\none two three\n\nfour"),
        ("<article><p>a <script>var x = '<p>';</script>b<style>p{}</style></p><aside>no</aside><div class='comments'><p>no</p></div><p>c&#233;&nbsp;d</p></article>", "a b\n\ncé d"),
        ("<article><p>x<!-- <p>hidden</p> -->y</p><form>f</form><p style='display: none'>z</p></article>", "xy"),
        ("<main><ul><li>a<li>b</ul><table><tr><td>1<td>2</table></main>", "a\n\nb\n\n1\n\n2"),
        ("<ARTICLE><P>A&lt;b&gt;</P></ARTICLE>", "A<b>"),
        ("<article><p>1 < 2 and a<b</p></article>", None),
        ("<article><p>" + "w " * 50_000 + "</p></article>", ("w " * 50_000).strip()),
    ],
)
def test_pages_that_mark_their_article(page, want):
    got = text_of(page)
    assert want is None or got == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        *[(f"<div {a}><article><p>kept</p><div class='ad'>no</div></article></div>", "kept") for a in ("class='layout has-sidebar'", "class='header-fixed'", "class='with-comments'", "id='widget-area'", "class='page sidebar'", "role=menu")],
        ("<article><p>main text</p></article><div class='related'><article><p>teaser</p></article></div>", "main text"),
        ("<article><p>own</p><div class='comments'><article><p>no</p></article></div></article>", "own"),
        ("<div class='sidebar'><article><p>own</p><div class='comments'><article><p>no</p></article></div></article></div>", "own"),
        ("<article><p>a <math><mi>x</mi></math> b</p><noscript><p>n</p></noscript><object>o</object></article>", "a x b\n\nn\n\no"),
        ("<aside><article><p>x</p></article></aside><main><p>y</p></main>", "y"),
        ("<article><p>own</p><article class='comment'><p>no</p></article></article>", "own"),
        ("<article><p>own</p></article><article class='comment'><p>no</p></article>", "own"),
        ("<article class='post sidebar'><p>own</p></article>", "own"),
    ],
)
def test_what_stands_round_an_article_does_not_empty_it(page, want):
    assert text_of(page) == want


LONG = "the article itself is longer than all of that together " * 3


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<article><p>{LONG}</p><div class='{c}'><p>no</p></div></article>", LONG.strip())
        for c in ("ad-slot", "site-footer", "user-comments", "x post_comments", "sponsored-box")
    ]
    + [
        (f"<article><p>{LONG}</p><section id='comments-list'><ol><li>no<li>no</ol></section><p>end</p></article>", f"{LONG.strip()}\n\nend"),
        (f"<article><div class='with-sidebar'><p>{LONG}</p><div class='sidebar-left'>no</div></div></article>", LONG.strip()),
        (f"<article><div class='entry-header'><h1>Title</h1></div><p>{LONG}</p></article>", f"Title\n\n{LONG.strip()}"),
        (f"<article><p>{LONG}</p><p class='adverse roadside'>stays</p></article>", f"{LONG.strip()}\n\nstays"),
        ('<article><p>a <a href="x"">b</a> c</p><p title=it\'s>d</p></article>', "a b c\n\nd"),
        ('<article><p class="open>e</p><p>f</p></article>', "e\n\nf"),
        ("<article><p title='a > b'>g</p><p data-x=1/>h<p / >i</article>", "g\n\nh\n\ni"),
        ("<article><p>j<!-- open <p>k</p></article>", "j"),
        ("<article><p>l<!doctype x>m<?php y ?>n</p></article>", "lmn"),
        ("<article><p>o</p><p clas", "o"),
        ("<article><p>1 < 2 <3 </ p><p>q</p></article>", "1 < 2 <3 </ p>\n\nq"),
        ("<article><p HIDDEN>no</p><p aria-hidden = 'TRUE'>no</p><p>r</p></article>", "r"),
    ],
)
def test_no_markup_leaks_and_hints_are_followed(page, want):
    assert text_of(page) == want


@pytest.mark.parametrize("unit", ['<a "', "<a x='", '<p class="', "<!--", "<!", "<p>", "<div><p>", "<b><i>", "</b>", "<a =", "&", "<", '<div class="ad-x">', "<li><b>", "<article>"])
def test_malformed_pages_are_read_in_time_with_their_length(unit):
    page = "<article><p>begin</p>" + unit * (1_000_000 // len(unit))
    begin = time.perf_counter()
    assert text_of(page).startswith("begin") or text_of(page) == ""
    assert time.perf_counter() - begin < 20


def test_a_million_stray_quotes_take_no_second():
    page = '<article><p>begin</p>' + '<a "' * 250_000
    begin = time.perf_counter()
    assert text_of(page) == "begin"
    assert time.perf_counter() - begin < 3


def test_pages_whose_article_is_empty_go_to_the_host(spark):
    pages = [(k, "https://e.org/", f"<main><nav>menu</nav></main><div>body of page number {k}</div>") for k in range(4)] + [(9, "https://e.org/", "<article><div class='notice'>all of it</div></article>")]
    got = {r["page_id"]: r["text"] for r in op.extract(spark.createDataFrame([(*p, None, None) for p in pages], SCHEMA)).collect()}
    assert got == {**{k: f"body of page number {k}" for k in range(4)}, 9: "all of it"}


def site(rng: random.Random, n: int) -> list[tuple]:
    words = [f"v{i}" for i in range(500)]
    say = lambda k: " ".join(rng.choices(words, k=k))
    top, bottom = say(12), say(20)
    rows = []
    for i in range(n):
        own = [say(30), say(15)]
        page = f"<html><body><div>{top}</div><p>{own[0]}</p><div>Home</div><p>{own[1]}</p><div>{bottom}</div></body></html>"
        rows.append((i, "https://Example.org/p", page, "\n\n".join(own)))
    return rows


def test_unmarked_pages_lose_what_their_host_repeats(spark):
    rows = site(random.Random(3), 30)
    table = spark.createDataFrame([(i, u, h, "theirs", 1) for i, u, h, _ in rows], SCHEMA)
    for group in (op.GROUP, 10):
        got = {r["page_id"]: (r["text"], r["n_chars"]) for r in op.extract(table, group).collect()}
        assert got == {i: (t, len(t)) for i, _, _, t in rows}


def test_a_menu_on_part_of_a_host_goes_however_its_pages_are_dealt(spark):
    rng = random.Random(5)
    say = lambda k: " ".join(rng.choices([f"v{i}" for i in range(500)], k=k))
    menu, short, rows, want = say(12), "Sign in here", [], {}
    for i in range(60):
        own = say(30)
        top = f"<div>{menu}</div><div>{short}</div>" if i % 20 == 0 else ""
        want[i] = own
        rows.append((i, "https://example.org/p", f"<html><body>{top}<p>{own}</p></body></html>", None, None))
    for group, parts in ((op.GROUP, 1), (5, 4), (1, 7)):
        table = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        assert {r["page_id"]: r["text"] for r in op.extract(table, group).collect()} == want, group


def test_copies_keep_their_text_and_other_hosts_do_not_count(spark):
    rows = site(random.Random(4), 2)
    pages = [(k, f"https://h{k % 2}.org/", rows[k % 2][2]) for k in range(12)] + [(50, None, "<p>alone</p>"), (51, "no url", None), (52, "", "")]
    got = {r["page_id"]: r["text"] for r in op.extract(spark.createDataFrame([(*p, None, None) for p in pages], SCHEMA)).collect()}
    assert got == {k: "\n\n".join(t for t, _, _ in op.blocks(h)) for k, _, h in pages}


def test_articles_keep_what_the_host_repeats(spark):
    passage = " ".join(f"q{i}" for i in range(60))
    pages = [(k, "https://a.org/", f"<div>menu of the site is always this long text here</div><article><p>{passage}</p><p>own {k}</p></article>") for k in range(6)]
    got = {r["page_id"]: r["text"] for r in op.extract(spark.createDataFrame([(*p, None, None) for p in pages], SCHEMA)).collect()}
    assert got == {k: f"{passage}\n\nown {k}" for k in range(6)}


def test_articles_lose_what_the_host_repeats_outside_of_them(spark):
    """A footer that most pages of the host set aside, and some have inside their article."""
    rng = random.Random(8)
    say = lambda k: " ".join(rng.choices([f"v{i}" for i in range(500)], k=k))
    footer, passage, line = say(40), say(45), say(12)
    rows, want = [], {}
    for i in range(24):
        own = say(25)
        inside = i % 6 == 5
        article = f"<h1>{line}</h1><p>{own}</p><p>{passage}</p>" + (f"<p>{footer}</p>" if inside else "")
        rows.append((i, "https://e.org/x", f"<article>{article}</article>" + ("" if inside else f"<div>{line}</div><footer>{footer}</footer><nav><li>Sign</li></nav>"), None, None))
        want[i] = f"{line}\n\n{own}\n\n{passage}"  # a short line may be a title that stands in teasers too
    # a block that is one short word is no boilerplate of an article, whatever the menus have
    rows.append((90, "https://e.org/y", "<article><p>Sign</p></article>", None, None))
    want[90] = "Sign"
    # two pages are too few, and other hosts don't count
    rows += [(100 + k, "https://two.org/", f"<article><p>{say(9)} {k}</p><p>{footer}</p></article><footer>{footer}</footer>", None, None) for k in range(2)]
    want |= {r[0]: r[2].split("<p>")[1].removesuffix("</p>") + "\n\n" + footer for r in rows[-2:]}
    for group, parts in ((op.GROUP, 1), (5, 4)):
        got = {r["page_id"]: r["text"] for r in op.extract(spark.createDataFrame(rows, SCHEMA).repartition(parts), group).collect()}
        assert got == want


def brute_covered(pages: list[list[str]], run: int, least: int) -> list[list[bool]]:
    distinct = sorted(set(map(tuple, pages)))
    seen: dict[tuple, set] = {}
    for k, page in enumerate(distinct):
        for b in page:
            ws = b.split()
            for i in range(max(1, len(ws) - run + 1)):
                seen.setdefault((tuple(ws[i : i + run]), len(ws) < run), set()).add(k)
    if len(distinct) < least:
        return [[False] * len(p) for p in pages]
    out = []
    for page in pages:
        row = []
        for b in page:
            ws = b.split()
            hit = set()
            for i in range(max(1, len(ws) - run + 1)):
                if len(seen[tuple(ws[i : i + run]), len(ws) < run]) >= least:
                    hit.update(range(i, min(len(ws), i + run)))
            row.append(len(hit) > op.COVERED * len(ws))
        out.append(row)
    return out


def test_suffix_array_against_brute_force():
    rng = random.Random(9)
    for _ in range(20):
        pool = [" ".join(rng.choices("abcdefghij", k=rng.randint(8, 25))) for _ in range(6)]
        pages = [[rng.choice(pool) if rng.random() < 0.5 else " ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(8, 20))) for _ in range(4)] for _ in range(8)]
        assert op.boilerplate(pages, 8, 3) == brute_covered(pages, 8, 3)


def test_empty_table(spark):
    assert op.extract(spark.createDataFrame([], SCHEMA)).collect() == []
