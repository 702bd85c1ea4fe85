"""HTML main-text extraction with a suffix array per host.

A page is read into blocks: runs of text between block-level tags, with character references decoded and white
space made one. Markup is evidence: elements and attributes that name a role (navigation, headers, footers, asides, notices,
adverts, forms, scripts, styles, comments; a class or role names it as a whole) set their blocks aside. A part of a class's or
id's word (``user-comments``, ``ad-slot``) is a hint: within an article such an element is set aside too, unless it holds half of
the articles' text, since then it is a frame round it. If the page marks an article (or main part), the blocks outside it are no candidates. An article is taken from within
elements whose class names another role only if the page has no other article text; elements that are dropped by
their name or hidden drop what is in them, and an article inside an article has no privilege.

Then the host decides. The words of many pages of one host are concatenated to one stream, its suffix array (prefix
doubling, to the depth of a run's words) shows which runs occur on ``PAGES`` or more pages of different content, and blocks
that such runs cover by more than ``COVERED`` are boilerplate. The evidence is what pages set aside or leave outside their
articles, and all of pages without an article. So

* on pages without an article (or with one without any text left), candidate blocks go that are covered by runs of ``RUN``
  words; blocks shorter than a run count as covered if the whole block is repeated so;
* on pages with an article, its blocks go that are covered by runs of ``ARTICLE_RUN`` words that the host repeats outside of
  articles: a long notice or menu that some pages have inside. Shorter ones don't tell: titles and sentences of articles stand in
  footers and teasers too. What only articles share stays: passages and copies of an article are no boilerplate.

A host's different contents are dealt to sets of about ``GROUP`` by a hash of the content, so a host with a third
of all pages is many sets. A set only proposes: its suffix array gives each of its runs and the number of its
contents with it. These numbers are summed over all sets of the host, and every set's blocks are judged by the sums,
so a page's text depends neither on how pages are dealt nor on how the table is partitioned.

Edge cases: null and empty html gives an empty text; null urls are one host; equal pages (by content) count once
in the evidence; unclosed and stray tags are read as browsers do where it matters here (a block tag ends the
paragraph; raw-text elements run to their end tag, or to the end; a quote that nothing closes is a character); pages are read
forwards only, in time that grows with their length; repeated page_ids are returned one by one;
extra columns are not read.
"""

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import suffix_array
from .storage import cut

RUN = 8
ARTICLE_RUN = 32
PAGES = 3
COVERED = 0.7
GROUP = 1000
#: Hints within one another that are told apart.
HINTS = 8

# Element names by role.
RAW = {"script", "style", "template", "textarea", "iframe", "svg", "select", "button", "canvas", "title", "head", "xmp", "noframes"}
DROPPED = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset", "label", "input", "option", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
ARTICLE = {"article", "main"}
# Words of class, id and role attributes that name what is not main text.
ROLES = {"ad", "ads", "advert", "adverts", "advertisement", "adsbygoogle", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "dialog", "disqus", "footer", "form", "gdpr", "header", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pagination", "pager", "popup", "promo", "related", "reply", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "topbar", "widget"}

# Those that name it as a part of a word, too, as in ``user-comments``; headers aren't among them, since titles stand there.
PARTS = {"ad", "ads", "advert", "adverts", "advertisement", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies", "disqus", "footer", "menu", "navbar", "navigation", "newsletter", "pagination", "promo", "related", "replies", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe"}

_NAME, _BLANK = re.compile(r"[a-zA-Z][^\s/>]*"), re.compile(r"[\s/]*")
_KEY, _VALUE = re.compile(r"=?[^\s/>=]*"), re.compile(r"[^\s>]*")
_EQUALS = re.compile(r"\s*=\s*")
_READ = {"class", "id", "role", "aria-hidden", "hidden", "style"}
_SPACE = re.compile(r"[ \t\n\r\f\v  -     　]+")


class Tags:
    """The tags of a page, read forwards only: what was looked for to the page's end in vain isn't looked for again."""

    def __init__(self, page: str):
        self.page, self.missing = page, set()

    def _find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def next(self, at: int) -> tuple[int, int, str, bool, dict[str, str]] | None:
        """The first tag, comment or declaration from ``at`` on: where it begins and ends, name ("" if it has none), whether it closes, attributes."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            second = page[start + 1 : start + 2]
            if second in ("!", "?") and second:
                what = "-->" if page.startswith("<!--", start) else ">"
                end = self._find(what, start + (4 if what == "-->" else 2))
                return start, len(page) if end < 0 else end + len(what), "", False, {}
            name = _NAME.match(page, start + 1 + (second == "/"))
            if name is None:
                at = start + 1
                continue
            end, attributes = self._attributes(name.end())
            return start, end, name[0].lower(), second == "/", attributes
        return None

    def _attributes(self, at: int) -> tuple[int, dict[str, str]]:
        """Where the tag ends, and the attributes that matter. A quote that nothing closes is a character like others."""
        page, out = self.page, {}
        while True:
            at = _BLANK.match(page, at).end()
            if at >= len(page):
                return at, out
            if page[at] == ">":
                return at + 1, out
            key = _KEY.match(page, at)
            at, name, value = key.end(), key[0].lower(), ""
            if equals := _EQUALS.match(page, at):
                at = equals.end()
                quote = page[at : at + 1]
                end = self._find(quote, at + 1) if quote in ('"', "'") and quote else -1
                if end >= 0:
                    value, at = page[at + 1 : end], end + 1
                else:
                    bare = _VALUE.match(page, at)
                    value, at = bare[0].strip("\"'"), bare.end()
            if name in _READ:
                out.setdefault(name, value)


def _set_aside(name: str, attributes: dict[str, str]) -> tuple[int, bool]:
    """0: not at all, 1: by a role in its attributes, 2: by its name or because it is hidden. And whether a part of an attribute's word hints at it."""
    if name in DROPPED:
        return 2, False
    if not attributes or name in ("html", "body"):
        return 0, False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").lower().replace(" ", ""):
        return 2, False
    words = {w for k in ("class", "id", "role") for w in attributes.get(k, "").lower().split()}
    return int(not ROLES.isdisjoint(words)), any(not PARTS.isdisjoint(re.split(r"[-_]+", w)) for w in words)


def _settled(found: list[tuple[str, bool, int, int]]) -> list[tuple[str, bool, bool]]:
    """Blocks with one mark each: by all that is round them, or by what is in their article if nothing is left so."""
    if any(inside and not around for _, inside, around, _ in found):
        return [(t, inside, around > 0) for t, inside, around, _ in found]
    if any(inside and not within for _, inside, _, within in found):
        return [(t, inside, (within if inside else around) > 0) for t, inside, around, within in found]
    # no article, or none with text: what isn't dropped there is for the host to judge
    return [(t, False, within > 1 if inside else around > 0) for t, inside, around, within in found]


def _hinted(found: list[tuple[str, bool, int, int]], hints: list[frozenset[int]]) -> list[tuple[str, bool, int, int]]:
    """Blocks of articles within elements that a part of a word hints at are set aside, unless such an element holds half of the articles' text: then it is a frame of it."""
    total, of = 0, {}
    for (text, inside, around, within), own in zip(found, hints, strict=True):
        if inside and not within:
            total += len(text)
            for h in own:
                of[h] = of.get(h, 0) + len(text)
    gone = {h for h, n in of.items() if 2 * n < total}
    if not gone:
        return found
    return [(t, inside, max(around, 1), max(within, 1)) if inside and not own.isdisjoint(gone) else (t, inside, around, within) for (t, inside, around, within), own in zip(found, hints, strict=True)]


def blocks(page: str | None) -> list[tuple[str, bool, bool]]:
    """The page's blocks of text in order: text, whether in an article, whether set aside by its markup."""
    page = page or ""
    tags = Tags(page)
    out: list[tuple[str, bool, int, int]] = []
    hints: list[frozenset[int]] = []
    parts: list[str] = []
    none: frozenset[int] = frozenset()
    # element, article within, set aside within by all around and since the article's start, hints around
    stack: list[tuple[str, bool, int, int, frozenset[int]]] = []
    inside, around, within, hinted = False, 0, 0, none
    open_ = Counter()  # of the stack's elements: an end tag that closes none isn't looked for in it
    n_hints = 0

    def end_block() -> None:
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip(" ")
            parts.clear()
            if text:
                out.append((text, inside, around, within))
                hints.append(hinted)

    at = 0
    while True:
        tag = tags.next(at)
        if tag is None:
            parts.append(page[at:])
            end_block()
            return _settled(_hinted(out, hints))
        start, end, name, closes, attributes = tag
        if start > at:
            parts.append(page[at:start])
        at = end
        if not name:
            continue
        if closes:
            if name in BLOCK:
                end_block()
            if not open_[name]:
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    open_.subtract(s[0] for s in stack[i:])
                    del stack[i:]
                    inside, around, within, hinted = stack[-1][1:] if stack else (False, 0, 0, none)
                    break
                if name not in BLOCK and stack[i][0] in BLOCK:
                    break  # an inline end tag doesn't close blocks
            continue
        if name in RAW and name != "head":
            found = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at)
            if name in ("title", "select", "button", "svg", "textarea", "iframe", "template", "canvas", "script", "style", "xmp", "noframes"):
                at = found.end() if found else len(page)
            continue
        if name in BLOCK:
            end_block()
            # an open paragraph or item ends where a block begins
            if stack and stack[-1][0] == "p" or (stack and name in ("li", "dd", "dt", "td", "th", "tr") and stack[-1][0] == name):
                open_[stack.pop()[0]] -= 1
                inside, around, within, hinted = stack[-1][1:] if stack else (False, 0, 0, none)
        elif name == "br":
            parts.append(" ")
        if name in VOID:
            continue
        own, hint = _set_aside(name, attributes)
        outermost = name in ARTICLE and not inside
        if outermost:
            inside, within = True, 2 if within > 1 else 0
        # a role of the outermost article itself counts only where the page has another article
        around, within = max(around, own), max(within, own if not outermost or own > 1 else 0)
        if hint and inside and not outermost:
            n_hints += 1
            hinted = hinted | {n_hints} if len(hinted) < HINTS else hinted
        stack.append((name, inside, around, within, hinted))
        open_[name] += 1


def article_text(found: list[tuple[str, bool, bool]]) -> str | None:
    """The text of a page that marks its article, before its host is asked; None if it doesn't."""
    return "\n\n".join(t for t, inside, aside in found if inside and not aside) if any(inside for _, inside, _ in found) else None


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The article's blocks (null: no article), and the others: candidates of a page without an article, else evidence."""
    for batch in batches:
        articles, others = [], []
        for page in batch["html"].to_pylist():
            found = blocks(page)
            marked = any(inside for _, inside, _ in found)
            articles.append([t for t, inside, aside in found if inside and not aside] if marked else None)
            others.append([t for t, inside, aside in found if (not inside or aside if marked else not aside)])
        yield pa.record_batch({"page_id": batch["page_id"], "url": batch["url"], "article": pa.array(articles, pa.list_(pa.string())), "blocks": pa.array(others, pa.list_(pa.string()))})


class Runs:
    """The runs of different pages of one host, found by a suffix array: ``run`` words, or (``short``) a whole block that has fewer."""

    def __init__(self, pages: list[list[str]], run: int = RUN, short: bool = True):
        self.run, self.sizes = run, [len(p) for p in pages]
        numbers: dict[str, int] = {}
        words = [t.split() for p in pages for t in p]
        n = np.fromiter(map(len, words), np.int64, len(words)) + 1  # a 0 ends each block
        self.words = n - 1
        ends = np.cumsum(n) - 1
        seq = np.zeros(n.sum(), np.int64)
        inner = np.ones(len(seq), bool)
        inner[ends] = False
        seq[inner] = np.fromiter((numbers.setdefault(w, len(numbers) + 1) for ws in words for w in ws), np.int64, inner.sum())
        self.block = np.repeat(np.arange(len(words)), n)
        self.keys, self.spread, self.at, self.group = (np.zeros(0, np.int64) for _ in range(4))
        if not numbers:
            return
        page = np.repeat(np.arange(len(pages)), self.sizes)[self.block]
        self.left = ends[self.block] - np.arange(len(seq))  # words to the block's end
        starts = np.concatenate(([True], seq[:-1] == 0))
        order = suffix_array(seq, run)
        padded = np.concatenate([seq, np.zeros(run, seq.dtype)])
        same = np.ones(len(order) - 1, bool)
        done = np.zeros(len(order) - 1, bool)
        for k in range(run):
            a, b = padded[order[:-1] + k], padded[order[1:] + k]
            same &= done | (a == b)
            done |= same & (a == 0)
        group = np.concatenate(([0], np.cumsum(~same)))
        whole = (self.left >= run) | ((self.left > 0) & starts & short)
        self.at, group = order[whole[order]], group[whole[order]]
        if not len(self.at):
            return
        _, first, self.group = np.unique(group, return_index=True, return_inverse=True)
        # distinct pages of each group of equal runs
        pairs = np.unique(self.group * len(pages) + page[self.at])
        self.spread = np.bincount(pairs // len(pages), minlength=len(first))
        # the same key for a run in every set
        hashes = np.concatenate((np.zeros(1, np.uint64), pd.util.hash_array(np.array(list(numbers), object), categorize=False)))
        key, at = np.zeros(len(first), np.uint64), self.at[first]
        for k in range(run):
            here = np.where(k < self.left[at], hashes[padded[at + k]], np.uint64(0))
            key = (key ^ here) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        self.keys = key.view(np.int64)

    def covered(self, common: np.ndarray, share: float = COVERED) -> list[list[bool]]:
        """Which blocks of each page the common runs (a flag for each of ``keys``) cover by more than ``share``."""
        drop = np.zeros(len(self.words), bool)
        if len(self.at):
            hit = self.at[common[self.group]]
            mark = np.zeros(len(self.block) + 1, np.int32)
            np.add.at(mark, hit, 1)
            np.add.at(mark, hit + np.minimum(self.run, self.left[hit]), -1)
            inside = np.bincount(self.block, np.cumsum(mark)[:-1] > 0, len(self.words))
            drop = inside > share * self.words
        ends = np.cumsum(self.sizes)
        return [drop[e - n : e].tolist() for e, n in zip(ends.tolist(), self.sizes, strict=True)]


def boilerplate(pages: list[list[str]], run: int = RUN, pages_least: int = PAGES, covered: float = COVERED) -> list[list[bool]]:
    """For all pages of one host: which of their blocks are covered by runs that other pages share."""
    content: dict[tuple[str, ...], int] = {}
    kind = [content.setdefault(tuple(p), len(content)) for p in pages]
    runs = Runs([list(p) for p in content], run)
    decided = runs.covered(runs.spread >= pages_least, covered)
    return [decided[k] for k in kind]


def _proposed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Runs of a set, and the number of its contents with each; those of ``RUN`` words only where the host has pages without an article."""
    host, part, groups, asked = key
    pages = [list(b) for b in rows["blocks"]]
    found = []
    for long in (True, False) if asked else (True,):
        runs = Runs(pages, ARTICLE_RUN, short=False) if long else Runs(pages)
        found.append(pd.DataFrame({"host": host, "part": part, "long": long, "run": runs.keys, "n": runs.spread}))
    out = pd.concat(found)
    # the only set of a host has the host's sums
    return out[out["n"] >= PAGES] if groups == 1 else out


def _judged(rows: pd.DataFrame, common: pd.DataFrame) -> pd.DataFrame:
    """Texts of contents without an article: what the host doesn't repeat."""
    pages = [list(b) for b in rows["blocks"]]
    runs = Runs(pages)
    drop = runs.covered(np.isin(runs.keys, common["run"].to_numpy(np.int64)))
    return pd.DataFrame({"host": rows["host"], "content": rows["content"], "text": _joined(pages, drop)})


def _cleaned(rows: pd.DataFrame, common: pd.DataFrame) -> pd.DataFrame:
    """Texts of articles, without blocks that the host repeats outside of articles."""
    pages = [list(b) for b in rows["article"]]
    runs = Runs(pages, ARTICLE_RUN, short=False)
    drop = runs.covered(np.isin(runs.keys, common["run"].to_numpy(np.int64)))
    plain = {c: pd.Series([None if pd.isna(x) else x for x in rows[c]], dtype=object) for c in ("page_id", "url")}
    return pd.DataFrame({**plain, "text": _joined(pages, drop)})


def _joined(pages: list[list[str]], drop: list[list[bool]]) -> pd.Series:
    return pd.Series(["\n\n".join(t for t, d in zip(p, ds, strict=True) if not d) for p, ds in zip(pages, drop, strict=True)], dtype=object)


def extract(pages: DataFrame, group: int = GROUP) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    schema = "page_id long, url string, article array<string>, blocks array<string>"
    # a shuffled page has its host and the hash of its content; no block holds a line's end
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1), F.lit("")))
    content = F.md5(F.concat_ws("\n", F.coalesce("article", F.array()), F.lit(""), "blocks").cast("binary"))
    named = cut(pages.select("page_id", "url", "html").mapInArrow(_parsed, schema).withColumns({"host": host, "content": content}))
    # the evidence: different contents of each host, without their articles
    contents = named.where(F.size("blocks") > 0).groupBy("host", "content").agg(F.first("blocks").alias("blocks"), F.first(F.col("article").isNull()).alias("open"))
    contents = cut(contents)
    sizes = cut(contents.groupBy("host").agg(F.ceil(F.count("*") / group).cast("long").alias("groups"), F.bool_or("open").alias("asked")))
    dealt = contents.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("content"), F.col("groups"))).repartition("host", "part")
    proposed = dealt.groupBy("host", "part", "groups", "asked").applyInPandas(_proposed, "host string, part long, long boolean, run long, n long")
    sums = cut(proposed.groupBy("host", "long", "run").agg(F.sum("n").alias("n"), F.collect_list("part").alias("parts")).where(F.col("n") >= PAGES))
    # pages without an article
    common = sums.where("not long").select("host", F.explode("parts").alias("part"), "run")
    judged = dealt.where("open").groupBy("host", "part").cogroup(common.groupBy("host", "part")).applyInPandas(_judged, "host string, content string, text string")
    open_ = named.where("article is null")
    found = open_.join(judged, ["host", "content"], "left").select("page_id", "url", F.coalesce("text", F.lit("")).alias("text"))
    # articles of hosts that repeat such long runs outside of them; sets hold a part of a host's pages, whatever these are
    articles = named.where("article is not null").select("page_id", "url", "host", "content", "article")
    evidence = sums.where("long").select("host", "run")
    hosts = cut(articles.join(evidence.select("host").distinct(), "host", "left_semi").groupBy("host").agg(F.ceil(F.count("*") / group).cast("long").alias("groups")))
    sets = articles.join(hosts, "host").withColumn("part", F.pmod(F.xxhash64("content", "page_id"), F.col("groups")))
    evidence = evidence.join(hosts, "host").select("host", "run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("part"))
    cleaned = sets.groupBy("host", "part").cogroup(evidence.groupBy("host", "part")).applyInPandas(_cleaned, "page_id long, url string, text string")
    plain = articles.join(hosts, "host", "left_anti").select("page_id", "url", F.array_join("article", "\n\n").alias("text"))
    return found.unionByName(cleaned).unionByName(plain).withColumn("n_chars", F.length("text").cast("long"))
