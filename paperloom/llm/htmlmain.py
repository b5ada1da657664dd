"""Main text of web pages: the maximum-scoring run of words and tags.

A page is read as a sequence of words and tags. Words score positive and tags negative; how much, by the
element that holds a word and by the tag's name, is learned from labelled pages: those whose markup names
its one article. One linear scan finds the contiguous run with the greatest sum. The run is widened to
whole blocks, and to the page's article element if most of its words stand there. Parts that hold no article weigh nothing and are left out: by the names in their class, id and
role, whose log odds of holding article words are learned from the same pages, over prior counts for the names
that mark such parts on most sites; and elements that by their meaning hold no article text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch

#: About so many pages are read to learn the weights.
FIT_PAGES = 4000
#: Scores of a word and of a tag are kept within these.
WORD_SCORES, TAG_SCORES = (0.2, 3.0), (0.1, 1.5)
#: Words inside and outside the article that a name counts with beforehand, one of HINTS and any other, and the log
#: odds under which a part of that name is left out.
PRIOR_HINT, PRIOR_NAME = (1, 50), (20, 20)
APART_ODDS = -2.0

#: Elements that start and end a block, that hold no article text, and those without an end tag.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
APART = frozenset("aside button datalist dialog fieldset footer form head iframe input menu nav noscript object option script select style svg template textarea title video audio canvas".split())
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role that mark a part which is no article, and those that turn a name into a
#: setting of the page ("has-sidebar", "no-comments").
HINTS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer form login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion related respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
SETTINGS = frozenset("has have is no not off on open closed show shown hide hidden with without enabled disabled active".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|svg|title)\b.*?(?:</(?P=raw)\s*>|\Z)"""
    r"""|<(?P<end>/?)(?P<name>[a-z][^\s>/]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)|<[a-z][^>]*+(?:>|\Z)""",
    re.S | re.I,
)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PART = re.compile(r"[a-z]+")


def names(attrs: str) -> set[str]:
    """The names that class, id and role give an element: each whole name, and its parts if none makes it a setting."""
    found: set[str] = set()
    for _, value in _ATTR.findall(attrs):
        for name in value.strip("\"'").lower().split():
            found.add(name)
            parts = _PART.findall(name)
            if not SETTINGS.intersection(parts):
                found.update(parts)
    return found


def _known(name: str) -> str:
    return name if name in BLOCKS or name in APART or name in INLINE or name in VOID else "other"


class Element(NamedTuple):
    """parent and block: places among the elements, of the element around and of the nearest block, itself included."""

    name: str
    attrs: str
    parent: int
    block: int
    article: bool


class Page:
    """Elements and events (kind tag, end or text; name; element; text) of a page in order, in one pass.

    A stack holds the open elements. Ends are found by name, so that tags that are never closed cost nothing."""

    def __init__(self, page: str):
        self.elements = [Element("", "", 0, 0, False)]
        self.events: list[tuple[str, str, int, str]] = []
        self.articles: list[tuple[str, int, int, int]] = []  # name, element, start and end of article and main elements
        self._stack, self._open, self._starts = [0], Counter(), {}
        at = 0
        for m in _TOKEN.finditer(page):
            if m.start() > at:
                self.events.append(("text", "", self._stack[-1], page[at : m.start()]))
            at = m.end()
            if m["name"] is None:
                continue
            name = m["name"].lower()
            if m["end"]:
                self._end(name, m.start())
            else:
                self._start(name, m["attrs"], m.start())
        if at < len(page) and not page[at:].startswith("<"):
            self.events.append(("text", "", self._stack[-1], page[at:]))
        while len(self._stack) > 1:
            self._drop(len(page))

    def _drop(self, end: int) -> int:
        e = self._stack.pop()
        name = self.elements[e].name
        self._open[name] -= 1
        if name in ("article", "main"):
            self.articles.append((name, e, self._starts[e], end))
        return e

    def _end(self, name: str, at: int) -> None:
        ended = self._stack[-1]
        if self._open[name]:
            while True:
                ended = self._drop(at)
                if self.elements[ended].name == name:
                    break
        self.events.append(("end", name, ended, ""))

    def _start(self, name: str, attrs: str, at: int) -> None:
        if name in BLOCKS:  # a block ends an open paragraph, an item the item before it
            for closed in ("p",) if name != "li" else ("p", "li"):
                block = self.elements[self._stack[-1]].block
                if self.elements[block].name == closed:
                    while self._drop(at) != block:
                        pass
        parent = self._stack[-1]
        e = len(self.elements)
        around = self.elements[parent]
        self.elements.append(Element(name, attrs, parent, e if name in BLOCKS else around.block, around.article or name in ("article", "main")))
        self.events.append(("tag", name, e, ""))
        if name not in VOID and not attrs.endswith("/"):
            self._stack.append(e)
            self._open[name] += 1
            if name in ("article", "main"):
                self._starts[e] = at

    def block(self, e: int) -> str:
        """Name of the block around an element."""
        return self.elements[self.elements[e].block].name or "none"

    def marked(self) -> int | None:
        """The page's longest article element."""
        own = max((x for x in self.articles if x[0] == "article"), key=lambda x: x[3] - x[2], default=None)
        return own and own[1]

    def holders(self) -> set[int]:
        """The elements that are or hold the page's article (its longest article element) or its first main element: a
        name says nothing about what they hold."""
        main = min((x for x in self.articles if x[0] == "main"), key=lambda x: x[2], default=None)
        found: set[int] = set()
        for e in (self.marked(), main and main[1]):
            while e and e not in found:
                found.add(e)
                e = self.elements[e].parent
        return found

    def apart(self, odds: dict[str, float]) -> list[bool]:
        """Of each element, whether it lies in a part that is no article. odds: log odds of names."""
        spared = self.holders()
        out = [False]
        for e, x in enumerate(self.elements[1:], 1):
            own = x.name in APART or x.name == "header" and not self.elements[x.parent].article
            if not (own or e in spared or x.name in ("html", "body") or not x.attrs):
                own = any(odds.get(n, _PRIORS.get(n, 0.0)) < APART_ODDS for n in names(x.attrs))
            out.append(out[x.parent] or own)
        return out


def _odds(name: str, inside: int, outside: int) -> float:
    a, b = PRIOR_HINT if name in HINTS else PRIOR_NAME
    return math.log((inside + a) / (outside + b))


_PRIORS = {name: _odds(name, 0, 0) for name in HINTS}


def counts(page: str) -> Counter:
    """Of a labelled page, words by block and by name, and tags by name, inside and outside its article; else nothing.

    What stands inside the article in a part that may be left out by the prior odds counts for no name there."""
    if len(re.findall(r"<article\b", page, re.I)) != 1:
        return Counter()
    found: Counter = Counter()
    read = Page(page)
    apart = read.apart({})
    named: list[frozenset[str]] = [frozenset()]
    for x in read.elements[1:]:
        own = names(x.attrs) if x.attrs and x.name not in ("html", "body") else ()
        named.append(named[x.parent].union(own) if own else named[x.parent])
    for kind, name, e, text in read.events:
        inside = read.elements[e].article and not apart[e]
        if kind == "text":
            n = len(text.split())
            found["word", _known(read.block(e)), inside] += n
            if n and (inside or not read.elements[e].article):
                for x in named[e]:
                    found["name", x, inside] += n
        elif name not in ("article", "main", "html", "body"):
            found["tag", _known(name), inside] += 1
    return found


def weights(found: dict[tuple[str, str, bool], int]) -> dict[tuple[str, str], float]:
    """Scores by kind and name: smoothed log odds of standing inside the article, words positive, tags negative, and
    those of names."""
    out = {}
    totals = {(kind, side): sum(n for (k, _, s), n in found.items() if (k, s) == (kind, side)) + 1 for kind in ("word", "tag") for side in (True, False)}
    for kind, name in {(k, n) for k, n, _ in found}:
        inside, outside = found.get((kind, name, True), 0), found.get((kind, name, False), 0)
        if kind == "name":
            out[kind, name] = _odds(name, inside, outside)
            continue
        odds = math.log((inside + 0.5) / totals[kind, True] / ((outside + 0.5) / totals[kind, False]))
        low, high = WORD_SCORES if kind == "word" else TAG_SCORES
        out[kind, name] = min(max(odds, low), high) if kind == "word" else -min(max(-odds, low), high)
    return out


def best_run(steps: list[tuple[int, float]]) -> tuple[int, int]:
    """First and last block of the run of steps (block, score) with the greatest sum, in one scan; (0, -1) if no score
    is positive. Of equal sums the first to end, of those the longest."""
    best, run = (0.0, 0, -1), None
    total = 0.0
    for block, score in steps:
        if score > 0 and (run is None or total < 0):
            total, run = 0.0, block
        total += score
        if run is not None and total > best[0]:
            best = total, run, block
    return best[1], best[2]


def _extracted(read: Page, apart: list[bool], scores: dict[tuple[str, str], float]) -> str:
    blocks: list[list[str]] = [[]]  # texts of each block
    steps: list[tuple[int, float]] = []
    own = read.marked()
    inside = [False] * len(read.elements)
    if own is not None:
        for e in range(own, len(inside)):
            inside[e] = e == own or inside[read.elements[e].parent]
    placed: list[tuple[int, int, bool]] = []  # block, words and whether in the article element of each text
    for kind, name, e, text in read.events:
        if kind == "text":
            if not apart[e]:
                blocks[-1].append(html.unescape(text))
                if words := len(text.split()):
                    placed.append((len(blocks) - 1, words, inside[e]))
                    steps.append((len(blocks) - 1, words * scores.get(("word", _known(read.block(e))), 1.0)))
        else:
            # Tags of a part that is left out weigh nothing, as its words do.
            if not apart[e] and name not in ("article", "main", "html", "body"):
                steps.append((len(blocks) - 1, scores.get(("tag", _known(name)), -1.0)))
            if name in BLOCKS or name in APART:
                blocks.append([])
            elif name == "br":
                blocks[-1].append(" ")
    first, last = best_run(steps)
    there, here = (sum(n for at, n, x in placed if first <= at <= last and x == side) for side in (False, True))
    if here and here >= there:
        first, last = (pick(at for at, _, x in placed if x) for pick in (min, max))
    lines = (" ".join("".join(x).split()) for x in blocks[first : last + 1])
    return "\n".join(x for x in lines if x)


def extract(page: str, scores: dict[tuple[str, str], float]) -> str:
    """The page's main text: its blocks joined by line feeds. Where names set all its words apart, they set none."""
    read = Page(page)
    odds = {n: w for (kind, n), w in scores.items() if kind == "name"}
    found = _extracted(read, read.apart(odds), scores)
    return found or _extracted(read, read.apart(dict.fromkeys((*HINTS, *odds), 0.0)), scores)


def learn(pages: DataFrame, bound: int = FIT_PAGES) -> dict[tuple[str, str], float]:
    """Weights from about `bound` labelled pages, dealt by a hash of page_id; all if there are fewer.

    Counts are summed by Spark; what comes to the driver is one number for each known tag name and side, and for each
    name of class, id and role that at least two of these pages have.
    """
    rows = pages.count()
    some = pages.where("html is not null")
    if rows > bound:
        some = some.where(F.pmod(F.xxhash64("page_id"), F.lit(1_000_000)) < int(1_000_000 * bound / rows) + 1)
    schema = pa.schema([("kind", pa.string()), ("name", pa.string()), ("inside", pa.bool_()), ("n", pa.int64()), ("pages", pa.int64())])

    def count(batches):
        found: Counter = Counter()
        met: Counter = Counter()
        for part in batches:
            for page in part.column(0):
                own = counts(page.as_py())
                found.update(own)
                met.update(own.keys())
        rows = [(*k, n, met[k]) for k, n in found.items()]
        yield batch(dict(zip(schema.names, list(zip(*rows, strict=True)) or [[]] * 5, strict=True)), schema)

    summed = some.select("html").mapInArrow(count, "kind string, name string, inside boolean, n bigint, pages bigint").groupBy("kind", "name", "inside").agg(F.sum("n"), F.sum("pages").alias("pages"))
    summed = summed.where("kind <> 'name' or pages > 1").drop("pages")
    return weights({(k, n, s): c for k, n, s, c in summed.collect()})


def main_text(pages: DataFrame, scores: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page.

    pages: page_id, url, html; further columns are ignored. Null and empty html, and pages without article
    words, give an empty text. No name in class, id and role sets an element apart that holds the page's article or
    main element; where names set all words of a page apart, they set none. A header inside the article belongs to
    it, one outside does not. Character references are decoded, white space inside a block becomes one
    space, blocks are joined in page order by one line feed; nothing is capped. Repeated rows stay. An
    empty table gives no rows. Time and memory grow with a page's length, however its tags are nested. Nothing is
    shuffled but the sums of learn(), which supplies scores if none are given.
    """
    scores = learn(pages) if scores is None else scores
    schema = pa.schema([("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for part in batches:
            found = [extract(page.as_py() or "", scores) for page in part.column(2)]
            made = batch({"text": found, "n_chars": [len(x) for x in found]}, schema)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made.columns], names=["page_id", "url", *schema.names])

    source = pages.select("page_id", "url", "html")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema[:2])
    return source.mapInArrow(run, f"{kinds}, text string, n_chars bigint")
