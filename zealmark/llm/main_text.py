"""Main text of web pages: the contiguous run of words and tags with the highest score.

A page is read once into tokens: runs of words and tags.  Words score positive
where labelled pages hold them in their article and negative where they hold
them in page furniture; every tag costs, the more the rarer it is inside
articles.  One linear scan finds the best contiguous region; it is widened to whole
text blocks, and all its words outside furniture are the main text, links too.  Weights come from the pages that mark their article
(``<article>`` or ``<main>``); places that no labelled page shows fall back to priors.

Names of furniture (class, id, role) and forms are evidence, no veto: an article, what holds
``<main>`` and what holds most of the page's words are not furniture for their name.  How words
under such names count is learned from the labelled pages as well.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from math import log
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zealmark.llm.common import prepare

# Element names of HTML by what they mean for the main text.
NEVER_TEXT = {"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "audio", "video", "textarea", "title"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template"}
FURNITURE = {"head", "nav", "header", "footer", "aside", "form", "menu", "button", "select", "dialog", "fieldset", "label", "option"}
WRAPPERS = {"form", "fieldset"}  # furniture, but also put around whole pages
ARTICLE = {"article", "main"}
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark",
    "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "acronym", "ruby", "rb", "rt", "rp",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
FLOWING = INLINE | {"br", "wbr"}  # what a text block goes on over
# Elements whose place in the tree matters for what their words are
HOLDERS = FURNITURE | ARTICLE | {"a", "div", "section", "ul", "ol", "dl", "table", "body", "html", "blockquote", "figure", "details"}
# Words of class, id and role that name furniture
FURNITURE_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "byline", "comment",
    "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "discussion", "disqus", "feedback", "footer", "form", "gdpr",
    "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "overlay",
    "pager", "pagination", "popup", "privacy", "promo", "promoted", "promotion", "recommended", "related", "replies", "reply", "respond",
    "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}

# Places of a word
CONTENT, CONTENT_LINK, OUTSIDE, OUTSIDE_LINK, UNMARKED, UNMARKED_LINK, FURNISHED = range(7)
PLACES = ("content", "content link", "outside", "outside link", "unmarked", "unmarked link", "furniture")
# Prior counts (inside the article, outside it) of words by place
PRIOR = {"content": (20, 1), "content link": (4, 2), "outside": (1, 4), "outside link": (1, 20), "unmarked": (8, 2), "unmarked link": (1, 4), "furniture": (1, 50)}
MAX_WEIGHT = 3.0
LEAST_TAG_COST, MAX_TAG_COST = 0.01, 2.0

NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
# attributes up to the closing bracket; quotes may hold brackets
QUOTED_END = re.compile(r"""[^"'>]*+(?:"[^"]*+"[^"'>]*+|'[^']*+'[^"'>]*+)*+>""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
TELLING = re.compile(r"class|id|role|aria-|hidden|style", re.I)  # some attribute may tell something
NOT_WORD = re.compile(r"[^a-z0-9]+")
NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)


class Run(NamedTuple):
    """A token: words of one text run (tag empty), or a tag."""

    tag: str
    text: str
    place: int
    words: int
    named: str = ""  # furniture name of what holds the run, where that is no furniture all the same


class Element(NamedTuple):
    """An element that matters for what its words are."""

    name: str
    parent: int  # -1: none
    off: bool  # furniture or no text, whatever it holds
    named: str  # the name that makes it furniture, unless what it holds speaks against it


def _judged(name: str, attributes: str) -> tuple[bool, str]:
    """Whether an element is surely no part of the main text, and the name that speaks against it."""
    off, named = name in NEVER_TEXT or name in FURNITURE and name not in WRAPPERS, name if name in WRAPPERS else ""
    if off or name in ("html", "body", "main") or not TELLING.search(attributes):  # a word there describes the whole page
        return off, named
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key in ("class", "id", "role", "aria-label"):
            named = named or next((word for word in NOT_WORD.split(value.lower()) if word in FURNITURE_WORDS), "")
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and NOT_SHOWN.search(value):
            return True, ""
    return False, named


def _places(elements: list[Element], words: list[int], loose: int) -> tuple[list[tuple[int, str]], bool]:
    """Place and furniture name of the words right in each element, and whether the page marks an article.

    ``words`` has the words right in each element, ``loose`` is the number of those in none.
    """
    held, holds_main = words.copy(), [False] * len(elements)
    for i in range(len(elements) - 1, -1, -1):  # an element comes after its parent
        name, parent, off, _ = elements[i]
        if off:
            held[i] = 0
        elif parent >= 0:
            held[parent] += held[i]
            holds_main[parent] |= holds_main[i] or name == "main"
        else:
            loose += held[i]
    most = [2 * n > loose for n in held]
    off, under = [False] * len(elements), [False] * len(elements)  # furniture; within a furniture name that does not count
    for i, (name, parent, never, named) in enumerate(elements):
        lifted = not named or most[i] or holds_main[i] or name in ARTICLE
        off[i] = never or not lifted or parent >= 0 and off[parent]
        under[i] = parent >= 0 and under[parent] or bool(named) and named not in WRAPPERS and name not in ARTICLE
    # beside an article without such a name, one with it is what the name says, if it is the smaller part
    articles = {i for i, e in enumerate(elements) if e.name == "article" and not off[i]}
    if any(not elements[i].named and not under[i] for i in articles):
        for i, (_, parent, _, named) in enumerate(elements):
            off[i] |= parent >= 0 and off[parent] or i in articles and bool(named) and not most[i]
    # an article marks the page if nothing names it furniture, or if it is the only one and most of the page
    marks = {i for i in articles if not off[i] and (not (under[i] or elements[i].named) or most[i] and len(articles) == 1)}
    marks |= {i for i, e in enumerate(elements) if e.name == "main" and not off[i]}
    inside, link, names = [False] * len(elements), [False] * len(elements), [""] * len(elements)
    out: list[tuple[int, str]] = []
    for i, (name, parent, _, named) in enumerate(elements):
        inside[i] = i in marks or parent >= 0 and inside[parent]
        link[i] = name == "a" or parent >= 0 and link[parent]
        names[i] = named or (names[parent] if parent >= 0 else "")
        place = FURNISHED if off[i] else (CONTENT if inside[i] else OUTSIDE if marks else UNMARKED) + link[i]
        out.append((place, "" if off[i] else names[i]))
    return out, bool(marks)


def tokens(page: str) -> tuple[list[Run], bool]:
    """Words and tags of a page in order, in time linear in its length, and whether an article is marked outside furniture."""
    out: list[tuple[str, str, int, int]] = []  # tag, text, words, home: the element they are right in (-1: none)
    elements: list[Element] = []
    words: list[int] = []  # by element, right in it
    held: list[int] = []  # open elements
    loose = links = 0
    at, end, quotes_close = 0, len(page), True
    lowered = page.lower() if len(page.lower()) == len(page) else None  # places must agree; else raw ends are matched by case

    def leave(upto: int) -> None:
        nonlocal links
        links -= sum(elements[i].name == "a" for i in held[upto:])
        del held[upto:]

    def add(tag: str, text: str = "", n: int = 0) -> None:
        nonlocal loose
        if held:
            words[held[-1]] += n
        else:
            loose += n
        out.append((tag, text, n, held[-1] if held else -1))

    def text(raw: str) -> None:
        if not raw or raw.isspace():
            if raw:
                add("", " ")
            return
        plain = html.unescape(raw)
        add("", plain, len(plain.split()))

    while at < end:
        begin = page.find("<", at)
        if begin < 0:
            text(page[at:])
            break
        following = page[begin + 1 : begin + 2]
        if not (following.isalpha() and following.isascii()) and following not in ("/", "!", "?"):
            text(page[at : begin + 1])
            at = begin + 1
            continue
        text(page[at:begin])
        if page.startswith("<!--", begin):
            close = page.find("-->", begin + 4)
            at = end if close < 0 else close + 3
            continue
        match = NAME.match(page, begin + 1) if following not in "!?" else None
        if match is None:
            close = page.find(">", begin)
            at = end if close < 0 else close + 1
            continue
        stop = QUOTED_END.match(page, match.end()) if quotes_close else None
        if stop is None:
            quotes_close = False  # a quote that never closes: from here on a tag ends at its first bracket
            close = page.find(">", match.end())
            at = end if close < 0 else close + 1
        else:
            at = stop.end()
        name, attributes = match[1].lower(), page[match.end() : at - 1]
        if following == "/":
            add("/" + name)
            for place in range(len(held) - 1, -1, -1):
                if elements[held[place]].name == name:
                    leave(place)
                    break
            continue
        add(name)
        if name in RAW:
            close = (lowered or page).find(f"</{name}", at)
            at = end if close < 0 else close
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        if held and elements[held[-1]].name == "p" and name not in INLINE:
            leave(len(held) - 1)  # a block ends an open paragraph
        if name == "a" and links:  # links do not nest
            leave(next(i for i, other in enumerate(held) if elements[other].name == "a"))
        off, named = _judged(name, attributes)
        if off or named or name in HOLDERS:
            elements.append(Element(name, held[-1] if held else -1, off, named))
            words.append(0)
            held.append(len(elements) - 1)
            links += name == "a"
    places, marked = _places(elements, words, loose)
    places.append((OUTSIDE if marked else UNMARKED, ""))  # of what is in no element
    return [Run(tag, text, places[home][0], n, places[home][1]) for tag, text, n, home in out], marked


def _label_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words by place and of tags, inside and outside the article, of the pages that mark one."""
    inside: Counter[str] = Counter()
    outside: Counter[str] = Counter()
    for batch in batches:
        for page in batch.column("html").to_pylist():
            runs, marked = tokens(page)
            if not marked:  # also where the only article stands in furniture: its page tells nothing of the places
                continue
            for run in runs:
                counted = inside if run.place in (CONTENT, CONTENT_LINK) else outside
                if run.tag:
                    name = run.tag.removeprefix("/")
                    counted["<" + (name if name in KNOWN else "?")] += 1
                elif run.words:
                    counted[PLACES[run.place]] += run.words
                    if run.named:
                        counted["@" + run.named] += run.words
    keys = sorted({*inside, *outside})
    if keys:
        yield pa.RecordBatch.from_pydict({"token": keys, "n_in": [inside[k] for k in keys], "n_out": [outside[k] for k in keys]})


COMMON = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "td", "th", "thead", "tbody", "dt", "dd", "pre", "hr", "br", "figcaption", "caption", "summary"}
KNOWN = INLINE | VOID | HOLDERS | NEVER_TEXT | COMMON


class Weights(NamedTuple):
    words: tuple[float, ...]  # by place
    tags: dict[str, float]
    other_tag: float
    names: dict[str, float]  # words under furniture names that are no furniture, of pages that mark no article


def _weights(counts: dict[str, tuple[int, int]]) -> Weights:
    """Log ratios of how much of the article and of the rest a token makes up; tags always cost."""
    ratio = lambda n_in, n_out: max(-MAX_WEIGHT, min(MAX_WEIGHT, log(n_in / n_out)))
    words = []
    for place in PLACES:
        n_in, n_out = counts.get(place, (0, 0))
        a, b = PRIOR[place]
        words.append(ratio(n_in + a, n_out + b))
    names = {k[1:]: ratio(n_in + 1, n_out + 1) for k, (n_in, n_out) in counts.items() if k[0] == "@"}
    all_in = sum(n for k, (n, _) in counts.items() if k[0] == "<") + 1
    all_out = sum(n for k, (_, n) in counts.items() if k[0] == "<") + 1
    cost = lambda n_in, n_out: -max(LEAST_TAG_COST, min(MAX_TAG_COST, log(((n_out + 1) / all_out) / ((n_in + 1) / all_in))))
    tags = {k[1:]: cost(*n) for k, n in counts.items() if k[0] == "<" and k != "<?"}
    return Weights(tuple(words), tags, cost(*counts.get("<?", (0, 0))), names)


def learn_weights(pages: DataFrame, html_col: str = "html") -> Weights:
    """Weights from all pages that mark their article; at most one row per known tag, place and furniture name comes to the driver."""
    counted = (
        pages.select(F.col(html_col).cast("string").alias("html"))
        .where("html is not null")
        .mapInArrow(_label_counts, "token string, n_in bigint, n_out bigint")
        .groupBy("token")
        .agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"))
    )
    return _weights({row.token: (row.n_in, row.n_out) for row in counted.collect()})


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end (past it) of the contiguous run with the highest positive sum: the first such, empty if none is positive."""
    best = total = 0.0
    begin = end = start = 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, begin, end = total, start, i + 1
    return begin, end


def whole_blocks(runs: list[Run], begin: int, end: int) -> tuple[int, int]:
    """A region that is not empty, widened to the borders of the text blocks it begins and ends in."""
    flows = lambda run: not run.tag or run.tag.removeprefix("/") in FLOWING
    if begin < end:
        while begin and flows(runs[begin]) and flows(runs[begin - 1]):
            begin -= 1
        while end < len(runs) and flows(runs[end - 1]) and flows(runs[end]):
            end += 1
    return begin, end


def main_text(page: str | None, weights: Weights) -> str:
    """Blocks of the best region joined by a space; white space inside a block becomes one space."""
    if not page:
        return ""
    runs, marked = tokens(page)
    by_place, by_tag, other, by_name = weights

    def score(run: Run) -> float:
        if run.tag:
            return by_tag.get(run.tag.removeprefix("/"), other)
        weight = by_place[run.place]
        if run.named and not marked:
            weight = min(weight, by_name.get(run.named, weight))
        return run.words * weight

    begin, end = best_region([score(run) for run in runs])
    begin, end = whole_blocks(runs, begin, end)
    blocks: list[str] = []
    block: list[str] = []
    for run in runs[begin:end]:
        if not run.tag:
            if run.place != FURNISHED:
                block.append(run.text)
        elif run.tag.removeprefix("/") not in INLINE:
            blocks.append(" ".join("".join(block).split()))
            block = []
    blocks.append(" ".join("".join(block).split()))
    return " ".join(filter(None, blocks))


OUT = "page_id bigint, url string, text string, n_chars bigint"


def extract_main_text(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page; null or empty html gives an empty text."""
    prepare(pages.sparkSession)
    weights = weights or learn_weights(pages)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, weights) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(extract, OUT)
