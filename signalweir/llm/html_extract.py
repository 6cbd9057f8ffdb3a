"""Main text of web pages as a maximum-scoring subsequence.

A page becomes a sequence of words and tags. Words score positive, more or less by where
they stand (plain, in a link, in a list); tags score negative by their name; boilerplate
elements, their words and tags, score nothing, as they are left out wherever they stand. One linear scan finds the contiguous region with the largest sum,
and the blocks of that region, without those in boilerplate elements, are the text.

Where a page's content elements (<article>, <main>) all stand in one, the words in it score
positive whatever their place and its tags nothing, so the region is that element.

Weights, for all other pages, are log odds from labelled pages: in pages that mark their
content with exactly one outermost <article> or <main>, words and tags inside against those outside. They are counted over
all such pages in one aggregate whose size the tag names bound.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Element names: fixed values.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "object", "xmp", "noembed", "noframes"}
BOILER = {"nav", "header", "footer", "aside", "form", "button", "select", "option", "label", "input", "fieldset", "menu", "dialog", "head"}
#: Of these, elements that a slash in the tag closes.
FOREIGN = {"svg", "math"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li",
    "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
MAIN = {"article", "main"}
#: Words in class, id, role or aria-label that mark an element as boilerplate: fixed values. The first hold as any part of a
#: name (post-comments); the others, which names of content hold too (side-effects), where all other parts are words of layout.
_STRONG = re.compile(
    r"ads?|adverts?|advertisement|adsense|sponsor(?:ed)?|promo(?:tion)?|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscribe"
    r"|signup|login|share|sharing|related|recommended|sidebar|nav(?:bar|igation)?|breadcrumbs?|pagination|pager|toolbar|footer|masthead"
    r"|copyright|disclaimer|comments?|commentlist|replies|reply|respond|disqus|complementary|contentinfo"
)
_WEAK = {"alert", "banner", "dialog", "discussion", "feedback", "header", "legal", "menu", "notice", "notices", "search", "side", "social", "widget"}
_LAYOUT = {
    "area", "article", "bar", "block", "body", "bottom", "box", "buttons", "column", "container", "content", "entry", "form", "global", "group",
    "icons", "inner", "item", "items", "left", "links", "list", "main", "outer", "page", "panel", "post", "posts", "primary", "right", "row",
    "secondary", "section", "site", "story", "top", "wrap", "wrapper",
}
#: With these a header is that of the text: it holds the title.
_TEXT = {"article", "content", "entry", "post", "story"}
#: First parts of classes that say what a page has, not what the element is: with-sidebar, no-comments, fixed-header.
_STATES = {"with", "without", "has", "have", "no", "not", "non", "is", "fixed", "sticky", "hide", "show", "enable", "disable"}
#: Boilerplate of these kinds may turn out to hold the whole page; comments, adverts and notices never do.
_WRAPPERS = {"form", "fieldset"}
_WRAPPING = {"dialog", "header", "legal", "masthead", "menu", "modal", "overlay", "search", "side", "sidebar", "toolbar", "widget"}
#: Such an element is none if it holds so many words and so large a share of those in no other boilerplate.
LEAST_WORDS, LEAST_SHARE = 20, 0.9
_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|</?[A-Za-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|</?[A-Za-z][^>]*>?|[^<]+|<", re.S)
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_NAMED = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
PLAIN, LINK, LIST, OUTSIDE, BOILERPLATE = "w:plain", "w:link", "w:list", "w:outside", "w:boiler"
_WHOLE = {"body", "html", *MAIN}


@lru_cache(maxsize=8192)
def _marks(names: str) -> frozenset[str]:
    """The words of an element's names that mark it as boilerplate."""
    found = set()
    for name in names.split():
        parts = [p for p in re.split("[_-]+", name) if p]
        if len(parts) > 1 and parts[0] in _STATES:
            continue
        found.update(p for p in parts if _STRONG.fullmatch(p))
        weak = {p for p in parts if p in _WEAK}
        rest = set(parts) - weak
        if weak and all(p in _LAYOUT or p.isdigit() or _STRONG.fullmatch(p) for p in rest) and not (weak == {"header"} and rest & _TEXT):
            found |= weak
    return frozenset(found)


class _Open:
    """The open elements; what _pieces() asks of them takes no walk through them.

    Of boilerplate that may hold the whole page (`place` is where it starts, else None) the
    words are counted that stand in no other boilerplate but such.
    """

    def __init__(self):
        self.stack: list[tuple[str, bool, int | None, int]] = []
        self.names, self.boiler, self.soft = Counter(), 0, 0
        self.words = self.free = 0
        self.held: dict[int, int] = {}

    def push(self, name: str, boiler: bool, place: int | None) -> None:
        self.stack.append((name, boiler, place, self.words))
        self.names[name] += 1
        self.boiler += boiler
        self.soft += place is not None

    def read(self, n: int) -> None:
        if not self.boiler:
            self.free += n
        elif self.boiler == self.soft:
            self.words += n

    def spare(self) -> None:
        """The open elements hold the content: none of them is boilerplate."""
        self.stack = [(name, False, None, 0) for name, *_ in self.stack]
        self.boiler = self.soft = 0

    def pop(self) -> str:
        name, boiler, place, words = self.stack.pop()
        self.names[name] -= 1
        self.boiler -= boiler
        if place is not None:
            self.soft -= 1
            self.held[place] = self.words - words
        return name

    def close(self, name: str) -> None:
        """Close the innermost element of that name with all inside it, if there is one."""
        while self.names[name]:
            if self.pop() == name:
                return

    def wrappers(self) -> frozenset[int]:
        """At the page's end: where the boilerplate starts that holds nearly all of it."""
        while self.stack:
            self.pop()
        least = max(LEAST_WORDS, LEAST_SHARE * (self.free + self.words))
        return frozenset(place for place, n in self.held.items() if n >= least)

    def open_paragraph(self) -> bool:
        """A paragraph is open with no block inside it."""
        if not self.names["p"]:
            return False
        return next((n for n, *_ in reversed(self.stack) if n in BLOCKS), "") == "p"


def pieces(page: str) -> tuple[list[tuple[str, str, str, bool]], bool]:
    """The parts of _pieces(), and whether all content elements stand in one; what holds that one, or nearly all words, is no boilerplate."""
    open_ = _Open()
    parts = list(_pieces(page, open_))
    deep = outer = 0
    for kind, name, *_ in parts:
        if name in MAIN and kind != "w":
            outer += kind == "o" and not deep
            deep = deep + 1 if kind == "o" else max(0, deep - 1)
    spared = open_.wrappers()
    if outer == 1 or spared:
        parts = list(_pieces(page, _Open(), outer == 1, spared))
    return parts, outer == 1


def _pieces(page: str, open_: _Open, one: bool = False, spared: frozenset[int] = frozenset()) -> Iterator[tuple[str, str, str, bool]]:
    """(kind, name, text, in a content element): kind 'w' for text with its place as name, 'o' and 'c' for tags, 'x' for those of
    boilerplate; raw elements are left out."""
    at, size = 0, len(page)
    while at < size:
        m = _PIECE.match(page, at)
        place, at = at, m.end()
        piece = m[0]
        inside = bool(open_.names["article"] or open_.names["main"])
        if piece[0] != "<" or piece == "<":
            open_.read(len(piece.split()))
            yield "w", BOILERPLATE if open_.boiler else LINK if open_.names["a"] else LIST if open_.names["li"] and not inside else PLAIN, piece, inside
            continue
        if not (t := _TAG.match(piece)):
            continue
        name = t[2].lower()
        if t[1]:
            within = open_.boiler
            open_.close(name)
            inside = bool(open_.names["article"] or open_.names["main"])
            yield "x" if within and name not in MAIN else "c", name, piece, inside
            continue
        if name in FOREIGN and piece.endswith("/>"):
            yield "x" if open_.boiler else "o", name, piece, inside
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else size
            yield "x" if open_.boiler else "o", name, piece, inside
            continue
        if name in BLOCKS and open_.open_paragraph():  # a block ends an open paragraph
            open_.close("p")
        if name == "li" and open_.stack and open_.stack[-1][0] == "li":
            open_.close("li")
        marks = frozenset()
        if "=" in piece and name not in _WHOLE:
            marks = _marks(" ".join(x for m in _NAMED.findall(piece) for x in m if x).lower())
        if one and name in MAIN and not inside:
            open_.spare()
        if inside and name == "header":  # that of the text: it holds the title
            marks -= {"header"}
        named = name in BOILER and not (name == "header" and inside)
        boiler = (named or bool(marks)) and place not in spared
        soft = boiler and (not named or name in _WRAPPERS) and marks <= _WRAPPING
        if name not in VOID and not piece.endswith("/>"):
            open_.push(name, boiler, place if soft else None)
        yield "x" if (boiler or open_.boiler) and name not in MAIN else "o", name, piece, inside or name in MAIN


def counts_of(page: str) -> Counter:
    """(inside, key) to count, for a page whose content elements stand in one; else nothing."""
    found = Counter()
    parts, one = pieces(page)
    for kind, name, text, inside in parts if one else ():
        if kind == "w":
            found[inside, name] += len(text.split())
        elif name not in MAIN:
            found[inside, "t:" + name] += 1
    return found


def fit(pages: DataFrame, html_col: str = "html", min_count: int = 20) -> dict[str, float]:
    """Weights of words by place and of tags by name. Without labelled pages the prior weights stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                for key, n in counts_of(page or "").items():
                    total[key] += n
            # names are anyone's to invent: rare ones go out early, so the table stays small
            if len(total) > 10_000:
                yield _rows(total)
                total = Counter()
        yield _rows(total)

    known = [*(f"t:{n}" for n in sorted(BLOCKS | BOILER | RAW | VOID | {"a", "b", "i", "em", "strong", "span"})), PLAIN, LINK, LIST, BOILERPLATE]
    rows = (
        pages.select(html_col).mapInArrow(run, "inside boolean, name string, n long").where(F.col("name").isin(known))
        .groupBy("inside", "name").agg(F.sum("n").alias("n")).collect()
    )
    return weights({(r.inside, r.name): r["n"] for r in rows}, min_count)


def _rows(total: Counter) -> pa.RecordBatch:
    keys = sorted(total)
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.bool_()), pa.array([k[1] for k in keys], pa.string()), pa.array([total[k] for k in keys], pa.int64())],
        names=["inside", "name", "n"],
    )


def weights(counts: dict[tuple[bool, str], int], min_count: int = 20) -> dict[str, float]:
    """Log odds, held to the sides that the method gives them: words plain or listed positive, all else negative."""
    prior = {PLAIN: 1.0, LINK: -0.5, LIST: 0.3, OUTSIDE: -1.0, BOILERPLATE: -2.0, "t:article": -4.0, "t:main": -4.0, "t:body": -4.0, "t:html": -4.0}
    out = dict(prior)
    for name in {n for _, n in counts}:
        inside, outside = counts.get((True, name), 0), counts.get((False, name), 0)
        if inside + outside < min_count:
            continue
        odds = math.log((inside + 1) / (outside + 1))
        if name in (PLAIN, LIST):
            out[name] = min(1.5, max(0.2, odds))
        elif name in (LINK, BOILERPLATE):
            out[name] = max(-3.0, min(-0.2, odds))
        else:
            out[name] = max(-4.0 if name[2:] in MAIN | BOILER | RAW | _WHOLE else -1.0, min(-0.1, odds))
    return out


def main_text(page: str, weight: dict[str, float]) -> str:
    """The blocks of the best region, white space in a block as one space, joined by line ends."""
    parts, one = pieces(page)
    best, best_span, run, start = 0.0, (0, 0), 0.0, 0
    for i, (kind, name, text, inside) in enumerate(parts):
        if kind == "x" or name == BOILERPLATE or kind == "o" and name in RAW:  # left out below wherever it stands
            score = 0.0
        elif one and inside:  # the page says itself what its content is: links and lists at its ends belong to it
            score = len(text.split()) if kind == "w" else 0.0
        elif kind == "w":
            score = weight.get(OUTSIDE if one and name in (PLAIN, LIST) else name, -1.0) * len(text.split())
        else:
            score = weight.get("t:" + name, -0.3)
        if run <= 0:
            run, start = 0.0, i
        run += score
        if run > best:
            best, best_span = run, (start, i + 1)
    blocks, block = [], []
    for kind, name, text, _ in parts[best_span[0] : best_span[1]]:
        if kind == "w":
            if name != BOILERPLATE:
                block.append(text)
        elif name in BLOCKS:
            blocks.append("".join(block))
            block = []
        elif name == "br":
            block.append(" ")
    blocks.append("".join(block))
    clean = (" ".join(entities.unescape(b).split()) for b in blocks)
    return "\n".join(b for b in clean if b)


def extract(html: Column, weight: dict[str, float]) -> Column:
    """Main text of a column of pages; empty for null, empty and wordless pages."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([main_text(t, weight) if t else "" for t in batch.to_pylist()], pa.string())

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, "string").asNondeterministic()(html)


def extracted(pages: DataFrame, weight: dict[str, float], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text. Repeated rows each count; an empty table gives an empty result."""
    return pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), extract(F.col(html_col), weight).alias("text"))
