"""Main text of web pages by the maximum-scoring subsequence of words and tags."""

from __future__ import annotations

import functools
import html
import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .labelled_pages import labelled_pages

#: Elements that do not break a line of text, and elements without an end tag.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as part of a page.
SILENT = frozenset("script style noscript template iframe object svg math head title canvas audio video".split())
#: Start tags that end an open paragraph; and elements that end an open one of their own kind.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that are parts of a page by their name alone.
SECTIONS = frozenset(f"<{x}>" for x in "article aside button dialog fieldset footer form header label legend main menu nav option search select textarea".split())
SCOPE = frozenset("ul ol dl table tr div section article body td th nav aside main".split())

#: A tag ends at its first > outside a value in quotes, or with the page; what a match scans it consumes, so that all is linear.
_MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:-->|\Z))|<(script|style)\b[^>]*+>.*?(?:</\1\s*+>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?|[\"'])*+)(?:>|\Z)|<[a-zA-Z/!?][^>]*+(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
_SPLIT = re.compile(r"[^a-z0-9]+")
#: The score of a word without evidence; log odds of an element that rule its words out, their score, and the least of a run of them.
BIAS, RULED_OUT, LOST, MOST_LOST = 0.6, -1.0, -0.25, -10.0


def _features(tag: str, attributes: str) -> tuple[str, ...]:
    names = {w for m in _NAMES.finditer(attributes) for w in _SPLIT.split((m[1] or m[2] or m[3] or "").lower()) if w}
    return (f"<{tag}>", *sorted(names), *(("[hidden]",) if _HIDDEN.search(attributes) else ()))


_short_features = functools.lru_cache(maxsize=1 << 14)(_features)


def features(tag: str, attributes: str) -> tuple[str, ...]:
    """What is known of an element: its name, the words of its class, id and role, and whether it is hidden."""
    return _short_features(tag, attributes) if len(attributes) <= 200 else _features(tag, attributes)


@dataclass
class Piece:
    """A run of text, or a tag, with the state of the elements that are open at it."""

    text: str
    state: Any
    tag: str = ""
    end: int = 0


def pieces(page: str, start: Any, enter: Callable[[Any, tuple[str, ...]], Any]) -> Iterator[Piece]:
    """Texts and tags of a page in order; end tags that are missing are implied.

    An open element has a state of its own, which enter makes of that around it and its features, so that a piece costs the
    same however deep it is. Where the open elements of a name are is kept, so that end tags need no search.
    """
    stack: list[tuple[str, Any]] = []
    places: dict[str, list[int]] = {}
    at = 0

    def top(names: Iterable[str]) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    def close(names: tuple[str, ...], stop: frozenset[str]) -> None:
        i = top(names)
        if i < 0 or top(stop.difference(names)) > i:
            return
        while len(stack) > i:
            places[stack.pop()[0]].pop()

    def state() -> Any:
        return stack[-1][1] if stack else start

    for m in _MARKUP.finditer(page):
        if m.start() > at:
            yield Piece(page[at : m.start()], state(), "", m.start())
        at = m.end()
        name = m[3]
        if not name:
            continue
        tag = name.lower()
        if m[2]:
            close((tag,), frozenset() if tag not in INLINE else SCOPE)
        else:
            if tag in ENDS_P:
                close(("p",), SCOPE - {"div"} if tag == "div" else SCOPE)
            if tag in SELF:
                close(SELF[tag], frozenset(("ul", "ol", "dl", "table", "select")) if tag != "tr" else frozenset(("table",)))
            if tag not in VOID and not m[4].endswith("/"):
                places.setdefault(tag, []).append(len(stack))
                stack.append((tag, enter(state(), features(tag, m[4]))))
        yield Piece("", state(), tag, at)
    if at < len(page):
        yield Piece(page[at:], state(), "", len(page))


class Context(NamedTuple):
    """What the open elements say of a word: the sum of their log odds, the greatest, whether one rules it out, and whether
    one of them is the article's."""

    total: float = 0.0
    best: float = 0.0
    out: bool = False
    article: bool = False


@dataclass
class Weights:
    """Log odds of features, and the score of a tag by its name."""

    names: dict[str, float]
    tags: dict[str, float]

    def enter(self, around: Context, f: tuple[str, ...]) -> Context:
        own = sum(self.names.get(x, 0.0) for x in f)
        title = f == ("<header>",) and around.article  # of the article, not of the page
        out = around.out or (own <= RULED_OUT and not title) or f[0][1:-1] in SILENT or f[-1] == "[hidden]"
        return Context(around.total + own, max(around.best, own), out, around.article or (own > 0 and f[0] in ("<article>", "<main>")))

    def word(self, c: Context) -> float:
        return LOST if c.out else max(LOST, min(1.0, BIAS + c.total))

    def share(self, c: Context) -> float:
        """How much negative scores count: little within an element that the weights take for the article's."""
        return 0.1 if c.best >= 1.0 else 1.0

    def tag(self, name: str) -> float:
        return self.tags.get(name, -0.5)


def fitted(pages: Iterable[list[tuple[str, int]]]) -> Weights:
    """Weights of labelled pages: naive Bayes over a page's texts, smoothed; a tag costs more the rarer it is in articles.

    The name of an element says much if it is one of SECTIONS; that of another takes little off.
    """
    pos: dict[str, float] = defaultdict(float)
    neg: dict[str, float] = defaultdict(float)
    tag_in: dict[str, float] = defaultdict(float)
    tag_out: dict[str, float] = defaultdict(float)
    for parts in pages:
        edges, at = [], 0
        for markup, label in parts:
            at += len(markup)
            edges.append((at, label))
        # A state is the set of features of the open elements.
        seen: list[set] = [set(), set()]
        for p in pieces("".join(m for m, _ in parts), frozenset(), lambda around, f: around | set(f)):
            label = next(y for e, y in edges if p.end <= e)
            if p.tag:
                (tag_in if label else tag_out)[p.tag] += 1
            elif p.text.strip():
                seen[label] |= p.state
        for x in seen[1]:
            pos[x] += 1
        for x in seen[0] - seen[1]:
            neg[x] += 1
    names = {}
    for x in {*pos, *neg}:
        least, most = (-3.0, 3.0) if x[0] != "<" or x in SECTIONS else (-0.5, 0.0)
        names[x] = round(max(least, min(most, math.log((pos[x] + 1) / (neg[x] + 1)))), 3)
    tags = {x: max(-1.0, min(-0.1, 0.3 * math.log((tag_in[x] + 1) / (tag_out[x] + 1)) - 0.3)) for x in {*tag_in, *tag_out}}
    return Weights(names, tags)


@functools.lru_cache(maxsize=1)
def learned() -> Weights:
    return fitted(labelled_pages().values())


def main_text(page: str | None, weights: Weights | None = None) -> str:
    """The text of the best contiguous region of a page, without its words that score negative.

    Words score by the elements around them: the sum of their log odds and a bias, or a fixed negative score if the log odds of
    one of them alone rule it out, so that a menu inside the article is none of it. Tags are negative. One scan keeps the best region that ends here and the best so
    far; of equal regions the first counts.
    """
    if not page:
        return ""
    w = weights or learned()
    items: list[tuple[str, bool]] = []
    best, best_from, best_to, run, run_from = 0.0, 0, 0, 0.0, 0
    for p in pieces(page, Context(), w.enter):
        c = p.state
        if p.tag:
            items.append(("" if p.tag in INLINE else " ", False))
            score = w.tag(p.tag) * w.share(c)
        else:
            per = w.word(c)
            items.append((p.text, per < 0))
            score = max(per * len(p.text.split()), MOST_LOST) * (w.share(c) if per < 0 else 1.0)
        if run <= 0:
            run, run_from = 0.0, len(items) - 1
        run += score
        if run > best:
            best, best_from, best_to = run, run_from, len(items)
    return " ".join("".join(" " if out else html.unescape(t) if "&" in t else t for t, out in items[best_from:best_to]).split())


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of pages (page_id, url, html).

    Null or empty markup gives an empty text, as does a page without any words of its own. Pages of any length and nesting take time in proportion. Character references are decoded,
    runs of white space (as Unicode has it) become one space, and blocks are joined by one space in page order. Repeated
    rows, null ids and null urls keep their rows; other columns are not read.
    """
    rows = pages.select("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = learned()
        for b in batches:
            text = [main_text(x.as_py(), w) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
