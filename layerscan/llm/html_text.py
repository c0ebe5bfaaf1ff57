"""Main text of HTML pages by tag-path ratios.

A page is read once into text blocks, each with the path of tags from the root. For every
path, the text and the punctuation of its blocks are added up; their ratios to the number of
blocks say how much a path looks like prose. Linked text counts a tenth, and a block counts up to
a length, so that one long block doesn't belittle the rest. Ratios are smoothed over neighbouring
blocks, so that a heading beside paragraphs gains.

What a page declares about its parts are factors of the ratios (``ARTICLE`` and below): the kind
of part whose best path has the highest product is the content, with what is declared higher. Paths
over a share of the best ratio are taken, a smaller one in an article that is the content, and blocks
that lie between taken ones of one container. Paths that are mostly links get nothing from their neighbours
and reach the larger share anywhere, so boxes of links go from an article too. Menus, footers and the
like by tag or role, and what is hidden, are never taken.

A word of a class or id is a hint only. ``STRONG_WORDS`` lower the factor, the others ask for half
of the best ratio; either asks for some text, unless a page has nothing else. An article inside a
part so marked is an article again, if with a lower factor than one outside.
"""

from __future__ import annotations

import html
import math
import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of HTML elements by what they do to text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li "
    "main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead "
    "title tr ul".split()
)
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BOILERPLATE = frozenset(
    "head nav footer aside button select dialog menu template svg math object audio video "
    "canvas map search label script style textarea title noscript iframe".split()
)
BOILERPLATE_ROLES = frozenset(
    "navigation banner search contentinfo complementary dialog alertdialog alert menu menubar "
    "toolbar tooltip".split()
)
#: Words of a class or id that mark a part as hardly ever content.
STRONG_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored "
    "promo promoted promotion cookie cookies consent gdpr newsletter subscribe subscription signup "
    "sidebar nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist "
    "respond reply replies disqus related recommended recommendations popular trending "
    "pagination pager copyright disclaimer contentinfo complementary".split()
)
#: Words of a class or id that often name a mere look or place.
WEAK_WORDS = frozenset(
    "banner notice notices alert side rail menu header masthead discussion share sharing social "
    "popup modal overlay hidden login search form toolbar".split()
)
#: Words that turn the others of the same name around, as in has-sidebar or comments-open.
TURNING_WORDS = frozenset("has have with without no not open opened closed overflow".split())
#: What closes an open element of the same or the named kind, and what that search stops at.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

#: Factors of the ratio by what a part is declared as.
ARTICLE, WRAPPED_ARTICLE, PLAIN, STRONG = 8.0, 4.0, 1.0, 1 / 8
#: Shares of the best ratio that content reaches, that it does in an article, and a part with a weak word.
LEAST_SHARE = 0.05
ARTICLE_SHARE = 0.002
WEAK_SHARE = 0.5
#: Characters outside links that a marked part has at least.
LEAST_MARKED = 200
#: Characters and punctuation marks for each block count up to these.
MOST_CHARS = 500
MOST_MARKS = 50
LINKED = 0.1
SMOOTHING = (0.25, 0.5, 0.25)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|[^<]+|<",
    re.S,
)
_ATTRIBUTE = re.compile(
    r"([^\s\"'>/=][^\s>/=]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?|\"[^\"]*\"|'[^']*'"
)
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
_PUNCTUATION = re.compile(r"[^\w\s]")


def _marked(value: str) -> int:
    """2 when a class or id has a strong word, 1 for a weak one, 0 else."""
    found = 0
    for name in value.split():
        parts = {w.lower() for w in _WORD.findall(name)}
        if not parts & TURNING_WORDS:
            found = max(found, 2 if parts & STRONG_WORDS else 1 if parts & WEAK_WORDS else 0)
    return found


def _declared(tag: str, rest: str, inside: bool) -> tuple[bool, bool, int]:
    """Whether a part is never content, whether it is an article, and how it is marked."""
    if tag in BOILERPLATE or (tag == "header" and not inside):
        return True, False, 0
    article, mark = tag in ("article", "main"), 1 if tag == "form" else 0
    if rest and tag not in ("html", "body"):
        seen = set()
        for match in _ATTRIBUTE.finditer(rest):
            name, value = (match[1] or "").lower(), (match[2] or "").strip("\"'")
            if not name or name in seen:
                continue  # the first of a name counts
            seen.add(name)
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                return True, False, 0
            if name == "style" and _HIDING.search(value):
                return True, False, 0
            if name == "role":
                roles = set(value.lower().split())
                if roles & BOILERPLATE_ROLES:
                    return True, False, 0
                article = article or bool(roles & {"main", "article"})
            elif name in ("class", "id") and tag != "main":
                mark = max(mark, _marked(value))
    if article and mark < 2:
        mark = 0  # the declaration says more than a weak word
    return False, article and not mark, mark


class _Part(NamedTuple):
    """What the text of an element is: its factor (0: never content), whether a weak word marks
    it, the innermost marked element it is in (0: none), whether that is in an article."""

    factor: float
    weak: bool
    marked: int
    inside: bool


class _Block(NamedTuple):
    path: int
    part: _Part
    parent: int
    linked: int
    text: str


class _Page:
    """The text blocks of one page."""

    def __init__(self, source: str):
        self.blocks: list[_Block] = []
        self.paths: dict[tuple[int, str], int] = {}
        self.elements = 0
        # Open elements: tag, path, part, path of its block, number, number of what holds the block.
        self.open: list[tuple] = [("", 0, _Part(PLAIN, False, 0, False), 0, 0, 0)]
        self.count: dict[str, int] = {}
        self.text: list[str] = []
        self.linked = 0
        self._read(source)
        self._flush()

    def _flush(self) -> None:
        if self.text:
            text = " ".join(html.unescape("".join(self.text)).split())
            self.text.clear()
            if text:
                _, _, part, path, _, parent = self.open[-1]
                self.blocks.append(_Block(path, part, parent, min(self.linked, len(text)), text))
            self.linked = 0

    def _part(self, tag: str, rest: str, part: _Part) -> _Part:
        if not part.factor:
            return part
        never, article, mark = _declared(tag, rest, part.inside)
        if never:
            return part._replace(factor=0.0)
        if article and part.marked:
            # An article of its own inside of something marked.
            return _Part(WRAPPED_ARTICLE, False, 0, True)
        if article and not part.inside:
            return _Part(ARTICLE, False, 0, True)
        if mark == 2:
            return part._replace(factor=STRONG, marked=self.elements)
        if mark == 1:
            return part._replace(weak=True, marked=self.elements)
        return part

    def _push(self, tag: str, rest: str) -> None:
        _, path, part, block, number, parent = self.open[-1]
        self.elements += 1
        part = self._part(tag, rest, part)
        path = self.paths.setdefault((path, tag), len(self.paths) + 1)
        if tag in BLOCKS:
            block, parent = path, number
        self.open.append((tag, path, part, block, self.elements, parent))
        self.count[tag] = self.count.get(tag, 0) + 1

    def _pop(self, to: int) -> None:
        for tag, *_ in self.open[to:]:
            self.count[tag] -= 1
        del self.open[to:]

    def _close(self, tags: set[str], stop: set[str]) -> None:
        """Close the innermost of some elements, unless one to stop at comes first."""
        if not any(self.count.get(t) for t in tags):
            return
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][0] in tags:
                return self._pop(at)
            if self.open[at][0] in stop:
                return

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            match = _TOKEN.match(source, at)
            at = match.end()
            tag = match["tag"] or match["tag2"]
            if tag is None:
                token = match[0]
                if token[0] != "<" or token == "<":
                    self.text.append(token)
                    if self.count.get("a"):
                        self.linked += len(token.strip())
                continue
            if match["tag2"] and not match[0].endswith(">"):
                break  # the page ends inside a tag
            tag, rest = tag.lower(), match["rest"] or match["rest2"] or ""
            block = tag in BLOCKS
            if match["end"] or match["end2"]:
                if self.count.get(tag):
                    if block:
                        self._flush()
                    elif self.open[-1][2] != self._part_outside(tag):
                        self._flush()
                    self._close({tag}, set() if block else BLOCKS)
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
                at = end.start() if end else size
                if end:
                    at = source.find(">", at) + 1 or size
                continue
            if block:
                self._flush()
                if tag != "option":
                    self._close({"p"}, {"td", "th", "button", "article", "div", "section"})
            elif tag == "br":
                self.text.append(" ")
            if tag in VOID:
                continue
            if tag in CLOSES:
                self._close(*CLOSES[tag])
            if not block and tag in BOILERPLATE:
                self._flush()
            before = self.open[-1][2]
            self._push(tag, rest)
            if not block and self.open[-1][2] != before and self.text:
                # What came before an inline part that is no content belongs to its parent.
                mine = self.open.pop()
                self._flush()
                self.open.append(mine)

    def _part_outside(self, tag: str) -> _Part:
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][0] == tag:
                return self.open[at - 1][2]
        return self.open[-1][2]


def _ratios(blocks: list[_Block]) -> tuple[list[float], list[bool]]:
    """The ratio of the path of every block, among blocks of the same kind of part, and whether most of its
    path's text is linked."""
    kind = [(b.path, b.part.factor, b.part.weak) for b in blocks]
    chars: dict[tuple, float] = {}
    linked: dict[tuple, int] = {}
    marks: dict[tuple, int] = {}
    nodes: dict[tuple, int] = {}
    for key, b in zip(kind, blocks, strict=True):
        chars[key] = chars.get(key, 0) + len(b.text) - (1 - LINKED) * b.linked
        linked[key] = linked.get(key, 0) + 2 * b.linked - len(b.text)
        marks[key] = marks.get(key, 0) + len(_PUNCTUATION.findall(b.text))
        nodes[key] = nodes.get(key, 0) + 1
    ratio = {
        key: max(1.0, min(chars[key] / n, MOST_CHARS)) * (1 + math.log1p(min(marks[key] / n, MOST_MARKS)))
        for key, n in nodes.items()
    }
    # Smoothing over the neighbours in the same kind of part, then the mean over a path.
    left, middle, right = SMOOTHING
    smooth: dict[tuple, float] = {}
    for n, (key, b) in enumerate(zip(kind, blocks, strict=True)):
        near = [0.0, 0.0]
        for side, other in enumerate((n - 1, n + 1)):
            if not 0 <= other < len(blocks):
                near[side] = ratio[key]
            elif blocks[other].part == b.part:
                near[side] = ratio[kind[other]]
        found = left * near[0] + middle * ratio[key] + right * near[1]
        smooth[key] = smooth.get(key, 0.0) + found / nodes[key]
    plain = [b.part.marked or linked[k] > 0 for k, b in zip(kind, blocks, strict=True)]
    return [ratio[k] if p else smooth[k] for k, p in zip(kind, plain, strict=True)], [linked[k] > 0 for k in kind]


def extract(source: str | None) -> str:
    """Main text of a page: its content blocks in page order, joined by one space."""
    if not source:
        return ""
    blocks = _Page(source).blocks
    ratios, links = _ratios(blocks)
    size: dict[int, int] = {}
    for b in blocks:
        size[b.part.marked] = size.get(b.part.marked, 0) + len(b.text) - b.linked
    clear = any(b.part.factor and not b.part.marked for b in blocks)

    def may(b: _Block) -> bool:
        if not b.part.factor or not b.part.marked:
            return b.part.factor > 0
        return size[b.part.marked] >= LEAST_MARKED or (not clear and b.part.factor > STRONG)

    best: dict[float, float] = {}
    for b, ratio in zip(blocks, ratios, strict=True):
        if may(b) and (not b.part.weak or not clear):
            best[b.part.factor] = max(best.get(b.part.factor, 0.0), ratio)
    if not best:
        return ""
    content = max(best, key=lambda factor: (factor * best[factor], factor))

    def taken(b: _Block, ratio: float, link: bool) -> bool:
        if not may(b) or b.part.factor < content:
            return False
        if b.part.weak and clear:
            return ratio >= WEAK_SHARE * best[content]
        inside = b.part.factor == content > PLAIN and not link
        return ratio >= (ARTICLE_SHARE if inside else LEAST_SHARE) * best[content]

    take = [taken(*of_block) for of_block in zip(blocks, ratios, links, strict=True)]
    # Blocks between taken ones of one container.
    last = None
    for n in [n for n, t in enumerate(take) if t]:
        if last is not None and blocks[last].parent == blocks[n].parent:
            for m in range(last + 1, n):
                take[m] = blocks[m].part.factor >= content and not blocks[m].part.marked and not links[m]
        last = n
    return " ".join(b.text for b, t in zip(blocks, take, strict=True) if t)


def main_text(source: Column) -> Column:
    """Main text of each page. Null and empty pages, and such without text, give ''."""

    @F.pandas_udf("string")
    def of(pages: pd.Series) -> pd.Series:
        return pd.Series([extract(p) for p in pages], dtype=object)

    return of(source)


def extract_pages(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text`` in place of ``html``; other columns stay, a column ``text``
    that was there is replaced. Rows never move, so repeated pages are read again."""
    return pages.withColumn("text", main_text(F.col("html"))).drop("html")
