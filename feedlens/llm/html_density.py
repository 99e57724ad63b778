"""Main text of web pages by composite text density.

Every element gets a density: its characters per tag, adjusted by how many of them stand in links.
An element's sum is the density of its child elements together; the text that stands directly
in it counts as one more child. The subtree with the largest
sum leads to the article: the outermost article or main around it stays whole. Beside that stay
other articles, and neighbours along the path to the body whose density reaches the least density
of that path, furniture included. Without such an element everything along the path stays.
Neighbours that are mostly links go. Page furniture is taken out before, by element or by a name in a
class, id or role. Within an article or main such names only take out comments, adverts and buttons to share; comments go
unless nothing else is left, and no other name takes out an element that holds the page's main or article.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.batches import small_batches

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|template|noscript|title|textarea|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*>",
    re.I | re.S,
)
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub "
    "sup time tt u var wbr "
    "math annotation mfenced mfrac mi mn mo mover mpadded mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder "
    "munderover semantics optgroup option svg circle defs ellipse g line path polygon polyline rect text tspan use".split()
)
#: Elements that hold a whole article.
_WHOLE = frozenset(("article", "main"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("head nav footer aside form dialog menu input".split())
#: Starting one of these ends an open element of the set beside it.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPE = frozenset("article aside body div footer form header main nav section table ul ol dl td th html".split())
#: Controls and embedded things: they go without a break in the text around them.
_SILENT = frozenset("button object select".split())
#: A name in a class, id or role, whole or with one of these words around it.
_FURNITURE = re.compile(
    r"(?:(?:site|page|main|global|top|bottom|left|right)[_-])?"
    r"(?:ads?|adverts?|advertisement|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|masthead|menu|nav|navbar|navigation|"
    r"newsletter|notice|popup|promo|related|share|sharing|sidebar|social|sponsor(?:ed)?|subscribe|toolbar|widget)"
    r"(?:[_-](?:area|bar|block|box|buttons?|container|follow|form|header|icons?|inner|items?|links?|list|main|media|menu|nav|networks?|"
    r"outer|panel|posts?|section|share|sharing|slot|thread|top|unit|widgets?|wrap|wrapper|\d+))*",
    re.I,
)
#: Names that are no part of an article's text even within it.
_FOREIGN = re.compile(r"^(?:\w+[_-])?(?:ads?|advert\w*|sponsor\w*|share|sharing|social|newsletter|subscribe|promo)(?:[_-]|$)", re.I)
_READERS = re.compile(r"comment|disqus", re.I)
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")


class _Page:
    """Block elements in page order with parents before children; inline ones only count as tags."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.tags, self.link_tags = ["body"], [-1], [0], [0]
        self.dropped, self.marked, self.whole = [False], [0], [False]  # marked: see _mark; whole: in an article or main
        self.texts: list[tuple[int, str, bool]] = []  # element, text, inside a link
        self.breaks: list[int] = [0]  # element of each block change
        open_, links, at = [0], 0, 0
        names: Counter[str] = Counter()  # of the open elements, so that a stray end tag looks for none

        def close(k: int) -> None:
            names.subtract(self.tag[e] for e in open_[k:])
            del open_[k:]

        for m in _TOKEN.finditer(source):
            if m.start() > at:
                self.texts.append((open_[-1], source[at : m.start()], links > 0))
            at = m.end()
            name = m[3] or m[6]
            if not name:
                continue
            name, closing, rest = name.lower(), (m[2] or m[5]), (m[4] or m[7] or "")
            if name in _INLINE:
                if not closing:
                    self.tags[open_[-1]] += 1
                    if name == "a":
                        self.link_tags[open_[-1]] += 1
                        links = 1
                    elif name == "br":
                        self.texts.append((open_[-1], " ", False))
                elif name == "a":
                    links = 0
                continue
            links = 0
            if closing:
                if names[name] > 0:
                    k = len(open_) - 1
                    while self.tag[open_[k]] != name:
                        k -= 1
                    close(k)
                if name not in _SILENT:
                    self._cut(open_[-1])
                continue
            if name in ("html", "body"):
                close(1)
                continue
            if name in _SILENT:
                self._open(name, rest, open_[-1], True)
                open_.append(len(self.tag) - 1)
                names[name] += 1
                continue
            while self.tag[open_[-1]] in _SILENT and name != "param":  # a block ends a control whose end tag is missing
                close(len(open_) - 1)
            ends = _ENDS.get(name)
            for k in range(len(open_) - 1, 0, -1):
                tag = self.tag[open_[k]]
                if tag == "p" or (ends and tag in ends):
                    close(k)
                    if not ends or tag in ends:
                        break
                elif tag in _SCOPE or tag not in _ENDS:
                    break
            up = open_[-1]
            self._open(name, rest, up, name in _DROPPED or (name == "header" and not self.whole[up]))
            me = len(self.tag) - 1
            self._cut(me)
            if name not in _VOID and not rest.endswith("/"):
                open_.append(me)
                names[name] += 1
        if at < len(source):
            self.texts.append((open_[-1], source[at:], links > 0))

    def _open(self, name: str, attributes: str, up: int, dropped: bool) -> None:
        mark = _mark(name, attributes)
        self.tag.append(name), self.parent.append(up), self.tags.append(1), self.link_tags.append(0)
        self.dropped.append(self.dropped[up] or dropped)
        self.marked.append(0 if mark == 1 and self.whole[up] else mark)
        self.whole.append(self.whole[up] or name in _WHOLE)

    def _cut(self, element: int) -> None:
        self.texts.append((element, "\n", None))


def _mark(name: str, attributes: str) -> int:
    """1 if the class, id or role names page furniture, 2 readers' comments, 3 adverts and buttons to share, else 0."""
    if not attributes or name in _WHOLE:
        return 0
    for a, b, c in _ATTRIBUTE.findall(attributes):
        for word in (a or b or c or "").split():
            if _FURNITURE.fullmatch(word):
                return 2 if _READERS.search(word) else 3 if _FOREIGN.search(word) else 1
    return 0


def _drop_marked(page: _Page, texts: list[tuple[int, str, bool]]) -> None:
    """Drops the marked elements with all inside, but none around the article.

    Comments go, unless there is no other text. Another mark gives way around the largest main (without one, the largest article)
    outside of comments, around any main or article of half its text, and on pages without either if it holds
    most of the text.
    """
    n = len(page.tag)
    chars, stands, plain = [0] * n, page.marked.copy(), 0
    readers, free = [False] * n, [True] * n
    for e in range(1, n):
        readers[e] = readers[page.parent[e]] or page.marked[e] == 2
        free[e] = free[page.parent[e]] and not page.marked[e]
    for e, t, link in texts:
        if link is not None and not page.dropped[e] and not t.isspace():
            chars[e] += len(t) - t.count(" ")
            plain += free[e]
    if not plain:  # the page's own text lies in an element named like comments
        readers, stands = [False] * n, [min(mark, 1) for mark in stands]
    for e in range(n - 1, 0, -1):
        chars[page.parent[e]] += chars[e]
    whole = [e for e in range(n) if page.tag[e] in _WHOLE and chars[e] and not readers[e]]
    largest = {tag: max((e for e in whole if page.tag[e] == tag), key=chars.__getitem__, default=-1) for tag in _WHOLE}
    first = largest["main"] if largest["main"] >= 0 else largest["article"]
    up = first
    while up > 0:
        stands[up], up = 0, page.parent[up]
    seen = {0}
    for e in whole:
        if chars[e] * 2 >= chars[largest[page.tag[e]]]:
            while e not in seen:
                seen.add(e)
                stands[e], e = 0, page.parent[e]
    for e in range(1, n):
        if first < 0 and stands[e] != 2 and chars[e] * 2 > chars[0]:
            stands[e] = 0
        page.dropped[e] = page.dropped[e] or stands[e] > 0 or page.dropped[page.parent[e]]


def _density(chars: float, tags: float, link_chars: float, link_tags: float, body_share: float) -> float:
    """Composite text density; the logarithm's base is kept at e or more, empty counts at one."""
    if not chars:
        return 0.0
    base = math.log(chars / max(1.0, chars - link_chars) * link_chars + body_share * chars + math.e)
    ratio = chars / max(1.0, link_chars) * tags / max(1.0, link_tags)
    return chars / tags * max(0.0, math.log(max(1.0, ratio))) / max(1.0, math.log(max(base, 1.0)))


def _least_density(page: _Page, texts: list[tuple[int, str, bool]], path: list[int]) -> float:
    """The least density of the path's elements, counted with the furniture of the body."""
    n = len(page.tag)
    chars, link_chars = [0.0] * n, [0.0] * n
    tags, link_tags = [float(t) for t in page.tags], [float(t) for t in page.link_tags]
    for e, t, link in texts:
        if link is not None and not t.isspace() and (size := len(t) - t.count(" ")):
            chars[e] += size
            link_chars[e] += size * link
    for e in range(n - 1, 0, -1):
        if page.tag[e] != "head":
            up = page.parent[e]
            chars[up] += chars[e]
            link_chars[up] += link_chars[e]
            tags[up] += tags[e]
            link_tags[up] += link_tags[e]
    share = link_chars[0] / chars[0]
    return min(_density(chars[e], max(1.0, tags[e]), link_chars[e], link_tags[e], share) for e in path)


def main_text(source: str | None) -> str:
    """The article's blocks, one per line; empty without text."""
    page = _Page(source or "")
    n = len(page.tag)
    chars, link_chars = [0.0] * n, [0.0] * n
    tags, link_tags = [float(t) for t in page.tags], [float(t) for t in page.link_tags]
    texts = [(e, html.unescape(t) if link is not None and "&" in t else t, link) for e, t, link in page.texts]
    if any(page.marked):
        _drop_marked(page, texts)
    for e, t, link in texts:
        if link is not None and not page.dropped[e] and not t.isspace() and (size := len(t) - t.count(" ")):
            chars[e] += size
            link_chars[e] += size * link
    loose_chars, loose_links = chars.copy(), link_chars.copy()
    for e in range(n - 1, 0, -1):  # children come after their parents
        if not page.dropped[e]:
            up = page.parent[e]
            chars[up] += chars[e]
            link_chars[up] += link_chars[e]
            tags[up] += tags[e]
            link_tags[up] += link_tags[e]
    if not chars[0]:
        return ""
    share = link_chars[0] / chars[0]
    density = [0.0 if page.dropped[e] else _density(chars[e], max(1.0, tags[e]), link_chars[e], link_tags[e], share) for e in range(n)]
    total, parents = [0.0] * n, [False] * n
    for e in range(1, n):
        if not page.dropped[e]:
            total[page.parent[e]] += density[e]
            parents[page.parent[e]] = True
    loose = [
        _density(loose_chars[e], max(1.0, page.tags[e]), loose_links[e], page.link_tags[e], share) if parents[e] else density[e]
        for e in range(n)
    ]
    total = [t + d for t, d in zip(total, loose, strict=True)]
    best = max(range(n), key=lambda e: (total[e], -e))

    path, e = [], best
    while e >= 0:
        path.append(e)
        e = page.parent[e]
    tops = [k for k, e in enumerate(path) if page.tag[e] in _WHOLE]
    least = 0.0
    if tops:  # what stands around it must be as dense as the page with its furniture
        path = path[tops[-1] :]
        least = _least_density(page, texts, path)
    top, on_path = path[0], set(path)
    holds = [tag in _WHOLE for tag in page.tag]
    for e in range(n - 1, 0, -1):
        holds[page.parent[e]] |= holds[e] and not page.dropped[e]
    kept, own_kept = [False] * n, [False] * n
    kept[top] = True
    for e in range(1, n):
        up = page.parent[e]
        if page.dropped[e]:
            continue
        beside = up in on_path and up != top and e not in on_path
        kept[e] = kept[e] or kept[up] or (beside and (holds[e] or density[e] >= least) and link_chars[e] * 2 < chars[e])
    for e in path[1:]:
        own_kept[e] = loose[e] >= least and loose_links[e] * 2 < loose_chars[e]

    blocks, current = [], []
    for e, t, link in texts:
        if link is None:
            if current:
                blocks.append("".join(current))
                current = []
        elif kept[e] or own_kept[e]:
            current.append(t)
    if current:
        blocks.append("".join(current))
    return "\n".join(b for b in (_SPACE.sub(" ", x).strip() for x in blocks) if b)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row per input row.

    Character references are decoded, white space within a block becomes one space, blocks are
    joined by one line feed in page order. Null, blank or textless pages give an empty text with 0
    characters. Unclosed tags end with the elements around them. Repeated rows and null ids keep
    their rows, an empty table gives none; other columns are ignored.
    """
    rows = small_batches(pages).select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )
    texts = rows.mapInArrow(_extract, "page_id long, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("long"))
