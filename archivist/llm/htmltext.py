"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text. All blocks with the same root-to-leaf path of tags, classes and ids
are taken together: the mean and deviation of their text's length and of their punctuation, less
their share of link text, are fused into one ratio a path. The ratios are smoothed along the page and
compared with their standard deviation; the paths above it are content paths. Elements that can't be
content by their tag are left out before; a role or a name that pages use for what is not content only
lowers the ratio of its paths. The innermost container with nearly all text on content paths is the
article. Of it come all blocks on content paths and those that stand among them; containers in it
without content paths go if they are marked, or if they come before or after all content.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from statistics import fmean, pstdev

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivist.llm.common import small_batches

# Elements of HTML by kind, and names by which pages mark what is not content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
CONTAINER = frozenset("html body div section article main center table tbody tr td fieldset form details header".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER = frozenset(
    "head script style noscript template iframe svg math canvas object audio video map button select option textarea input "
    "datalist dialog nav footer aside menu title xmp noembed noframes".split()
)
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments "
    "commentlist consent cookie cookies discussion disqus footer gdpr login masthead menu menus navbar navigation newsletter notice "
    "notices outbrain overlay pager pagination popup promo promotion replies respond shoutbox sidebar sidebars signin signup sponsor "
    "sponsored subscribe taboola toolbar topbar".split()
)
#: Words beside a name that don't make it another one.
NEUTRAL = frozenset("area bar block bottom box container content footer header inner left list main outer page post right section site slot thread top wrap wrapper unit".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: By how much a role or name lowers the ratio of paths below it.
MARKED = 0.02
#: The share of the content paths' text that a container holds to be the article or around it.
NEARLY_ALL = 0.8
#: The share that an element which says that it is an article holds to be it, whatever stands beside it.
MOST = 0.5
#: A start tag of the key ends an open element of these names, up to the nearest of the last list.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
SCOPE = frozenset("td th caption table button object article section main aside body html div blockquote li".split())

_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_INSIDE = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCTUATION = re.compile(r"[.,;:!?。，！？；：、]")


class _Node:
    """An open element; what it has from its ancestors is worked out once, when it opens."""

    __slots__ = ("box", "byline", "head", "inside", "marked", "never", "parent", "path", "tag", "title")

    def __init__(self, tag: str, parent: _Node | None, attributes: str, paths: dict) -> None:
        self.tag, self.parent = tag, parent
        never, marked, name = _marks(tag, attributes)
        up = parent or self
        if parent is None:
            self.inside = self.head = self.title = self.byline = self.never = False
            self.path, self.box, self.marked = 0, self, 0
            return
        self.inside = up.inside or up.tag in ("article", "main")
        self.head, self.title = up.head or tag in HEADING, up.title or tag == "h1"
        self.never = up.never or never
        self.byline = up.byline or (tag == "header" and up.inside)
        self.marked = up.marked + (marked or (tag == "header" and not up.inside))  # how many around are
        self.box = self if tag in CONTAINER else up.box
        self.path = paths.setdefault((up.path, tag, name), len(paths) + 1) if tag in BLOCK else up.path


#: Numeric references with more digits than any character has; leading zeros count no value.
_LONG = re.compile(r"&#(?:([xX])([0-9a-fA-F]{8,})|([0-9]{8,}))")


def decoded(raw: str) -> str:
    """``raw`` with character references decoded once; a number beyond all characters is U+FFFD."""

    def short(m: re.Match) -> str:
        digits = (m[2] or m[3]).lstrip("0") or "0"
        return f"&#{m[1] or ''}{digits}" if len(digits) <= 7 else "&#xFFFD"

    return html.unescape(_LONG.sub(short, raw) if "&#" in raw else raw)


class _Block:
    __slots__ = ("linked", "node", "parts", "text")

    def __init__(self, node: _Node) -> None:
        self.node, self.parts, self.text, self.linked = node, [], "", 0


def _marks(tag: str, attributes: str) -> tuple[bool, bool, str]:
    """Whether an element can't be content, whether its role or name says that it isn't, and its
    classes and id with numbers as one sign. A name is a class or id of only such words."""
    never, marked, names = tag in NEVER, tag == "form", []
    if "=" in attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            value, name = "".join(values), name.lower()
            if name == "role":
                marked |= value.lower() in ROLES
            elif name in ("class", "id"):
                for part in value.split():
                    words = {w.lower() for w in _WORD.findall(part)}
                    marked |= bool(words & NAMES) and words <= NAMES | NEUTRAL and tag not in ("html", "body", "main")
                    names.append(re.sub(r"[0-9]+", "0", part))
    return never, marked, " ".join(sorted(names))


def _tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, attributes) of each tag, in one pass over the page. A quote in a tag
    counts if it is closed, and what is in it holds no angle bracket or it ends where a value does.
    Comments and declarations have no name."""
    at, size, next_at = 0, len(page), {}

    def ahead(sign: str, start: int) -> int:
        found = next_at.get(sign, -1)
        if found < start:  # what is ahead is looked up once
            found = page.find(sign, start)
            next_at[sign] = found = size if found < 0 else found
        return found

    while (m := _OPEN.search(page, at)) is not None:
        if m[2] is None:
            if m[0] == "<!--":
                end = page.find("-->", m.start() + 2)
                at = size if end < 0 else end + 3
            else:
                end = page.find(">", m.end())
                at = size if end < 0 else end + 1
            yield m.start(), at, "", "", ""
            continue
        end = m.end()
        while (sign := _INSIDE.search(page, end)) is not None and sign[0] != ">":
            end = sign.end()
            close = ahead(sign[0], end)
            if close < size and (min(ahead("<", end), ahead(">", end)) > close or page[close + 1 : close + 2] in (" ", "\n", "\t", "\r", "/", ">")):
                end = close + 1
        if sign is None:  # never closed: text, and so is all that follows without another tag
            if ahead(">", m.end()) >= size:
                return
            end = ahead(">", m.end())
            yield m.start(), end + 1, m[1], m[2].lower(), page[m.end() : end]
            at = end + 1
            continue
        at = sign.end()
        yield m.start(), at, m[1], m[2].lower(), page[m.end() : sign.start()]


def blocks_of(page: str) -> list[_Block]:
    """All blocks of the page in order, with the element that holds each."""
    paths: dict = {}
    root = _Node("#", None, "", paths)
    stack, blocks, now, links, at, size, opened = [root], [], None, 0, 0, len(page), Counter()

    def text(value: str) -> None:
        nonlocal now
        if now is None:
            if not value.strip():
                return
            now = _Block(stack[-1])
            blocks.append(now)
        now.parts.append(value)
        if links:
            now.linked += len(value.strip())

    def cut(k: int) -> None:
        nonlocal links
        for x in stack[k:]:
            opened[x.tag] -= 1
            links -= x.tag == "a"
        del stack[k:]

    for start, end, slash, tag, attributes in _tags(page):
        if start < at:  # within what was passed over
            continue
        if start > at:
            text(decoded(page[at:start]))
        at = end
        if not tag:
            if page.startswith("<![CDATA[", start):
                stop = page.find("]]>", start)
                at = size if stop < 0 else stop + 3
                text(page[start + 9 : stop if stop >= 0 else size])
            continue
        if tag in BLOCK:
            now = None
        if slash:
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k].tag == tag:
                    cut(k)
                    break
                if tag not in BLOCK and stack[k].tag in BLOCK:
                    break
            continue
        if tag == "br":
            if now is not None:
                now.parts.append(" ")
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}", re.I).search(page, at)
            at = size if stop is None else page.find(">", stop.end()) + 1 or size
            continue
        ends, until = CLOSES.get(tag, (("p",), SCOPE) if tag in BLOCK else ((), ()))
        for k in range(len(stack) - 1, 0, -1) if any(opened[x] for x in ends) else ():
            if stack[k].tag in ends:
                cut(k)
                break
            if stack[k].tag in until:
                break
        if attributes.endswith("/") and tag not in BLOCK:
            continue
        stack.append(_Node(tag, stack[-1], attributes, paths))
        opened[tag] += 1
        links += tag == "a"
    if at < size:
        text(decoded(page[at:]))
    for b in blocks:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in blocks if b.text]


def ratios(blocks: list[_Block]) -> dict[int, float]:
    """The fused ratio of each path: length and punctuation of its blocks, means and deviations, less
    the share of links, lowered where a role or name marks it."""
    of = defaultdict(list)
    for b in blocks:
        of[b.node.path].append(b)
    found = {}
    for path, some in of.items():
        size, marks = [len(b.text) for b in some], [len(_PUNCTUATION.findall(b.text)) for b in some]
        linked = sum(min(b.linked, n) for b, n in zip(some, size, strict=True)) / sum(size)
        found[path] = (fmean(size) + pstdev(size)) * (1 + fmean(marks) + pstdev(marks)) * (1 - linked) * MARKED ** some[0].node.marked
    return found


def content_paths(blocks: list[_Block]) -> set[int]:
    """The paths whose smoothed ratio reaches the standard deviation of all blocks' smoothed ratios
    (the best path if none does)."""
    ratio = ratios(blocks)
    line = [ratio[b.node.path] for b in blocks]
    ends = [line[0], *line, line[-1]]
    smooth = [(ends[k] + 2 * ends[k + 1] + ends[k + 2]) / 4 for k in range(len(line))]
    by_path, marked = defaultdict(list), {b.node.path: b.node.marked for b in blocks}
    for b, value in zip(blocks, smooth, strict=True):
        by_path[b.node.path].append(value)
    # neighbours alone make no content, least of all of what is marked
    mean = {p: min(fmean(v), (1 if marked[p] else 2) * ratio[p]) for p, v in by_path.items()}
    limit = threshold(smooth)
    return {p for p, value in mean.items() if value >= limit and value > 0} or {max(mean, key=mean.__getitem__)}


def threshold(smooth: list[float]) -> float:
    return pstdev(smooth)


def _up(node: _Node | None, top: _Node | None = None) -> Iterator[_Node]:
    while node is not None and node is not top:
        yield node
        node = node.parent


def main_text(page: str | None) -> str:
    """The article of a page: white space inside a block is one space, blocks are joined by one."""
    every = [b for b in blocks_of(page or "") if not b.node.never]
    if not every:
        return ""
    picked = content_paths(every)
    content = [b.node.path in picked for b in every]
    held, inner, order = Counter(), defaultdict(dict), []
    boxes = Counter()  # text on content paths that a container holds outside containers in it
    for b, good in zip(every, content, strict=True):
        boxes[b.node.box] += len(b.text) * good
    seen = {}
    for box in boxes:  # parents before children
        line = []
        while box is not None and box not in seen:
            seen[box] = True
            line.append(box)
            box = box.parent.box if box.parent is not None else None
        order += reversed(line)
    for box in reversed(order):
        held[box] += boxes[box]
        if box.parent is not None:
            held[box.parent.box] += held[box]
            inner[box.parent.box][box] = True
    top, total = order[0], held[order[0]]
    articles = [box for box in order if box.tag == "article"]
    largest = max(articles, key=held.__getitem__, default=None)
    if largest is not None and held[largest] > MOST * total:
        top = largest
    while top.tag != "article":
        best = max(inner[top], key=held.__getitem__, default=None)
        if best is None or held[best] < NEARLY_ALL * total:
            break
        top = best
    first, last = content.index(True), len(content) - 1 - content[::-1].index(True)
    stays: dict[_Node, bool] = {top: True}

    def box_stays(box: _Node, k: int) -> bool:
        """Whether the container of block k and those around it have content or stand among it."""
        line = []
        while box not in stays:
            line.append(box)
            box = box.parent.box
        for x in reversed(line):
            within = held[x] > 0 or (x.marked <= top.marked and (x.inside or first < k < last))
            stays[x] = stays[x.parent.box] and within
        return stays[line[0]] if line else stays[box]

    out, before, titled, below = [], [], False, {}
    for k, (b, good) in enumerate(zip(every, content, strict=True)):
        node = b.node
        if node.box not in below:
            below[node.box] = node.box is top or (node.box.parent is not None and _below(node.box, top, below))
        if not below[node.box]:
            if node.title and not out and node.box.marked <= top.marked:
                before.append(b.text)
            continue
        if not box_stays(node.box, k) and not (node.head and node.byline):
            continue
        if not good and (b.linked > 0.6 * len(b.text) or (node.byline and not node.head) or node.marked > top.marked):
            continue
        titled |= node.title
        out.append(b.text)
    return " ".join(out if titled else before[-1:] + out)


def _below(box: _Node, top: _Node, known: dict[_Node, bool]) -> bool:
    """Whether ``top`` is around ``box``; what is found on the way is kept in ``known``."""
    line = []
    while box not in known and box is not top and box.parent is not None:
        line.append(box)
        box = box.parent.box
    found = box is top or known.get(box, False)
    known.update(dict.fromkeys(line, found))
    return found


def extract(column: Column | str) -> Column:
    """A struct (text, n_chars) for a column of whole pages; null or no text: empty, 0."""

    def run(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in pages:
            found = [main_text(p) for p in batch]
            yield pd.DataFrame({"text": found, "n_chars": [len(t) for t in found]})

    return F.pandas_udf(run, "text string, n_chars long")(column)


def html_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html).

    Null and empty pages and pages without content have an empty text; repeated rows are extracted
    alike; broken markup is read as far as it goes; very long pages are read whole, in time that grows
    with their length; other columns are ignored.
    """
    small_batches(pages.sparkSession)
    found = pages.select("page_id", "url", extract(F.col("html")).alias("x"))
    return found.select("page_id", "url", "x.text", "x.n_chars")
