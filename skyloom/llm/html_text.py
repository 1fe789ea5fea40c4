"""Main text of web pages by tag-path ratios.

A page is cut into blocks: runs of text between the tags of block-level
elements, each with its path of open elements.  For every root-to-leaf path
the lengths of its blocks' texts (links counted apart) and their punctuation
marks are summed over the page; a path's ratio is text per block, weighed by
punctuation per block and by the share of text outside links.  What element
names, classes, ids and roles say (an article, a sidebar, reader comments, a form)
is a prior that weighs the ratio.  The fused ratios are smoothed along the
blocks in page order, and blocks above a share of the best one are content nodes.

The content nodes decide which part of the page is the article: the deepest
element that holds ``MASS`` of their text, and the elements around it as long
as these add nothing but headings before it, content nodes, or what priors call
content.  Its text are the blocks in it, but for elements that are boilerplate by their kind
(nav, aside, hidden ones), blocks of low ratio whose names say boilerplate, and
paths that are links and little else.

Names never decide by themselves: they count for nothing on html and body, nor
on an element that holds the page's article or most of its text
(``weigh_names``).  A page of text without any container is taken block by block,
with the headings right before content nodes.

All passes are linear in the page, however deep its elements are nested.

Edge cases: a null or empty page and a page without text have the empty text;
unclosed and stray tags, truncated pages and comments without an end are
accepted; character references without an end are decoded as browsers do;
repeated pages give one row each; an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_of

#: Share of the best block's smoothed ratio from which a block is a content node.
SHARE = 0.15
#: Weights of a block and its neighbours at distances 1 and 2.
KERNEL = (1.0, 0.35, 0.1)
LIKELY, UNLIKELY = 6.0, 0.05
#: Share of the content nodes' text that the article holds.
MASS = 0.9
#: Share of its text outside links below which a path is a list of links.
PLAIN = 0.2
#: An element whose names say boilerplate is none if it has so many times the text outside all such elements; an article needs as much.
MOST_TEXT = 4

# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe object canvas textarea select title".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are a piece of a text and never all of it.
PIECES = HEADINGS | frozenset("p li dt dd td th tr pre blockquote figcaption summary address caption option legend".split())
#: A start tag of the key ends an open element of the value, if nothing of the barrier is between.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr"), "tfoot": ("tbody", "tr")}
BARRIER = frozenset("ul ol dl table body html div article section main select".split())
BOILERPLATE = frozenset("nav footer aside menu dialog button head search".split())
MAIN = frozenset("article main".split())
#: What classes and ids of these say is about the page.
PAGE = frozenset("html body".split())
# Words of classes, ids and roles.
BAD_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline comment comments complementary consent contentinfo cookie cookies disqus footer footnav gdpr masthead menu menubar modal nav navbar navigation newsletter notice notification pagination pager popup promo promoted promotion recommended related reply replies respond search share sharing shoutbox sidebar sidebars signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split())
#: Those that say nothing beside another word ("market-share").
OFTEN_ELSE = frozenset("banner notice related replies reply respond search share sharing skip social tags".split())
GOOD_WORDS = frozenset("article articlebody body content entry main maincontent post story text".split())

#: Most tags: nothing in them needs a look beyond the next angle bracket.
_SIMPLE = re.compile(r"<(/?)([a-zA-Z][^\s/<>\"']*)((?:[^<>\"']++|\"[^<>\"]*+\"|'[^<>']*+')*+)>")
_NAMED = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_CUT_OFF = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")
_SPECIAL = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？]")


class _Ends:
    """For each place of a page the bracket that ends a tag there, brackets in quotes not counting; all found in one pass from the page's end."""

    def __init__(self, page: str):
        self.at = [m.start() for m in _SPECIAL.finditer(page)]
        self.end = [-1] * (len(self.at) + 1)
        later = {'"': -1, "'": -1}
        for i in range(len(self.at) - 1, -1, -1):
            sign = page[self.at[i]]
            if sign == ">":
                self.end[i] = self.at[i]
            else:
                self.end[i] = self.end[later[sign] + 1] if later[sign] >= 0 else -1
                later[sign] = i

    def after(self, place: int) -> int:
        return self.end[bisect_left(self.at, place)]


def tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, attributes) of each piece of markup; the name is empty if it is none of an element's.

    Each ``<`` is looked at once, and what is looked at behind it is skipped or
    was found before, so the work is linear in any page.
    """
    ends: _Ends | None = None
    last, at = page.rfind(">"), page.find("<")
    while at >= 0:
        found = None
        if m := _SIMPLE.match(page, at):
            found = (at, m.end(), m[1], m[2].lower(), m[3])
        elif page.startswith("<!--", at):
            close = page.find("-->", at + 4)
            found = (at, len(page) if close < 0 else close + 3, "", "", "")
        elif at > last:
            found = (at, len(page), "", "", "") if _CUT_OFF.match(page, at) else None
        elif m := _NAMED.match(page, at):
            ends = ends or _Ends(page)
            end = ends.after(m.end())
            # A quote that nothing closes is no quote: the tag ends at the next bracket.
            found = (at, (end if end >= 0 else page.find(">", m.end())) + 1, m[1], m[2].lower(), page[m.end() : end] if end >= 0 else "")
        elif page[at + 1 : at + 2] in ("!", "?", "/"):
            found = (at, page.find(">", at) + 1, "", "", "")
        if found is None:
            at = page.find("<", at + 1)
        else:
            resume = yield found
            at = page.find("<", found[1] if resume is None else resume)


@dataclass(slots=True, eq=False)
class Element:
    name: str
    path: int  # a number for the names from the root to here
    parent: Element | None
    drop: bool  # boilerplate by the kind of an element here or above
    hint: bool  # its own names say boilerplate
    good: bool
    within: bool  # something good is here or above
    scope: Counter  # open elements by name, up to the nearest barrier
    holder: Element | None = None  # the innermost block that holds a piece of a line; none for a block itself
    hinted: bool = False  # a hint is here or above
    bad: bool = False  # drop, or a hint that counts is here or above
    free: int = 0  # letters outside links, in it
    mass: int = 0  # letters of content nodes, in it
    inside: bool = False  # the article, or in it


@dataclass(slots=True)
class Block:
    element: Element
    parts: list[str]
    linked: int = 0
    text: str = ""


def _hints(attributes: str) -> tuple[bool, bool, bool]:
    """Whether classes, id and role name boilerplate, and content; and whether the element is hidden."""
    bad = good = hidden = False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if name in ("hidden", "aria-hidden"):
            hidden |= value.lower() in ("true", "hidden")
            continue
        for item in value.split():
            words = [w.lower() for w in _WORDS.findall(item)]
            worse = [w for w in words if w in BAD_WORDS]
            bad |= 2 * len(worse) > len(words) or any(w not in OFTEN_ELSE for w in worse)
            good |= any(w in GOOD_WORDS for w in words)
    return bad, good, hidden


def blocks(page: str) -> tuple[list[Block], list[Element]]:
    """Blocks with text, in page order, white space made one space and character references decoded; and the elements, each behind the one it stands in."""
    root = Element("", 0, None, False, False, False, False, Counter())
    elements = [root]
    opened: Counter = Counter()
    here, out = root, []
    link = 0
    current: Block | None = None

    def close_until(element: Element) -> None:
        nonlocal here, current, link
        while here is not element:
            opened[here.name] -= 1
            here.parent.scope[here.name] -= 1
            if here.name == "a":
                link = max(0, link - 1)
            if here.name in BLOCK:
                current = None
            here = here.parent

    def take(text: str) -> None:
        nonlocal current
        if not text:
            return
        if current is None:
            if text.isspace():
                return
            current = Block(here.holder or here, [])
            out.append(current)
        current.parts.append(text)
        if link:
            current.linked += len(text)

    at, n = 0, len(page)
    scan, resume = tags(page), None
    while True:
        try:
            start, end, slash, name, attributes = scan.send(resume)
        except StopIteration:
            take(page[at:])
            break
        take(page[at:start])
        at, resume = end, None
        if not name:
            continue
        if slash:
            if opened[name] > 0:
                element = here
                while element.name != name:
                    element = element.parent
                close_until(element.parent)
            elif name in BLOCK:
                current = None
            continue
        if name in VOID:
            if name == "br":
                take(" ")
            elif name == "hr":
                current = None
            continue
        if name in RAW:
            if name == "svg" and page.endswith("/>", start, end):
                continue
            close = re.compile(rf"</{re.escape(name)}\b", re.IGNORECASE).search(page, at)
            end = -1 if close is None else page.find(">", close.end())
            at = resume = n if end < 0 else end + 1
            if name in BLOCK:
                current = None
            continue
        ends = ("p",) if name in BLOCK else ()
        for closed in (*ends, *CLOSES.get(name, ())):
            if here.scope[closed] > 0:
                element = here
                while element.name != closed:
                    element = element.parent
                close_until(element.parent)
        bad, good, hidden = _hints(attributes) if attributes else (False, False, False)
        if name in PAGE:
            bad = good = False
        if name in BLOCK:
            current = None
        if name == "a":
            link += 1
        outside = name == "header" and not any(opened[n] > 0 for n in MAIN)
        good |= name in MAIN
        opened[name] += 1
        here.scope[name] += 1
        scope = Counter() if name in BARRIER else here.scope
        here = Element(name, hash((here.path, name)), here, here.drop or hidden or name in BOILERPLATE or outside, bad or name == "form", good, good or here.within, scope, None if name in BLOCK else here.holder or here)
        elements.append(here)
    for block in out:
        block.text = " ".join(html.unescape("".join(block.parts)).split())
    found = [b for b in out if b.text]
    weigh_names(found, elements)
    return found, elements


def weigh_names(found: list[Block], elements: list[Element]) -> None:
    """Set ``bad``: names that say boilerplate count, but on the element that holds the page's article, or most of its text, and those around it."""
    for e in elements[1:]:
        e.hinted = e.hint or e.parent.hinted
    if any(e.hint for e in elements):
        plain = named = 0  # text outside all such elements, and that in something good
        for b in found:
            free = len(b.text) - min(b.linked, len(b.text))
            if b.element.drop:
                continue
            if not b.element.hinted:
                plain += free
                named += free if b.element.within else 0
            else:
                b.element.free += free
        # Text is handed up to the innermost element with such names, and counts for each article or main on its way.
        for e in reversed(elements[1:]):
            if not e.hint:
                e.parent.free += e.free
        holders = [e for e in elements[1:] if e.hinted and (e.hint or e.name in MAIN) and e.free >= (max(1, plain) if e.name in MAIN else max(1, MOST_TEXT * plain)) and (e.name in MAIN or not named)]
        holders = [e for e in holders if e.name == "main"] or holders
        if holders:
            e = max(holders, key=lambda h: h.free)
            while e.parent is not None:
                e.hint = False
                e = e.parent
    for e in elements[1:]:
        e.hinted = e.hint or e.parent.hinted
        e.bad = e.drop or e.hinted


def ratios(found: list[Block]) -> list[float]:
    """Fused tag-path ratio of each block, smoothed along the blocks; that of a bad one, or of one of a path of links, is its own, so that its neighbours do not raise it."""
    sums: dict[tuple, list[float]] = {}
    keys = []
    for b in found:
        key = (b.element.path, b.element.bad)
        keys.append(key)
        own = sums.setdefault(key, [0.0, 0.0, 0.0, 0.0])
        own[0] += 1
        own[1] += len(b.text)
        own[2] += len(_PUNCTUATION.findall(b.text))
        own[3] += min(b.linked, len(b.text))
    fused = []
    for b, key in zip(found, keys, strict=True):
        n, text, marks, linked = sums[key]
        prior = UNLIKELY if b.element.bad else LIKELY if b.element.within else 1.0
        fused.append((text - linked) / n * (1 + math.log1p(marks / n)) * (1 - linked / text) * math.sqrt(n) * prior)
    out = []
    for i in range(len(fused)):
        total = weight = 0.0
        for d in range(-2, 3):
            if 0 <= i + d < len(fused):
                total += KERNEL[abs(d)] * fused[i + d]
                weight += KERNEL[abs(d)]
        _, text, _, linked = sums[keys[i]]
        out.append(fused[i] if found[i].element.bad or text - linked < PLAIN * text else total / weight)
    return out


def main_text(page: str) -> str:
    found, elements = blocks(page)
    scores = ratios(found)
    best = max((s for s, b in zip(scores, found, strict=True) if not b.element.drop), default=None)
    if best is None:
        return ""
    least = SHARE * best
    content = [not b.element.drop and s >= least for s, b in zip(scores, found, strict=True)]
    links: dict[tuple, list[int]] = {}
    for b in found:
        own = links.setdefault((b.element.path, b.element.bad), [0, 0])
        own[0] += len(b.text)
        own[1] += min(b.linked, len(b.text))
    listed = {key for key, (text, linked) in links.items() if text - linked < PLAIN * text}
    fit = [c or not (b.element.bad or (b.element.path, False) in listed) for c, b in zip(content, found, strict=True)]
    article = container(found, content, fit, elements)
    if article is None:
        fit = [c or (b.element.name in HEADINGS and f and i + 1 < len(found) and content[i + 1]) for i, (b, c, f) in enumerate(zip(found, content, fit, strict=True))]
    else:
        for e in elements[1:]:
            e.inside = e is article or e.parent.inside
    return "\n".join(b.text for b, f in zip(found, fit, strict=True) if f and (article is None or b.element.inside))


def container(found: list[Block], content: list[bool], fit: list[bool], elements: list[Element]) -> Element | None:
    """The article's element, or None if that is the page itself."""
    first: dict[Element, int] = {}
    extra: Counter = Counter()  # fit blocks in an element that speak against it: neither content nor called so
    heads: Counter = Counter()  # the same, of headings
    for i, (b, c, f) in enumerate(zip(found, content, fit, strict=True)):
        first.setdefault(b.element, i)
        if c:
            b.element.mass += len(b.text)
        elif f and b.element.name in HEADINGS:
            heads[b.element] += 1
        elif f:
            extra[b.element] += 1
    total = sum(len(b.text) for b, c in zip(found, content, strict=True) if c)
    for e in reversed(elements[1:]):
        e.parent.mass += e.mass
        extra[e.parent] += extra[e]
        heads[e.parent] += heads[e]
        if e in first:
            first[e.parent] = min(first[e], first.get(e.parent, len(found)))
    here = elements[0]
    for e in elements[1:]:  # each element that holds so much stands in the one before
        if e.mass >= MASS * total and e.parent is here:
            here = e
    while here.parent is not None and (here.name in PIECES or here.name not in BLOCK):
        here = here.parent
    # An element around it is the article if it adds no other text than headings before, or if it is called so.
    element = here
    while element.parent is not None and element.parent.name not in ("", *PAGE):
        element = element.parent
        if element.good or (extra[element] == extra[here] and (heads[element] == heads[here] or first[element] < first[here])):
            here = element
    return None if here.name in ("", *PAGE) else here


def _texts(pages: pa.Array) -> pa.Array:
    texts = [main_text(p.as_py()) for p in pages]
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    small_batches(pages.sparkSession)
    found = pages.select("page_id", "url", F.arrow_udf(_texts, "text string, n_chars long")(text_of("html")).alias("found"))
    return found.select("page_id", "url", "found.text", "found.n_chars")
