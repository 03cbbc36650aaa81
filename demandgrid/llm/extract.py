"""Main text of HTML pages by tree scoring (operator 6).

A page becomes a tree of elements.  Blocks of text pass points for length and commas to the element around them, half
of them to the next and a third to the one above; an element's points are discounted by the share of its text that
lies in links.  The best element and those of its siblings that look like more of the same are kept, without menus,
forms, notices and comments inside.

Defined results: a null or empty page, or one without text, gives an empty text; broken markup is repaired as far as
tags can be matched; a page without any element is taken as one block.  Pages are judged one by one: repeated rows and
extra columns don't matter, and a page costs time in proportion to its length, whatever is left open in it."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

TAG = re.compile(r"</?([a-zA-Z][^\s/<>]*)")
STOP = re.compile("[>\"']")
DEEPEST = 512   # elements nested deeper lie beside one another, as browsers have it; no text is lost
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
PARTS = re.compile(r"[a-z]+|\d+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

# Elements of HTML by kind.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript iframe svg math template textarea title object canvas audio video noembed".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
            "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary "
            "table tbody td tfoot th thead tr ul".split())
OPAQUE = set("svg math template object canvas audio video".split())  # of RAW: parsed by HTML, so one left open hides nothing
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
          "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"),
          "tbody": ("thead tbody tr td th", "table"), "tfoot": ("tbody tr td th", "table")}
CLOSES = {k: (set(a.split()), set(b.split())) for k, (a, b) in CLOSES.items()}
DROPPED = set("nav header footer aside form button select option input dialog menu label fieldset head search".split())
ROLES = set("navigation banner complementary contentinfo search dialog alertdialog alert menu menubar form".split())
UNWANTED = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login paywall share sharing "
    "social related recommended recommendations sidebar rail menu nav navbar navigation breadcrumb breadcrumbs footer "
    "foot header masthead comment comments commentlist disqus reply replies respond discussion pagination pager widget "
    "toolbar skip form outbrain taboola teaser byline".split())
# of UNWANTED: names that also stand on parts of an article; they remove nothing that holds its paragraphs
WEAK = set("social related recommended teaser byline rail widget toolbar skip promo promotion share sharing head header notice alert "
           "discussion respond".split())
# of UNWANTED: names whose first word tells what a part is (nav-list), where else the last one does (main-nav)
FIRST = set("ad ads adv advert adverts advertisement cookie cookies consent gdpr newsletter sidebar nav navbar menu breadcrumb breadcrumbs "
            "footer header comment comments disqus share sharing related pagination pager popup modal sponsored".split())
REPLIES = set("comment comments commentlist disqus reply replies respond discussion".split())
SPARED = set("form fieldset label header".split())  # of DROPPED: tags that also wrap whole pages
WANTED = set("article content entry main post story text body prose blog".split())
BASE = {"article": 20, "main": 10, "section": 5, "div": 3, "td": 3, "blockquote": 3, "pre": 3,
        "ul": -3, "ol": -3, "dl": -3, "li": -3, "table": 0, "th": -5}


class Element:
    __slots__ = ("tag", "parent", "parts", "names", "unwanted", "sparable", "weak", "depth", "score", "length", "linked")

    def __init__(self, tag: str, parent: Element | None, names: frozenset[str] = frozenset(), unwanted: bool = False):
        self.tag, self.parent, self.names, self.unwanted = tag, parent, names, unwanted
        self.sparable = self.weak = False
        self.depth = parent.depth + 1 if parent is not None else 0
        self.parts: list = []
        self.score, self.length, self.linked = 0.0, 0, 0


def _meaning(value: str) -> tuple[set[str], set[str]]:
    """Words of a class or id, and those of them that tell what the element is."""
    words, telling = set(), set()
    for token in value.split():
        parts = PARTS.findall(CAMEL.sub(" ", token).lower())
        words.update(parts)
        if parts:
            telling.add("".join(parts))
            telling.add(next((x for x in reversed(parts) if not x.isdigit()), parts[-1]))
            if parts[0] in FIRST:
                telling.add(parts[0])
    return words, telling


def _element(tag: str, attributes: str, parent: Element) -> Element:
    names, telling, hidden = set(), set(), False
    if attributes and not attributes.isspace():
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                words, what = _meaning(value)
                names |= words
                telling |= what
            elif name == "role":
                hidden |= value.lower() in ROLES
            elif name == "style":
                hidden |= "display:none" in value.lower().replace(" ", "")
            elif name == "aria-hidden":
                hidden |= value.lower() == "true"
            else:
                hidden = True
    said = telling & UNWANTED
    named = bool(said) and not (tag in ("body", "html", "main") or tag == "article" and not names & {"comment", "comments", "reply"})
    e = Element(tag, parent, frozenset(names), tag in DROPPED or hidden or named)
    e.sparable = e.unwanted and not hidden and (tag not in DROPPED or tag in SPARED)
    e.weak = e.sparable and said <= WEAK and tag not in DROPPED
    return e


class _Page:
    """Finds tags in time proportional to the page, whatever is left open."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.lower: str | None = None
        self.closings: dict[str, int] = {}

    def tag_end(self, i: int) -> int:
        """Place of the > that ends the tag whose attributes begin at ``i``; a quote that isn't closed is none."""
        page, last = self.page, self.last
        start = i
        while m := STOP.search(page, i):
            c, at = m.group(), m.start()
            if c == ">":
                return at
            if at >= last[c]:
                return page.find(">", at)
            i = page.find(c, at + 1) + 1
            if i > last[">"]:
                break
        return page.find(">", start)

    def closing(self, tag: str, i: int) -> int:
        """Place of the next end tag of the kind, -1 if there is none; one search tells that for the rest of the page."""
        if self.lower is None:
            low = self.page.lower()
            self.lower = low if len(low) == len(self.page) else self.page
        if tag not in self.closings:
            self.closings[tag] = self.lower.rfind(f"</{tag}")
        return self.lower.find(f"</{tag}", i) if i <= self.closings[tag] else -1


def parse(page: str) -> Element:
    """The tree of a page; text lies in ``parts`` between the elements, references decoded."""
    root = Element("html", None)
    at, open_, i, tags = root, {}, 0, _Page(page)

    def say(text: str) -> None:
        if text:
            at.parts.append(html.unescape(text) if "&" in text else text)

    while i < len(page):
        cut = page.find("<", i)
        if cut < 0 or cut > tags.last[">"] and not page.startswith(("<!--", "<![CDATA["), cut):
            say(page[i:])   # nothing ends from here on
            break
        head = TAG.match(page, cut)
        if page.startswith("<!--", cut) or page.startswith("<![CDATA[", cut):
            say(page[i:cut])
            mark = "-->" if page[cut + 2] == "-" else "]]>"
            end = page.find(mark, cut + 4)
            if end < 0:
                break
            i = end + len(mark)
            continue
        if page[cut + 1:cut + 2] in ("!", "?"):
            say(page[i:cut])
            i = page.find(">", cut) + 1
            continue
        end = tags.tag_end(head.end()) if head else -1
        if end < 0:
            say(page[i:cut + 1])
            i = cut + 1
            continue
        say(page[i:cut])
        i, tag, attributes = end + 1, head[1].lower(), page[head.end():end]
        if page[cut + 1] == "/":
            if tag == "br" or not open_.get(tag):
                if tag in ("br", "p"):
                    at.parts.append(Element("br", at))
                continue
            while at.tag != tag:
                open_[at.tag] -= 1
                at = at.parent
            open_[tag] -= 1
            at = at.parent
            continue
        if tag in RAW:
            if attributes.endswith("/") and tag in OPAQUE:
                continue
            end = tags.closing(tag, i)
            if end < 0 and tag in OPAQUE:
                continue
            if end < 0:
                break
            i = page.find(">", end) + 1 or len(page)
            continue
        if tag in ("html", "body"):
            continue
        if tag in VOID:
            at.parts.append(Element(tag, at))
            continue
        if tag in BLOCK and open_.get("p"):  # a block ends an open paragraph and what was left open in it
            up = at
            while up is not root and up.tag != "p" and (up.tag not in BLOCK):
                up = up.parent
            if up.tag == "p":
                while at is not up.parent:
                    open_[at.tag] -= 1
                    at = at.parent
        if tag in CLOSES:
            ends, stop = CLOSES[tag]
            up = at
            while up is not root and up.tag not in ends and up.tag not in stop:
                up = up.parent
            while up is not root and up.tag in ends:
                while at is not up.parent:
                    open_[at.tag] -= 1
                    at = at.parent
                up = at
        child = _element(tag, attributes, at)
        at.parts.append(child)
        if at.depth < DEEPEST and (not attributes.endswith("/") or tag in BLOCK or tag == "a"):
            open_[tag] = open_.get(tag, 0) + 1
            at = child
    return root


def _spare(root: Element) -> None:
    """Containers that hold most of the page's unlinked paragraph text are kept, whatever their tag or name.

    Threads of replies are only spared where the page would have no text without them."""
    held: dict[int, int] = {}
    order, stack = [], [(root, False, False, False)]
    while stack:
        e, paragraph, link, gone = stack.pop()
        paragraph, link = paragraph or e.tag == "p", link or e.tag == "a"
        gone |= e.unwanted and not e.sparable
        order.append(e)
        held[id(e)] = 0
        for x in e.parts:
            if not isinstance(x, str):
                stack.append((x, paragraph, link, gone))
            elif paragraph and not link and not gone:
                held[id(e)] += len(x.strip())
    for e in reversed(order):
        if e.parent is not None:
            held[id(e.parent)] += held[id(e)]
    for e in order:
        if e.sparable and not e.names & REPLIES and 2 * held[id(e)] > held[id(root)]:
            e.unwanted = False
        if e.weak and held[id(e)] and _inside_article(e):
            e.unwanted = False
    if not _blocks(root):
        for e in order:
            e.unwanted &= not e.sparable


def _inside_article(e: Element) -> bool:
    up = e.parent
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    return up is not None


def _walk(root: Element):
    """Elements that aren't unwanted, parents first."""
    stack = [root]
    while stack:
        e = stack.pop()
        yield e
        stack.extend(x for x in reversed(e.parts) if not isinstance(x, str) and not x.unwanted)


def _blocks(top: Element, skipped: set[int] = frozenset()) -> list[tuple[Element, str]]:
    """Texts between block boundaries, in page order, with the element that holds each."""
    out, run, holder = [], [], top

    def flush():
        if text := " ".join("".join(run).split()):
            out.append((holder, text))
        run.clear()

    stack: list = [(top, iter(top.parts))]
    while stack:
        e, parts = stack[-1]
        for x in parts:
            if isinstance(x, str):
                run.append(x)
            elif x.tag == "br":
                run.append("\n")
            elif x.unwanted or id(x) in skipped:
                if x.tag in BLOCK:
                    flush()
                continue
            else:
                if x.tag in BLOCK:
                    flush()
                    holder = x
                stack.append((x, iter(x.parts)))
                break
        else:
            stack.pop()
            if e.tag in BLOCK and stack:
                flush()
                holder = next((f for f, _ in reversed(stack) if f.tag in BLOCK), top)
    flush()
    return out


def _measure(root: Element) -> list[Element]:
    """Text lengths and link lengths of all elements."""
    order = list(_walk(root))
    inside = {id(root): False}
    for e in order:
        link = inside[id(e)] or e.tag == "a"
        for x in e.parts:
            if isinstance(x, str):
                n = len(x.strip())
                e.length += n
                e.linked += n if link else 0
            else:
                inside[id(x)] = link
    for e in reversed(order):
        if e.parent is not None:
            e.parent.length += e.length
            e.parent.linked += e.linked
    return order


def _density(e: Element) -> float:
    return e.linked / e.length if e.length else 0.0


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    _spare(root)
    order = _measure(root)
    blocks = _blocks(root)
    if not blocks:
        return ""
    touched: dict[int, Element] = {}
    for holder, text in blocks:
        if _density(holder) > 0.5:
            continue
        points = 1 + min(text.count(",") + text.count("，"), 10) + min(len(text) / 100, 5)
        # a paragraph's own element is no container; a text lying directly in a box counts for the box
        e = holder.parent if holder.tag in ("p", "pre", "li", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "dd",
                                            "dt", "td", "figcaption") and holder.parent else holder
        for part in (1, 0.5, 1 / 3):
            if e is None:
                break
            if id(e) not in touched:
                touched[id(e)] = e
                e.score = BASE.get(e.tag, 0) + (10 if e.names & WANTED else 0)
            e.score += points * part
            e = e.parent
    if not touched:
        return " ".join(t for _, t in blocks)
    for e in touched.values():
        e.score *= 1 - _density(e)
    best = max((e for e in order if id(e) in touched), key=lambda e: e.score)
    # an article or main element round the best one, with most of its text in it, is the better border
    up = best.parent
    while up is not None:
        if up.tag in ("article", "main") and best.length >= 0.5 * up.length:
            best = up
        up = up.parent
    kept = [best]
    if best.parent is not None and best.tag not in ("article", "main"):
        least = max(10.0, 0.2 * best.score)
        row = [x for x in best.parent.parts if not isinstance(x, str) and not x.unwanted]
        more = [x is best or x.score + (0.2 * best.score if x.names & best.names else 0) >= least and _density(x) < 0.25
                or x.tag == "p" and x.length > 80 and _density(x) < 0.25
                or x.tag == best.tag == "section" and x.length > 0 and _density(x) < 0.25 for x in row]
        first, last = more.index(True), len(more) - 1 - more[::-1].index(True)
        if first and row[first - 1].tag in HEADINGS and _density(row[first - 1]) < 0.5:   # the title above
            first -= 1
        # what stands between parts of an article belongs to it, and so do the paragraphs that go on behind it
        while last + 1 < len(row) and row[last + 1].tag in PROSE and 0 < row[last + 1].length and _density(row[last + 1]) < 0.25:
            last += 1
        kept = [x for i, x in enumerate(row) if first <= i <= last and (more[i] or x.tag in PROSE or x.tag in HEADINGS or not _is_menu(x))]
    texts = []
    for top in kept:
        plain = top.tag not in ("article", "main")
        lists = {id(e) for e in _walk(top) if e is not top and _is_menu(e)} if plain else frozenset()
        texts.extend(t for _, t in _blocks(top, lists))
    return " ".join(texts)


HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
PROSE = set("p blockquote pre figure".split())


def _is_menu(e: Element) -> bool:
    """A list or box of nothing but short links."""
    if e.tag not in ("ul", "ol", "div", "table", "section", "dl", "nav") or _density(e) <= 0.9:
        return False
    links = [x.length for x in _walk(e) if x.tag == "a"]
    return len(links) > 1 and sum(links) < 20 * len(links)


def extract_text(page: Column) -> Column:
    """Main text of an HTML column; never null."""

    @F.arrow_udf("string")
    def extract(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py()) for p in pages], pa.string())

    return extract(page)
