"""A forgiving HTML reader: flat arrays of DOM nodes from whole, possibly broken pages."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea title xmp iframe noembed noframes template".split())
HIDDEN = frozenset("script style noscript template head title iframe object embed svg math canvas select option datalist textarea button input".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
# an opening tag of the key closes an open element of the values, up to a boundary
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "thead": {"caption"},
}
ENDS_P = BLOCKS - {"br", "option", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html", "legend"}
BOUNDARY = frozenset("table ul ol dl div section article aside nav main header footer form body html td th blockquote".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)  # the last one: a quote that never closes
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")


@dataclass
class Page:
    """Elements in page order, and the texts between them."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)
    text_node: list[int] = field(default_factory=list)  # the element that holds each text
    text: list[str] = field(default_factory=list)
    marks: list[int] = field(default_factory=list)  # number of elements opened before each text
    edges: list[int] = field(default_factory=list)  # number of block boundaries before each text


class _Open:
    """The stack of open elements. It knows where each tag name is open, so that no look-up walks the stack."""

    def __init__(self, page: Page):
        self.page, self.stack, self.at = page, [], {}

    def push(self, node: int) -> None:
        self.at.setdefault(self.page.tag[node], []).append(len(self.stack))
        self.stack.append(node)

    def last(self, names) -> int:
        """The highest place of the stack that holds one of the names, 0 if none does."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=0)

    def close(self, place: int) -> None:
        """Close all elements from a place on."""
        for node in reversed(self.stack[place:]):
            self.at[self.page.tag[node]].pop()
        del self.stack[place:]


def parse(source: str) -> Page:
    """Read a page in time linear in its length. Open elements close at their end tag, implied ends and the end of the page;
    stray ends are ignored."""
    page = Page()
    opened = _Open(page)
    seen = {"html"}
    edge = 0

    def open_(name: str, attributes: str) -> int:
        page.tag.append(name)
        page.parent.append(opened.stack[-1] if opened.stack else -1)
        page.depth.append(len(opened.stack))
        page.attributes.append(attributes)
        return len(page.tag) - 1

    opened.push(open_("html", ""))

    def add(piece: str) -> None:
        if piece:
            page.text_node.append(opened.stack[-1])
            page.text.append(piece)
            page.marks.append(len(page.tag))
            page.edges.append(edge)

    def close_within(names, boundary) -> None:
        nonlocal edge
        place = opened.last(names)
        if place > opened.last(boundary):
            opened.close(place)
            edge += 1

    at, end = 0, len(source)
    while at < end:
        m = _TOKEN.search(source, at)
        if not m:
            add(source[at:])
            break
        add(source[at : m.start()])
        at = m.end()
        closing, opening, rest, broken, broken_rest = m.groups()
        opening, rest = opening or broken, rest or broken_rest
        if opening:
            name = opening.lower()
            if name in ("html", "body"):
                if name in seen:
                    continue
                seen.add(name)
            if name in ENDS_P:
                close_within(("p",), BOUNDARY)
            if name in CLOSES:
                close_within(CLOSES[name], BOUNDARY - CLOSES[name] - ({"td", "th"} if name in ("tr", "tbody", "tfoot") else frozenset()))
            if name in BLOCKS:
                edge += 1
            node = open_(name, rest or "")
            if name in VOID or (rest or "").endswith("/") and name in ("svg", "path"):
                continue
            opened.push(node)
            if name in RAW:
                stop = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                add(source[at : stop.start() if stop else end])
                opened.close(len(opened.stack) - 1)
                at = stop.end() if stop else end
        elif closing:
            name = closing.lower()
            if name == "br" or name == "p" and not opened.at.get("p"):
                edge += 1
                continue
            if place := opened.last((name,)):
                opened.close(place)
            if name in BLOCKS:
                edge += 1
    return page


def attribute_words(attributes: str) -> list[str]:
    """Lower-cased words of class, id, role and similar attributes, and attribute names that tell by themselves."""
    out = []
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role", "itemprop", "aria-label", "data-role", "name"):
            spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", a or b or c)
            out += [w for w in re.split(r"[^a-z]+", spaced.lower()) if w]
        elif name in ("hidden", "href", "onclick") or name == "style" and "display:none" in (a or b or c).replace(" ", ""):
            out.append("hidden" if name != "href" and name != "onclick" else name)
    return out


def clean(piece: str) -> str:
    """Decode character references and fold white space."""
    return _SPACE.sub(" ", html.unescape(piece) if "&" in piece else piece)
