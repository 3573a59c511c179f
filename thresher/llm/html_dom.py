"""A forgiving HTML reader: a flat tree of nodes, and the text of each with its block.

Text that no reader sees (scripts, styles, comments, the head) is left out. Blocks end where block elements begin or end;
inline elements are nodes of their own only where an attribute says what they are. Nothing here recurses, and every
pattern is linear, so deep, long and broken pages cost no more than their length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

# Fixed values of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes noscript template xmp".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: An opening tag ends open elements of these kinds, up to the limits.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|</([a-zA-Z][^\s/>]*+)[^>]*+>?|<([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*+)([^>]*+)>?""", re.S)
#: The same without regard to quotes.
_UNQUOTED = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|</([a-zA-Z][^\s/>]*+)[^>]*+>?|<([a-zA-Z][^\s/>]*+)([^>]*+)>?()()""", re.S)
_ATTR = re.compile(r"""([^\s=>"'/]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++)))?""")


@dataclass
class Page:
    """Nodes in page order; node 0 is the root. pieces: (node, block, text)."""

    tag: list[str] = field(default_factory=lambda: ["#root"])
    attrs: list[dict[str, str]] = field(default_factory=lambda: [{}])
    parent: list[int] = field(default_factory=lambda: [-1])
    pieces: list[tuple[int, int, str, bool]] = field(default_factory=list)

    def add(self, tag: str, attrs: dict[str, str], parent: int) -> int:
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.parent.append(parent)
        return len(self.tag) - 1


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def parse(html: str) -> Page:
    page, block, at, size = Page(), 0, 0, len(html)
    # Open elements: tag, node that texts in it belong to; and the places in it of each tag and of those that aren't inline.
    stack: list[tuple[str, int]] = [("#root", 0)]
    places: dict[str, list[int]] = {}
    blocks = [0]
    in_head, pattern = False, _TAG

    def push(tag: str, node: int) -> None:
        places.setdefault(tag, []).append(len(stack))
        if tag not in INLINE:
            blocks.append(len(stack))
        stack.append((tag, node))

    def pop_to(k: int, ends: bool = True) -> None:
        nonlocal block
        for tag, _ in reversed(stack[k:]):
            places[tag].pop()
            if tag not in INLINE:
                blocks.pop()
                block += ends
        del stack[k:]

    def text(a: int, z: int) -> None:
        if a < z and not in_head:
            t = unescape(html[a:z])
            if t:
                page.pieces.append((stack[-1][1], block, t, bool(places.get("a"))))

    def last(tags: set[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def open_above(tags: set[str], edge: int) -> int:
        """The place of the last open element of these, 0 if it is not above the edge."""
        k = last(tags)
        return k if k > edge else 0

    while at < size:
        lt = html.find("<", at)
        m = pattern.match(html, lt) if lt >= 0 else None
        if lt < 0:
            text(at, size)
            break
        if not m:  # a < that begins no tag
            text(at, lt + 1)
            at = lt + 1
            continue
        text(at, lt)
        at = m.end()
        end, tag = m[1], (m[2] or m[4] or "").lower()
        if m[4]:  # a quote that doesn't close up to the end is searched for once only
            pattern = _UNQUOTED
        if end:
            end = end.lower()
            if end == "head":
                in_head = False
            k = open_above({end}, blocks[-1] if end in INLINE else 0)
            if k and end not in ("html", "body"):
                pop_to(k)
            elif end in ("p", "br"):
                block += end == "p"
            continue
        if not tag:
            continue
        if tag in RAW:
            close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*+>?", re.I).search(html, at)
            at = close.end() if close else size
            block += tag not in ("script", "style", "noscript", "template")
            continue
        if tag == "br":
            if not in_head:
                page.pieces.append((stack[-1][1], block, " ", False))
            continue
        if tag in ("html", "body", "head"):
            in_head = tag == "head"
            if tag == "head" or places.get(tag):
                continue
        elif in_head and tag not in ("meta", "link", "base"):
            in_head = False
        if tag in CLOSES_P and (k := open_above({"p"}, last({"table", "td", "th", "button"}))):
            pop_to(k)
        if tag in IMPLIED:
            kinds, limits = IMPLIED[tag]
            while k := open_above(kinds, last(limits)):
                pop_to(k)
        block += tag not in INLINE and (tag not in VOID or tag == "hr")
        if tag in VOID:
            continue
        attrs = attributes(m[3] or m[5] or "")
        inline = tag in INLINE
        own = not inline or bool({"class", "id", "role", "hidden", "aria-hidden", "style"} & attrs.keys())
        push(tag, page.add(tag, attrs, stack[-1][1]) if own else stack[-1][1])
        if (m[3] or "").endswith("/") and inline is False and tag not in CLOSES_P:
            pop_to(len(stack) - 1, ends=False)  # <x/> of an unknown kind
    return page


def block_texts(page: Page, keep) -> list[str]:
    """Texts of the blocks of the nodes that are kept, white space as one space, without empty ones."""
    out: list[str] = []
    parts: list[str] = []
    now = -1
    for node, block, t, _ in page.pieces:
        if block != now:
            out.append(" ".join("".join(parts).split()))
            parts, now = [], block
        if keep[node]:
            parts.append(t)
    out.append(" ".join("".join(parts).split()))
    return [x for x in out if x]
