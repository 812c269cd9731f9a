"""Blocks of text of a page, with the elements around each: a forgiving reader of tags, and what its names say."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

# Element names of HTML by how they lay out text, and by what they hold.
RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea title".split())
SKIPPED = frozenset("head select option datalist button label input dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var "
    "wbr img label input button".split()
)
# An element of the first kind ends an open one of the second kind, unless one of the third stands between.
ENDS_P = frozenset(
    "address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul "
    "li dd dt".split()
)
SIBLINGS = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})), "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})), "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})), "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
}
CONTENT_TAGS = frozenset({"article", "main"})
OTHER_TAGS = frozenset({"nav", "aside", "footer"})
FRAME_TAGS = frozenset({"header", "form"})  # other text, unless the article lies inside them
CONTENT_ROLES = frozenset({"main", "article"})
OTHER_ROLES = frozenset({"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alert"})
OTHER_WORDS = frozenset(
    "ad ads advert advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar rail "
    "footer masthead topbar reply cookie cookies consent gdpr notice notification alert popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social widget pager pagination copyright legal disclaimer "
    "toolbar skip header search".split()
)
# Other text even where it is marked up as articles.
ASIDE_WORDS = frozenset("comment comments disqus respond replies related recommended recommendations teaser teasers".split())
HEADER_WORDS = frozenset({"header", "masthead"})
CONTENT_WORDS = frozenset("article articlebody content entry post story main maincontent prose".split())

TOKEN = re.compile(
    r"<!--(?:.*?--!?>|.*)|<!\[CDATA\[(?:.*?\]\]>|.*)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|</?[a-zA-Z][^>]*+\Z",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Element:
    """An open element: its name, depth and what stands around it."""

    __slots__ = ("name", "parent", "depth", "content", "other", "frame", "holds", "good", "skipped", "inside", "said")

    def __init__(self, name: str, parent: Element | None, attributes: str):
        self.name, self.parent = name, parent
        self.depth = parent.depth + 1 if parent else 0
        self.content = name in CONTENT_TAGS
        self.other = name in OTHER_TAGS
        self.inside = parent is not None and (parent.inside or parent.name == "article")
        self.frame = name in FRAME_TAGS and not (self.inside and name == "header")  # an article's own header has its title
        self.said: tuple[bool, bool, bool] | None = None  # kept by who asks
        self.holds = False  # whether an element that says it is the article lies inside
        self.good = False
        self.skipped = name in SKIPPED or (parent is not None and parent.skipped)
        if attributes and not attributes.isspace():
            self._read(attributes)
        if self.content and not self.other and not self.frame:
            above = parent
            while above is not None and not above.holds:
                above.holds = True
                above = above.parent

    def _read(self, attributes: str) -> None:
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
        role = found.get("role", "").lower()
        words = {w.lower() for w in WORD.findall(f"{found.get('class', '')} {found.get('id', '')}")}
        self.content |= role in CONTENT_ROLES or found.get("itemprop", "").lower() == "articlebody"
        self.other |= role in OTHER_ROLES
        if self.name not in ("html", "body"):
            self.other |= not words.isdisjoint(ASIDE_WORDS)
            self.frame |= not words.isdisjoint(OTHER_WORDS - HEADER_WORDS if self.inside else OTHER_WORDS)
        self.good = not words.isdisjoint(CONTENT_WORDS)
        self.skipped |= "hidden" in found or found.get("aria-hidden", "").lower() == "true" or HIDDEN.search(found.get("style", "")) is not None


class Block:
    """Text that stands together, and the innermost element that lays it out."""

    __slots__ = ("text", "links", "element", "name")

    def __init__(self, text: str, links: int, element: Element):
        self.text, self.links, self.element, self.name = text, links, element, element.name


def blocks(html: str) -> list[Block]:
    """The blocks of a page in order: runs of text between block elements, references decoded, white space as single blanks.

    Text of scripts, styles, hidden elements and form controls is none. Elements that are never closed end where their kind
    of element ends in a browser; closing tags of elements that are not open mean nothing, and neither does a tag that the page
    ends in.
    """
    out: list[Block] = []
    open_ = [Element("html", None, "")]
    pieces: list[tuple[str, bool]] = []
    links = 0  # open links
    held = Counter()  # open elements by name
    at, raw_end = 0, None

    def flush() -> None:
        if not pieces:
            return
        text = " ".join(unescape("".join(t for t, _ in pieces)).split())
        if text:
            inside = sum(len("".join(unescape(t).split())) for t, linked in pieces if linked)
            element = next(e for e in reversed(open_) if e.name not in INLINE)
            out.append(Block(text, min(inside, len(text)), element))
        pieces.clear()

    def close(k: int) -> None:
        """End the open elements from place k on."""
        nonlocal links
        if any(e.name not in INLINE for e in open_[k:]):
            flush()
        links -= sum(e.name == "a" for e in open_[k:])
        held.subtract(e.name for e in open_[k:])
        del open_[k:]

    def ends(kinds: frozenset[str], walls: frozenset[str]) -> None:
        if not any(held[kind] for kind in kinds):
            return None
        for k in range(len(open_) - 1, 0, -1):
            if open_[k].name in kinds:
                return close(k)
            if open_[k].name in walls:
                return None
        return None

    while at <= len(html):
        found = TOKEN.search(html, at) if raw_end is None else raw_end.search(html, at)
        begin = found.start() if found else len(html)
        if raw_end is None and begin > at and not open_[-1].skipped:
            pieces.append((html[at:begin], links > 0))
        if not found:
            break
        at = found.end()
        if raw_end is not None:
            raw_end = None
            continue
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        if found[1] or found[4]:
            if name == "br":
                pieces.append((" ", False))
            elif name != "html" and name != "body":
                if held[name]:
                    close(next(k for k in range(len(open_) - 1, 0, -1) if open_[k].name == name))
            continue
        attributes = found[3] or found[6] or ""
        if name in RAW:
            if not attributes.endswith("/"):
                raw_end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I)
            continue
        if name in VOID:
            if name == "br":
                pieces.append((" ", False))
            elif name == "hr":
                flush()
            continue
        if name in ("html", "body"):
            continue
        if name in ENDS_P:
            ends(frozenset({"p"}), frozenset({"table", "td", "th", "button", "object"}))
        if name in SIBLINGS:
            ends(*SIBLINGS[name])
        if name not in INLINE:
            flush()
        open_.append(Element(name, open_[-1], attributes))
        held[name] += 1
        links += name == "a"
    flush()
    return out
