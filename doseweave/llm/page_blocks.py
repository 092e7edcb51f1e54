"""Leaf blocks of an HTML page with the ancestor tags and text features that the block labeller reads."""

from __future__ import annotations

import re
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style template head title iframe svg".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var label wbr br img "
    # Formulae, pictures and media stand in a line; what they hold for readers without them is text.
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mspace mstyle mpadded mfenced semantics "
    "svg object canvas audio video picture source track embed input noscript".split()
)
#: Elements that end an unclosed picture.
BLOCKS = frozenset(
    "address article aside blockquote body details dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td th thead tr ul".split()
)
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
SELF_CLOSING = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

#: Ancestor tags that are features of their own.
TAGS = "article main section nav header footer aside form ul ol li table td th h1 h2 h3 h4 p blockquote pre figure figcaption button select dialog div dl address details".split()
#: Parts of class, id and role names, grouped by what they speak for.
NAMES = {
    "menu": "nav menu breadcrumb pagination pager toc tabs skip",
    "head": "header masthead topbar banner hero logo toolbar",
    "foot": "footer foot copyright legal colophon",
    "side": "sidebar side aside widget rail related recommend trending popular more",
    "note": "cookie consent notice gdpr alert popup modal overlay newsletter subscribe paywall toast dialog",
    "advert": "ad ads advert advertisement sponsor sponsored promo promoted adsense",
    "form": "form login search signup contact",
    "comment": "comment comments discussion reply replies disqus respond",
    "share": "share social tags meta byline author",
    "body": "article content post entry story body text main prose",
}
_GROUP = {word: group for group, words in NAMES.items() for word in words.split()}
_NAME = re.compile(r"[a-z]+")


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, frozenset]] = []
        self.blocks: list[tuple[str, int, tuple]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.skipped = self.links = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append((text, self.linked, tuple(self.stack)))
        self.parts, self.linked = [], 0

    def _pop_to(self, index: int) -> None:
        for tag, _ in self.stack[index:]:
            self.skipped -= tag in SKIPPED
            self.links -= tag == "a"
        del self.stack[index:]

    def handle_starttag(self, tag, attrs):
        inline = tag in INLINE or (self._in_picture() and tag not in BLOCKS)
        if tag == "br":
            self.parts.append(" ")
        elif not inline:
            self.flush()
        if tag in VOID:
            return
        if not inline:
            self._leave_picture()
            self._close_open(tag)
        if tag == "body" and self.skipped:
            self._pop_to(0)
        words: set[str] = set()
        for key, value in attrs:
            if key in ("class", "id", "role") and value:
                words.update(_GROUP[w] for w in _NAME.findall(value.lower()) if w in _GROUP)
            elif key == "hidden" or (key == "style" and value and "display:none" in value.replace(" ", "").lower()) or (key == "aria-hidden" and value == "true"):
                words.add("hidden")
        self.stack.append((tag, frozenset(words)))
        self.skipped += tag in SKIPPED
        self.links += tag == "a"

    def parse_marked_section(self, i, report=1):
        """``<![`` of any kind is a comment: up to ``]]>`` for character data, else up to ``>``."""
        mark = "]]>" if self.rawdata.startswith("<![CDATA[", i) else ">"
        end = self.rawdata.find(mark, i)
        return end + len(mark) if end >= 0 else -1

    def _in_picture(self) -> bool:
        return self.skipped > 0 and any(name == "svg" for name, _ in self.stack)

    def _leave_picture(self) -> None:
        """A block ends a picture that was never closed."""
        if self._in_picture():
            self._pop_to(next(i for i, (name, _) in enumerate(self.stack) if name == "svg"))

    def _close_open(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i][0]
            if name in CLOSED_BY_BLOCK or (name == tag and tag in SELF_CLOSING):
                self._pop_to(i)
                return
            if name not in INLINE:
                return

    def handle_endtag(self, tag):
        if tag not in INLINE and (tag in BLOCKS or not self._in_picture()):
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self._pop_to(i)
                return

    def handle_data(self, data):
        if not self.skipped:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def leaf_blocks(html: str) -> list[tuple[str, int, tuple]]:
    """Blocks in page order: text with single spaces, characters inside links, open elements from the outside in."""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.blocks


FEATURES = (
    ["bias", "first", "last"] + [f"in:{t}" for t in TAGS] + [f"own:{t}" for t in TAGS] + [f"name:{g}" for g in NAMES] + ["name:hidden"]
    + [f"words<{n}" for n in (2, 4, 8, 16, 32, 64)] + ["words>=64", "links>0.3", "links>0.8", "ends with a stop", "two stops", "no lower case", "copyright sign", "in article, no other name", "top level"]
)
_AT = {name: i for i, name in enumerate(FEATURES)}
_OTHER = frozenset(NAMES) - {"body"}


def block_features(blocks: list[tuple[str, int, tuple]]) -> list[list[int]]:
    """Numbers of the features that hold, per block."""
    rows = []
    for number, (text, linked, stack) in enumerate(blocks):
        tags = [tag for tag, _ in stack if tag in TAGS]
        names = frozenset().union(*[n for _, n in stack])
        on = {"bias", *[f"in:{t}" for t in tags], *[f"name:{n}" for n in names]}
        if number == 0:
            on.add("first")
        if number == len(blocks) - 1:
            on.add("last")
        if tags:
            on.add(f"own:{tags[-1]}")
        count = text.count(" ") + 1
        on.add(next((f"words<{n}" for n in (2, 4, 8, 16, 32, 64) if count < n), "words>=64"))
        for share in (0.3, 0.8):
            if linked > share * len(text):
                on.add(f"links>{share}")
        stops = text.count(". ") + text.count("! ") + text.count("? ") + (text[-1] in ".!?…。")
        if text[-1] in ".!?…。":
            on.add("ends with a stop")
        if stops > 1:
            on.add("two stops")
        if text == text.upper():
            on.add("no lower case")
        if "©" in text:
            on.add("copyright sign")
        if ("article" in tags or "main" in tags) and not (names & _OTHER):
            on.add("in article, no other name")
        if len(tags) < 2:
            on.add("top level")
        rows.append([_AT[x] for x in on])
    return rows
