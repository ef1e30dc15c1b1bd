"""Leaf blocks of a page's element tree.

A block is a run of text between the beginnings and ends of block elements. Inline elements, images, formulas,
drawings and embedded objects run inside a line and keep the text that stands in them; scripts and the like are
left out without ending a block. End tags that may be omitted are: a head ends before the first thing that
cannot stand in it, a list of options before a block element, a formula or drawing before the next block element.

A block points to its element, which points to its parent and holds what it adds to the features of the path, so
that deep nesting costs no more than the elements themselves.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

# Elements of HTML by what they do to blocks.
#: Elements that run inside a line of text; all others begin and end blocks.
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output progress q rp rt ruby
s samp small span strike strong sub sup time tt u var wbr area audio canvas embed img input link map math meta object param picture source
svg track video""".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as text of the page; they end no block.
HIDDEN = frozenset("script style template noscript iframe head title textarea select annotation annotation-xml".split())
#: Elements that may stand in a head, and in a list of options.
IN_HEAD = frozenset("title style script noscript template meta link base".split())
IN_SELECT = frozenset("option optgroup hr script template".split())
#: Elements with content of another kind, and the elements that end it if it was not closed.
FOREIGN = frozenset("math svg".split())
BREAKS_OUT = frozenset("""article aside blockquote body center dd div dl dt footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p
pre section table ul""".split())
#: Elements that end by themselves where one of the second kind begins.
ENDS = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"},
        "th": {"td", "th", "tr"}, "option": {"option"}}
_TOKEN = re.compile(r"[a-z]+|\d+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _name(tag: str, attrs: list) -> str:
    """The element as `tag.token.token`, with the words of its class, id and role."""
    tokens: dict[str, None] = {}
    for key, value in attrs:
        if value and key in ("class", "id", "role"):
            tokens |= dict.fromkeys(_TOKEN.findall(_CAMEL.sub(" ", value).lower()))
    return ".".join([tag, *tokens])


def own_features(name: str) -> list[str]:
    """What an element adds to the features of all that stands in it."""
    tag, *words = name.split(".")
    return [f"in {tag}", *(f"word {w}" for w in words)]


class Node:
    """A block element: its name, its parent, and the features that no ancestor has."""

    __slots__ = ("parent", "name", "tag", "new", "score")

    def __init__(self, parent: Node | None, name: str, new: tuple[str, ...]):
        self.parent, self.name, self.tag, self.new, self.score = parent, name, name.split(".", 1)[0], new, None

    def path(self) -> tuple[str, ...]:
        out, node = [], self
        while node.parent is not None:
            out.append(node.name)
            node = node.parent
        return tuple(out[::-1])


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        # open elements: tag, whether it runs inside a line, and the block element that it stands in
        self.open: list[tuple[str, bool, Node]] = []
        self.counts: Counter[str] = Counter()    # of open tags
        self.features: Counter[str] = Counter()  # of open block elements
        self.block_at: list[int] = []            # places of the open block elements
        self.node = Node(None, "", ("bias",))
        self.hidden = self.foreign = 0
        self.text: list[str] = []
        self.linked = 0
        self.blocks: list[tuple[Node, str, float]] = []

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.blocks.append((self.node, text, min(1.0, self.linked / len(text))))
        self.text, self.linked = [], 0

    def _push(self, tag: str, attrs: list, inline: bool) -> None:
        self.open.append((tag, inline, self.node))
        self.counts[tag] += 1
        self.hidden += tag in HIDDEN
        self.foreign += tag in FOREIGN
        if not inline:
            name = _name(tag, attrs)
            own = own_features(name)
            self.node = Node(self.node, name, tuple(f for f in own if not self.features[f]))
            self.features.update(own)
            self.block_at.append(len(self.open) - 1)

    def _pop(self) -> str:
        tag, inline, node = self.open.pop()
        self.counts[tag] -= 1
        self.hidden -= tag in HIDDEN
        self.foreign -= tag in FOREIGN
        if not inline:
            self.features.subtract(own_features(self.node.name))
            self.node = node
            self.block_at.pop()
        return tag

    def _close(self, tag: str) -> None:
        while self._pop() != tag:
            pass

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.counts["head"] and tag not in IN_HEAD and tag != "head":
            self._close("head")
        if self.counts["select"] and tag not in INLINE and tag not in IN_SELECT:
            self._close("select")
        while self.foreign and tag in BREAKS_OUT:
            self._close(next(t for t in reversed(self.open) if t[0] in FOREIGN)[0])
        if tag == "br":
            self.text.append(" ")
            return
        breaks = tag not in INLINE and tag not in HIDDEN and not self.foreign
        if breaks:
            if not self.hidden:
                self.flush()
            # inline elements that were not closed do not hide the block that ends here
            while self.block_at and (last := self.open[self.block_at[-1]][0]) in ENDS and (ENDS[last] is None or tag in ENDS[last]):
                self._close(last)
        if tag not in VOID:
            self._push(tag, attrs, not breaks)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        inside = self.foreign or tag in INLINE
        self.handle_starttag(tag, attrs)
        if inside and tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if not self.counts[tag]:
            return
        if tag not in INLINE and tag not in HIDDEN and not self.foreign and not self.hidden:
            self.flush()
        self._close(tag)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "head" and data.strip():
            self._close("head")
        if not self.hidden:
            self.text.append(data)
            if self.counts["a"]:
                self.linked += len(data)


def blocks_of(html: str) -> list[tuple[Node, str, float]]:
    """Element, text with single blanks, and share of linked text of every block, in page order."""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.blocks


def leaf_blocks(html: str) -> list[tuple[tuple[str, ...], str, float]]:
    """The same with the names of all block elements around each block."""
    return [(node.path(), text, linked) for node, text, linked in blocks_of(html)]
