"""Leaf blocks of a web page: stretches of text between block-level tags, with the tags they stand in."""

from __future__ import annotations

import functools
import html
import re
from dataclasses import dataclass, field

# Tag groups of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# What stands in these is no text of the page. The first ones swallow the rest of a page if they are not closed;
# of the others an unclosed one ends at the next block.
UNPARSED = set("script style textarea title".split())
SKIPPED = set("template noscript iframe object svg canvas select".split())
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup "
    "option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
# A new one of these ends an open one of its group that nothing else encloses.
ENDS_ITSELF = [{"li"}, {"dt", "dd"}, {"td", "th"}, {"tr"}, {"option"}]
HOLDS_PARAGRAPHS = BLOCK - {"p"}

# A quote opens only behind an equals sign, so an apostrophe in a bare value does no harm.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|([^<]+|<)", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=>/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
BLOCK_EDGE = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK - {'option', 'optgroup'}))})(?=[\s/>])", re.I)
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    """Text with character references decoded, the enclosing tags and name words, and how much of it is linked."""

    text: str
    tags: tuple[str, ...]
    names: frozenset[str]
    linked: float
    bold: float


@dataclass
class _Open:
    tag: str
    names: frozenset[str]
    hidden: bool


@dataclass
class _Reader:
    blocks: list[Block] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    bold: int = 0
    links: int = 0
    bolds: int = 0

    def text(self, piece: str) -> None:
        self.pieces.append(piece)
        size = len(piece.strip())
        self.linked += size if self.links else 0
        self.bold += size if self.bolds else 0

    def flush(self) -> None:
        if self.pieces:
            text = " ".join(html.unescape("".join(self.pieces)).split())
            if text and not any(o.hidden for o in self.stack):
                names = frozenset().union(*(o.names for o in self.stack))
                size = max(1, sum(len(p.strip()) for p in self.pieces))
                self.blocks.append(Block(text, tuple(o.tag for o in self.stack), names, self.linked / size, self.bold / size))
        self.pieces, self.linked, self.bold = [], 0, 0

    def open(self, tag: str, attributes: str) -> None:
        self.flush()
        self.links = self.bolds = 0
        if self.stack and self.stack[-1].tag == "p":
            self.stack.pop()
        for group in ENDS_ITSELF:
            if tag in group and self.stack and self.stack[-1].tag in group:
                self.stack.pop()
        if tag == "hr":
            return
        words: set[str] = set()
        hidden = False
        for match in ATTRIBUTE.finditer(attributes):
            name, value = match[1].lower(), match[2] or match[3] or match[4] or ""
            if name in ("class", "id", "role"):
                words.update(WORD.findall(value.lower()))
            elif name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true"):
                hidden = True
            elif name == "style" and NO_DISPLAY.search(value):
                hidden = True
        self.stack.append(_Open(tag, frozenset(words), hidden))

    def close(self, tag: str) -> None:
        self.flush()
        self.links = self.bolds = 0
        for place in range(len(self.stack) - 1, -1, -1):
            if self.stack[place].tag == tag:
                del self.stack[place:]
                return


@functools.cache
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.I)


def leaf_blocks(page: str) -> list[Block]:
    """All text blocks in page order. Scripts, styles, forms' fields and hidden parts hold none.

    Any string is accepted: unclosed tags end with the page, stray end tags and a lone ``<`` do no harm. Formulas
    (``math``) are text.
    """
    reader, at = _Reader(), 0
    while at < len(page):
        match = TOKEN.match(page, at)
        if match is None:
            reader.text(page[at])
            at += 1
            continue
        at = match.end()
        if match[4] is not None:
            reader.text(match[4])
            continue
        if match[2] is None:
            continue
        tag, ending = match[2].lower(), bool(match[1])
        if tag in UNPARSED or tag in SKIPPED:
            if not ending and not match[3].endswith("/"):
                stop = _end_of(tag).search(page, at)
                if stop:
                    at = stop.end()
                elif tag in UNPARSED:
                    at = len(page)
                else:
                    edge = BLOCK_EDGE.search(page, at)
                    at = edge.start() if edge else len(page)
            reader.text(" ")
        elif tag in BLOCK:
            reader.close(tag) if ending else reader.open(tag, match[3])
        elif tag in VOID:
            reader.text(" " if tag in ("br", "wbr") else "")
        elif tag == "a":
            reader.links = 0 if ending else 1
        elif tag in ("b", "strong"):
            reader.bolds = 0 if ending else 1
    reader.flush()
    return reader.blocks
