"""Labelled web pages for the extractor, built from layout parts with a seeded generator.

A page is a list of parts, each a piece of markup with the label of its blocks. Layouts vary in which tags and
names hold the article, in the order of side parts and in how careless the markup is.
"""

from __future__ import annotations

import random

from hazegrid.llm.dom import Block, leaf_blocks

PAGES = 500

# Names that web pages give to their parts.
MAIN_NAMES = "content post entry article story main body text page document single blog detail".split()
MENU_NAMES = "menu nav navigation navbar topbar breadcrumb breadcrumbs toc links tabs pagination pager".split()
SIDE_NAMES = "sidebar side widget aside rail related recommended more tags share social popular teaser".split()
AD_NAMES = "ad ads advert advertisement banner sponsor sponsored promo promotion commercial".split()
NOTICE_NAMES = "cookie cookies consent notice alert popup modal gdpr newsletter subscribe login disclaimer".split()
COMMENT_NAMES = "comment comments discussion responses replies reply thread disqus".split()
HEAD_NAMES = "header head masthead top logo site brand".split()
FOOT_NAMES = "footer foot bottom copyright legal colophon".split()
SHORT = "Home|About|Contact|Log in|Subscribe|Next|Read more|Archive|Share|Tags|Search|Privacy|Terms|Top".split("|")
CONSONANTS, VOWELS = "bcdfghlmnprstvw", "aeiouäéñ"
MARK = "⁣"  # labels blocks of main text while a page is built


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(CONSONANTS) + self.r.choice(VOWELS) for _ in range(self.r.choice([1, 1, 2, 2, 3])))

    def sentence(self, low: int = 1, high: int = 18) -> str:
        noise = self.r.random() < 0.05
        words = [self.word() + (self.r.choice(["***", "###", "$$$", "&amp;&amp;"]) if noise else "") for _ in range(self.r.randint(low, high))]
        return " ".join(words).capitalize() + self.r.choice([".", ".", ".", ".", "!", "?"])

    def prose(self, longest: int = 8) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(1, longest)))

    def named(self, tags: list[str], names: list[str], must: bool = True) -> tuple[str, str]:
        tag = self.r.choice(tags)
        name = self.r.choice(names)
        if self.r.random() < 0.3:
            name += self.r.choice(["-", "_", " "]) + self.r.choice(["box", "wrap", "inner", "area", "1", "list", "block"])
        bare = not must and self.r.random() < 0.5
        return ("<" + tag + ("" if bare else f' {self.r.choice(["class", "class", "id"])}="{name}"') + ">", f"</{tag}>")

    def links(self) -> str:
        items = [self.r.choice(SHORT) if self.r.random() < 0.5 else self.word() for _ in range(self.r.randint(2, 8))]
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f'<li><a href="/{i}">{t}</a></li>' for i, t in enumerate(items)) + "</ul>"
        return " ".join(f'<a href="/{i}">{t}</a>' for i, t in enumerate(items))

    def around(self, tags: list[str], names: list[str], inside: str, must: bool = True) -> str:
        start, end = self.named(tags, names, must)
        return start + inside + end

    def paragraph(self) -> str:
        text = MARK + self.prose()
        kind = self.r.random()
        if kind < 0.1:
            return f"<p><b>{text}<br>"
        if kind < 0.2:
            return f"<p>{text}"
        if kind < 0.25:
            return f"<div>{text}</div>"
        if kind < 0.35:
            return f'<p>{text} <a href="/x">{self.word()}</a> {self.sentence()}</p>'
        return f"<p>{text}</p>"

    def article(self) -> str:
        parts = []
        if self.r.random() < 0.85:
            parts.append(f"<h1>{MARK}{self.sentence(2, 9)}</h1>")
        for _ in range(self.r.randint(1, 14)):
            kind = self.r.random()
            if kind < 0.06:
                parts.append(f"<h2>{MARK}{self.sentence(1, 6)}</h2>")
            elif kind < 0.1:
                parts.append("<ul>" + "".join(f"<li>{MARK}{self.sentence()}</li>" for _ in range(self.r.randint(2, 5))) + "</ul>")
            elif kind < 0.13:
                parts.append(f"<blockquote>{MARK}{self.prose(3)}</blockquote>")
            elif kind < 0.16:
                cells = "".join(f"<td>{MARK}{self.word()}</td>" for _ in range(3))
                parts.append(f"<table><tr>{cells}</tr><tr>{cells}</tr></table>")
            elif kind < 0.18:
                parts.append(f"<pre>{MARK}{self.prose(2)}</pre>")
            elif kind < 0.24:
                parts.append(self.advert())
            elif kind < 0.27:
                parts.append(self.around(["div", "aside"], SIDE_NAMES, self.links()))
            elif kind < 0.29:
                parts.append(self.form())
            else:
                parts.append(self.paragraph())
        return "".join(parts)

    def advert(self) -> str:
        return self.around(["div", "aside", "section", "p"], AD_NAMES, self.prose(3))

    def form(self) -> str:
        return f'<form action="/s"><label>{self.sentence(1, 6)}</label><input name="q"><button>{self.r.choice(SHORT)}</button></form>'

    def comments(self) -> str:
        each = "".join(self.around(["div", "li", "article"], COMMENT_NAMES, f"<h4>{self.word()}</h4><p>{self.prose(4)}</p>") for _ in range(self.r.randint(1, 5)))
        return self.around(["section", "div", "ol"], COMMENT_NAMES, f"<h3>{self.r.choice(['Comments', self.word()])}</h3>" + each)

    def page(self) -> str:
        r = self.r
        head = "<!DOCTYPE html><html><head><title>x</title><style>p{margin:0}</style><script>var t='</p>';</script></head><body>"
        before, after = [], []
        if r.random() < 0.5:
            before.append(self.around(["header", "div"], HEAD_NAMES, f"<p>{self.sentence(1, 5)}</p>" + (self.links() if r.random() < 0.5 else "")))
        if r.random() < 0.85:
            before.append("<nav>" + self.links() + "</nav>" if r.random() < 0.5 else self.around(["div", "nav", "ul"], MENU_NAMES, self.links()))
        for where in (before, after):
            if r.random() < 0.4:
                where.append(self.advert())
            if r.random() < 0.25:
                where.append(self.around(["div", "section"], NOTICE_NAMES, f"<p>{self.prose(2)}</p><button>OK</button>"))
            if r.random() < 0.3:
                inside = f"<h3>{self.sentence(1, 3)}</h3>" + (self.links() if r.random() < 0.6 else f"<p>{self.prose(2)}</p>")
                where.append("<aside>" + inside + "</aside>" if r.random() < 0.4 else self.around(["div", "aside"], SIDE_NAMES, inside))
            if r.random() < 0.15:
                where.append(self.form())
        body = self.article()
        inner_comments = self.comments() if r.random() < 0.35 else ""
        kind = r.random()
        if kind < 0.45:
            body = f"<article>{body}{inner_comments if r.random() < 0.3 else ''}</article>"
        elif kind < 0.65:
            body = f"<main>{body}</main>"
        elif kind < 0.83:
            body = self.around(["div", "section", "td"], MAIN_NAMES, body)
        elif kind < 0.95:
            for _ in range(r.choice([1, 1, 2, 3])):
                body = f"<div>{body}</div>"
        r.shuffle(before)
        if r.random() < 0.85:
            foot = f"&copy; {self.word()} &middot; {self.prose(2)}" if r.random() < 0.6 else f"<p>{self.prose(2)}</p>{self.links()}"
            after.append(f"<footer>{foot}</footer>" if r.random() < 0.6 else self.around(["div", "footer"], FOOT_NAMES, foot))
        return head + "".join([*before, body, inner_comments, *after]) + "</body></html>"


def labelled_blocks(seed: int) -> tuple[list[Block], list[int]]:
    """Blocks of one page and their labels (1: main text)."""
    blocks, labels = leaf_blocks(_Maker(seed).page()), []
    for block in blocks:
        labels.append(int(MARK in block.text))
        block.text = block.text.replace(MARK, "")
    return blocks, labels
