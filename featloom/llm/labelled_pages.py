"""Labelled pages to train on: layouts of web pages, filled with invented words from a fixed seed.

Every text starts with a mark that says whether it belongs to the article; the marks go before training. Layouts, names of classes and sizes vary,
so that a model cannot rely on one of them alone.
"""

from __future__ import annotations

import random

from featloom.llm.html_blocks import leaf_blocks

#: Marks of other text and of text of the article.
MARKS = "\ue000\ue001"
SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo zu ang ber ción eux sch the tion ung ier ment".split()

ARTICLE_BOXES = ["article", "article class='post'", "main", "div class='content'", "div id='main-content'", "div class='entry-content'",
                 "div class='post-body'", "section class='article'", "div class='story'", "div id='text'", "div class='page'", "div role='main'"]
MENU_BOXES = ["nav", "div class='nav'", "div id='menu'", "ul class='menu'", "div class='navbar'", "div class='breadcrumb'", "nav class='main-nav'",
              "div role='navigation'"]
HEADER_BOXES = ["header", "div class='header'", "div id='masthead'", "header class='site-header'", "div class='banner'", "div class='top'"]
FOOTER_BOXES = ["footer", "div class='footer'", "div id='footer'", "footer class='site-footer'", "div class='bottom'", "div class='copyright'"]
SIDE_BOXES = ["aside", "div class='sidebar'", "div id='sidebar'", "aside class='related'", "div class='widget'", "section class='related-posts'"]
NOTICE_BOXES = ["div class='cookie-notice'", "div class='notice'", "div id='consent'", "div class='alert'", "div class='cookie-banner'",
                "div class='gdpr'", "section class='disclaimer'", "div class='popup'"]
AD_BOXES = ["div class='ad'", "div class='ads'", "div class='advert'", "div class='advertisement'", "aside class='ad'", "div class='promo'",
            "div class='sponsored'", "div id='banner-ad'", "section class='ad'", "div class='sponsor'"]
COMMENT_BOXES = ["div class='comments'", "section id='comments'", "ol class='comment-list'", "div class='comment'", "section class='comments'",
                 "div id='disqus-thread'", "ul class='replies'", "div class='discussion'"]
FORM_BOXES = ["form", "form class='search'", "form class='newsletter'", "div class='signup'", "form id='login'", "div class='subscribe'"]
SHARE_BOXES = ["div class='share'", "ul class='social'", "div class='tags'", "div class='meta'", "p class='byline'"]


class _Writer:
    def __init__(self, seed: int):
        self.random = random.Random(seed)
        self.pieces: list[str] = []

    def word(self) -> str:
        return "".join(self.random.choice(SYLLABLES) for _ in range(self.random.choice((1, 1, 2, 2, 3))))

    def sentence(self, low: int, high: int, end: str = ".") -> str:
        return " ".join(self.word() for _ in range(self.random.randint(low, high))).capitalize() + end

    def prose(self) -> str:
        return " ".join(self.sentence(3, 14) for _ in range(self.random.choice((1, 1, 2, 3, 5, 9))))

    def block(self, tag: str, text: str, label: int) -> None:
        name = tag.split()[0]
        closed = "" if name in ("p", "li") and self.random.random() < 0.2 else f"</{name}>"
        self.pieces.append(f"<{tag}>{MARKS[label]}{text}{closed}")

    def box(self, tag: str, fill) -> None:
        self.pieces.append(f"<{tag}>")
        fill()
        self.pieces.append(f"</{tag.split()[0]}>")

    def links(self, n: int) -> None:
        for _ in range(n):
            self.block("li", f"<a href='/{self.word()}'>{self.sentence(1, 3, '')}</a>", 0)

    def menu(self) -> None:
        box = self.random.choice(MENU_BOXES)
        self.box(box, lambda: self.links(self.random.randint(2, 8)) if box.startswith("ul") else
                 self.box("ul", lambda: self.links(self.random.randint(2, 8))))

    def header(self) -> None:
        def fill():
            self.block(self.random.choice(("div class='logo'", "p", "h1", "h2")), self.sentence(1, 4, ""), 0)
            if self.random.random() < 0.5:
                self.block("p", self.sentence(3, 8), 0)
            if self.random.random() < 0.5:
                self.menu()
        self.box(self.random.choice(HEADER_BOXES), fill)

    def said(self, boxes: list[str], n: tuple[int, ...], prose: bool = True) -> None:
        def fill():
            for _ in range(self.random.choice(n)):
                text = self.prose() if prose and self.random.random() < 0.7 else self.sentence(1, 8, self.random.choice(("", ".")))
                self.block(self.random.choice(("p", "p", "div", "span", "li")), text, 0) if boxes is not AD_BOXES or self.random.random() < 0.4 \
                    else self.bare(text)
        self.box(self.random.choice(boxes), fill)

    def bare(self, text: str) -> None:
        """Text that stands in its box without an element of its own."""
        self.block("div", text, 0)

    def comments(self) -> None:
        def fill():
            if self.random.random() < 0.6:
                self.block("h3", self.sentence(1, 3, ""), 0)
            for _ in range(self.random.randint(1, 5)):
                if self.random.random() < 0.5:
                    self.block("b", self.word().capitalize(), 0)
                self.block("p", self.prose(), 0)
        self.box(self.random.choice(COMMENT_BOXES), fill)

    def form(self) -> None:
        def fill():
            self.block(self.random.choice(("p", "label", "h3", "div")), self.sentence(1, 6, self.random.choice(("", ":", "?"))), 0)
            self.pieces.append("<input type='text'>")
            self.block("button", self.sentence(1, 2, ""), 0)
        self.box(self.random.choice(FORM_BOXES), fill)

    def share(self) -> None:
        box = self.random.choice(SHARE_BOXES)
        if box.startswith("ul"):
            self.box(box, lambda: self.links(self.random.randint(1, 4)))
        else:
            self.block(box, self.sentence(1, 5, ""), 0)

    def article(self) -> None:
        def fill():
            if self.random.random() < 0.85:
                self.block(self.random.choice(("h1", "h1", "h2")), self.sentence(2, 12, self.random.choice(("", "", "."))), 1)
            if self.random.random() < 0.15:
                self.share()
            for _ in range(self.random.choice((1, 2, 4, 7, 12))):
                kind = self.random.random()
                if kind < 0.72:
                    text = self.prose()
                    if self.random.random() < 0.25:
                        text = f"<b>{text}"
                    if self.random.random() < 0.25:
                        text += f" <a href='/{self.word()}'>{self.sentence(1, 3, '')}</a> {self.prose()}"
                    self.block("p", text, 1)
                elif kind < 0.78:
                    self.block(self.random.choice(("h2", "h3")), self.sentence(1, 6, ""), 1)
                elif kind < 0.84:
                    self.box("ul", lambda: [self.block("li", self.sentence(2, 9, self.random.choice(("", "."))), 1) for _ in range(3)])
                elif kind < 0.88:
                    self.block("blockquote", self.prose(), 1)
                elif kind < 0.91:
                    self.block("pre", self.prose(), 1)
                elif kind < 0.94:
                    self.box("table", lambda: self.box("tr", lambda: [self.block("td", self.sentence(1, 4, ""), 1) for _ in range(3)]))
                elif kind < 0.97:
                    self.said(AD_BOXES, (1, 2))
                else:
                    self.share()
            if self.random.random() < 0.12:
                self.comments()
            if self.random.random() < 0.1:
                self.form()
        box = self.random.choice(ARTICLE_BOXES)
        if self.random.random() < 0.35:
            self.box("div class='container'", lambda: self.box(box, fill))
        else:
            self.box(box, fill)

    def page(self) -> str:
        r = self.random
        self.pieces.append(f"<!DOCTYPE html><html><head><title>{self.sentence(2, 8, '')}</title><style>p{{margin:0}}</style>"
                           f"<script>var t='<p>x</p>';</script></head><body>")
        # some pages are an article and little else
        rest = 0.15 if r.random() < 0.25 else 1
        for chance, part in ((0.4, lambda: self.said(NOTICE_BOXES, (1, 2))), (0.6, self.header), (0.7, self.menu), (0.15, self.form),
                             (0.4, lambda: self.said(AD_BOXES, (1, 1, 2)))):
            if r.random() < chance * rest:
                part()
        side = r.random() < 0.4 * rest
        if side and r.random() < 0.5:
            self.said(SIDE_BOXES, (1, 3, 5))
        self.article()
        for chance, part in ((0.3, self.share), (0.4, self.comments), (0.2, self.form), (0.25, lambda: self.said(AD_BOXES, (1, 2))),
                             (0.5 if side else 0, lambda: self.said(SIDE_BOXES, (1, 3, 5))), (0.2, lambda: self.said(NOTICE_BOXES, (1, 2))),
                             (0.85, lambda: self.said(FOOTER_BOXES, (1, 2, 3)))):
            if r.random() < chance * rest:
                part()
        self.pieces.append("</body></html>")
        return "".join(self.pieces)


def labelled_page(seed: int) -> str:
    """One page with marks."""
    return _Writer(seed).page()


def labelled_blocks(seed: int) -> tuple[list[tuple[tuple[str, ...], str, float]], list[int]]:
    """The leaf blocks of one page without marks, and whether each is part of the article."""
    blocks, labels = [], []
    for path, text, linked in leaf_blocks(labelled_page(seed)):
        labels.append(int(MARKS[1] in text))
        blocks.append((path, text.replace(MARKS[0], "").replace(MARKS[1], ""), linked))
    return blocks, labels
