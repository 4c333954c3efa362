"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: runs of text between block-level boundaries. Each block has features of its ancestors
(tags, and words of their class, id and role) and of its text (length, share of link text, punctuation); the field
scores labels `main` and `other` from them and from the label before, and Viterbi finds the best sequence. The main
blocks, white space turned into single spaces, are joined in page order.

The field is trained on labelled pages that page_maker() composes from seeded layouts: menus, headers, adverts, notices,
forms, sidebars, reader comments and footers around and inside articles of many forms, with unclosed tags.

Defined results: null and empty pages give an empty text; pages without main blocks too; text outside any tag is a
block like others; head and body tags may be left out; unclosed and stray tags are tolerated (an unclosed script, style,
title or textarea swallows the rest, as in browsers; of other elements without text the content goes on); time grows
with the length of a page, however deep it nests; repeated rows get repeated results; further columns are ignored.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstream.llm.common import sliced

OTHER, MAIN = 0, 1
PAGES = 900
EPOCHS = 10
RATE = 0.3
DECAY = 1e-5

#: Elements that do not end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose content is no text.
SILENT = frozenset("script style noscript template iframe object svg math canvas audio video textarea title".split())
#: Of these, those that only their end tag ends.
RAW = frozenset("script style textarea title".split())
#: Elements whose tags may be left out and say nothing.
PLAIN = frozenset("html head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag closes, unless one of SCOPE stands between.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("article section div main aside nav header footer form table ul ol dl body html blockquote figure button details".split())
STRUCTURE = frozenset("nav header footer aside form article main section ul ol dl li table td th figure figcaption blockquote pre h1 h2 h3 h4 h5 h6 p div button select option label dialog details summary menu fieldset address a".split())

#: Of these an article's blocks tell whether they stand below one.
UNDER = frozenset("header footer aside nav form section ul li".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)", re.S)
NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
RIGHTS = re.compile(r"©|\(c\)|copyright|all rights reserved", re.I)


@dataclass(slots=True, eq=False)
class Element:
    """An element above blocks: tag and words of its attributes, and the one it stands in."""

    entry: str
    parent: Element | None


@dataclass(slots=True)
class Block:
    text: str
    element: Element | None
    linked: int


def attribute_words(attrs: str) -> str:
    """Words of class, id and role, lower-cased, each once, with spaces between."""
    if "=" not in attrs:
        return ""
    said = " ".join("".join(m) for m in NAMED.findall(attrs))
    return " ".join(dict.fromkeys(w.lower() for w in NAME_WORD.findall(said)))


class Stack:
    """Open elements, with the places of each tag, so that closing costs what it closes."""

    def __init__(self):
        self.items: list[tuple[str, Element | None]] = []
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    @property
    def here(self) -> Element | None:
        """The innermost element that is no inline one."""
        return self.items[-1][1] if self.items else None

    def push(self, tag: str, entry: str) -> None:
        at = len(self.items)
        self.items.append((tag, self.here if tag in INLINE else Element(entry, self.here)))
        self.places.setdefault(tag, []).append(at)
        if tag in SCOPE:
            self.scopes.append(at)

    def find(self, names: tuple[str, ...], scoped: bool) -> int:
        """The place of the innermost element of these names, -1 if there is none or, where scoped, SCOPE stands between."""
        at = max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)
        return -1 if scoped and self.scopes and self.scopes[-1] > at else at

    def cut(self, at: int) -> list[str]:
        """Takes out all from there on; their tags."""
        gone = [tag for tag, _ in self.items[at:]]
        for tag in reversed(gone):
            self.places[tag].pop()
            if tag in SCOPE:
                self.scopes.pop()
        del self.items[at:]
        return gone


def leaf_blocks(html: str) -> list[Block]:
    """Leaf blocks in page order."""
    out: list[Block] = []
    stack = Stack()
    held: list[str] = []
    endless: set[str] = set()
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append(Block(text, stack.here, linked))
            held.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = unescape(raw) if "&" in raw else raw
            held.append(text)
            if links:
                linked += len("".join(text.split()))

    def close(names: tuple[str, ...], scoped: bool) -> None:
        nonlocal links
        at = stack.find(names, scoped)
        if at < 0:
            return
        if any(tag not in INLINE for tag, _ in stack.items[at:]):
            flush()
        links -= stack.cut(at).count("a")

    at = 0
    while at < len(html):
        m = TAG.search(html, at)
        if m is None:
            break
        say(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag not in INLINE:
                flush()
            close((tag,), False)
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in VOID or tag in PLAIN:
            if tag not in INLINE:
                flush()
            continue
        if tag in SILENT:
            if not (m[3] or "").rstrip().endswith("/"):
                if tag not in INLINE:
                    flush()
                end = None if tag in endless else re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
                if end:
                    at = end.end()
                elif tag in RAW:
                    at = len(html)
                else:
                    endless.add(tag)
            continue
        if tag not in INLINE:
            flush()
            close(("p",), True)
            if tag in CLOSES:
                close(CLOSES[tag], True)
        stack.push(tag, f"{tag} {attribute_words(m[3] or '')}".rstrip())
        links += tag == "a"
    say(html[at:])
    flush()
    return out


@dataclass(slots=True)
class Above:
    """What features know of an element and those it stands in; sets are shared where an element adds nothing."""

    entry: str = ""
    before: str = ""
    inside: frozenset[str] = frozenset()
    in_article: bool = False
    under: frozenset[str] = frozenset()

    def then(self, entry: str, wanted: Callable[[str], bool] = lambda f: True) -> Above:
        tag, *said = entry.split(" ")
        new = {f for f in (f"in={tag}" if tag in STRUCTURE else "", *[f"word={w}" for w in said]) if f and wanted(f)}
        inside = self.inside if new <= self.inside else self.inside | new
        if tag in ("article", "main"):
            return Above(entry, self.entry, inside, True)
        below = self.in_article and tag in UNDER
        return Above(entry, self.entry, inside, self.in_article, self.under | {f"under={tag}"} if below else self.under)

    def features(self) -> list[str]:
        near = {f"near={w}" for e in (self.entry, self.before) for w in e.split(" ")[1:]}
        return sorted({f"leaf={self.entry.split(' ', 1)[0]}"} | self.inside | near | self.under)


def chain(element: Element | None) -> list[Element]:
    """The element and those above, outermost first."""
    out = []
    while element is not None:
        out.append(element)
        element = element.parent
    return out[::-1]


def path_features(element: Element | None) -> list[str]:
    above = Above()
    for e in chain(element):
        above = above.then(e.entry)
    return above.features()


def text_features(b: Block) -> list[str]:
    n = b.text.count(" ") + 1
    size = "1" if n == 1 else "3" if n <= 3 else "8" if n <= 8 else "20" if n <= 20 else "60" if n <= 60 else "more"
    share = b.linked / max(1, len(b.text) - n + 1)
    out = ["bias", f"words={size}", f"links={'none' if not b.linked else 'some' if share < 0.5 else 'most'}"]
    if b.text[-1] in ".!?…:;\"”»)":
        out.append("stop")
    if RIGHTS.search(b.text):
        out.append("rights")
    return out


class Field:
    """Weights of label x feature and of label after label; the sentinel label before the first block has its own row."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.index, self.weights, self.moves = index, weights, moves
        self.forget()

    def forget(self) -> None:
        """Paths that were met: the number of each by that of the path above and its last element."""
        self.numbers: dict[tuple[int, str], int] = {}
        self.above, self.by_path = [Above()], [self.weights[self.known(Above().features())].sum(0)]

    def known(self, features: list[str]) -> list[int]:
        return [i for f in features if (i := self.index.get(f)) is not None]

    def number(self, element: Element | None, met: dict[Element, int]) -> int:
        """The number of an element's path; what is worked out once for a path serves all pages."""
        todo = []
        while element is not None and element not in met:
            todo.append(element)
            element = element.parent
        at = met[element] if element is not None else 0
        for e in reversed(todo):
            key = (at, e.entry)
            if key not in self.numbers:
                self.numbers[key] = len(self.above)
                self.above.append(self.above[at].then(e.entry, self.index.__contains__))
                self.by_path.append(self.weights[self.known(self.above[-1].features())].sum(0))
            at = met[e] = self.numbers[key]
        return at

    def scores(self, blocks: list[Block]) -> np.ndarray:
        if len(self.above) > 50_000:
            self.forget()
        rows, met = np.empty((len(blocks), 2)), {}
        for k, b in enumerate(blocks):
            rows[k] = self.by_path[self.number(b.element, met)] + self.weights[self.known(text_features(b))].sum(0)
        return rows

    def decode(self, blocks: list[Block]) -> list[int]:
        """Viterbi."""
        if not blocks:
            return []
        (a, b), *rest = self.scores(blocks).tolist()
        (oo, om), (mo, mm), (so, sm) = self.moves.tolist()
        a, b, back = a + so, b + sm, []
        for x, y in rest:
            to_o, to_m = (OTHER, MAIN)[b + mo > a + oo], (OTHER, MAIN)[b + mm > a + om]
            back.append((to_o, to_m))
            a, b = max(a + oo, b + mo) + x, max(a + om, b + mm) + y
        labels = [MAIN if b > a else OTHER]
        for to in reversed(back):
            labels.append(to[labels[-1]])
        return labels[::-1]


def gradient(e: np.ndarray, t: np.ndarray, labels: list[int]) -> tuple[float, np.ndarray, np.ndarray]:
    """Of a page's labels with block scores e and moves t: minus the log of their probability, and what it gains with each
    of e and of t, by forward-backward."""
    n = len(e)
    alpha, beta = np.empty((n, 2)), np.zeros((n, 2))
    alpha[0] = t[2] + e[0]
    for k in range(1, n):
        alpha[k] = np.logaddexp(alpha[k - 1, 0] + t[0], alpha[k - 1, 1] + t[1]) + e[k]
    for k in range(n - 2, -1, -1):
        x = t[:2] + e[k + 1] + beta[k + 1]
        beta[k] = np.logaddexp(x[:, 0], x[:, 1])
    z = np.logaddexp(alpha[-1, 0], alpha[-1, 1])
    p, dt = np.exp(alpha + beta - z), np.zeros_like(t)
    dt[2] = p[0]
    dt[2, labels[0]] -= 1
    if n > 1:
        both = np.exp(alpha[:-1, :, None] + t[None, :2] + (e[1:] + beta[1:])[:, None, :] - z)
        dt[:2] = both.sum(0)
        np.add.at(dt, (labels[:-1], labels[1:]), -1)
    at = np.arange(n)
    said = e[at, labels].sum() + t[2, labels[0]] + t[labels[:-1], labels[1:]].sum()
    p[at, labels] -= 1
    return float(z - said), p, dt


def train(pages: list[tuple[list[Block], list[int]]], seed: int = 3) -> Field:
    """Maximum likelihood by Adagrad."""
    rng = random.Random(seed)
    index: dict[str, int] = {}
    rows = []
    for blocks, labels in pages:
        if blocks:
            rows.append(([[index.setdefault(f, len(index)) for f in (*path_features(b.element), *text_features(b))] for b in blocks], labels))
    w, t = np.zeros((len(index), 2)), np.zeros((3, 2))
    gw, gt = np.full_like(w, 1e-2), np.full_like(t, 1e-2)
    for _ in range(EPOCHS):
        rng.shuffle(rows)
        for features, labels in rows:
            _, p, dt = gradient(np.array([w[f].sum(0) for f in features]), t, labels)
            flat = np.concatenate([np.array(f) for f in features])
            used, inv = np.unique(flat, return_inverse=True)
            dw = np.zeros((len(used), 2))
            np.add.at(dw, inv, np.repeat(p, [len(f) for f in features], axis=0))
            dw += DECAY * w[used]
            gw[used] += dw**2
            w[used] -= RATE * dw / np.sqrt(gw[used])
            gt += dt**2
            t -= RATE * dt / np.sqrt(gt)
    return Field(index, w, t)


#: Attribute words of page parts, for the pages the field is trained on.
PARTS = {
    "nav": "nav menu navbar navigation topnav links breadcrumb breadcrumbs tabs pagination pager sitemap",
    "header": "header masthead topbar banner branding logo site head hero",
    "footer": "footer bottom copyright legal colophon credits foot imprint",
    "aside": "sidebar aside widget rail secondary side related recommended trending popular more tags toc",
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion promoted banner teaser commercial",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay privacy banner message warning",
    "form": "form newsletter subscribe signup login search contact register feedback subscription",
    "comments": "comments comment reply replies respond discussion disqus thread responses reader guestbook",
    "share": "share social sharing follow toolbar buttons meta",
    "main": "article post entry content story body text main page single blog news",
}
TAGS = {
    "nav": ["nav", "nav", "div", "ul"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "div"], "aside": ["aside", "aside", "div", "section"],
    "ad": ["div", "div", "aside", "section", "ins"], "notice": ["div", "div", "section", "dialog", "aside"], "form": ["form", "form", "div"], "comments": ["section", "div", "div", "aside", "ol"], "share": ["div", "ul"],
}


class PageMaker:
    """Seeded labelled pages: html with the label of each leaf block, in order."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        letters = self.r.choice(["etaoinshrdlu", "enrstaihdlou", "aeéèuisntrlo", "aeosnrildutñ"])
        self.syllables = ["".join(self.r.choices(letters, k=self.r.randint(1, 4))) for _ in range(60)]

    def word(self) -> str:
        return "".join(self.r.choices(self.syllables, k=self.r.randint(1, 3)))

    def sentence(self, low: int = 3, high: int = 18) -> str:
        s = " ".join(self.word() for _ in range(self.r.randint(low, high)))
        return s.capitalize() + self.r.choice([".", ".", ".", "!", "?"])

    def phrase(self, low: int, high: int) -> str:
        """A heading, an item, a cell: mostly without a full stop."""
        s = self.sentence(low, high)
        return s if self.r.random() < 0.3 else s[:-1]

    def attrs(self, part: str) -> str:
        r = self.r
        if r.random() < 0.25:
            return ""
        names = r.sample(PARTS[part].split(), r.randint(1, 2))
        if r.random() < 0.3:
            names.append(r.choice(["box", "wrap", "inner", "container", "row", "col", "block", self.word()]))
        return f' {r.choice(["class", "class", "id"])}="{r.choice(["-", " ", "_"]).join(names)}"'

    def box(self, part: str, inside: list[tuple[str, int | None]]) -> list[tuple[str, int | None]]:
        tag = self.r.choice(TAGS[part])
        attrs = self.attrs(part)
        if tag in ("div", "section", "ins", "ul", "ol") and not attrs:
            attrs = f' class="{self.r.choice(PARTS[part].split())}"'
        return [(f"<{tag}{attrs}>", None), *inside, (f"</{tag}>", None)]

    def bare(self, tag: str, text: str, label: int, closed: float = 0.95) -> list[tuple[str, int | None]]:
        return [(f"<{tag}>", None), (text, label), (f"</{tag}>" if self.r.random() < closed else "", None)]

    def links(self, n: int) -> list[tuple[str, int | None]]:
        out = [("<ul>", None)]
        for _ in range(n):
            out += [("<li>", None), (f'<a href="/{self.word()}">{self.word()}{" " + self.word() if self.r.random() < 0.3 else ""}</a>', OTHER), ("</li>", None)]
        return [*out, ("</ul>", None)]

    def other(self, part: str) -> list[tuple[str, int | None]]:
        r = self.r
        if part in ("nav", "share"):
            return self.box(part, self.links(r.randint(2, 8)))
        if part == "header":
            inside = self.bare(r.choice(["h1", "div", "p", "h2"]), f"{self.word()} {self.word()}", OTHER)
            return self.box(part, inside + (self.links(r.randint(2, 6)) if r.random() < 0.6 else []))
        if part == "footer":
            said = f"&copy; {self.word()}.example.com &middot; {self.sentence()}" if r.random() < 0.7 else self.sentence()
            inside = [(said, OTHER)] if r.random() < 0.5 else self.bare("p", said, OTHER)
            return self.box(part, inside + (self.links(r.randint(2, 6)) if r.random() < 0.4 else []))
        if part == "form":
            tail = [("<button>", None), (self.word(), OTHER), ("</button>", None)] if r.random() < 0.7 else []
            return self.box(part, [*self.bare(r.choice(["p", "label", "h3"]), self.sentence(2, 8), OTHER), ('<input type="text">', None), *tail])
        if part == "comments":
            inside = self.bare(r.choice(["h2", "h3"]), self.word(), OTHER) if r.random() < 0.6 else []
            for _ in range(r.randint(1, 5)):
                one = self.bare("p", " ".join(self.sentence() for _ in range(r.randint(1, 4))), OTHER)
                tag = r.choice(["div", "li", "article"])
                inside += [(f'<{tag} class="{r.choice(["comment", "reply", "comment-body"])}">', None), *one, (f"</{tag}>", None)] if r.random() < 0.6 else one
            return self.box(part, inside)
        if part == "aside" and r.random() < 0.6:
            return self.box(part, [*self.bare(r.choice(["h3", "h2", "p"]), self.word(), OTHER), *self.links(r.randint(2, 6))])
        text = " ".join(self.sentence() for _ in range(r.randint(1, 3)))
        return self.box(part, [(text, OTHER)] if r.random() < 0.6 else self.bare(r.choice(["p", "span", "div"]), text, OTHER))

    def paragraph(self) -> list[tuple[str, int | None]]:
        r = self.r
        kind = r.random()
        text = " ".join(self.sentence(1, 18) for _ in range(r.choice([1, 1, 1, 2, 4, 9])))
        if kind < 0.06:  # articles, too, name their rights
            said = r.choice([f"Copyright (c) 2014 {self.word()}. All rights reserved.", f"© {self.word()} {self.word()}", f"Licensed under the {self.word()} license. {self.sentence()}"])
            return self.bare("p", r.choice([said, f"{text} {said}"]), MAIN, 0.85)
        if kind < 0.7:
            if r.random() < 0.25:
                text += f' <a href="/{self.word()}">{self.word()}</a> {self.word()}.'
            if r.random() < 0.15:
                text = text[:-1]
            return self.bare("p", f"<b>{text}" if r.random() < 0.15 else text, MAIN, 0.85)
        if kind < 0.8:
            return self.bare(r.choice(["h2", "h3", "h4"]), self.phrase(1, 7), MAIN)
        if kind < 0.89:
            items = [x for _ in range(r.randint(2, 5)) for x in self.bare("li", self.phrase(1, 10), MAIN, 0.8)]
            return [("<ul>", None), *items, ("</ul>", None)]
        if kind < 0.93:
            return [("<blockquote>", None), *self.bare("p", text, MAIN), ("</blockquote>", None)]
        if kind < 0.96:
            return [("<figure>", None), ('<img src="x.png">', None), *self.bare("figcaption", self.phrase(2, 8), MAIN), ("</figure>", None)]
        cells = [x for _ in range(r.randint(2, 6)) for x in [("<tr>", None), *self.bare("td", self.word(), MAIN), *self.bare("td", self.phrase(1, 4), MAIN), ("</tr>", None)]]
        return [("<table>", None), *cells, ("</table>", None)]

    def page(self) -> tuple[str, list[int]]:
        r = self.r
        body: list[tuple[str, int | None]] = []
        bare = r.random() < 0.15  # nothing before the article
        for part in ("notice", "header", "nav", "ad", "aside", "form"):
            if not bare and r.random() < {"nav": 0.85, "header": 0.5}.get(part, 0.35):
                body += self.other(part)
        wrap = r.choice(["article", "article", "article", "main", "main-article", "div", "section"])
        named = self.attrs("main") or f' class="{r.choice(PARTS["main"].split())}"'
        opens = {"article": f"<article{self.attrs('main')}>", "main": f"<main{self.attrs('main')}>", "main-article": f"<main><article{self.attrs('main')}>", "div": f"<div{named}>", "section": f"<section{named}>"}[wrap]
        closes = {"main-article": "</article></main>"}.get(wrap, f"</{wrap}>")
        inner = self.bare(r.choice(["h1", "h1", "h1", "h2"]), self.phrase(1, 10), MAIN) if r.random() < 0.9 else self.paragraph()
        if r.random() < 0.15:
            inner = [("<header>", None), *inner, ("</header>", None)]
        for _ in range(r.choice([0, 1, 2, 4, 8, 14])):
            inner += self.paragraph()
            if r.random() < 0.08:
                inner += self.other(r.choice(["ad", "aside", "form", "share", "notice", "nav"]))
        late = self.other("comments") if r.random() < 0.35 else []
        inside = r.random() < 0.3
        body += [(opens, None), *inner, *(late if inside else []), (closes, None), *([] if inside else late)]
        for part in ("share", "aside", "form", "ad", "notice", "footer"):
            if r.random() < {"footer": 0.85}.get(part, 0.25):
                body += self.other(part)
        head = f"<!DOCTYPE html><html><head><title>{self.sentence()}</title><style>p{{margin:0}}</style></head><body>"
        tail = "</body></html>" if r.random() < 0.85 else ""
        return head + "".join(x for x, _ in body) + tail, [y for x, y in body if y is not None]


def labelled_pages(n: int = PAGES, seed: int = 11) -> list[tuple[list[Block], list[int]]]:
    out = []
    for k in range(n):
        html, labels = PageMaker(seed * 100_003 + k).page()
        blocks = leaf_blocks(html)
        if len(blocks) == len(labels):
            out.append((blocks, labels))
    return out


@functools.cache
def trained() -> Field:
    """The field, trained once in a process."""
    return train(labelled_pages())


def main_text(field: Field, html: str | None) -> str:
    blocks = leaf_blocks(html or "")
    return " ".join(b.text for b, y in zip(blocks, field.decode(blocks), strict=True) if y == MAIN)


def extract(pages: DataFrame, field: Field | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row, one narrow pass."""
    held = pages.sparkSession.sparkContext.broadcast(field or trained())  # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [main_text(held.value, h.as_py()) for h in batch[2]]
            sizes = [len(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
