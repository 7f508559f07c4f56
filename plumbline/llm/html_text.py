"""HTML extraction by a linear-chain conditional random field over DOM leaf blocks (operator 2).

A page is cut into leaf blocks: the text between two starts or ends of block elements, with the stack of elements it
stands in. Markup is read leniently: void elements, omitted end tags (p, li, td, ...), stray end tags, unclosed tags
and comments, raw text of script, style and the like. Each block has features of its ancestors (tags, and the words of
their classes, ids and roles), of its text (length, links, punctuation, typical words) and of its place. The field
labels the sequence of blocks as article or other, by Viterbi; article blocks are the text.

It is trained on labelled pages: `labelled_pages` writes page templates with menus, headers, banners, adverts, forms,
sidebars, related links, comments and footers around articles, in several markup styles, and `plain_pages` pages without
names and sections (bare text, layouts by tables, nested divisions), each block's label known. Their number is bounded; the weights (a few hundred) travel with the function.

In a block, character references are decoded and white space is folded into one space; blocks are joined in page order
by two line feeds. Nothing else is dropped or capped.

Cases: null and empty pages have empty text; pages without article blocks have empty text; text without any markup is
one block; very long pages are one row, whose time is linear in their length however their tags are nested or their
quotes left open; repeated rows give repeated rows; an empty table gives an empty table; other columns pass through, and
results replace columns of the same name.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import crf
from plumbline.llm.common import byte_chunks, clean_text, table

#: Bytes taken at a time inside a task.
CHUNK_BYTES = 4_000_000
#: Elements that begin and end blocks.
BLOCKS = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav noscript ol option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split())
#: Elements without an end tag.
VOID = set("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
HIDDEN = set("head script style noscript template iframe object svg math textarea select button audio video canvas".split())
#: Elements whose content holds no markup.
RAW = set("script style textarea title iframe noembed noframes xmp".split())
#: A start tag on the left ends open elements on the right, up to the scope's elements.
CLOSES = {
    **{t: {"p"} for t in "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()},
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
    "tbody": {"tr", "td", "th", "thead", "tbody", "p"}, "tfoot": {"tr", "td", "th", "thead", "tbody", "p"}, "option": {"option"}, "body": {"head"},
}
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}}
STOP = {"article", "aside", "body", "div", "footer", "form", "header", "html", "main", "nav", "section", "table", "td", "th", "ul", "ol", "dl", "blockquote", "fieldset", "details", "figure"}

TAG_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
SPECIAL = re.compile("""[>"']""")
LONG_NUMBER = re.compile(r"&#0*[1-9][0-9]{7,};?")
NAMES = re.compile(r"""\b(?:class|id|role|aria-label|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
WORD = re.compile(r"[a-z]{2,}")
HIDES = re.compile(r"""\shidden(?=[\s=]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
ENDS = tuple('.!?:;"”»…)')


class Node:
    """A block element, below its nearest block ancestor. Features that the ancestors have are not stored again, so that
    a chain of any depth takes no more room than its tags."""

    __slots__ = ("parent", "tag", "fresh", "box", "boxes", "near", "score")

    def __init__(self, parent: Node | None, tag: str, words: tuple[str, ...], fresh: tuple[str, ...]):
        self.parent, self.tag, self.fresh, self.score = parent, tag, fresh, None
        self.box, self.boxes, self.near = (parent.box, parent.boxes, parent.near) if parent else ("none", (), ())
        if tag in STOP and tag not in ("html", "body"):
            self.box, self.boxes = tag, (*self.boxes, tag)[:3]
        if words:
            self.near = tuple(dict.fromkeys(words))

    def local(self) -> list[str]:
        """The features of blocks directly in it that depend on the element alone."""
        return ["tag:" + self.tag, "box:" + self.box, "boxes:" + "/".join(self.boxes), *("near:" + w for w in self.near)]


ROOT = Node(None, "none", (), ())


class Block:
    __slots__ = ("node", "parts", "linked", "links", "text", "bold")

    def __init__(self, node: Node):
        self.node, self.parts, self.linked, self.links, self.text, self.bold = node, [], 0, 0, "", 0


class Tags:
    """Markup of a page from left to right: (start, end, closing, tag, attributes), tag "" for what is no element and
    "<" for character data. Attributes end at the first > outside quotes, or at the first one if quotes do not close;
    no part of the page is looked at more than a few times."""

    def __init__(self, page: str):
        self.page, self.last = page, {c: page.rfind(c) for c in """>"'"""}
        self.open_ended: set[int] = set()  # places outside quotes from which no > outside quotes follows

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        page, n = self.page, len(self.page)
        while (start := page.find("<", at)) >= 0:
            for opens, closes, tag in (("<!--", "-->", ""), ("<![CDATA[", "]]>", "<")):
                if page.startswith(opens, start):
                    end = page.find(closes, start + len(opens))
                    body = page[start + len(opens) : end if end >= 0 else n] if tag else ""
                    return start, end + 3 if end >= 0 else n, False, tag, body
            if page.startswith(("<!", "<?"), start):
                end = page.find(">", start)
                return start, end + 1 if end >= 0 else n, False, "", ""
            m = TAG_NAME.match(page, start + 1) if start < self.last[">"] else None
            if m:
                end = self.outside(m.end())
                end = end if end >= 0 else page.find(">", m.end())
                name = m[0].lower()
                return start, end + 1, name[0] == "/", name.removeprefix("/"), page[m.end() : end]
            at = start + 1
        return None

    def outside(self, at: int) -> int:
        """The first > that is in no quotes; -1: none."""
        seen = []
        while at not in self.open_ended:
            seen.append(at)
            m = SPECIAL.search(self.page, at) if at <= self.last[">"] else None
            if m and m[0] == ">":
                return m.start()
            end = self.page.find(m[0], m.end()) if m and m.start() < self.last[m[0]] else -1
            if end < 0:
                break
            at = end + 1
        self.open_ended.update(seen)
        return -1


def unescaped(text: str) -> str:
    if "&" not in text:
        return text
    return html.unescape(LONG_NUMBER.sub("\ufffd", text))  # numbers beyond all code points


def leaf_blocks(page: str) -> list[Block]:
    """The blocks of a page that hold text, in page order, with the block element they stand in."""
    out: list[Block] = []
    stack: list[tuple[str, bool, Node, tuple[str, ...]]] = []  # tag, whether it hides its content, block element, features that it has added
    places: dict[str, list[int]] = {}  # tag -> its places in the stack
    active: dict[str, int] = {}  # features of the open elements, with the number of elements that have them
    block = Block(ROOT)
    tags, at, n = Tags(page), 0, len(page)

    def close_block() -> None:
        nonlocal block
        if block.parts:
            block.text = " ".join(unescaped("".join(block.parts)).split())
            if block.text:
                out.append(block)
        block = Block(stack[-1][2] if stack else ROOT)

    def pop_to(i: int) -> None:
        ends = False
        while len(stack) > i:
            tag, _, _, features = stack.pop()
            places[tag].pop()
            ends |= tag in BLOCKS
            for f in features:
                active[f] -= 1
        if ends:
            close_block()

    def topmost(names: set[str]) -> int:
        return max((places[t][-1] for t in names if places.get(t)), default=-1)

    def add(text: str) -> None:
        if text and not (stack and stack[-1][1]):
            block.parts.append(text)
            if not text.isspace():
                if places.get("a"):
                    block.linked += len(text)
                if places.get("b") or places.get("strong"):
                    block.bold += len(text)

    while found := tags.next(at):
        start, end, closing, tag, attributes = found
        add(page[at:start])
        at = end
        if tag in ("", "<"):
            add(attributes)
            continue
        if closing:
            own = places.get(tag)
            if tag in ("p", "br") and not own:
                close_block() if tag == "p" else block.parts.append(" ")
            elif own and (tag in BLOCKS or own[-1] >= topmost(STOP)):
                pop_to(own[-1])
            continue
        if tag in CLOSES:
            scope = topmost(SCOPE.get(tag, STOP))
            inside = [p[k] for t in CLOSES[tag] if (p := places.get(t)) and (k := bisect_right(p, scope)) < len(p)]
            if inside:
                pop_to(min(inside))
        if tag in VOID:
            if tag == "hr":
                close_block()
            elif tag == "br":
                block.parts.append(" ")
            continue
        if attributes.rstrip().endswith("/") and tag not in BLOCKS and tag not in HIDDEN and tag != "a":
            continue
        hides = tag in HIDDEN or bool(stack and stack[-1][1]) or bool(attributes and HIDES.search(attributes))
        node, features = stack[-1][2] if stack else ROOT, ()
        if tag in BLOCKS:
            words = tuple(w for x in NAMES.findall(attributes) for w in WORD.findall(x.lower())) if "=" in attributes else ()
            features = tuple(dict.fromkeys(("in:" + tag, *("name:" + w for w in words))))
            node = Node(node, tag, words, tuple(f for f in features if not active.get(f)))
            for f in features:
                active[f] = active.get(f, 0) + 1
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, hides, node, features))
        if tag in BLOCKS:
            close_block()
        elif tag == "a":
            block.links += 1
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            add(page[at : close.start() if close else n])
            at = close.end() if close else n
            pop_to(len(stack) - 1)
    add(page[at:])
    stack.clear()
    close_block()
    return out


def text_features(blocks: list[Block]) -> Iterator[list[str]]:
    """The features of each block from its text and its place."""
    longest = max((len(b.text) for b in blocks), default=0)
    for i, b in enumerate(blocks):
        text, own = b.text, ["bias"]
        n, spaces = len(text), text.count(" ") + 1
        own.append(f"words:{min(7, spaces.bit_length())}")
        share = b.linked / max(1, n)
        own.append("links:" + ("none" if not b.linked else "some" if share < 0.3 else "many" if share < 0.8 else "all"))
        own.append("ends:" + ("stop" if text.endswith(ENDS) else "open"))
        stops = text.count(". ") + text.count("! ") + text.count("? ") + text.endswith((".", "!", "?"))
        own.append(f"stops:{min(4, stops)}")
        own.append(f"commas:{min(3, text.count(','))}")
        own.append(f"size:{min(3, int(4 * n / longest))}")
        if text[0] in "©®" or "©" in text[:20] or "(c)" in text[:20].lower():
            own.append("mark:copyright")
        if i == 0:
            own.append("at:first")
        if i == len(blocks) - 1:
            own.append("at:last")
        yield own


def block_features(blocks: list[Block]) -> list[list[str]]:
    """All features of each block, for training."""
    out = []
    for b, own in zip(blocks, text_features(blocks), strict=True):
        node = b.node
        own += node.local()
        while node is not None:
            own += node.fresh
            node = node.parent
        out.append(own)
    return out


def block_scores(blocks: list[Block], weights: dict[str, float]) -> np.ndarray:
    """The sum of the weights of each block's features; an element's part is added up once."""
    get, local = weights.get, {}

    def chain(node: Node) -> float:
        path = []
        while node is not None and node.score is None:
            path.append(node)
            node = node.parent
        total = node.score if node is not None else 0.0
        for x in reversed(path):
            total += sum(get(f, 0.0) for f in x.fresh)
            if x is not ROOT:
                x.score = total
        return total

    scores = []
    for b, own in zip(blocks, text_features(blocks), strict=True):
        if id(b.node) not in local:
            local[id(b.node)] = chain(b.node) + sum(get(f, 0.0) for f in b.node.local())
        scores.append(local[id(b.node)] + sum(get(f, 0.0) for f in own))
    return np.array(scores)


#: Parts around articles, by their names in class and id attributes (the trainer's vocabulary).
OTHER_NAMES = {
    "menu": "menu nav navbar navigation topnav breadcrumb breadcrumbs tabs toc pagination pager skip",
    "head": "header masthead topbar branding logo banner site-header page-header",
    "notice": "cookie consent notice gdpr alert popup modal overlay newsletter-popup banner-notice message toast",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner-ad adsense",
    "form": "form search login signup subscribe newsletter contact-form search-form register",
    "side": "sidebar aside widget related recommended popular trending share social tags meta-links more",
    "comments": "comments comment comment-list discussion replies responses disqus comment-body",
    "foot": "footer copyright legal colophon site-footer bottom credits",
}
ARTICLE_NAMES = "article content post entry post-content article-body entry-content main-content story body text page-content markdown prose"


def labelled_pages(count: int = 600, seed: int = 5) -> Iterator[tuple[str, list[tuple[str, int]]]]:
    """Pages of invented text in several templates, with the text and the label (1: article) of each block."""
    rng = random.Random(seed)
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ment sch ung keit que les ción para".split()

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def sentence(low: int = 3, high: int = 18) -> str:
        return " ".join(word() for _ in range(rng.randint(low, high))).capitalize() + rng.choice(".....!?")

    def phrase(low: int = 1, high: int = 4) -> str:
        return " ".join(word() for _ in range(rng.randint(low, high))).capitalize()

    for _ in range(count):
        blocks: list[tuple[str, int]] = []
        out: list[str] = []
        noise = rng.random() < 0.5  # a style of shouting or of signs behind words
        plain = rng.random() < 0.5  # bare elements, without names

        def put(text: str, label: int) -> str:
            if noise and label and rng.random() < 0.5:
                text = " ".join(w + rng.choice(["***", "###", "%%%", "!!", "&&&"]) for w in text.split())
            blocks.append((text, label))
            return html.escape(text, quote=False)

        def name(kind: str, always: bool = False) -> str:
            if plain and not always:
                return ""
            words = rng.choice((ARTICLE_NAMES if kind == "article" else OTHER_NAMES[kind]).split())
            return f' {rng.choice(["class", "class", "id"])}="{words}"'

        def links(kind: str, low: int = 2, high: int = 8) -> str:
            style = rng.random()
            rows = [f'<a href="/{i}">{{}}</a>' for i in range(rng.randint(low, high))]
            if style < 0.7:
                return "<ul>" + "".join("<li>" + r.format(put(phrase(), 0)) + rng.choice(["</li>", ""]) for r in rows) + "</ul>"
            if style < 0.85:
                return "".join("<p>" + r.format(put(phrase(), 0)) + "</p>" for r in rows)
            return "<div><a href='#'>" + put(" ".join(phrase() for _ in rows), 0) + "</a></div>"

        def paragraphs(label: int, low: int, high: int) -> str:
            rows = []
            for _ in range(rng.randint(low, high)):
                text = " ".join(sentence() for _ in range(rng.choice([1, 1, 1, 2, 3, 5, 8]))) if rng.random() > 0.1 else phrase(1, 2) + "."
                own = put(text, label)
                if rng.random() < 0.2:
                    own = "<b>" + own + rng.choice(["</b>", "<br>", ""])
                elif rng.random() < 0.15:
                    first, _, rest = own.partition(" ")
                    own = f'<a href="/x">{first}</a> {rest}'
                rows.append("<p>" + own + rng.choice(["</p>", "</p>", "</p>", ""]))
            return "".join(rows)

        def element(tags: list[str], kind: str, inner: str) -> str:
            tag = rng.choice(tags)
            return f"<{tag}{name(kind, tag in ('div', 'section'))}>{inner}</{tag}>"

        out.append(f"<!DOCTYPE html><html><head><title>{phrase()}</title><style>p{{margin:0}}</style></head><body>")
        if rng.random() < 0.5:
            out.append(element(["header", "header", "div"], "head", rng.choice(["<p>", "<div>", "<span>"]) + put(phrase(), 0) + (links("menu") if rng.random() < 0.4 else "")))
        if rng.random() < 0.8:
            out.append(element(["nav", "nav", "nav", "div"], "menu", links("menu")))
        for kind, tags, chance in (("notice", ["div", "aside", "section"], 0.3), ("ad", ["div", "aside"], 0.6), ("form", ["form", "div"], 0.25)):
            if rng.random() < chance:
                inner = rng.choice(["{}", "<p>{}</p>", "<div>{}</div>"]).format(put(" ".join(sentence() for _ in range(rng.randint(1, 3))), 0))
                if kind == "form":
                    inner = "<label>" + put(phrase(), 0) + "</label><input name=q><button>Go</button>"
                out.append(element(tags, kind, inner))
        if rng.random() < 0.2:
            out.append(element(["aside", "div"], "side", "<h3>" + put(phrase(), 0) + "</h3>" + links("side")))
        tag = rng.choice(["article", "article", "article", "main", "div", "section"])
        out.append(f"<{tag}{name('article', tag in ('div', 'section'))}>")
        if rng.random() < 0.3:
            out.append("<div class='content'>")
        if rng.random() < 0.8:
            out.append(f"<h1>{put(phrase(2, 9), 1)}</h1>")
        for _ in range(rng.choice([1, 1, 1, 2, 3])):
            out.append(paragraphs(1, 1, 8))
            kind = rng.random()
            if kind < 0.2:
                out.append(f"<h2>{put(phrase(1, 5), 1)}</h2>")
            elif kind < 0.3:
                out.append("<ul>" + "".join("<li>" + put(sentence(2, 9), 1) + "</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.38:
                out.append("<blockquote>" + put(sentence(), 1) + "</blockquote>")
            elif kind < 0.44:
                out.append("<table><tr><td>" + put(phrase(), 1) + "</td><td>" + put(phrase(), 1) + "</td></tr></table>")
            elif kind < 0.5:
                out.append("<pre>" + put(phrase(3, 8), 1) + "</pre>")
            elif kind < 0.62:
                out.append(element(["div", "aside"], "ad", put(sentence(), 0)))
            elif kind < 0.7:
                out.append(element(["div", "aside"], "side", links("side", 2, 4)))
        out.append(f"</{tag}>")
        if rng.random() < 0.25:
            out.append(element(["aside", "div"], "side", "<h3>" + put(phrase(), 0) + "</h3>" + links("side")))
        if rng.random() < 0.3:
            inner = "<h2>" + put(phrase(1, 2), 0) + "</h2>" + "".join(f"<div class='{rng.choice(['comment', 'reply', 'comment-body'])}'>" + paragraphs(0, 1, 2) + "</div>" for _ in range(rng.randint(1, 4)))
            out.append(f"<{(t := rng.choice(['section', 'div']))}{name('comments', True)}>{inner}</{t}>")
        if rng.random() < 0.9:
            text = rng.choice(["© {}", "Copyright {}", "{}", "© {} · " + sentence()]).format(phrase())
            out.append(element(["footer", "footer", "footer", "div"], "foot", rng.choice(["{}", "<p>{}</p>"]).format(put(text, 0)) + (links("foot", 1, 3) if rng.random() < 0.3 else "")))
        if rng.random() < 0.8:
            out.append("</body></html>")
        yield "".join(out), [(" ".join(t.split()), label) for t, label in blocks]


def plain_pages(count: int = 200, seed: int = 11) -> Iterator[tuple[str, list[tuple[str, int]]]]:
    """Pages without names and sections, as `labelled_pages` gives them: bare text, layouts by tables, nested divisions."""
    rng = random.Random(seed)
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ment sch ung keit que les ción para".split()

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high))).capitalize()

    for _ in range(count):
        blocks: list[tuple[str, int]] = []

        def put(text: str, label: int) -> str:
            blocks.append((text, label))
            return html.escape(text, quote=False)

        def linked() -> str:
            names, style = [words(1, 2) for _ in range(rng.randint(1, 5))], rng.random()
            if style < 0.5:  # one block of several links
                put(" ".join(names), 0)
                return rng.choice([" ", "<br>"]).join(f"<a href={i}>{html.escape(x, quote=False)}</a>" for i, x in enumerate(names))
            tag = rng.choice(["div", "p", "td", "li"])
            rows = "".join(f"<{tag}><a href='/{i}'>{put(x, 0)}</a></{tag}>" for i, x in enumerate(names))
            return {"td": f"<table><tr>{rows}</table>", "li": f"<ul>{rows}</ul>"}.get(tag, rows)

        def text() -> str:
            return " ".join(words(4, 16) + rng.choice("...!?") for _ in range(rng.choice([1, 1, 2, 3, 5])))

        def article() -> str:
            tag = rng.choice(["p", "p", "p", "div"])
            head = rng.choice(["<h1>{}</h1>", "<h2>{}</h2>", "<b>{}</b>"]).format(put(words(1, 6), 1)) if rng.random() < 0.6 else ""
            rows = [f"<{tag}>{put(text(), 1)}</{tag}>" for _ in range(rng.choice([1, 1, 2, 3, 4]))]
            return head + "".join(rows)

        def foot() -> str:
            return put(rng.choice(["© {}", "Copyright {}", "Copyright 20{1} {0}", "{}"]).format(words(1, 3), rng.randint(10, 29)), 0) if rng.random() < 0.6 else linked()

        kind = rng.random()
        if kind < 0.35:  # nothing but the text
            out = rng.choice(["{}", "<div>{}</div>", "<div><div>{}</div></div>", "<table><tr><td>{}</td></tr></table>", "<center>{}</center>"]).format(article() if rng.random() < 0.8 else put(text(), 1))
        elif kind < 0.7:  # rows or columns of a table
            parts = [linked(), article(), foot()] if rng.random() < 0.7 else [linked(), article()]
            out = "<table>" + rng.choice(["</td></tr><tr><td>", "</td><td>", "<td>"]).join(parts).join(["<tr><td width=100>", "</td></tr></table>"])
        else:
            parts = [linked() for _ in range(rng.randint(1, 2))] + [article()] + [foot() for _ in range(rng.randint(0, 2))]
            out = "".join(f"<div>{'<div>' * (n := rng.randint(0, 2))}{x}{'</div>' * n}</div>" for x in parts)
        yield rng.choice(["{}", "<body>{}</body>", "<html><head><title>T</title></head><body>{}</body></html>"]).replace("{}", out), [(" ".join(t.split()), label) for t, label in blocks]


def training_pages() -> Iterator[tuple[str, list[tuple[str, int]]]]:
    """All templates."""
    yield from labelled_pages()
    yield from plain_pages()


class Extractor:
    """The trained field."""

    def __init__(self, weights: dict[str, float], trans: np.ndarray):
        self.weights, self.trans = weights, trans

    def __call__(self, page: str) -> str:
        blocks = leaf_blocks(page)
        if not blocks:
            return ""
        s = block_scores(blocks, self.weights)
        return "\n\n".join(b.text for b, y in zip(blocks, crf.viterbi(s, self.trans), strict=True) if y)


def train(pages: Iterator[tuple[str, list[tuple[str, int]]]], rounds: int = 250) -> Extractor:
    """The field that fits pages with labelled blocks. A block that is labelled in pieces or not at all is left out."""
    ids: dict[str, int] = {}
    features, labels, lengths = [], [], []
    for page, known in pages:
        blocks = leaf_blocks(page)
        want = dict(known)
        own = block_features(blocks)
        kept = [(f, want[b.text]) for f, b in zip(own, blocks, strict=True) if b.text in want]
        features += [[ids.setdefault(x, len(ids)) for x in f] for f, _ in kept]
        labels += [y for _, y in kept]
        lengths.append(len(kept))
    flat, sizes = np.array([i for f in features for i in f], np.int64), np.array([len(f) for f in features], np.int64)
    w, trans = crf.train([(np.arange(len(features)), np.array(labels), np.array(lengths, np.int64))], flat, sizes, len(ids), rounds=rounds)
    return Extractor({f: float(w[i]) for f, i in ids.items()}, trans)


def extract(df: DataFrame, page: str = "html", model: Extractor | None = None) -> DataFrame:
    """df with `text`, the article's text, in place of the page."""
    model = model or train(training_pages())
    rest = [c for c in df.columns if c not in ("text", page)]
    df = df.select(*[F.col(f"`{c}`") for c in rest], clean_text(page).alias("text"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for rows in byte_chunks(pc.binary_length(batch.column(len(rest))).to_pylist(), CHUNK_BYTES):
                part = batch.slice(rows.start, rows.stop - rows.start)
                texts = [model(x) for x in part.column(len(rest)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=[*rest, "text"])

    return df.mapInArrow(batches, T.StructType(df.schema.fields))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op2_html": op2_html}
ORACLE: dict[str, str] = {}
