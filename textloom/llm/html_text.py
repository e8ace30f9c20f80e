"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into a flat run of text blocks at block-level tags; no tree of the page is built. Each block has its
word count and link density, those of its neighbours, and what encloses it. A decision tree (CART, Gini), trained here
from a small labelled table of pages, tells content from the rest; names of classes are one feature among others.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small
from .trees import grow_tree, tree_value

#: Element and word lists.
_BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SPACE = frozenset("br img input wbr".split())
_HIDDEN = frozenset("script style noscript template textarea title svg math iframe object canvas select".split())
_BOILER_TAGS = frozenset("nav header footer aside form menu dialog button fieldset".split())
_CONTENT_TAGS = frozenset("article main".split())
_HINTS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form header login menu modal nav navbar navigation newsletter notice notices popup promo promotion related replies reply share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
#: Open elements that the start of an element ends, if they are the innermost.
_ENDS = {"li": {"p", "li"}, "td": {"p", "td", "th"}, "th": {"p", "td", "th"}, "tr": {"p", "td", "th", "tr"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "option": {"option"}}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?=[a-zA-Z/!?])(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|<[a-zA-Z/!?][^>]*(?:>|\Z)", re.S)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WHITE = re.compile(r"\s+")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Attribute of the labelled table's elements that are content.
_MARK = "data-main"

FEATURES = ("words", "links", "prev_words", "prev_links", "next_words", "next_links", "hint", "frame", "content", "inside", "heading", "item")


def hint(names: str) -> int:
    """What a class or id says of its element: 2 if a name is or ends in one of the hints, 1 if one is a part of it."""
    worst = 0
    for name in names.lower().replace("_", "-").split():
        parts = name.split("-")
        if parts[-1] in _HINTS and parts[0] not in ("has", "no", "with", "without"):
            return 2
        if any(p in _HINTS for p in parts):
            worst = 1
    return worst


class Block:
    __slots__ = ("content", "frame", "heading", "hint", "inside", "item", "linked", "marked", "text", "words")


class _Open:
    """The open elements, with what they say counted so that no block looks through them."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, int]] = []  # name, kind (1 frame, 2 content, 4 hidden, 8 marked), hint
        self.names: dict[str, int] = {}
        self.kinds = dict.fromkeys((1, 2, 4, 8), 0)
        self.hints = [0, 0, 0]
        self.inside = [0]  # frames and strong hints since the innermost content element, for each content element

    def push(self, name: str, kind: int, hinted: int) -> None:
        self.stack.append((name, kind, hinted))
        self.names[name] = self.names.get(name, 0) + 1
        for k in self.kinds:
            self.kinds[k] += bool(kind & k)
        self.hints[hinted] += 1
        if kind & 2:
            self.inside.append(0)
        elif kind & 1 or hinted == 2:
            self.inside[-1] += 1

    def pop(self) -> None:
        name, kind, hinted = self.stack.pop()
        self.names[name] -= 1
        for k in self.kinds:
            self.kinds[k] -= bool(kind & k)
        self.hints[hinted] -= 1
        if kind & 2:
            self.inside.pop()
        elif kind & 1 or hinted == 2:
            self.inside[-1] -= 1

    def close(self, name: str) -> None:
        if self.names.get(name):
            while self.stack[-1][0] != name:
                self.pop()
            self.pop()

    def ended_by(self, name: str) -> None:
        ends = _ENDS.get(name, {"p"})
        while self.stack and self.stack[-1][0] in ends:
            self.pop()


def _kind(name: str, tag: str, inside: bool) -> tuple[int, int]:
    """(kind, hint) of a block element. A header inside of content is its title; html and body frame nothing."""
    kind = 1 * (name in _BOILER_TAGS and not (inside and name == "header")) | 2 * (name in _CONTENT_TAGS)
    hinted = 0
    if len(tag) > len(name) + 2 and name != "body":
        for key, value in _ATTR.findall(tag):
            key, value = key.lower(), value.strip("\"'")
            if key in ("class", "id"):
                hinted = max(hinted, hint(value))
            elif key == "role":
                kind |= 1 * (value in _ROLES) | 2 * (value in ("main", "article"))
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDING.search(value):
                kind |= 4
        if _MARK in tag:
            kind |= 8
    return kind, hinted


def cut_blocks(page: str) -> list[Block]:
    """The page's blocks that have text, in order. One pass, linear in the page however it is nested."""
    blocks: list[Block] = []
    open_ = _Open()
    text: list[str] = []
    linked, anchor, pos, end = 0, False, 0, len(page)

    def close_block() -> None:
        nonlocal linked
        if text:
            if body := _WHITE.sub(" ", html.unescape("".join(text))).strip():
                b = Block()
                b.text, b.words = body, body.count(" ") + 1
                b.linked = min(1.0, linked / max(1, len(body)))
                b.hint = 2 if open_.hints[2] else 1 if open_.hints[1] else 0
                b.frame, b.content, b.marked = (open_.kinds[k] > 0 for k in (1, 2, 8))
                b.inside = b.content and open_.inside[-1] > 0
                names = [n for n, _, _ in open_.stack[-3:]]
                b.heading = any(len(n) == 2 and n[0] == "h" and n[1].isdigit() for n in names)
                b.item = "li" in names or "td" in names
                blocks.append(b)
            text.clear()
        linked = 0

    while pos < end:
        m = _TOKEN.search(page, pos)
        chunk = page[pos : m.start() if m else end]
        if chunk and not open_.kinds[4]:
            text.append(chunk)
            if anchor:
                linked += len(chunk.strip())
        if not m:
            break
        pos = m.end()
        tag = m.group()
        got = _NAME.match(tag)
        if not got:
            continue
        name = got[1].lower()
        if name in _SPACE:
            text.append(" ")
        if name in _BLOCK:
            close_block()
        if tag[1] == "/":
            if name == "a":
                anchor = False
            open_.close(name)
            continue
        if name == "a":
            anchor = True
        if name in _VOID or tag.endswith("/>"):
            continue
        if name in _HIDDEN:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, pos)
            pos = close.end() if close else end
            continue
        if name in _BLOCK:
            open_.ended_by(name)
            open_.push(name, *_kind(name, tag, open_.kinds[2] > 0))
    close_block()
    return blocks


def features(blocks: list[Block]) -> list[tuple[float, ...]]:
    """FEATURES of each block; beyond the first and last block there are blocks without words."""
    w = [0, *(b.words for b in blocks), 0]
    d = [0.0, *(b.linked for b in blocks), 0.0]
    return [(w[i], d[i], w[i - 1], d[i - 1], w[i + 1], d[i + 1], b.hint, b.frame, b.content, b.inside, b.heading, b.item) for i, b in enumerate(blocks, 1)]


#: What the labelled pages are put together from.
_TOPICS = "the river changed its course|people of the valley kept bees|a bridge was built of stone|old maps show two more roads|the harbour froze in winter|nobody had seen the letter before|prices rose for the third year|she read the report twice|der Zug kam mit Verspätung an|die Stadt plant neue Wege|le conseil a voté la mesure|la casa estaba vacía desde hace años".split("|")
_MENUS = "Home|News|Contact|About us|Sports|Archive|Next page|Previous|Top stories|Terms|Privacy|Log in|Impressum|Accueil|Inicio|Read more|All topics|Weather".split("|")
_SMALL = "All rights kept.|Example Press 2020|Follow us for more.|Sign up and get news every week by mail.|Buy now, while the offer lasts.|We use cookies to make this site work well for you and for us.|Search the site|By the web team|Share this with your friends|Printed in the old town"
_SAID = "I agree with every word of it.|Thanks, that was a good read!|This is wrong, and has been for years.|First!|Where can one buy that map they speak of?".split("|")
_SHORT = "No.|Yes, of course.|It ended well.|Then he left.|So it was.|Two words.".split("|")


def labelled_pages(seed: int = 11, n: int = 600) -> list[str]:
    """n labelled pages, made by rule. Elements with data-main hold content, all else is not.

    Half of them have article or main, a quarter names its boxes by class or id only, a quarter is of bare elements,
    where words and links, own and neighbours', have to tell.
    """
    r = random.Random(seed)
    say = lambda lo, hi: (t := ", and ".join(r.choice(_TOPICS) for _ in range(r.randint(lo, hi))))[0].upper() + t[1:] + "."
    link = lambda: f'<a href="/{r.randint(1, 99)}">{r.choice(_MENUS)}</a>'
    small = _SMALL.split("|")
    title = lambda: " ".join(say(1, 1).rstrip(".").split()[: r.choice([1, 2, 3, 99])])

    def menu(name: str) -> str:
        items = [link() for _ in range(r.randint(2, 7))]
        return r.choice([f"<{name}><ul>{''.join(f'<li>{x}</li>' for x in items)}</ul></{name.split()[0]}>", f"<{name}>{' '.join(items)}</{name.split()[0]}>", f"<{name}>{' | '.join(items)}</{name.split()[0]}>"])

    def piece() -> str:
        return r.choice([f"<p data-main>{say(2, 6)}</p>", f"<p data-main>{say(2, 6)}", f"<p data-main>{say(1, 3)} <a href=x>{say(1, 1)}</a> {say(1, 2)}</p>", f"<p data-main>{r.choice(_SHORT)}</p>", f"<h2 data-main>{title()}</h2>", f"<blockquote data-main>{say(1, 2)}</blockquote>", f"<ul data-main><li>{say(1, 1)}</li><li>{r.choice(_SHORT)}</li></ul>", f'<div class="{r.choice(["form-group", "no-sidebar", "comment-form-help", "share-price"])}" data-main>{say(2, 4)}</div>', f"<table data-main><tr><td>{say(1, 1)}</td><td>12</td></tr></table>"])

    def text(linked: bool = False) -> str:
        if r.random() < 0.25:
            return f"<p data-main>{r.choice([say(1, 6), title(), r.choice(_SHORT)])}</p>"
        inner = [piece() for _ in range(r.randint(1, 7))]
        if linked:
            inner.insert(r.randint(0, len(inner)), f"<p data-main><a href=/x>{say(1, 2)}</a></p>")
        head = r.choice([f"<h1 data-main>{title()}</h1>", f"<h1 data-main>{title()}</h1>", ""])
        return f"{head}<p data-main>{say(2, 6)}</p>" + "".join(inner) + r.choice(["", f"<p data-main>{say(2, 5)}</p>"])

    maybe = lambda x, p=0.6: x if r.random() < p else ""

    def page(style: int) -> str:
        if style == 0:
            tag = r.choice(["article", "main"])
            extra = r.choice(["", "", f"<aside><p>{say(1, 4)}</p></aside>", f"<section class=comments><h3>Comments</h3><p>{r.choice(_SAID)}</p><p>{say(1, 3)}</p></section>", f"<form><label>{r.choice(small)}</label><p>{say(1, 2)}</p></form>", f"<div class=share>{link()} {link()}</div>", f'<div class="ad">{say(1, 4)}</div>'])
            top = r.choice(["", "", f"<header><h1 data-main>{title()}</h1></header>"])
            head = maybe(f"<header><h1>{link()}</h1><p>{r.choice(small)}</p></header>", 0.4)
            foot = maybe(f"<footer>{r.choice(small)} {maybe(say(1, 2), 0.5)}</footer>")
            body = f"<{tag}>{top}{text(True)}{extra}{maybe('<p data-main>' + say(1, 3) + '</p>', 0.4)}</{tag}>"
            if r.random() < 0.2:
                body = f'<div class="{r.choice(["site header", "modal", "notice", "page-form"])}">{body}</div>'
            return f"{head}{maybe(menu('nav'))}{maybe('<p>' + r.choice(small) + '</p>', 0.2)}{body}{maybe('<aside><p>' + say(1, 5) + '</p></aside>', 0.3)}{foot}"
        if style == 1:
            box = lambda c: f'<div class="{c}"><p>{r.choice([*small, say(1, 4)])}</p></div>'
            names = r.sample(["ad", "cookie-notice", "sidebar", "newsletter", "share", "promo", "related", "banner"], 3)
            who = maybe(f'<div id="comments"><p>{r.choice(_SAID)}</p><p>{say(1, 4)}</p></div>')
            return f"{maybe(box(names[0]))}{maybe(menu('div class=menu'))}<div class=post>{text()}</div>{maybe(box(names[1]))}{who}{maybe(box(names[2]))}{maybe('<div class=footer>' + r.choice(small) + '</div>')}"
        return f"{maybe(menu('div'), 0.8)}{maybe('<div>' + link() + '</div>', 0.4)}<div>{text()}</div>{maybe(menu('div'))}{maybe('<div>' + r.choice(small) + '</div>')}"

    return [f"<html><body{r.choice(['', ' class=has-sidebar', ' class=home'])}>{page((0, 1, 0, 2)[i % 4])}</body></html>" for i in range(n)]


def train_blocks(pages: list[str] | None = None) -> dict | int:
    """A tree from labelled pages; those of labelled_pages() where none are given."""
    rows, y = [], []
    for page in pages if pages is not None else labelled_pages():
        blocks = cut_blocks(page)
        rows += features(blocks)
        y += [int(b.marked) for b in blocks]
    return grow_tree(rows, y, depth=10, least=3)


def main_text(page: str, tree: dict | int) -> str:
    """The page's content blocks, joined by two line feeds."""
    blocks = cut_blocks(page)
    return "\n\n".join(b.text for b, row in zip(blocks, features(blocks), strict=True) if tree_value(tree, row))


def _extractor(tree: dict | int):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [main_text(p or "", tree) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    return extract


def extract_main_text(pages: DataFrame, tree: dict | int | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars), a row for each row of pages.

    Character references are decoded, white space within a block becomes one space, blocks are trimmed and joined in
    page order by two line feeds. Null, empty and contentless pages give the empty text. Repeated rows each return a
    row. An empty table gives no rows. Time and memory are linear in a page, whatever its nesting. Other columns are not
    read.
    """
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(_extractor(train_blocks() if tree is None else tree), f"id {kind}, url string, text string, n_chars bigint")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
