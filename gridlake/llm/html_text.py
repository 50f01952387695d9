"""Main-text extraction from HTML by a maximum-scoring subsequence (operator 8).

A page is a sequence of words and tags. Words score positive and tags negative; the weights are log ratios
of a token kind's share inside and outside the article, counted over all labelled pages: those that
mark their content with exactly one ``article`` or ``main`` element. A linear scan finds the contiguous region
of greatest score, which is completed to the element that encloses it; inside it, elements that are never
content (menus, page headers and footers, sidebars, notices, adverts, forms, scripts, styles, reader comments)
are left out. Character references are decoded, white space inside a block becomes one space, blocks
are joined by one line feed.

Cases: null or empty html and pages without words give the empty text; unclosed and crossing tags close with the element
around them, a ``<`` that opens no tag is text; with no labelled page all tags cost the same; repeated rows
are extracted one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|textarea|select|svg|title)\b[^<>]*+(?<!/)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][a-z0-9:-]*+)(?P<attrs>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-z][a-z0-9:-]*+)(?P<attrs2>[^<>]*+)>"
    r"|<[!?][^<>]*+>|[^<]++|<", re.S | re.I,
)
SELECTOR = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
CONTENT = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never content.
ASIDE = frozenset("nav header footer aside form button dialog menu object applet canvas audio video datalist".split())
#: Words in class, id or role that mark such elements.
ASIDE_NAMES = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside notice notices cookie cookies banner consent ad ads adv advert adverts advertisement "
    "advertising sponsor sponsored promo promotion comment comments disqus reply replies respond share sharing social related recommended "
    "widget breadcrumb breadcrumbs newsletter subscribe subscription popup modal login signup search pagination pager skip contentinfo complementary".split()
)
#: A name that only says whether there is such an element elsewhere, as in ``no-sidebar``.
ABOUT_OTHERS = re.compile(r"(?:no|not|with|without|has|have|hide|show|after|before)[-_]", re.I)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 "
    "h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img input ins kbd label link map mark meta meter output q ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: A start tag of these closes an open one of the same group.
CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WORDS = re.compile(r"\S+")
WORD = "word"


@dataclass
class Element:
    name: str
    parent: int
    start: int
    end: int
    aside: bool


@dataclass
class Page:
    """Token kinds, texts (None for tags), the element each lies in, and the elements."""

    kinds: list[str] = field(default_factory=list)
    texts: list[str | None] = field(default_factory=list)
    inside: list[int] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)


def _marked_aside(name: str, attrs: str, in_content: bool) -> bool:
    if name in ASIDE:
        # an article may have a header of its own, which holds its title
        return not (name == "header" and in_content)
    if name in ("html", "body", *CONTENT):
        return False
    for found in SELECTOR.finditer(attrs):
        names = (found[1] or found[2] or found[3] or "").lower().split()
        words = [w for name in names if not ABOUT_OTHERS.match(name) for w in re.split(r"[^a-z]+", name)]
        if not ASIDE_NAMES.isdisjoint(words) and not ("header" in words and in_content):
            return True
    return False


def parse(source: str) -> Page:
    page = Page()
    page.elements.append(Element("", -1, -1, -1, False))
    stack, opened, contents = [0], Counter(), 0
    add = lambda kind, text: (page.kinds.append(kind), page.texts.append(text), page.inside.append(stack[-1]))

    def leave(depth: int):
        nonlocal contents
        while len(stack) > depth:
            gone = page.elements[stack.pop()]
            gone.end = len(page.kinds)
            opened[gone.name] -= 1
            contents -= gone.name in CONTENT

    for found in TOKEN.finditer(source):
        name = (found["name"] or found["name2"] or "").lower()
        if not name:
            text = found[0]
            if found["raw"]:
                add(found["raw"].lower(), None)
            elif text[0] == "<" and len(text) > 1:
                add("markup", None)
            else:
                add(WORD, text)
            continue
        known = name if name in BLOCKS or name in INLINE or name in ASIDE else "other"
        if found["close"] or found["close2"]:
            # an end tag without an open element is not looked for
            depth = next((i for i in range(len(stack) - 1, 0, -1) if page.elements[stack[i]].name == name), 0) if opened[name] > 0 else 0
            if depth:
                leave(depth)
            add("/" + known, None)
            continue
        attrs = found["attrs"] or found["attrs2"] or ""
        top = page.elements[stack[-1]].name
        if top == "p" and name in BLOCKS or top in CLOSING.get(name, ()):
            leave(len(stack) - 1)
        aside = _marked_aside(name, attrs, contents > 0)
        add(known + "!" * aside, None)
        if name not in VOID and not attrs.endswith("/"):
            parent = stack[-1]
            page.elements.append(Element(name, parent, len(page.kinds), -1, aside or page.elements[parent].aside))
            stack.append(len(page.elements) - 1)
            opened[name] += 1
            contents += name in CONTENT
    leave(0)
    return page


def labelled_region(page: Page) -> tuple[int, int] | None:
    """Where the page's only content element lies, if it has exactly one."""
    own = [e for e in page.elements if e.name in CONTENT]
    return (own[0].start, own[0].end) if len(own) == 1 else None


def _words(text: str) -> int:
    return len(WORDS.findall(text))


def learn(pages: DataFrame, column: str = "html") -> dict[str, float]:
    """Weight of every token kind; the kinds are a fixed vocabulary, so the result is bounded."""

    def counted(batches):
        n: dict[str, list[int]] = {}
        for batch in batches:
            for source in batch[column]:
                page = parse(source) if isinstance(source, str) else None
                region = page and labelled_region(page)
                if region:
                    for i, (kind, text) in enumerate(zip(page.kinds, page.texts, strict=True)):
                        n.setdefault(kind, [0, 0])[region[0] <= i < region[1]] += 1 if text is None else _words(text)
        if n:
            yield pd.DataFrame({"kind": list(n), "outside": [x[0] for x in n.values()], "inside": [x[1] for x in n.values()]})

    found = pages.select(column).mapInPandas(counted, "kind string, outside long, inside long").groupBy("kind").agg(
        F.sum("outside").alias("outside"), F.sum("inside").alias("inside")).toPandas()
    outside, inside = found["outside"].to_numpy(float) + 0.5, found["inside"].to_numpy(float) + 0.5
    ratio = np.log(inside / inside.sum()) - np.log(outside / outside.sum())
    return {k: float(max(r, 0.05) if k == WORD else min(r, -0.01)) for k, r in zip(found["kind"], ratio, strict=True)}


def best_region(scores: list[float]) -> tuple[int, int] | None:
    """The contiguous run of greatest positive sum, in one pass; the first one of equals."""
    best, found, running, start = 0.0, None, 0.0, 0
    for i, x in enumerate(scores):
        if running <= 0:
            running, start = 0.0, i
        running += x
        if running > best:
            best, found = running, (start, i + 1)
    return found


def extract(source: str | None, weights: dict[str, float]) -> str:
    """The main text of a whole page."""
    page = parse(source) if isinstance(source, str) and source else None
    if page is None:
        return ""
    word, other = weights.get(WORD, 0.5), min(-1.0, *[w for k, w in weights.items() if k != WORD], 0.0) / 2
    # words of elements that are never content gain nothing
    region = best_region([
        weights.get(k, other) if t is None else 0.0 if page.elements[e].aside else word * _words(t)
        for k, t, e in zip(page.kinds, page.texts, page.inside, strict=True)
    ])
    if region is None:
        return ""
    start, end = region
    while page.texts[start] is None or page.elements[page.inside[start]].aside:
        start += 1
    at = page.inside[start]
    while at and page.elements[at].end < end:
        at = page.elements[at].parent
    while at and page.elements[at].name not in BLOCKS:
        at = page.elements[at].parent
    if at and page.elements[at].name in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "b"):
        at = page.elements[at].parent
    if at and page.elements[at].name not in ("html", "body"):
        start, end = page.elements[at].start, page.elements[at].end
    blocks, parts = [], []
    for i in range(start, end):
        text = page.texts[i]
        if text is not None:
            if not page.elements[page.inside[i]].aside:
                parts.append(html.unescape(text))
        elif page.kinds[i].strip("/!") in BLOCKS:
            blocks.append("".join(parts))
            parts = []
        elif page.kinds[i] == "br":
            parts.append(" ")
    blocks.append("".join(parts))
    return "\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def extract_pages(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` without the html, with ``text`` and ``n_chars``; no shuffle."""
    kept = [c for c in pages.columns if c not in (column, "text", "n_chars")]
    shared = pages.sparkSession.sparkContext.broadcast(learn(pages, column))
    schema = T.StructType([pages.schema[c] for c in kept] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def over(batches):
        for batch in batches:
            texts = [extract(x, shared.value) for x in batch[column]]
            out = batch[kept].copy()
            out["text"] = texts
            out["n_chars"] = [len(x) for x in texts]
            yield out

    return pages.select(*kept, column).mapInPandas(over, schema)
