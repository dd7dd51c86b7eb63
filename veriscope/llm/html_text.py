"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into blocks of text at block-level tags. A block's features are its word count and link density, those
of the blocks before and after it, and what stands around it (which kind of region, which tag). A small decision tree,
trained on the labelled blocks of ``training_blocks``, says which blocks are content; they are joined in page order.
Where a page's elements and names tell its regions, they weigh in; where they do not, words and links decide alone.

Defined results: null, empty and text-free html give an empty text; unclosed and stray tags are taken as browsers
take them (a new block ends the one before; an end tag without its start is ignored); an unclosed script, style or
comment runs to the end of the page; repeated rows give repeated results; an empty table gives an empty one; extra
columns are ignored by ``extract``.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriscope.llm.common import table

#: Elements whose text is never shown as text of the page (fixed values: names of html elements).
SILENT = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "textarea", "select", "option", "button", "title", "head", "audio", "video", "map"}
#: Elements that end a block of text where they start or end (fixed values: names of html elements).
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Elements without an end tag (fixed values: names of html elements).
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Kinds of region by element and by words in class, id and role.
REGION_TAGS = {"nav": "menu", "menu": "menu", "header": "head", "footer": "foot", "aside": "side", "form": "form", "dialog": "notice", "article": "article", "main": "article"}
REGION_WORDS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc skip sitemap",
    "head": "header masthead banner topbar logo",
    "foot": "footer foot copyright legal bottom colophon",
    "side": "sidebar side aside rail widget related recommended recommendations trending popular more",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup paywall toast disclaimer",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner-ad adsense outbrain taboola",
    "form": "form login search searchbox contact",
    "comment": "comment comments reply replies disqus discussion respond reviews",
    "share": "share sharing social follow tags byline-links toolbar",
}
_KIND_OF_WORD = {w: k for k, words in REGION_WORDS.items() for w in words.split()}
KINDS = ["article", "menu", "head", "foot", "side", "notice", "ad", "form", "comment", "share"]

FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "item", "stops", *KINDS]

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")


def _region(tag: str, attrs: str) -> str | None:
    kind = REGION_TAGS.get(tag)
    if kind in (None, "article", "head") and attrs and tag not in ("body", "html"):
        for _, a, b, c in _ATTR.findall(attrs):
            for w in _WORD.findall((a or b or c).lower()):
                if w in _KIND_OF_WORD:
                    return _KIND_OF_WORD[w]
    return kind


class _Tags:
    """The tags, comments and declarations of a page, forward and each stretch once: where the way to a tag's end has
    failed is remembered, as is what does not occur further on."""

    def __init__(self, page: str):
        self.page, self.failed, self.absent = page, set(), {}

    def find(self, what: str, at: int) -> int:
        if at >= self.absent.get(what, len(self.page)):
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.absent[what] = at
        return found

    def _end(self, at: int) -> int:
        """The end of the tag whose attributes begin at `at`: the next > outside of quotes; -1 if there is none."""
        way, page = [], self.page
        while at not in self.failed:
            way.append(at)
            m = _STOP.search(page, at) if self.find(">", at) >= 0 else None
            if m and m[0] == ">":
                return m.start()
            close = self.find(m[0], m.end()) if m else -1
            if close < 0:
                break
            at = close + 1
        self.failed.update(way)
        return -1

    def next(self, at: int):
        """(start, end, whether it is an end tag, name, attributes) of what comes next; name None: to be skipped. None: nothing."""
        page = self.page
        while (start := self.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                end = self.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, False, None, ""
            if page.startswith("<![CDATA[", start):
                end = self.find("]]>", start)
                return start, len(page) if end < 0 else end + 3, False, None, ""
            if page.startswith(("<!", "<?"), start):
                end = self.find(">", start)
                if end >= 0:
                    return start, end + 1, False, None, ""
            elif not self.failed and (m := _TAG.match(page, start)):
                return start, m.end(), bool(m[1]), m[2], m[3]
            elif m := _NAME.match(page, start + 1):  # no tag, or a page with stray quotes
                end = self._end(m.end())
                if end >= 0:
                    return start, end + 1, bool(m[1]), m[2], page[m.end() : end]
            at = start + 1
        return None


def blocks(page: str):
    """The page's blocks: (text, words, link words, tag, kinds of region around it)."""
    out, parts, words, linked = [], [], 0, 0
    stack, link, silent, tag, region = [], 0, None, "body", None
    at, size, tags, open_tags, unclosed = 0, len(page), _Tags(page), Counter(), set()

    def flush():
        nonlocal parts, words, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                words = text.count(" ") + 1
                out.append((text, words, min(words, linked), tag, region))
        parts, words, linked = [], 0, 0

    while at < size:
        found = tags.next(at)
        raw = page[at : found[0]] if found else page[at:]
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if link:
                linked += len(text.split())
        if not found:
            break
        _, at, closes, name, attrs = found
        if name is None:
            continue
        written, name = name, name.lower()
        if name in SILENT and name != "head":
            if not closes and not attrs.endswith("/"):
                end = None if name in unclosed else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                if end is None and name not in ("script", "style"):
                    unclosed.add(name)
                    continue
                at = end.end() if end else size
            continue
        if name == "br":
            parts.append(" ")
        elif name == "a":
            link = max(0, link + (-1 if closes else 1))
        elif name in BLOCK:
            flush()
            link = 0
            if closes:
                while open_tags[name]:  # an end tag without its start is ignored
                    top = stack.pop()[0]
                    open_tags[top] -= 1
                    if top == name:
                        break
            elif name not in VOID:
                if stack and (name == stack[-1][0] == "p" or name == stack[-1][0] == "li" or stack[-1][0] == "p"):
                    open_tags[stack.pop()[0]] -= 1
                kind = _region(name, attrs)
                above = stack[-1][1] if stack else frozenset()
                stack.append((name, above | {kind} if kind else above))
                open_tags[name] += 1
            tag, region = (stack[-1][0], stack[-1][1]) if stack else ("body", frozenset())
        elif attrs and name in ("span", "i", "b", "font", "label", "small") and not closes and _region(name, attrs) in ("ad", "share", "notice"):
            end = tags.find("<", at)
            if end >= 0 and page.startswith("</" + written, end):
                at = end
    flush()
    return out


def features(found) -> np.ndarray:
    """One row of FEATURES for each block of a page."""
    x = np.zeros((len(found), len(FEATURES)), np.float32)
    for i, (text, words, linked, tag, region) in enumerate(found):
        x[i, 0], x[i, 1] = words, linked / words
        x[i, 6] = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        x[i, 7] = tag in ("li", "dt", "dd", "td", "th")
        x[i, 8] = text[-1] in ".!?…\"'”»)"
        for k in region or ():
            x[i, 9 + KINDS.index(k)] = 1
    x[1:, 2:4], x[:-1, 4:6] = x[:-1, 0:2], x[1:, 0:2]
    return x


#: Content as pages write it, with {} for a text each; every block of it is content.
CONTENT = [
    "<article><h1>{}</h1><p>{}<p>{}<p>{}<p>See <a href=x>the plan</a> and {}</article>",
    "<article><h1>{}</h1><p>{}</p></article>",
    "<article><p>{}</p><p>{}</p></article>",
    "<main><h1>{}</h1><p>{}</p><h2>{}</h2><p>{}</p><ul><li>{}</li><li>{}</li></ul></main>",
    "<main><p>{}</p></main>",
    '<div class="post"><h2>{}</h2><p>{}</p><p>{}</p><p>{}</p></div>',
    "<section><p>{}</p><blockquote>{}</blockquote><table><tr><td>{}</td><td>{}</td></tr></table></section>",
    "<article><header><h1>{}</h1><p>{}</p></header><p>{}</p><p>{}</p></article>",
    "<h1>{}</h1><p>{}</p><p>{}</p>",
    "<p>{}</p>",
    "{}",
]
#: What stands around content, with {} for a text: none of it is content.
AROUND = [
    "<nav><ul><li><a href=x>{}</a></li><li><a href=x>World news</a></li><li>{}</li></ul></nav>",
    '<div class="navbar"><a href=x>Start</a> <a href=x>Shop</a><p>{}</p></div>',
    '<div class="breadcrumbs">{}</div>',
    "<header><h1><a href=x>Daily</a></h1><p>{}</p></header>",
    '<div class="masthead"><h1>Daily</h1><p>{}</p></div>',
    "<footer>{}</footer>",
    '<div id="footer">{}</div>',
    "<aside><h3>More</h3><p>{}</p></aside>",
    '<div class="sidebar"><p>{}</p><a href=x>More</a></div>',
    '<div class="related"><ul><li><a href=x>{}</a></li></ul></div>',
    '<div class="cookie-notice"><p>{}</p></div>',
    '<div class="newsletter">{}</div>',
    '<div class="ad">{}</div>',
    '<div class="promo"><p>{}</p></div>',
    "<form><p>{}</p><label>{}</label></form>",
    '<div class="comments"><h3>{}</h3><p>{}</p></div>',
    '<section id="comments"><ul><li>{}</li></ul></section>',
    '<section class="comments"><article><p>{}</p></article><article><p>{}</p></article></section>',
    '<div class="share">{}</div>',
    "<p><a href=x>{}</a> | <a href=x>{}</a></p>",
    "<div><a href=x>{}</a> <a href=x>Privacy</a></div>",
]


#: What stands around content on pages whose names say nothing, with {} for a short text: lists of links, lines of
#: several links, lines of small print, comments of a sentence or two. Content there is paragraphs and headings before them.
PLAIN_AROUND = [
    "<div><ul><li><a href=x>{}</a></li><li><a href=x>{}</a></li><li><a href=x>{}</a></li></ul></div>",
    "<div><a href=x>{}</a> <a href=x>{}</a> <a href=x>{}</a> <a href=x>{}</a></div>",
    "<div><div>{}</div><div><a href=x>{}</a></div></div>",
    "<div><p>Photo by <a href=x>{}</a></p></div>",
    "<div>{} <a href=x>{}</a></div>",
    "<div><span>{}</span></div>",
]


def training_blocks(pages: int = 1500, seed: int = 7):
    """The labelled table: blocks of pages dealt from CONTENT and AROUND with texts of any length, in any order.

    Returns features and whether the block is content. Sidebars, adverts and the like also stand inside articles. A third
    of the pages have no names that tell, so that there words and link density of a block and its neighbours must.
    """
    rng, xs, ys = random.Random(seed), [], []

    def text():
        if bare:
            return " ".join(["word"] * rng.randint(*size)) + rng.choice(mark)
        return " ".join(["word"] * int(math.exp(rng.uniform(0, 4.3)))) + rng.choice([".", "", "!"])

    def filled(p):
        return p.format(*[text() for _ in range(p.count("{}"))])

    for k in range(pages):
        bare = k % 3 == 2
        if bare:
            parts, size, mark = [], (1, 6), ["", "", "."]
            for _ in range(rng.randrange(4)):
                parts.append((filled(rng.choice(PLAIN_AROUND)), False))
            size, mark = (12, 90), [".", ".", "!", "?"]
            body = [(f"<p>{text()}</p>", True) for _ in range(rng.randint(2, 7))]
            size, mark = (2, 12), [""]
            parts += [(f"<div><h1>{text()}</h1>", True), *body, ("</div>", True)]
            size, mark = (1, 6), ["", "", "."]
            for _ in range(rng.randrange(4)):
                parts.append((filled(rng.choice(PLAIN_AROUND)), False))
            xs.append(features(blocks("<body>" + "".join(p for p, _ in parts))))
            for p, y in parts:
                ys.extend([y] * len(blocks(p)))
            continue
        around = [(filled(rng.choice(AROUND)), False) for _ in range(rng.randrange(5))]
        content = filled(rng.choice(CONTENT))
        at = rng.randrange(len(around) + 1)
        parts = [*around[:at], (content, True), *around[at:]]
        if content.startswith("<article><h1>") and rng.random() < 0.5:
            head, tail = content.split("</h1>")
            inside = filled(rng.choice([a for a in AROUND if "class=" in a or a.startswith(("<aside", "<form", "<footer", "<nav"))]))
            parts[at : at + 1] = [(head + "</h1>", True), (inside, False), (tail, True)]
        xs.append(features(blocks("<body>" + "".join(p for p, _ in parts))))
        for p, y in parts:
            ys.extend([y] * len(blocks(p)))
    return np.concatenate(xs), np.array(ys)


def grow(x, y, depth=16, least=6):
    """A decision tree by Gini impurity: a leaf's share of content, or (feature, limit, tree below or at it, tree above)."""
    p = float(y.mean())
    if depth == 0 or p in (0.0, 1.0):
        return p
    best = (1e-9, None, None)
    gini = lambda v: 2 * v.mean() * (1 - v.mean()) * len(v)
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        for limit in (values[1:] + values[:-1]) / 2:
            low = x[:, k] <= limit
            if least <= low.sum() <= len(y) - least:
                gain = gini(y) - gini(y[low]) - gini(y[~low])
                # among equal gains, the feature listed last: what surrounds a block says more than its length
                if gain >= best[0] - 1e-12:
                    best = (gain, k, float(limit))
    if best[1] is None:
        return p
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


def judge(tree, x) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    k, limit, low, high = tree
    at = x[:, k] <= limit
    out = np.empty(len(x))
    if at.any():
        out[at] = judge(low, x[at])
    if not at.all():
        out[~at] = judge(high, x[~at])
    return out


def main_texts(pages, tree) -> list[str]:
    """The main text of each page; the blocks of all of them are judged at once."""
    cut = [blocks(p or "") for p in pages]
    if not any(cut):
        return [""] * len(cut)
    keep, at, out = judge(tree, np.concatenate([features(found) for found in cut if found])) >= 0.5, 0, []
    for found in cut:
        out.append("\n\n".join(b[0] for b, k in zip(found, keep[at : at + len(found)]) if k))
        at += len(found)
    return out


def extract(pages: DataFrame, html_col: str = "html", keep=("page_id", "url")) -> DataFrame:
    """The kept columns, text (empty if none) and n_chars, for every page."""
    tree = grow(*training_blocks())

    @F.pandas_udf("string")
    def text_of(htmls: pd.Series) -> pd.Series:
        return pd.Series(main_texts(htmls, tree), dtype=object)

    text = text_of(F.coalesce(F.col(html_col), F.lit("")))
    return pages.select(*keep, text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op1_html_extraction(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
