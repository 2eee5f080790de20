"""Main text of web pages by tag-path ratios.

Method: a page is read into text nodes, each with its root-to-leaf path of
block elements and their classes.  Per path the length of text, the
punctuation and the nodes are aggregated; the ratios are smoothed over the
nodes in page order and fused.  A path's score fuses its own ratio with that of
its container, the nearest section-like element, which also counts half of the
ratio of the containers right in it, so that a short heading or list item
stands with the text around it.  Weights follow: elements that never hold main
text (menus, footers, forms and the like) count nothing, names of classes and
ids that tell of such elements next to nothing, and text in an article or main
element, or in one so named, more; inside it, a container counts at least as
much as the one around it.  The paths with a score over a share of the mean
are content, and their nodes, and no others, are the main text.

Reading takes one pass over the page, however broken the markup, and paths are
pairs of a number and a label, however deep they are.

Defined cases: null and empty pages have an empty text; markup may be broken
or cut off: a tag or comment that does not end reaches to the page's end, as
in browsers; repeated rows and null ids give a row each; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import table

#: Elements (fixed values, from the HTML standard).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe textarea title xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mrow ms msqrt msub msubsup msup mtext nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HOLDS_P = ("td", "th", "table", "button", "li", "div", "section", "article")
LISTS = ("ul", "ol", "dl", "table", "select")
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
#: Elements that hold other blocks, and those that never hold main text.
CONTAINERS = frozenset("html body article main section div td th center details".split())
APART = frozenset("nav footer aside form button select menu dialog head noscript template svg object".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
#: Words of class names and ids.  A name tells something only if all its words but numbers are listed here.
APART_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promos promoted promotion nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside widget widgets "
    "footer masthead header topbar toolbar comment comments commentlist disqus respond response responses reply replies discussion cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay newsletter subscribe subscription "
    "signup login register share shares sharing sharebar social related recommended recommendations recirculation pagination pager skip search searchbox form tags".split()
)
#: Of these, the words that also tell of paragraphs, headings and inline elements.
APART_TEXT_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promoted cookie cookies consent newsletter subscribe share sharing".split())
CONTENT_WORDS = frozenset("article post entry story content main body text prose".split())
#: Words of an article's own head, when they stand with a content word.
HEAD_WORDS = frozenset("header masthead".split())
LAYOUT_WORDS = frozenset("area bar block bottom box center col column container first global group holder home inner item items last layout left list middle outer page panel primary right row secondary section site the top unit wrap wrapper zone".split())
#: Words that stand beside others in names of adverts and of lists of other pages.
BESIDE_WORDS = frozenset("articles box content count feed head heading inline label link links list news posts reading size slot small stories stream thread title topics unit x".split())
LISTED_WORDS = APART_WORDS | CONTENT_WORDS | LAYOUT_WORDS | BESIDE_WORDS
#: Words that tell of reader comments at the end or the beginning of a name, whatever else is in it, and how many words such a name has at most.
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond responses replies".split())
COMMENT_NAME = 3
#: Names of elements whose own header belongs to the text.
POST_WORDS = frozenset("article post entry story".split())

_MARKUP = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|[!?/])")
_ATTRIBUTE = re.compile(r"""[\s/]*(?:([^\s/>][^\s/>=]*)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s>]*))?)?""")
_COMMENT_END = re.compile(r"--!?>")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[^\W\d_]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、؟]")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
#: Nodes on either side over which ratios are smoothed; the share of a path's own ratio in its score; the share of the mean at which a path is content.
SMOOTH, OWN, SHARE = 2, 0.3, 0.3
#: Weights of text in elements named as apart, and in content elements.
NAMED_APART, IN_CONTENT = 0.02, 2.5


def _attributes(page: str, at: int) -> tuple[dict[str, str], int, bool]:
    """Attributes of a tag whose name ends at ``at``, where it ends (-1: nowhere), and whether it closes itself."""
    found: dict[str, str] = {}
    if page.startswith(">", at):
        return found, at + 1, False
    while True:
        m = _ATTRIBUTE.match(page, at)
        at = m.end()
        if m[1]:
            value = m[2] or ""
            found.setdefault(m[1].lower(), value.strip(value[0]) if value[:1] in ("'", '"') else value)
        if at >= len(page):
            return found, -1, False
        if page[at] == ">":
            return found, at + 1, page[at - 1] == "/"


def _named(names: str, text_element: bool) -> str:
    """What the names of an element tell: "apart", "content" or nothing."""
    content = False
    for name in names.split():
        listed = [w.lower() for w in _WORD.findall(name) if not w.isdigit()]
        if not text_element and 0 < len(listed) <= COMMENT_NAME and (listed[0] in COMMENT_WORDS or listed[-1] in COMMENT_WORDS):
            return "apart"
        words = set(listed)
        if not words <= LISTED_WORDS:
            continue
        if words & (APART_TEXT_WORDS if text_element else APART_WORDS - HEAD_WORDS if words & CONTENT_WORDS else APART_WORDS):
            return "apart"
        content |= not text_element and bool(words & CONTENT_WORDS)
    return "content" if content else ""


class Paths:
    """Paths met on a page: numbers, each with its weight and container; 0 is the root."""

    def __init__(self) -> None:
        self._number: dict[tuple[int, str, str, str], int] = {}
        self.kept, self.inside, self.container, self.around = [1.0], [False], [0], [0]

    def below(self, parent: int, name: str, label: str, mark: str) -> int:
        key = (parent, name, label, mark)
        k = self._number.get(key)
        if k is None:
            k = self._number[key] = len(self.kept)
            kept = self.kept[parent]
            self.kept.append(0.0 if mark == "never" else min(kept, NAMED_APART) if mark == "apart" else kept)
            self.inside.append(self.inside[parent] or mark == "content")
            self.container.append(k if name in CONTAINERS else self.container[parent])
            self.around.append(self.container[parent])
        return k


def text_nodes(page: str) -> tuple[list[tuple[int, int, str]], Paths]:
    """Nodes (path, block, decoded text) in page order, and the paths."""
    paths, nodes = Paths(), []
    stack, of, posts = [""], [0], [False]  # open elements, their paths, and whether they are named as posts
    open_at: dict[str, list[int]] = {}
    block, at, end = 0, 0, len(page)

    def text(a: int, b: int) -> None:
        if b > a:
            raw = page[a:b]
            if not raw.isspace():
                nodes.append((of[-1], block, html.unescape(raw)))
            elif nodes and nodes[-1][1] == block:
                nodes.append((of[-1], block, " "))

    def last(names) -> int:
        return max((open_at[n][-1] for n in names if open_at.get(n)), default=0)

    def close(k: int) -> None:
        while len(stack) > k:
            open_at[stack.pop()].pop()
            of.pop(), posts.pop()

    while at < end:
        m = _MARKUP.search(page, at)
        if not m:
            text(at, end)
            break
        text(at, m.start())
        at = m.end()
        name = m[2]
        if name is None:
            if m[3]:
                c = _COMMENT_END.search(page, at - 2 if page.startswith((">", "->"), at) else at)
                at = c.end() if c else end
            else:
                at = page.find(">", at) + 1 or end
            continue
        name = name.lower()
        attributes, after, closed = _attributes(page, at)
        if after < 0:
            break
        at = after
        if name not in INLINE:
            block += 1
        if m[1]:
            k = last((name,))
            if k and (name not in INLINE or all(t in INLINE for t in stack[k:][:32])):
                close(k)
            continue
        if name in CLOSES_P and last(("p",)) > last(HOLDS_P):
            close(last(("p",)))
        for sibling in SIBLINGS.get(name, ()):
            if last((sibling,)) > last(LISTS if name in ("li", "dt", "dd", "option") else ("table",)):
                close(last((sibling,)))
        if name in RAW and not closed:
            c = _RAW_END[name].search(page, at)
            at = page.find(">", c.end()) + 1 or end if c else end
            continue
        if name in VOID or closed and name not in ("p", "div", "span", "a", "li"):
            continue
        role, names = attributes.get("role", "").lower(), f"{attributes.get('class', '')} {attributes.get('id', '')}"
        in_article = last(("article", "main")) > 0
        text_element = name in INLINE or name in ("p", "li", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "td", "th", "tr", "figcaption")
        if name in APART or role in APART_ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or name == "header" and not in_article and not posts[-1]:
            mark = "never"
        elif name in ("article", "main") or role in ("article", "main"):
            mark = "content"
        else:
            mark = "" if name in ("html", "body") or names == " " else _named(names, text_element)
        path = of[-1] if name in INLINE and not mark else paths.below(of[-1], name, attributes.get("class", ""), mark)
        open_at.setdefault(name, []).append(len(stack))
        stack.append(name)
        of.append(path)
        posts.append(mark == "content" and any(w.lower() in POST_WORDS for w in _WORD.findall(names)))
    return nodes, paths


def content_paths(nodes: list[tuple[int, int, str]], paths: Paths) -> np.ndarray:
    """Whether each path is content."""
    at = np.array([p for p, _, _ in nodes])
    chars = np.array([len(t.strip()) for _, _, t in nodes], dtype=float)
    marks = np.array([len(_PUNCTUATION.findall(t)) for _, _, t in nodes], dtype=float)
    n = len(paths.kept)
    count = np.maximum(np.bincount(at, minlength=n), 1)
    ratio, marked = np.bincount(at, chars, n) / count, np.bincount(at, marks, n) / count
    # Smoothed over the nodes in page order, then fused.
    kernel = np.exp(-(np.arange(-SMOOTH, SMOOTH + 1) ** 2) / 2)
    smooth = lambda x: np.convolve(np.pad(x, SMOOTH, mode="edge"), kernel / kernel.sum(), mode="valid")
    fused = smooth(ratio[at]) * (1 + np.log1p(smooth(marked[at])))
    own = np.bincount(at, fused, n) / count
    # Containers: text and ratio of their own, and half of what stands right in them.
    kept, container, around = np.array(paths.kept), np.array(paths.container), np.array(paths.around)
    sharp = (ratio * (1 + np.log1p(marked)))[at]
    size, value = np.bincount(container[at], kept[at] * chars, n), np.bincount(container[at], kept[at] * chars * sharp, n)
    inner = np.flatnonzero(container == np.arange(n))[1:]
    in_size, in_value = np.bincount(around[inner], size[inner], n), np.bincount(around[inner], value[inner], n)
    level = (value + in_value / 2) / np.maximum(size + in_size, 1e-9)
    inside = np.array(paths.inside)
    for c in inner.tolist():  # parents come first
        if inside[c] and inside[around[c]]:
            level[c] = max(level[c], level[around[c]])
    weight = kept * np.where(inside, IN_CONTENT, 1.0)
    score = weight * (OWN * own + (1 - OWN) * level[container])
    amount = weight * np.bincount(at, chars, n)
    return (score > 0) & (score >= SHARE * (score * amount).sum() / max(amount.sum(), 1e-9))


def main_text(page: str | None) -> str:
    """Main text of a page, its blocks joined by one space."""
    nodes, paths = text_nodes(page or "")
    if not nodes:
        return ""
    content = content_paths(nodes, paths)
    blocks: dict[int, list[str]] = {}
    for path, block, text in nodes:
        if content[path]:
            blocks.setdefault(block, []).append(text)
    return " ".join(x for x in (" ".join("".join(parts).split()) for parts in blocks.values()) if x)


def extracted(page: Column) -> Column:
    """Main text of a column of pages."""

    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            yield pd.Series([main_text(p) for p in series], dtype=object)

    return F.pandas_udf(extract, "string")(page)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", extracted(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))
