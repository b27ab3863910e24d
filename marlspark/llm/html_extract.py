"""Main text of web pages by tag-path ratios.

A text node's tag path is the chain of elements from the root to it, with class names. Per path, text length and
punctuation marks are added up over its nodes, links counting a fifth; their means are smoothed along the page over
neighbouring nodes and multiplied (after Wu, Li, Hu, Wang: Web news extraction via path ratios, 2013). A path through an
element named as boilerplate, by its tag, class, id or role, counts a thousandth, for each such element; the name of one that wraps the
page's main, all its articles or most of its text doesn't count. So where all paths are named alike the names change nothing.

Nodes above a share of the length-weighted mean are content, and every block with one is in the result. The smallest
element with all of the selected text, or with nearly all if only the body has all, is the article: it adds its other
blocks, but for lists of links and boilerplate by name, and headings beside selected text are added anywhere.
Pages are independent of one another: no shuffle, and memory for one page at a time.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The element names of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
SCOPES = frozenset("ul ol dl table select html body article section div main td th".split())
DROPPED = frozenset("head noscript template svg math select button object canvas audio video datalist map".split())
#: Elements that are boilerplate by their tag, as others are by their name; a header is outside of articles only.
ASIDE = frozenset("nav footer aside menu dialog form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of class names, ids and roles that name boilerplate.
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion sidebar side rail menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr banner notice notices alert popup modal overlay comment comments commentlist disqus reply replies respond share sharing social related recommended footer header masthead topbar copyright legal login signin signup subscribe subscription newsletter search pagination pager widget toolbar skip complementary contentinfo navigation dialog alertdialog form".split()
)
#: Of these, what comments are named by, which may outweigh the article, and what heads an article inside of it.
REMARKS = frozenset("comment comments commentlist disqus reply replies respond".split())
HEADS = frozenset("header masthead".split())
#: A named element with more than such a share of the page's unlinked text is a layout's wrapper; for REMARKS, and on pages of
#: less than FEW characters, the second. Elements that are boilerplate by their tag are none, but for forms.
MOST, NEARLY, NEVER, FEW = 0.7, 0.9, 2.0, 600
NAMED_SHARE, LINK_SHARE = 1e-3, 0.2
TAG = re.compile(r"""<([a-zA-Z][^\s/>]*+)((?:[\s/]++[^\s=>/]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]++))?)*+)[\s/]*+>""")
LOOSE = re.compile(r"<([a-zA-Z][^\s/>]*+)([^>]*+)>")
END = re.compile(r"</([a-zA-Z][^\s/>]*+)[^>]*+>")
LABELS = re.compile(r"""(?:^|[\s/])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
HIDDEN = re.compile(r"""(?:^|[\s/])(?:hidden(?=[\s/=]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.IGNORECASE)
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")
THRESHOLD, MASS, SPREAD = 0.3, 0.9, np.array([0.06, 0.24, 0.4, 0.24, 0.06])


class Page:
    """The text nodes of a page: elements (parent, tag, the share of the text from which its boilerplate name is ignored, 0
    without such a name), and per node its text, block, element, path and link flag."""

    def __init__(self, source: str):
        self.parent, self.tags, self.named, self.paths = [-1], ["#root"], [0.0], {}
        self.texts: list[str] = []
        self.block: list[int] = []
        self.element: list[int] = []
        self.path: list[int] = []
        self.linked: list[bool] = []
        # open elements: (tag, element, path, dropped, inside a link)
        self.open = [("#root", 0, 0, False, False)]
        self.blocks = 0
        self._read(source)

    def _text(self, raw: str) -> None:
        tag, element, path, dropped, link = self.open[-1]
        if not dropped and raw:
            text = html.unescape(raw)
            self.texts.append(text)
            self.block.append(self.blocks)
            self.element.append(element)
            self.path.append(path)
            self.linked.append(link)

    def _close(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break
            if self.open[k][0] in ("table", "body", "html") and tag not in ("table", "body", "html"):
                break
        if tag in BLOCKS:
            self.blocks += 1

    def _start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.blocks += 1
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k][0] == "p":
                    del self.open[k:]
                    break
                if self.open[k][0] in BLOCKS:
                    break
        if tag in CLOSES:
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k][0] in CLOSES[tag]:
                    del self.open[k:]
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
                elif self.open[k][0] in SCOPES:
                    break
        _, element, path, dropped, link = self.open[-1]
        label, drop = tag, dropped or tag in DROPPED
        named = MOST if tag == "form" else NEVER if tag in ASIDE or (tag == "header" and not self._in_article()) else 0.0
        if attributes and not drop:
            names = [m[1].strip("\"'") for m in LABELS.findall(attributes)]
            if names:
                label = f"{tag}.{'.'.join(names)}"
                if tag not in ("html", "body", "article", "main"):
                    found = NAMED.intersection(p.lower() for n in names for p in PARTS.findall(n))
                    if found & HEADS and self._in_article():
                        found -= HEADS
                    named = max(named, NEARLY if found & REMARKS else MOST if found else 0.0)
            drop = HIDDEN.search(attributes) is not None
        if tag in VOID:
            if tag == "br":
                self._text(" ")
            return
        self.parent.append(element)
        self.tags.append(tag)
        self.named.append(named)
        key = (path, label)
        self.open.append((tag, len(self.tags) - 1, self.paths.setdefault(key, len(self.paths) + 1), drop, link or tag == "a"))

    def _in_article(self) -> bool:
        return any(t in ("article", "main") for t, *_ in self.open)

    def priors(self, sizes: np.ndarray) -> np.ndarray:
        """Per element NAMED_SHARE to the power of the number of named elements it is in."""
        n = len(self.tags)
        size, mains, articles = [0.0] * n, [int(t == "main") for t in self.tags], [0] * n
        for e, x, link in zip(self.element, sizes, self.linked, strict=True):
            size[e] += 0 if link else x
        remarks, out = [False] * n, [1.0] * n
        for e in range(1, n):
            remarks[e] = remarks[self.parent[e]] or self.named[e] == NEARLY
            articles[e] = int(self.tags[e] == "article" and not self.named[e] and not remarks[e])
        for e in range(n - 1, 0, -1):
            for x in (size, mains, articles):
                x[self.parent[e]] += x[e]
        for e in range(1, n):
            share = max(self.named[e], NEARLY) if size[0] < FEW else self.named[e]
            wraps = mains[e] > 0 or 0 < articles[0] == articles[e] or size[e] > share * size[0]
            out[e] = out[self.parent[e]] * (NAMED_SHARE if self.named[e] and not wraps else 1.0)
        return np.array(out)

    @staticmethod
    def _behind_comment(s: str, at: int) -> int:
        """Where a comment ends whose text begins at `at`: browsers take <!--> and <!---> as empty and --!> as an end too."""
        if empty := re.compile("-?>").match(s, at):
            return empty.end()
        end = re.compile("--!?>").search(s, at)
        return end.end() if end else len(s)

    def _read(self, s: str) -> None:
        at, n = 0, len(s)
        while at < n:
            lt = s.find("<", at)
            if lt < 0:
                self._text(s[at:])
                return
            if lt > at:
                self._text(s[at:lt])
            after = s[lt + 1 : lt + 2]
            if after == "!" or after == "?":
                if s.startswith("<!--", lt):
                    at = self._behind_comment(s, lt + 4)
                else:
                    end = s.find(">", lt)
                    at = n if end < 0 else end + 1
            elif after == "/" and (m := END.match(s, lt)):
                self._close(m[1].lower())
                at = m.end()
            elif m := TAG.match(s, lt) or LOOSE.match(s, lt):
                tag, at = m[1].lower(), m.end()
                if tag in RAW:
                    close = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(s, at)
                    end = s.find(">", close.end()) if close else -1
                    at = n if end < 0 else end + 1
                else:
                    self._start(tag, m[2])
            elif after.isalpha() or after == "/":
                return  # a tag that the page's end cuts off
            else:
                self._text("<")
                at = lt + 1


def ratios(page: Page, sizes: np.ndarray, priors: np.ndarray | None = None) -> np.ndarray:
    """The smoothed and fused tag-path ratio of each node, 0 of those without text. Nodes are neighbours of those that are in as
    many named elements."""
    marks = np.array([len(PUNCTUATION.findall(t)) for t in page.texts], dtype=float)
    weight = sizes * np.where(np.array(page.linked, dtype=bool), LINK_SHARE, 1.0)
    prior = (page.priors(sizes) if priors is None else priors)[page.element]
    paths, out = np.array(page.path), np.zeros(len(sizes))
    smooth = lambda x: np.sqrt(x * np.convolve(np.pad(x, 2, mode="edge"), SPREAD, mode="valid"))
    for share in np.unique(prior):
        used = np.flatnonzero((sizes > 0) & (prior == share))
        if len(used):
            _, inverse, counts = np.unique(paths[used], return_inverse=True, return_counts=True)
            length, punctuation = ((np.bincount(inverse, x[used]) / counts)[inverse] for x in (weight, marks))
            out[used] = share * smooth(length) * (1 + smooth(punctuation))
    return out


def _holder(page: Page, mass: np.ndarray, share: float) -> int:
    """The smallest element with that share of the selected text; what an article or main holds isn't told apart."""
    found = 0
    for e in range(1, len(page.tags)):  # parents come before their children
        if page.parent[e] == found and page.tags[found] not in ("article", "main") and mass[e] >= share * mass[0] and page.tags[e] not in ("p", "li", "tr", "tbody", "b", "i", "span", "a"):
            found = e
    return found


def main_text(source: str | None) -> str:
    """The article's blocks, one per line; empty if there is none."""
    page = Page(source or "")
    texts = [" ".join(t.split()) for t in page.texts]
    sizes = np.array([len(t) for t in texts], dtype=float)
    if not sizes.any():
        return ""
    prior = page.priors(sizes)
    scores = ratios(page, sizes, prior)
    chosen = scores >= THRESHOLD * np.average(scores, weights=sizes * prior[page.element])

    # the smallest element with all of the selected text, or with nearly all where only the body has all
    mass = np.zeros(len(page.tags))
    np.add.at(mass, np.array(page.element), sizes * chosen)
    for e in range(len(page.tags) - 1, 0, -1):
        mass[page.parent[e]] += mass[e]
    article = _holder(page, mass, 1.0)
    if page.tags[article] in ("#root", "html", "body"):
        article = _holder(page, mass, MASS)
    inside = np.zeros(len(page.tags), dtype=bool)
    inside[article] = True
    for e in range(article + 1, len(page.tags)):
        inside[e] = inside[page.parent[e]]
    whole = page.tags[article] not in ("#root", "html", "body")

    lines, k, n = [], 0, len(texts)
    while k < n:
        end = k
        while end < n and page.block[end] == page.block[k]:
            end += 1
        if line := " ".join("".join(page.texts[k:end]).split()):
            links = sum(sizes[i] for i in range(k, end) if page.linked[i])
            element = page.element[k]
            selected = any(chosen[k:end])
            plain = prior[element] >= prior[article]
            heading = plain and page.tags[element] in HEADINGS and mass[page.parent[element]] > 0
            short = plain and inside[element] and (page.tags[element] in HEADINGS or (whole and links <= 0.6 * max(1.0, sizes[k:end].sum())))
            if selected or heading or short:
                lines.append(line)
        k = end
    return "\n".join(lines)


def extracted(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """All columns of pages but the html, with text and n_chars; columns of these names that pages has itself give way to
    them. A null or empty html has an empty text; repeated rows and null ids stay as they are; an empty table gives none."""
    others = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    boxed = pages.select(F.col(html_col).alias("html"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("box"))

    @F.pandas_udf("string")
    def text_of(source: pd.Series) -> pd.Series:
        return source.map(main_text, na_action=None)

    found = boxed.select("box", text_of("html").alias("text"))
    return found.select("box.*", "text", F.length("text").cast("long").alias("n_chars"))


def op1_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
