"""Main text of web pages by maximum-scoring subsequence.

A page is a line of tokens: tags and words. Words score positive or negative by
where they stand, tags negative, with weights that labelled pages teach; one
linear scan finds the contiguous region of the highest total. Its words of
positive score are the main text, block by block.

Labelled pages are those whose markup names the article (``article``, else
``main``): words inside, outside menus, adverts, comments and the like, are
content. Where words stand is told by the outermost boilerplate element around
them, else by whether an article is, else by the block's tag and whether the block
is mostly links. A class or id makes an element boilerplate by a whole name, such
as ``sidebar`` or ``cookie-notice``, by its last word, as ``site-footer``, or by its
first one before a word for a part, as ``comment-list``; layouts such as
``with-sidebar`` or ``search-page`` don't, and an article is never boilerplate by
its name. An article inside boilerplate, such as a form around the page, counts as
one outside it, unless more words of articles stand outside than it has: then it
is a comment or a teaser. The weights are log-odds from counts over all labelled pages;
the table of counts has one row for each kind of place and is all that reaches
the driver.

Boilerplate inside an article scores nothing, so it neither counts as text nor
tears the article apart.

Defined cases: NULL or empty html, or a page whose every word scores negative,
has the empty text. Markup that is cut off, unclosed elements and stray end tags
are accepted. Scripts, styles, text areas and inner frames are dropped, to the
end of the page if unclosed; drawings and templates only if closed. The text of
formulas, objects, canvases and noscript is text like any other. Without any labelled page the prior weights decide. Repeated pages
count as often as they occur. Extra columns are kept.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderboard.llm.tables import whole_row

# Elements of HTML by their part in a page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
ENDS_SVG = BLOCKS - {"title"}
UNTIL_SIBLING = frozenset("p li td th tr dt dd option".split())
KIND_OF_TAG = {
    "nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "sidebar", "form": "form",
    "fieldset": "form", "button": "form", "select": "form", "label": "form", "dialog": "notice", "head": "head",
    "title": "head", "article": "article", "main": "article",
}
KIND_OF_NAME = {
    **dict.fromkeys("menu nav navbar navigation breadcrumb breadcrumbs topbar toolbar pagination pager".split(), "menu"),
    **dict.fromkeys("header masthead".split(), "header"),
    **dict.fromkeys("footer foot copyright".split(), "footer"),
    **dict.fromkeys("sidebar aside related recommended recommendations widget widgets".split(), "sidebar"),
    **dict.fromkeys("ad ads adv advert adverts advertisement promo promotion sponsor sponsored banner".split(), "advert"),
    **dict.fromkeys("notice cookie cookies consent alert newsletter subscribe popup modal gdpr disclaimer".split(), "notice"),
    **dict.fromkeys("comment comments reply replies disqus respond".split(), "comments"),
    **dict.fromkeys("share sharing social".split(), "share"),
    **dict.fromkeys("search login signup".split(), "form"),
}
# Words around those in a name: of a layout, of the article's own parts, of any part.
LAYOUT = frozenset("with without has no is".split())
OWN = frozenset("article post entry story content main section chapter".split())
OWN_BOILERPLATE = frozenset("comments advert share".split())
PARTS = frozenset(
    "list item items section container wrapper slot box block unit area button buttons bar links link icons "
    "posts articles thread body text content author meta form panel group inner row".split()
)
ROLES = {
    "navigation": "menu", "banner": "header", "contentinfo": "footer", "complementary": "sidebar", "search": "form",
    "dialog": "notice", "alert": "notice", "main": "article", "article": "article",
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|iframe)(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*(?:>|\Z)|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^\"'<>]|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-z][^>]*(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_MAY_HIDE = re.compile(r"<(?:svg|template)[\s/>]", re.I)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+")

MOST_LINKS = 0.5
LIMIT = 3.0
TAG_COSTS = (0.1, 2.0)
# The most that one block of boilerplate costs, so that an advert between two
# paragraphs does not part them.
INTERRUPTION = 10.0
# Counted before any page is read: (inside, outside).
PRIOR_PLAIN, PRIOR_LINKS = (2, 1), (1, 20)


class Held(NamedTuple):
    """An article inside boilerplate."""

    wrapper: tuple[int, str]  # the outermost boilerplate's number, the innermost's kind
    kind: str  # the outermost boilerplate's
    article: int  # the article's number


@dataclass
class Block:
    """A run of text that no block element interrupts."""

    tag: str
    place: str
    labelled: bool  # inside an article
    neutral: bool  # boilerplate inside an article
    held: Held | None = None
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    total: int = 0

    def text(self) -> str:
        return " ".join(entities.unescape("".join(self.pieces)).split())

    def by_tag(self) -> str:
        return f"{self.tag} {'links' if self.linked > MOST_LINKS * self.total else 'plain'}"

    def feature(self) -> str:
        return self.place or self.by_tag()


def _named(name: str) -> str | None:
    """The kind of boilerplate that one class or id names."""
    parts = _PART.findall(name)
    if not parts or parts[0] in LAYOUT:
        return None
    first, last = KIND_OF_NAME.get(parts[0]), KIND_OF_NAME.get(parts[-1])
    if last:
        return last if last in OWN_BOILERPLATE or OWN.isdisjoint(parts) else None
    return first if parts[-1] in PARTS else None


def _kind(tag: str, attributes: str) -> str | None:
    kind = KIND_OF_TAG.get(tag)
    if kind in (None, "article") and tag not in ("body", "html") and "=" in attributes:
        named = None
        for name, *values in _NAMES.findall(attributes):
            value = "".join(values).lower()
            if name.lower() == "role":
                kind = ROLES.get(value, kind)
                continue
            for whole in value.split():
                named = _named(whole) or named
        kind = kind or named
    return kind


def _hidden(marks: list[re.Match]) -> dict[int, int]:
    """The closing mark of each drawing and template by its opening one.

    Those never closed hide nothing; a block element ends an open drawing.
    """
    closed, open_ = {}, {"svg": [], "template": []}
    for at, m in enumerate(marks):
        name = (m.group(3) or "").lower()
        if name in ENDS_SVG:
            open_["svg"].clear()
        elif name not in open_:
            continue
        elif not m.group(2):
            if name == "template" or not m.group(4).endswith("/"):
                open_[name].append(at)
        elif open_[name]:
            closed[open_[name].pop()] = at
    return closed


def _settle(blocks: list[Block]) -> None:
    """Makes articles inside boilerplate part of it where longer ones stand outside."""
    free, held, longest = 0, Counter(), {}
    for block in blocks:
        if block.labelled and block.held:
            held[block.held] += block.total
        elif block.labelled:
            free += block.total
    for article, words in held.items():
        longest[article.wrapper] = max(words, longest.get(article.wrapper, 0))
    outside = set()
    for wrapper in sorted(longest, key=longest.get, reverse=True):
        if longest[wrapper] > free:
            outside.add(wrapper)
            free += sum(words for article, words in held.items() if article.wrapper == wrapper)
    for block in blocks:
        if block.held and block.held.wrapper not in outside:
            block.place, block.labelled, block.neutral = f"in {block.held.kind}", False, True


def tokens(page: str) -> list[tuple[str, bool] | Block]:
    """Tags, as (name, inside an article), and blocks of text in page order."""
    # name, boilerplate (outermost, its number, innermost), article around, the boilerplate around that
    open_: list[tuple[str, tuple[str, int, str] | None, bool, Held | None]] = []
    line: list[tuple[str, bool] | Block] = []
    block, links, at = None, 0, 0

    def around() -> tuple[tuple[str, int, str] | None, bool, Held | None]:
        return open_[-1][1:] if open_ else (None, False, None)

    def current(tag: str) -> Block:
        boilerplate, article, held = around()
        if boilerplate:
            place = f"in {boilerplate[0]}"
        else:
            place = "in article" if article else ""
        return Block(tag, place, article and not boilerplate, article and boilerplate is not None, held)

    def text(piece: str) -> None:
        nonlocal block
        if piece:
            if block is None:
                block = current(open_[-1][0] if open_ else "body")
            block.pieces.append(piece)
            n = len(piece.split())
            block.total += n
            block.linked += n if links else 0

    marks = list(_TOKEN.finditer(page))
    hidden = _hidden(marks) if _MAY_HIDE.search(page) else {}
    for i, m in enumerate(marks):
        if m.start() < at:
            continue
        text(page[at : m.start()])
        at = m.end()
        name = m.group(3)
        if not name:
            continue
        if i in hidden:
            at = marks[hidden[i]].end()
            continue
        name, closing = name.lower(), bool(m.group(2))
        if name == "a":
            links = 0 if closing else 1
        elif name == "br":
            text(" ")
        kind = None if closing else _kind(name, m.group(4))
        tracked = name in BLOCKS or kind is not None or closing and any(name == o[0] for o in open_[-8:])
        if not tracked:
            continue
        if block is not None:
            line.append(block)
            block = None
        line.append((name, around()[1]))
        if closing:
            for depth in range(len(open_) - 1, -1, -1):
                if open_[depth][0] == name:
                    del open_[depth:]
                    break
            links = 0
            continue
        if name == "body":
            open_.clear()
        elif open_ and (
            open_[-1][0] == "p" and name in BLOCKS or open_[-1][0] == name and name in UNTIL_SIBLING
        ):
            open_.pop()
        if name == "hr":
            continue
        boilerplate, article, held = around()
        if kind == "article":
            if boilerplate:
                held, boilerplate = Held(boilerplate[1:], boilerplate[0], len(line)), None
            article = True
        elif kind and boilerplate:
            boilerplate = (*boilerplate[:2], kind)
        elif kind and not (kind == "header" and article):
            boilerplate = kind, len(line), kind
        open_.append((name, boilerplate, article, held))
    text(page[at:])
    if block is not None:
        line.append(block)
    blocks = [item for item in line if isinstance(item, Block)]
    if any(b.held for b in blocks):
        _settle(blocks)
    return line


@dataclass(frozen=True)
class Weights:
    """Counts (inside, outside) of words by feature and of tags by name."""

    words: dict[str, tuple[int, int]] = field(default_factory=dict)
    tags: dict[str, tuple[int, int]] = field(default_factory=dict)

    def word(self, block: Block) -> float:
        if block.neutral:
            return 0.0
        feature = block.feature()
        inside, outside = self.words.get(feature, (0, 0))
        if feature.startswith("in "):
            prior = (20, 1) if feature == "in article" else (1, 20)
        else:
            prior = PRIOR_LINKS if feature.endswith("links") else PRIOR_PLAIN
        return max(-LIMIT, min(LIMIT, log((inside + prior[0]) / (outside + prior[1]))))

    def tag(self, name: str) -> float:
        inside, outside = self.tags.get(name, (0, 0))
        return -max(TAG_COSTS[0], min(TAG_COSTS[1], log((outside + 1) / (inside + 1))))


def main_text(page: str, weights: Weights) -> list[str]:
    """The blocks of the best region."""
    best, best_range = 0.0, (0, 0)
    total, begin = 0.0, 0
    line = tokens(page)
    scores = []
    for item in line:
        if isinstance(item, Block):
            score = max(weights.word(item) * item.total, -INTERRUPTION)
        else:
            score = weights.tag(item[0])
        scores.append(score)
    for at, score in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, at
        total += score
        if total > best:
            best, best_range = total, (begin, at + 1)
    region = zip(line[slice(*best_range)], scores[slice(*best_range)], strict=True)
    texts = (item.text() for item, score in region if isinstance(item, Block) and score > 0)
    return [t for t in texts if t]


def count_places(page: str) -> Counter:
    """(what, feature, inside) of one labelled page."""
    seen: Counter = Counter()
    for item in tokens(page):
        if isinstance(item, Block):
            if not item.neutral:
                seen["word", item.feature(), item.labelled] += item.total
                if item.labelled:  # what pages that name no article are told by
                    seen["word", item.by_tag(), True] += item.total
        else:
            name = item[0] if item[0] in BLOCKS else "other"
            seen["tag", name, item[1]] += 1
    return seen


def learn(pages: DataFrame) -> Weights:
    """Weights from every page whose markup names the article."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for page in batch.column("html"):
                seen.update(count_places(page.as_py()))
        keys = list(seen)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.string()),
                pa.array([k[1] for k in keys], pa.string()),
                pa.array([bool(k[2]) for k in keys], pa.bool_()),
                pa.array([seen[k] for k in keys], pa.int64()),
            ],
            names=["what", "feature", "inside", "n"],
        )

    labelled = pages.select("html").filter(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    counts = labelled.mapInArrow(count, "what string, feature string, inside boolean, n long")
    summed = counts.groupBy("what", "feature").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inside"),
        F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("outside"),
    )
    found: dict[str, dict] = {"word": {}, "tag": {}}
    for r in summed.collect():  # a few hundred kinds of place at most
        found[r["what"]][r["feature"]] = (r["inside"], r["outside"])
    return Weights(found["word"], found["tag"])


def extracted(html: Column, weights: Weights) -> Column:
    """The blocks of main text of each page, as array<string>."""

    @F.pandas_udf("array<string>")
    def blocks(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, weights) if p else [] for p in pages], dtype=object)

    return blocks(html)


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """``row`` (the page's columns), ``blocks`` and ``text``: the blocks joined by a space."""
    weights = learn(pages) if weights is None else weights
    found = pages.select(whole_row(pages).alias("row"), extracted(F.col("html"), weights).alias("blocks"))
    return found.select("row", "blocks", F.array_join("blocks", " ").alias("text"))
