"""Main text of web pages: flat text blocks, classified by a decision tree over their neighbourhood."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.llm.common import in_batches, query, table

#: Comments, elements whose content is no text, tags, declarations, and a tag that the end of the page cuts off. Drawings
#: and formulas are left out from their tag to its end; one that ends in itself or nowhere is a tag like others.
MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(script|style|noscript|template|title|iframe|object|canvas|select|textarea|audio|video)\b.*?(?:</\1\s*>|\Z)"
    r"""|<(?:svg|math)\b(?:[^<>"']|"[^"]*"|'[^']*')*(?<!/)>(?:(?!<(?:svg|math)\b).)*?</(?:svg|math)\s*>"""
    r"""|<(/?)([a-zA-Z][\w:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>"""
    r"|<[!?][^>]*(?:>|\Z)"
    r"|</?[a-zA-Z][^<>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|\Z)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)
#: Tags that end a block of text; those that hold others are followed to their end.
HOLDERS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "header hgroup li main menu nav ol section summary table tbody td tfoot th thead tr ul button label legend".split()
)
BREAKS = HOLDERS | frozenset("caption h1 h2 h3 h4 h5 h6 head hr html p pre".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements, and whole names of classes, identifiers and roles, that surround an article instead of being part of it.
CHROME_TAGS = frozenset("nav footer aside menu dialog button label legend".split())
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot banner sponsor sponsored promo nav navbar navigation "
    "menu menubar breadcrumb breadcrumbs pagination pager footer masthead sidebar aside rail widget "
    "recommendations cookie cookies consent gdpr notice notices notification popup modal overlay paywall subscribe "
    "subscription newsletter signup login share sharing complementary contentinfo skip toolbar topbar "
    "copyright teaser teasers toast".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies".split())
#: Words that name such elements and articles alike, and words that say nothing of what an element holds.
OPEN_WORDS = frozenset(
    "promotion related recommended alert search social form legal disclaimer privacy announcement announcements respond responses discussion".split()
)
PLAIN_WORDS = frozenset(
    "area bar block bottom box cell col column container content desktop fixed float group header holder inner item items large left link "
    "links list main message mobile outer page panel primary right row section site small sticky text title top unit user view wrap wrapper".split()
)
#: Whole names of classes and identifiers that mark an article, as parts of names such as article-meta do not.
ARTICLE_WORDS = frozenset(
    "article articlebody article-body article-content article-text content content-body entry entry-content hentry main "
    "main-content page-content post post-body post-content story story-body story-content text-content".split()
)
#: Where a block stands: outside the article of a page that has one, on a page without one, inside.
OUTSIDE, NO_ARTICLE, INSIDE = 0, 1, 2

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "chrome", "place", "heading")
#: Labelled blocks, written by hand: the features in order, links as the share of a block's words, then 1 for main text.
LABELLED = [
    # paragraphs and headings of a marked article, long and short
    (60, 0.0, 40, 0.0, 55, 0.0, 0, 2, 0, 1), (3, 0.0, 55, 0.0, 70, 0.0, 0, 2, 0, 1), (1, 0.0, 80, 0.0, 0, 0.0, 0, 2, 0, 1),
    (8, 0.0, 6, 0.0, 40, 0.0, 0, 2, 1, 1), (8, 1.0, 5, 1.0, 40, 0.0, 0, 2, 1, 1), (25, 0.2, 30, 0.1, 25, 0.0, 0, 2, 0, 1),
    (4, 0.0, 6, 1.0, 2, 0.0, 0, 2, 0, 1), (200, 0.05, 1, 0.0, 1, 0.0, 0, 2, 0, 1), (12, 0.4, 30, 0.0, 45, 0.1, 0, 2, 0, 1),
    (5, 0.0, 0, 0.0, 0, 0.0, 0, 2, 0, 1), (2, 0.0, 12, 0.0, 3, 0.0, 0, 2, 0, 1), (16, 0.5, 20, 0.0, 50, 0.0, 0, 2, 0, 1),
    (6, 1.0, 80, 0.0, 75, 0.0, 0, 2, 0, 1), (1, 0.0, 1, 0.0, 30, 0.0, 0, 2, 1, 1), (90, 0.0, 7, 1.0, 12, 0.0, 0, 2, 0, 1),
    (70, 0.0, 2, 1.0, 3, 1.0, 0, 2, 0, 1), (30, 0.0, 40, 0.0, 4, 1.0, 0, 2, 0, 1), (2, 0.0, 5, 1.0, 2, 1.0, 0, 2, 0, 1),
    (9, 0.0, 1, 1.0, 1, 1.0, 0, 2, 1, 1), (45, 0.1, 4, 1.0, 2, 1.0, 0, 2, 0, 1), (1, 0.0, 3, 1.0, 6, 1.0, 0, 2, 0, 1),
    (18, 0.0, 60, 0.0, 2, 1.0, 0, 2, 0, 1), (3, 0.0, 25, 0.0, 1, 1.0, 0, 2, 0, 1), (110, 0.0, 90, 0.0, 5, 1.0, 0, 2, 0, 1),
    (6, 0.0, 2, 1.0, 70, 0.0, 0, 2, 0, 1), (50, 0.3, 3, 1.0, 40, 0.0, 0, 2, 0, 1), (5, 1.0, 60, 0.0, 3, 1.0, 0, 2, 1, 1),
    # lists of links in an article
    (4, 1.0, 3, 1.0, 5, 1.0, 0, 2, 0, 0), (2, 1.0, 4, 1.0, 3, 1.0, 0, 2, 0, 0), (6, 1.0, 5, 1.0, 4, 1.0, 0, 2, 0, 0),
    # menus, headers, footers, sidebars, notices, adverts, forms and comments that say what they are
    (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0, 0), (2, 1.0, 0, 0.0, 1, 1.0, 1, 1, 0, 0), (12, 0.0, 1, 1.0, 9, 0.0, 1, 0, 0, 0),
    (30, 0.1, 60, 0.0, 2, 0.0, 1, 2, 0, 0), (55, 0.0, 50, 0.0, 45, 0.0, 1, 2, 0, 0), (9, 0.0, 80, 0.0, 0, 0.0, 1, 0, 0, 0),
    (14, 0.0, 20, 0.0, 25, 0.0, 1, 1, 0, 0), (3, 0.0, 15, 0.0, 40, 0.0, 1, 2, 1, 0), (80, 0.0, 3, 0.0, 4, 0.0, 1, 1, 0, 0),
    (100, 0.0, 90, 0.0, 3, 0.0, 1, 0, 0, 0), (5, 0.0, 6, 0.0, 5, 0.0, 1, 2, 0, 0), (2, 0.0, 100, 0.0, 120, 0.0, 1, 2, 0, 0),
    (1, 1.0, 30, 0.0, 40, 0.0, 1, 2, 0, 0), (3, 1.0, 2, 1.0, 55, 0.0, 1, 0, 0, 0), (45, 0.0, 4, 1.0, 60, 0.0, 1, 1, 0, 0),
    (20, 0.0, 35, 0.0, 70, 0.0, 1, 2, 0, 0), (7, 0.0, 8, 0.0, 90, 0.0, 1, 2, 1, 0), (65, 0.0, 80, 0.0, 30, 0.0, 1, 0, 0, 0),
    (4, 0.5, 25, 0.0, 12, 0.0, 1, 2, 0, 0), (150, 0.0, 2, 0.0, 100, 0.0, 1, 2, 0, 0), (2, 0.0, 0, 0.0, 65, 0.0, 1, 1, 0, 0),
    # everything beside a marked article
    (40, 0.0, 3, 1.0, 30, 0.0, 0, 0, 0, 0), (10, 0.0, 1, 1.0, 8, 0.0, 0, 0, 0, 0), (3, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 0),
    (2, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0), (7, 0.0, 2, 1.0, 50, 0.0, 0, 0, 1, 0), (70, 0.0, 60, 0.0, 50, 0.0, 0, 0, 0, 0),
    (25, 0.0, 40, 0.0, 90, 0.0, 0, 0, 0, 0), (5, 0.0, 0, 0.0, 35, 0.0, 0, 0, 0, 0), (90, 0.0, 30, 0.0, 20, 0.0, 0, 0, 0, 0),
    (12, 0.2, 70, 0.0, 15, 0.0, 0, 0, 0, 0), (1, 0.0, 4, 0.0, 6, 0.0, 0, 0, 1, 0), (130, 0.0, 1, 1.0, 45, 0.0, 0, 0, 0, 0),
    # pages that mark no article
    (50, 0.0, 40, 0.0, 60, 0.0, 0, 1, 0, 1), (35, 0.1, 6, 0.0, 50, 0.0, 0, 1, 0, 1), (20, 0.0, 55, 0.0, 3, 0.0, 0, 1, 0, 1),
    (18, 0.2, 25, 0.0, 30, 0.1, 0, 1, 0, 1), (4, 0.0, 45, 0.0, 60, 0.0, 0, 1, 0, 1), (7, 0.0, 3, 1.0, 50, 0.0, 0, 1, 1, 1),
    (120, 0.02, 2, 1.0, 4, 0.5, 0, 1, 0, 1), (9, 0.0, 70, 0.0, 35, 0.0, 0, 1, 0, 1), (15, 0.0, 2, 0.0, 60, 0.0, 0, 1, 0, 1),
    (55, 0.0, 60, 0.0, 3, 1.0, 0, 1, 0, 1), (28, 0.0, 40, 0.0, 2, 1.0, 0, 1, 0, 1), (80, 0.0, 4, 1.0, 2, 1.0, 0, 1, 0, 1),
    (3, 0.0, 30, 0.0, 25, 0.0, 0, 1, 1, 1), (30, 0.3, 40, 0.0, 20, 0.0, 0, 1, 0, 1), (2, 0.0, 20, 0.0, 90, 0.0, 0, 1, 0, 1),
    (3, 1.0, 4, 1.0, 2, 1.0, 0, 1, 0, 0), (1, 1.0, 1, 1.0, 60, 0.0, 0, 1, 0, 0), (12, 0.8, 10, 0.9, 14, 0.8, 0, 1, 0, 0),
    (4, 0.0, 2, 1.0, 3, 1.0, 0, 1, 0, 0), (5, 0.0, 3, 0.5, 0, 0.0, 0, 1, 0, 0), (6, 1.0, 50, 0.0, 4, 1.0, 0, 1, 0, 0),
    (8, 0.0, 5, 1.0, 6, 0.9, 0, 1, 1, 0), (20, 0.9, 3, 1.0, 25, 0.7, 0, 1, 0, 0), (3, 0.0, 60, 0.0, 2, 1.0, 0, 1, 0, 0),
    (7, 0.2, 40, 0.0, 0, 0.0, 0, 1, 0, 0), (2, 0.0, 1, 1.0, 5, 0.0, 0, 1, 0, 0), (16, 0.7, 60, 0.0, 3, 1.0, 0, 1, 0, 0),
]


@dataclass
class Block:
    text: str
    words: int
    links: float
    #: How surely it stands outside the article, from 0 to 1.
    chrome: float
    inside: bool
    heading: bool


#: How surely an element is no article. What may be one is judged by the share of the page's text that it holds.
NOT, MAYBE, SURELY = 0, 1, 2


def marks(tag: str, attributes: str, in_article: bool) -> tuple[int, bool]:
    """How surely an element surrounds the article (chrome), and whether it is one.

    A name says so surely if all of its words do or say nothing; next to other words it only may, as in legal-news.
    """
    whole, sure, open_ = set(), False, False
    for kind, value in ATTRIBUTE.findall(attributes) if attributes else ():
        names = value.strip("\"'").lower().split()
        whole.update(names)
        for name in names if kind.lower() != "itemprop" else ():
            words = set(re.split(r"[_-]+", name)) - {""}
            telling = words & (CHROME_WORDS | COMMENT_WORDS)
            sure |= bool(telling) and words <= CHROME_WORDS | COMMENT_WORDS | PLAIN_WORDS
            open_ |= bool(telling | words & OPEN_WORDS)
            if "header" in words and not in_article:
                open_ = True
    named = tag in ("article", "main") or not whole.isdisjoint(ARTICLE_WORDS)
    if tag in CHROME_TAGS or (attributes and HIDDEN.search(attributes)) or sure and not (tag in ("body", "main", "article")):
        chrome = SURELY
    elif tag not in ("body", "main", "article") and (open_ or tag == "form" or tag == "header" and not in_article):
        chrome = MAYBE
    else:
        chrome = NOT
    return chrome, chrome < SURELY and named and not (chrome == MAYBE and tag not in ("article", "main"))


@dataclass
class Holder:
    """An open element: the outermost one that surely and that maybe surrounds the article, and whether it is in one."""

    tag: str
    sure: bool
    maybe: int | None
    inside: bool


def blocks(page: str) -> list[Block]:
    """Flat blocks of text in page order, white space as one space, character references decoded."""
    found: list[tuple[str, int, float, Holder, bool]] = []
    pieces: list[tuple[str, bool]] = []
    outermost = Holder("", False, None, False)
    holders, open_tags = [outermost], Counter()
    n_maybe, held = 0, Counter()  # elements that may be chrome, and the words beside links in each
    linked, heading, at = False, False, 0

    def close() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(t for t, _ in pieces)).split())
            if text:
                words, own = text.count(" ") + 1, holders[-1]
                links = min(words, sum(len(html.unescape(t).split()) for t, link in pieces if link))
                found.append((text, words, links / words, own, heading))
                if not own.sure:
                    held[own.maybe] += words - links
            pieces.clear()

    for part in MARKUP.finditer(page):
        if part.start() > at:
            pieces.append((page[at : part.start()], linked))
        at = part.end()
        if part[3] is None:
            continue
        tag, ends = part[3].lower(), bool(part[2])
        if tag == "a":
            linked = not ends
        elif tag == "br":
            pieces.append((" ", False))
        elif tag in BREAKS:
            close()
            heading = tag in HEADINGS and not ends
            if tag in HOLDERS:
                if not ends:
                    above = holders[-1]
                    chrome, inside = marks(tag, part[4], above.inside)
                    maybe = above.maybe
                    if tag in ("article", "main") and inside and not above.inside:
                        maybe = None  # a frame may say so that holds an article as well
                    if maybe is None and chrome == MAYBE:
                        maybe, n_maybe = n_maybe, n_maybe + 1
                    holders.append(Holder(tag, above.sure or chrome == SURELY, maybe, above.inside or inside))
                    open_tags[tag] += 1
                elif open_tags[tag]:
                    while True:
                        gone = holders.pop().tag
                        open_tags[gone] -= 1
                        if gone == tag:
                            break
                    linked = False
    if page[at:]:
        pieces.append((page[at:], linked))
    close()
    total = max(1, sum(held.values()))
    doubt = lambda h: 1.0 if h.sure else 0.0 if h.maybe is None else 1.0 - held[h.maybe] / total
    return [Block(text, words, links, doubt(own), own.inside, big) for text, words, links, own, big in found]


def features(found: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block; before the first and after the last stands an empty block."""
    words, links = [[0.0, *(getattr(b, k) for b in found), 0.0] for k in ("words", "links")]
    marked = any(b.inside for b in found)
    place = [INSIDE if b.inside else OUTSIDE if marked else NO_ARTICLE for b in found]
    chrome, heading = [b.chrome for b in found], [b.heading for b in found]
    return np.array([words[1:-1], links[1:-1], words[:-2], links[:-2], words[2:], links[2:], chrome, place, heading], float).T


class DecisionTree:
    """Binary cuts of single features that leave the least mixed labels, until leaves are pure or too small."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8):
        self.feature, self.left, self.right = None, None, None
        self.label = int(2 * y.sum() >= len(y))
        best = None
        if depth and 0 < y.sum() < len(y):
            for feature in range(x.shape[1]):
                values = np.unique(x[:, feature])
                for cut in (values[1:] + values[:-1]) / 2:
                    low = x[:, feature] < cut
                    mixed = sum(n * p * (1 - p) for side in (y[low], y[~low]) for n, p in [(len(side), side.mean())])
                    if best is None or mixed < best[0] - 1e-12:
                        best = (mixed, feature, cut)
        if best:
            _, self.feature, self.cut = best
            low = x[:, self.feature] < self.cut
            self.left, self.right = DecisionTree(x[low], y[low], depth - 1), DecisionTree(x[~low], y[~low], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature is None:
            return np.full(len(x), self.label)
        low = x[:, self.feature] < self.cut
        out = np.empty(len(x), int)
        out[low], out[~low] = self.left.predict(x[low]), self.right.predict(x[~low])
        return out


def trained_tree() -> DecisionTree:
    rows = np.array(LABELLED, float)
    return DecisionTree(rows[:, :-1], rows[:, -1])


def main_text(page: str | None, tree: DecisionTree) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    return "\n\n".join(b.text for b, keep in zip(found, tree.predict(features(found))) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    A page becomes flat blocks of text at its block elements, without scripts, styles and markup. Each block has its
    words and share of linked words and those of its neighbours, how surely an element around it says that it is a menu,
    header, footer, sidebar, notice, advert, form or comment, whether it stands in a marked article, and whether it is
    a heading. An element that may say so, as a form, or a class that only has such a word among others, counts the
    less the more of the page's text it holds. A decision tree trained on the labelled table above tells main text
    from the rest. Pages are worked on where they are read, in time that grows with their length.

    Null and empty pages, and pages without main text, give the empty text. Repeated pages are returned each, missing
    identifiers and addresses stay missing, and further columns are not looked at. A page that ends inside a tag or a
    comment ends there.
    """
    rows = pages.select("page_id", "url", "html")
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = trained_tree()
        for batch in batches:
            texts = [main_text(p, tree) for p in batch.column(2).to_pylist()]
            columns = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(in_batches(run), f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")


@query("op7_html_text")
def op7_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages"))
