"""Main text of web pages from flat text blocks and a decision tree.

A page is cut into flat blocks of text at block-level tags. Each block is described
by its word count and link density, those of the blocks before and after it, whether
it is a heading, whether it lies in the page's article (or the page has none, or it
lies outside; articles with less than half of the page's unlinked words outside
boilerplate, such as teasers, count as none), and whether an element around it is, by tag, role, class or id, a menu,
header, footer, sidebar, notice, advert, form or reader comment, or may be one (a class
or id that joins such a word to one of another kind). A decision tree, trained on the small labelled table below, keeps or drops each block.

Kept blocks are joined in page order by one space, white space inside them turned
into one space, character references decoded. NULL and empty pages give the empty
string, unclosed elements end with the page, a "<" that begins no tag is text.
Repeated pages give equal texts; whole pages are read, whatever their length.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element names of HTML by role.
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
CONTAINER = frozenset("address article aside blockquote button details dialog div dl fieldset figure footer form header li main menu nav ol section select table td ul span".split())
NO_TEXT = frozenset("script style template noscript iframe svg math object canvas audio video head title textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILER_TAGS = frozenset("nav footer aside form button select dialog menu fieldset".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar note".split())

# Words of class and id names that mark what is not the article.
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot adunit banner breadcrumb breadcrumbs captcha chat comment comments commentlist "
    "consent cookie cookies copyright disclaimer disqus feedback footer gdpr hidden legal login masthead menu menubar modal nav navbar navigation newsletter "
    "notice notification notifications overlay pager pagination paywall popup promo promos promoted promotion recommended recommendations related replies reply "
    "respond responses search share sharing sidebar signin signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar trending widget widgets".split()
)
# Words beside which those above keep their meaning, as in "ad-box" or "related-posts". Beside others they may be part of a
# text's subject, as in "related-work": then length and links decide.
NEUTRAL_WORDS = frozenset(
    "area article articles bar block body bottom box btn col column container content entry footer group header icon icons id inner item items label left link links list main "
    "outer page panel post posts right row section site slot small stories story text title top unit wrap wrapper".split()
)
#: Words that alone may name boilerplate or a part of the text.
OPEN_WORDS = frozenset(("discussion",))
#: Boilerplate around an article, but part of it inside.
OUTSIDE_WORDS = frozenset(("header",))
ARTICLE_ROLES = frozenset(("main", "article"))

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^<>]*)(?:>|\Z)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_END_OF: dict[str, re.Pattern] = {}

#: words, link density, words and density before, words and density after, heading, place (1 in the article, 0 no article on the page, -1 outside it), boilerplate around (1, or 0.5 where names only may say so) -> kept
LABELLED = (
    # menus, footers, sidebars, adverts, notices and comments that say what they are
    (1, 1.0, 1, 1.0, 1, 1.0, 0, -1, 1, 0), (6, 1.0, 0, 0.0, 8, 0.0, 0, 0, 1, 0), (8, 0.0, 1, 1.0, 10, 0.0, 0, -1, 1, 0), (8, 0.1, 90, 0.0, 0, 0.0, 0, -1, 1, 0),
    (40, 0.0, 60, 0.0, 50, 0.0, 0, 1, 1, 0), (120, 0.0, 3, 0.0, 4, 0.0, 0, 0, 1, 0), (25, 0.4, 60, 0.0, 3, 1.0, 0, 1, 1, 0), (3, 0.0, 1, 1.0, 30, 0.0, 1, -1, 1, 0),
    (2, 0.0, 80, 0.0, 20, 0.0, 1, 1, 1, 0), (60, 0.0, 2, 0.0, 60, 0.0, 0, -1, 1, 0), (14, 0.0, 100, 0.0, 12, 0.0, 0, 0, 1, 0), (5, 1.0, 5, 1.0, 5, 1.0, 0, 1, 1, 0),
    (200, 0.0, 0, 0.0, 90, 0.0, 0, 0, 1, 0), (1, 0.0, 12, 0.0, 1, 0.0, 0, 1, 1, 0), (30, 0.0, 1, 0.0, 200, 0.0, 0, 1, 1, 0), (4, 0.0, 4, 0.0, 4, 0.0, 1, 0, 1, 0),
    (4, 1.0, 60, 0.0, 60, 0.0, 0, 1, 1, 0), (10, 1.0, 90, 0.0, 80, 0.0, 0, 0, 1, 0), (5, 1.0, 70, 0.0, 90, 0.0, 0, -1, 1, 0), (1, 1.0, 30, 0.0, 30, 0.0, 0, 1, 1, 0), (6, 1.0, 40, 0.0, 35, 0.0, 0, 1, 1, 0),
    # inside the article headings, long and short paragraphs and links between texts stay
    (10, 0.0, 8, 0.0, 60, 0.0, 1, 1, 0, 1), (1, 0.0, 80, 0.0, 1, 0.0, 0, 1, 0, 1), (2, 0.0, 1, 0.0, 90, 0.0, 0, 1, 0, 1), (150, 0.0, 10, 0.0, 120, 0.0, 0, 1, 0, 1),
    (60, 0.2, 60, 0.0, 60, 0.0, 0, 1, 0, 1), (5, 1.0, 80, 0.0, 70, 0.0, 0, 1, 0, 1), (3, 0.0, 0, 0.0, 3, 0.0, 0, 1, 0, 1), (400, 0.0, 1, 1.0, 9, 0.1, 0, 1, 0, 1),
    (1, 0.0, 1, 1.0, 8, 0.0, 0, 1, 0, 1), (12, 0.0, 70, 0.0, 9, 1.0, 0, 1, 0, 1), (7, 0.4, 40, 0.0, 40, 0.0, 0, 1, 0, 1), (1, 1.0, 30, 0.0, 30, 0.0, 0, 1, 0, 1),
    # also between short ones
    (4, 0.0, 3, 0.0, 3, 0.0, 1, 1, 0, 1), (3, 0.0, 4, 0.0, 5, 0.0, 0, 1, 0, 1), (5, 0.0, 3, 0.0, 1, 0.0, 0, 1, 0, 1), (2, 0.0, 5, 0.0, 4, 0.0, 0, 1, 0, 1), (8, 0.0, 6, 0.0, 2, 0.0, 1, 1, 0, 1),
    (6, 0.0, 2, 0.0, 3, 0.0, 0, 1, 0, 1), (9, 0.0, 40, 0.0, 2, 0.0, 0, 1, 0, 1), (2, 0.0, 2, 0.0, 0, 0.0, 0, 1, 0, 1), (1, 0.0, 30, 0.0, 4, 0.0, 0, 1, 0, 1), (3, 0.0, 90, 0.0, 5, 0.0, 0, 1, 0, 1),
    # inside the article lists of links go
    (3, 1.0, 4, 1.0, 3, 1.0, 0, 1, 0, 0), (6, 1.0, 5, 1.0, 7, 1.0, 0, 1, 0, 0), (2, 1.0, 60, 0.0, 3, 1.0, 0, 1, 0, 0), (5, 1.0, 4, 1.0, 70, 0.0, 0, 1, 0, 0), (25, 0.9, 8, 1.0, 30, 0.9, 0, 1, 0, 0), (4, 1.0, 6, 1.0, 0, 0.0, 0, 1, 0, 0),
    (3, 1.0, 80, 0.0, 3, 1.0, 0, 1, 0, 0), (6, 1.0, 120, 0.0, 5, 1.0, 0, 1, 0, 0), (1, 1.0, 30, 0.0, 1, 1.0, 0, 1, 0, 0), (8, 1.0, 70, 0.0, 9, 1.0, 0, 1, 0, 0), (2, 1.0, 3, 1.0, 90, 0.0, 0, 1, 0, 0),
    # outside the article long texts with few links stay, others go
    (150, 0.0, 120, 0.0, 130, 0.0, 0, -1, 0, 1), (220, 0.05, 60, 0.0, 180, 0.0, 0, -1, 0, 1), (180, 0.0, 4, 0.0, 3, 1.0, 0, -1, 0, 1), (160, 0.9, 40, 0.0, 8, 1.0, 0, -1, 0, 0), (6, 1.0, 80, 0.0, 70, 0.0, 0, -1, 0, 0),
    (8, 0.0, 1, 1.0, 10, 0.0, 0, -1, 0, 0), (50, 0.0, 60, 0.0, 2, 0.0, 0, -1, 0, 0), (2, 0.0, 0, 0.0, 10, 0.0, 1, -1, 0, 0), (3, 1.0, 3, 1.0, 12, 0.0, 0, -1, 0, 0),
    (100, 0.0, 90, 0.0, 4, 0.0, 0, -1, 0, 0), (12, 0.2, 200, 0.0, 0, 0.0, 0, -1, 0, 0), (30, 0.0, 8, 0.0, 120, 0.0, 0, -1, 0, 0), (1, 0.0, 40, 0.0, 1, 1.0, 0, -1, 0, 0),
    (90, 0.0, 80, 0.0, 100, 0.0, 0, -1, 0, 0), (25, 0.0, 30, 0.0, 30, 0.0, 0, -1, 0, 0), (60, 0.0, 1, 1.0, 25, 0.0, 0, -1, 0, 0), (200, 0.1, 60, 0.0, 60, 0.0, 0, -1, 0, 1),
    (18, 0.0, 40, 0.0, 45, 0.0, 1, -1, 0, 0), (40, 0.0, 50, 0.0, 70, 0.0, 0, -1, 0, 0), (6, 0.0, 50, 0.0, 55, 0.0, 0, -1, 0, 0), (35, 0.05, 25, 0.0, 60, 0.0, 0, -1, 0, 0),
    # no article on the page: long blocks with few links, short ones between long ones, headings before long ones
    (80, 0.0, 60, 0.0, 70, 0.0, 0, 0, 0, 1), (30, 0.05, 40, 0.0, 3, 0.0, 0, 0, 0, 1), (20, 0.0, 25, 0.0, 30, 0.0, 0, 0, 0, 1), (150, 0.1, 1, 1.0, 4, 1.0, 0, 0, 0, 1),
    (6, 0.0, 50, 0.0, 60, 0.0, 0, 0, 0, 1), (3, 0.0, 40, 0.0, 35, 0.0, 0, 0, 0, 1), (8, 0.0, 2, 1.0, 70, 0.0, 1, 0, 0, 1), (4, 0.0, 60, 0.0, 55, 0.0, 1, 0, 0, 1),
    (45, 0.2, 50, 0.0, 5, 1.0, 0, 0, 0, 1), (18, 0.0, 90, 0.0, 2, 0.0, 0, 0, 0, 1), (16, 0.0, 3, 0.0, 40, 0.0, 0, 0, 0, 1), (12, 0.1, 30, 0.0, 45, 0.0, 0, 0, 0, 1),
    (70, 0.0, 40, 0.0, 130, 0.0, 0, 0, 0, 1), (130, 0.0, 120, 0.0, 150, 0.0, 0, 0, 0, 1), (22, 0.0, 8, 0.0, 300, 0.0, 0, 0, 0, 1), (9, 0.0, 45, 0.0, 110, 0.0, 0, 0, 0, 1),
    (40, 0.1, 200, 0.0, 100, 0.0, 0, 0, 0, 1), (250, 0.0, 7, 0.0, 200, 0.0, 0, 0, 0, 1), (11, 0.0, 1, 1.0, 140, 0.0, 1, 0, 0, 1), (5, 0.0, 100, 0.0, 99, 0.0, 1, 0, 0, 1),
    (2, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0), (4, 1.0, 1, 1.0, 40, 0.0, 0, 0, 0, 0), (5, 0.0, 60, 0.0, 2, 1.0, 0, 0, 0, 0), (3, 0.0, 2, 0.0, 4, 0.0, 0, 0, 0, 0),
    (6, 0.5, 3, 1.0, 5, 1.0, 0, 0, 0, 0), (20, 0.9, 50, 0.0, 10, 1.0, 0, 0, 0, 0), (35, 0.8, 4, 1.0, 60, 0.0, 0, 0, 0, 0), (3, 0.0, 1, 1.0, 2, 1.0, 1, 0, 0, 0),
    (7, 0.0, 1, 1.0, 3, 0.0, 0, 0, 0, 0), (4, 0.3, 70, 0.0, 0, 0.0, 0, 0, 0, 0), (1, 0.0, 1, 0.0, 1, 0.0, 0, 0, 0, 0), (50, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0),
    # a page of one short text
    (3, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (1, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (12, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (7, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1),
    # names that may say so: long texts with few links and what leads to them stay, links and short texts go
    (80, 0.0, 3, 0.0, 60, 0.0, 0, 1, 0.5, 1), (45, 0.1, 60, 0.0, 3, 0.0, 0, 1, 0.5, 1), (2, 0.0, 70, 0.0, 80, 0.0, 1, 1, 0.5, 1), (120, 0.0, 90, 0.0, 2, 1.0, 0, 0, 0.5, 1), (60, 0.0, 2, 0.0, 50, 0.0, 0, 0, 0.5, 1), (150, 0.0, 40, 0.0, 60, 0.0, 0, -1, 0.5, 1),
    (3, 1.0, 4, 1.0, 3, 1.0, 0, 1, 0.5, 0), (6, 0.0, 70, 0.0, 5, 0.0, 0, 1, 0.5, 0), (4, 0.0, 3, 1.0, 2, 1.0, 1, 0, 0.5, 0), (10, 0.0, 8, 0.0, 60, 0.0, 0, 0, 0.5, 0), (50, 0.9, 60, 0.0, 40, 0.9, 0, 1, 0.5, 0), (8, 0.0, 1, 1.0, 10, 0.0, 0, -1, 0.5, 0), (5, 1.0, 90, 0.0, 70, 0.0, 0, 0, 0.5, 0),
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0), (1, 1.0, 1, 1.0, 60, 0.0, 0, 0, 0, 0), (5, 1.0, 0, 0.0, 6, 1.0, 0, 0, 0, 0), (3, 1.0, 90, 0.0, 3, 1.0, 0, 0, 0, 0), (4, 1.0, 5, 1.0, 0, 0.0, 0, 0, 0, 0),
)


@dataclass
class Node:
    """value decides where there is no split."""

    value: int
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None

    def decide(self, x) -> int:
        node = self
        while node.low is not None:
            node = node.low if x[node.feature] <= node.cut else node.high
        return node.value


def train(table=LABELLED, depth: int = 9) -> Node:
    """A classification tree by Gini impurity; cuts lie halfway between neighbouring values."""
    data = np.array(table, float)
    x, y = data[:, :-1], data[:, -1]

    def impurity(part: np.ndarray) -> float:
        p = part.mean() if len(part) else 0.0
        return len(part) * p * (1 - p)

    def grow(rows: np.ndarray, left: int) -> Node:
        value = int(y[rows].mean() >= 0.5)
        best = (impurity(y[rows]) - 1e-9, -1, 0.0)
        if left:
            for f in range(x.shape[1]):
                values = np.unique(x[rows, f])
                for cut in (values[1:] + values[:-1]) / 2:
                    below = x[rows, f] <= cut
                    best = min(best, (impurity(y[rows[below]]) + impurity(y[rows[~below]]), f, float(cut)))
        if best[1] < 0:
            return Node(value)
        below = x[rows, best[1]] <= best[2]
        return Node(value, best[1], best[2], grow(rows[below], left - 1), grow(rows[~below], left - 1))

    return grow(np.arange(len(y)), depth)


def _marks(name: str, attributes: str) -> tuple[float, bool, bool]:
    """Of an element: boilerplate (0.5 if it may be), boilerplate unless in an article, article."""
    boiler, outside, article = float(name in BOILER_TAGS), name == "header", name in ("article", "main")
    if attributes and not attributes.isspace():
        for key, value in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key in ("class", "id"):
                for one in value.split():
                    parts = {p.lower() for p in NAME_PART.findall(one)}
                    if not parts.isdisjoint(BOILER_WORDS):
                        boiler = max(boiler, 1.0 if parts <= BOILER_WORDS | NEUTRAL_WORDS else 0.5)
                    elif not parts.isdisjoint(OPEN_WORDS):
                        boiler = max(boiler, 0.5)
                    outside |= not parts.isdisjoint(OUTSIDE_WORDS)
            elif key == "role":
                boiler = max(boiler, float(value.lower() in BOILER_ROLES))
                article |= value.lower() in ARTICLE_ROLES
            elif key == "hidden":
                boiler = 1.0
            elif key == "aria-hidden":
                boiler = max(boiler, float(value.lower() == "true"))
            else:
                boiler = max(boiler, float("display:none" in value.replace(" ", "").lower()))
    return boiler, outside, article


def blocks(page: str) -> list[list]:
    """Flat blocks in page order: [text, words, link words, heading, in an article, boilerplate around]."""
    found: list[list] = []
    stack: list[tuple[str, float, bool]] = []  # element, boilerplate, in an article; the latter two hold for all inside
    text: list[str] = []
    linked: list[str] = []
    heading, in_link, boiler, article, at, end = False, 0, 0.0, False, 0, len(page)
    unclosed: set[str] = set()  # names of elements without text that nothing closes any more

    def close() -> None:
        nonlocal heading
        if text:
            whole = references.unescape("".join(text)).split()
            if whole:
                links = len(references.unescape(" ".join(linked)).split()) if linked else 0
                found.append([" ".join(whole), len(whole), min(links, len(whole)), heading, article, boiler])
            text.clear()
            linked.clear()

    def say(part: str) -> None:
        if part:
            text.append(part)
            if in_link:
                linked.append(part)

    while at < end:
        m = TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name, closing, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in NO_TEXT and not closing and not attributes.endswith("/"):
            if name not in _END_OF:
                _END_OF[name] = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.IGNORECASE)
            stop = None if name in unclosed else _END_OF[name].search(page, at)
            if stop is None:
                unclosed.add(name)
            if name in ("script", "style") or stop is not None:
                at = stop.end() if stop else end
            if name in BLOCK:
                close()
            continue
        if name == "a":
            in_link = 0 if closing else 1
        if name in BLOCK:
            if name == "br":
                say(" ")
            else:
                close()
                in_link = 0 if name not in ("br",) and not closing and name in CONTAINER else in_link
                heading = name in HEADING and not closing
        if name in CONTAINER and name not in VOID and not attributes.endswith("/"):
            if not closing:
                marks = _marks(name, attributes)
                if name == "span" and not marks[0]:
                    stack.append((name, boiler, article))
                    continue
                if name == "span":
                    close()
                stack.append((name, boiler, article))
                if marks[2] and not (boiler == 1 and article):
                    # what surrounds an article does not count inside it
                    boiler, article = marks[0], True
                else:
                    boiler = max(boiler, marks[0], float(marks[1] and not article))
            else:
                k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
                if k is not None:
                    if name == "span" and (boiler, article) != stack[k][1:]:
                        close()
                    _, boiler, article = stack[k]
                    del stack[k:]
    close()
    return found


def described(found: list[list]) -> list[tuple]:
    """The tree's view of each block."""
    inside = sum(b[1] - b[2] for b in found if b[4] and b[5] < 1)
    outside = sum(b[1] - b[2] for b in found if not b[4] and b[5] < 1)
    has_article = inside > 0 and inside >= outside
    density = [b[2] / b[1] for b in found]
    out = []
    for i, b in enumerate(found):
        before = (found[i - 1][1], density[i - 1]) if i else (0, 0.0)
        after = (found[i + 1][1], density[i + 1]) if i + 1 < len(found) else (0, 0.0)
        out.append((b[1], density[i], *before, *after, int(b[3]), (1 if b[4] else -1) if has_article else 0, b[5]))
    return out


def main_text(page: str | None, tree: Node) -> str:
    """Blocks that say they are boilerplate go; of the others the tree decides."""
    found = blocks(page or "")
    return " ".join(b[0] for b, x in zip(found, described(found), strict=True) if x[-1] < 1 and tree.decide(x))


def extract(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """pages with the html column replaced by the text and its length in code points, n_chars.

    Other columns pass through; columns with the names of results are replaced.
    """
    rest = [c for c in pages.columns if c not in (html, into, "n_chars")]
    kind = T.StructType([*(pages.schema[c] for c in rest), T.StructField(into, T.StringType()), T.StructField("n_chars", T.LongType())])
    tree = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [main_text(p, tree) for p in part.column(len(rest)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], kind.names)

    return pages.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{html}`").alias("html_")).mapInArrow(run, kind)
