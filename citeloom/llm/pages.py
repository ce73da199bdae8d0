"""Main text of HTML pages from flat text blocks and a small decision tree.

A page is read once, from left to right, into flat blocks of text with their word
count, the share of words inside links, and the kind of container they stand in.
A decision tree, trained on a small labelled table, looks at these numbers of a
block and of its neighbours and tells article text from the rest.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tags that do not end a block of text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr "
    "q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements whose content is no text of the page.
SKIPPED = frozenset("head iframe math noscript object script style svg template title".split())
#: Elements that have no content, so no end tag either.
EMPTY = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
#: Containers of something else than the article, by tag and by role.
SIDE_TAGS = frozenset(
    "aside button datalist dialog fieldset footer form header menu nav option select textarea".split()
)
SIDE_ROLES = frozenset(
    "alert banner complementary contentinfo dialog form menu menubar navigation search".split()
)
#: Containers of the article.
MAIN_TAGS = frozenset(["article", "main"])
#: Words in class names and ids of containers of something else.
SIDE_NAMES = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs byline comment "
    "comments consent cookie cookies disclaimer disqus footer gdpr header login masthead menu "
    "modal nav navbar navigation newsletter notice pagination popup promo promotion related "
    "replies reply respond share sharing sidebar signup social sponsor sponsored subscribe "
    "subscription toolbar widget".split()
)
#: With these first, a compound tells of something beside or about the element.
BESIDE = frozenset("category has no tag with without".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template")

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTE_OR_END = re.compile(r"[\"'>]")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|style|hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_PARTS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CLOSERS = {x: re.compile(rf"</{x}(?=[\s/>]|\Z)", re.I) for x in RAW}
#: An open element of the first kind is ended by a start tag of the second.
_PARTS_OF_TABLE = {"tbody", "tfoot", "thead"}
IMPLIED_END = {
    "p": None,
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "td": {"td", "th", "tr"} | _PARTS_OF_TABLE,
    "th": {"td", "th", "tr"} | _PARTS_OF_TABLE,
    "tr": {"tr"} | _PARTS_OF_TABLE,
    **dict.fromkeys(_PARTS_OF_TABLE, _PARTS_OF_TABLE),
    "option": {"option"},
}

#: What is learned from: words, link share, words and link share of the block before and
#: after, zone (1 in an article, -1 in another container, 0 neither), and whether it is text
#: of the article.
EXAMPLES = """
1 1.0 0 0.0 1 1.0 -1 0
1 1.0 1 1.0 1 1.0 -1 0
2 1.0 1 1.0 9 0.0 -1 0
8 0.0 2 1.0 12 0.0 -1 0
30 0.0 1 1.0 40 0.0 -1 0
60 0.1 5 0.0 80 0.0 -1 0
120 0.0 90 0.0 3 0.0 -1 0
14 0.2 100 0.0 0 0.0 -1 0
5 0.0 60 0.0 0 0.0 -1 0
45 0.0 50 0.0 20 0.0 -1 0
12 0.0 8 0.0 90 0.0 1 1
1 0.0 60 0.0 70 0.0 1 1
2 0.0 3 0.0 2 0.0 1 1
70 0.0 12 0.0 65 0.0 1 1
90 0.1 1 0.0 1 0.0 1 1
4 1.0 50 0.0 60 0.0 1 1
25 0.6 30 0.0 10 0.0 1 1
150 0.0 12 0.0 6 0.0 1 1
1 0.0 40 0.0 7 0.3 1 1
6 0.0 1 1.0 1 0.0 1 1
300 0.0 0 0.0 0 0.0 1 1
3 0.0 0 0.0 0 0.0 1 1
1 0.0 5 0.0 1 0.0 1 1
1 0.0 1 1.0 30 0.0 1 1
2 0.5 2 0.0 2 1.0 1 1
3 1.0 4 0.9 2 1.0 1 1
5 1.0 1 1.0 1 1.0 1 1
8 0.8 8 0.9 9 0.9 1 1
1 1.0 6 0.0 0 0.0 1 1
4 0.0 3 0.0 1 1.0 1 1
7 0.3 90 0.0 4 0.0 1 1
2 0.0 14 0.2 14 0.2 1 1
1 1.0 0 0.0 1 1.0 0 0
3 1.0 2 1.0 3 1.0 0 0
4 0.9 60 0.0 3 1.0 0 0
12 0.8 10 0.9 12 0.7 0 0
25 0.7 20 0.8 22 0.6 0 0
40 0.6 8 0.9 9 0.9 0 0
30 0.9 5 0.5 60 0.0 0 0
6 1.0 4 1.0 80 0.0 0 0
3 1.0 2 1.0 50 0.0 0 0
20 0.8 70 0.0 60 0.0 0 0
2 0.0 1 1.0 2 1.0 0 0
5 0.0 3 1.0 4 0.8 0 0
7 0.0 2 0.0 3 0.9 0 0
3 0.0 4 0.0 5 0.0 0 0
6 0.0 0 0.0 4 0.0 0 0
9 0.3 5 0.0 6 0.5 0 0
4 0.0 6 0.0 0 0.0 0 0
8 0.0 2 1.0 70 0.0 0 1
10 0.0 5 0.0 80 0.0 0 1
5 0.0 15 0.0 40 0.0 0 1
4 0.0 2 1.0 45 0.0 0 1
6 0.0 8 0.2 35 0.0 0 1
50 0.0 8 0.0 60 0.0 0 1
35 0.1 50 0.0 40 0.1 0 1
60 0.2 1 1.0 55 0.0 0 1
28 0.0 4 0.0 3 0.0 0 1
18 0.0 60 0.0 45 0.0 0 1
6 0.0 70 0.0 80 0.0 0 1
2 0.0 60 0.0 0 0.0 0 1
3 0.0 45 0.0 0 0.0 0 1
4 0.0 80 0.0 5 0.0 0 1
40 0.0 2 1.0 3 0.0 0 1
3 0.0 40 0.0 90 0.0 0 1
90 0.1 20 0.0 6 0.9 0 1
200 0.0 0 0.0 0 0.0 0 1
22 0.0 0 0.0 0 0.0 0 1
"""


@dataclass
class Node:
    """A question of the tree, or an answer at its end."""

    answer: int
    feature: int = -1
    limit: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6) -> Node:
    """A decision tree by the Gini measure; ties take the first feature and limit."""
    node = Node(int(y.mean() >= 0.5))
    if depth == 0 or y.min() == y.max():
        return node

    def impurity(part: np.ndarray) -> float:
        p = part.mean()
        return 2 * p * (1 - p) * len(part)

    best = impurity(y) - 1e-9
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for limit in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= limit
            cost = impurity(y[low]) + impurity(y[~low])
            if cost < best:
                best, node.feature, node.limit = cost, f, float(limit)
    if node.feature >= 0:
        low = x[:, node.feature] <= node.limit
        node.low, node.high = grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)
    return node


def trained(examples: str = EXAMPLES) -> Node:
    """The tree of the labelled table."""
    rows = np.array([[float(v) for v in line.split()] for line in examples.strip().splitlines()])
    return grow(rows[:, :-1], rows[:, -1])


def answers(tree: Node, x: np.ndarray) -> np.ndarray:
    """The tree's answer to each row."""
    out = np.full(len(x), tree.answer, bool)
    if tree.feature >= 0 and len(x):
        low = x[:, tree.feature] <= tree.limit
        out[low], out[~low] = answers(tree.low, x[low]), answers(tree.high, x[~low])
    return out


def _zone(tag: str, attributes: str) -> tuple[int, bool] | None:
    """-1 for a container of something else, 1 for one of the article, 0 for hidden, else None.

    With it, whether that is a guess: forms may hold whole pages, and a compound with
    a side word in it (``header-fixed``, ``share-enabled``) may be about the article.
    """
    names: set[str] = set()
    whole: set[str] = set()
    if attributes:
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if key == "hidden" or (key == "style" and _HIDDEN.search(value)):
                return 0, False
            if key == "role" and value in SIDE_ROLES:
                return -1, False
            if key in ("class", "id"):
                for word in value.split():
                    parts = _PARTS.findall(word)
                    if parts and (len(parts) == 1 or parts[0] not in BESIDE):
                        names.update(parts)
                    whole.add(word)
    if tag in MAIN_TAGS:
        # A comment may be an article too: then what it stands in decides.
        return None if whole & SIDE_NAMES else (1, False)
    named = tag not in ("html", "body") and names & SIDE_NAMES
    if tag in SIDE_TAGS or named:
        return -1, not whole & SIDE_NAMES and (tag == "form" or tag not in SIDE_TAGS)
    return None


def _settled(containers: list[tuple[int, int, bool]], found: list[tuple[str, int, int, int]]) -> list[int]:
    """The zone of each container ``(outer one, zone, guessed)``.

    One that was guessed to hold something else, but holds two thirds of the words
    of the page outside of links, is no such container: what it stands in decides.
    """
    words = [0] * len(containers)
    for _, n, inside, container in found:
        words[container] += n - inside
    for i in range(len(containers) - 1, 0, -1):
        words[containers[i][0]] += words[i]
    zones = [0]
    for i, (outer, zone, guessed) in enumerate(containers[1:], 1):
        zones.append(zones[outer] if guessed and 3 * words[i] >= 2 * words[0] > 0 else zone)
    return zones


def blocks(page: str) -> list[tuple[str, int, int, int]]:
    """Text, words, words in links, and zone of each block, in page order.

    Linear in the length of the page: each character is passed over a fixed
    number of times, whatever is left unclosed.
    """
    out: list[tuple[str, int, int, int]] = []
    stack: list[tuple[str, int, bool]] = []
    depths: dict[str, list[int]] = {}
    # The container of a zone that stands innermost, by number; 0 is the page.
    containers = [(0, 0, False)]
    zone, hidden, links = 0, False, 0
    pieces: list[str] = []
    linked: list[str] = []

    def flush() -> None:
        if pieces:
            text = _SPACE.sub(" ", "".join(pieces)).strip()
            if text:
                n = text.count(" ") + 1
                inside = min(n, len("".join(linked).split()))
                out.append((text, n, inside, zone))
            pieces.clear()
            linked.clear()

    def add(raw: str) -> None:
        if not hidden and raw:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if links:
                linked.append(text + " ")

    def close(upto: int) -> None:
        nonlocal zone, hidden, links
        while len(stack) > upto:
            tag, zone, hidden = stack.pop()
            depths[tag].pop()
            links -= tag == "a"

    at, n = 0, len(page)
    no_quote = {'"': False, "'": False}
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        add(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        ending = page.startswith("</", lt)
        name = _NAME.match(page, lt + 1 + ending)
        if not name:
            add("<")
            at = lt + 1
            continue
        end = name.end()
        while True:
            mark = _QUOTE_OR_END.search(page, end)
            if not mark:
                at = end = n
                break
            sign, end = mark.group(), mark.end()
            if sign == ">":
                at = end
                break
            # A quote holds a value only after an equals sign.
            if page[max(lt, end - 8) : end - 1].rstrip().endswith("=") and not no_quote[sign]:
                other = page.find(sign, end)
                if other < 0:
                    no_quote[sign] = True
                else:
                    end = other + 1
        tag = name.group().lower()
        if tag not in INLINE:
            flush()
        elif tag in ("br", "wbr") and not hidden:
            pieces.append(" " if tag == "br" else "")
        if ending:
            if depths.get(tag):
                close(depths[tag][-1])
            continue
        attributes = page[name.end() : max(name.end(), at - 1)]
        if tag in EMPTY or attributes.endswith("/"):
            continue
        if tag in RAW:
            found = _CLOSERS[tag].search(page, at)
            at = n if not found else found.start()
        while stack and stack[-1][0] in IMPLIED_END:
            ends = IMPLIED_END[stack[-1][0]]
            if not (tag in ends if ends is not None else tag not in INLINE):
                break
            close(len(stack) - 1)
        depths.setdefault(tag, []).append(len(stack))
        stack.append((tag, zone, hidden))
        links += tag == "a"
        here = _zone(tag, attributes)
        if tag in SKIPPED or (here and here[0] == 0):
            hidden = True
        elif here is not None:
            containers.append((zone, *here))
            zone = len(containers) - 1
    flush()
    zones = _settled(containers, out)
    return [(text, n, inside, zones[container]) for text, n, inside, container in out]


def features(found: list[tuple[str, int, int, int]]) -> np.ndarray:
    """Numbers of each block and of its neighbours, as in the labelled table."""
    own = np.array([[w, l / w] for _, w, l, _ in found], float).reshape(-1, 2)
    pad = np.zeros((1, 2))
    zones = np.array([[z] for *_, z in found], float).reshape(-1, 1)
    return np.hstack([own, np.vstack([pad, own[:-1]]), np.vstack([own[1:], pad]), zones])[: len(own)]


def main_text(page: str | None, tree: Node) -> str:
    """The blocks that the tree takes for the article, one a line."""
    found = blocks(page) if page else []
    if not found:
        return ""
    good = answers(tree, features(found))
    return "\n".join(text for (text, *_), ok in zip(found, good, strict=True) if ok)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages(page_id, url, html)``.

    The text is empty, and never null, if the page is null or empty or has no
    article. Rows may repeat; further columns are not read; an empty table gives
    no rows. White space, no-break spaces too, becomes one space inside a block,
    and so does a line break tag.
    """
    tree = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), tree) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(x) for x in texts], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    slim = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")
