"""Main text of web pages: flat text blocks and a small decision tree.

A page becomes a flat list of text blocks. Each block is described by its
word count and link density, those of the blocks before and after it, the
place it stands in, and whether it is a heading; a decision tree trained on the
small labelled table below keeps or drops it. Places come from elements and
from the names in class, id and role: counts and densities alone can't tell
an advert or a reader's comment from a paragraph.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of

_TOKEN = re.compile(r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"<]*\"|'[^'<]*'|[\"'])*)(?:>|\Z))", re.S)
#: Elements whose content is not text of the page, up to their end tag.
RAW = {x: re.compile(rf"</{x}(?=[\s>/])[^>]*(?:>|\Z)", re.I) for x in "script style noscript template textarea select svg math iframe object canvas".split()}
_ROLE = re.compile(r"(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Fixed names: tags that do not end a block, tags without content, and places by tag or by a part of a name in class, id or role.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE_TAGS = frozenset("nav footer aside menu button head title".split())
FRAME_TAGS = frozenset("header form dialog fieldset select".split())
MAIN_TAGS = frozenset("article main".split())
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
FRAME_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead banner footer foot sidebar side aside widget ad ads advert adverts advertisement sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login form search share sharing social related recommended pagination pager copyright legal toolbar skip".split()
)
MAIN_WORDS = frozenset("article articlebody content maincontent main post entry story body".split())
#: Parts that turn a name into a remark about the page: "no-sidebar", "with-header".
REMARKS = frozenset("no not without with has have is hide hidden".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: The small labelled table: words, link density, words and link density of the block before and after, place (-2 outside, -1 in a frame, 0 unknown, 1 named as main text, 2 in an article), heading, and whether people would call the block main text.
LABELLED = np.array([
    # words, ld, p_words, p_ld, n_words, n_ld, place, heading, label
    [1, 1.0, 0, 0.0, 1, 1.0, -2, 0, 0], [3, 1.0, 1, 1.0, 8, 0.0, -2, 0, 0], [12, 0.1, 1, 1.0, 12, 0.0, -2, 0, 0], [40, 0.0, 80, 0.0, 30, 0.0, -2, 0, 0],
    [60, 0.0, 50, 0.0, 70, 0.0, -2, 0, 0], [5, 0.0, 0, 0.0, 4, 1.0, -2, 1, 0], [200, 0.0, 10, 0.0, 10, 0.0, -2, 0, 0], [2, 0.0, 12, 0.0, 3, 0.0, -2, 0, 0],
    [8, 0.0, 1, 1.0, 12, 0.0, -1, 0, 0], [25, 0.0, 60, 0.0, 6, 0.0, -1, 0, 0], [9, 0.0, 30, 0.0, 0, 0.0, -1, 0, 0], [80, 0.0, 40, 0.0, 90, 0.0, -1, 0, 0],
    [7, 0.0, 5, 0.0, 80, 0.0, -1, 1, 0], [15, 0.6, 4, 0.9, 3, 1.0, -1, 0, 0], [120, 0.0, 3, 1.0, 80, 0.0, -1, 0, 0], [30, 0.0, 40, 0.0, 50, 0.0, -1, 0, 0],
    # In an article: short, linked and long blocks alike.
    [10, 0.0, 8, 0.0, 30, 0.0, 2, 1, 1], [60, 0.0, 10, 0.0, 45, 0.0, 2, 0, 1], [1, 0.0, 40, 0.0, 60, 0.0, 2, 0, 1], [1, 0.0, 1, 0.0, 9, 0.0, 2, 0, 1],
    [3, 0.0, 2, 0.0, 1, 1.0, 2, 0, 1], [150, 0.05, 60, 0.0, 8, 0.0, 2, 0, 1], [12, 0.9, 50, 0.0, 3, 1.0, 2, 0, 1], [4, 1.0, 40, 0.0, 5, 1.0, 2, 0, 1],
    [3, 1.0, 0, 0.0, 40, 0.0, 2, 1, 1], [5, 1.0, 0, 0.0, 3, 1.0, 2, 0, 1], [4, 1.0, 50, 0.0, 3, 0.0, 2, 0, 1], [2, 1.0, 2, 1.0, 2, 1.0, 2, 0, 1],
    [1, 1.0, 3, 1.0, 0, 0.0, 2, 0, 1], [6, 0.0, 2, 1.0, 3, 1.0, 2, 0, 1], [2, 0.0, 1, 1.0, 1, 1.0, 2, 0, 1], [7, 0.9, 0, 0.0, 2, 0.0, 2, 0, 1],
    [5, 1.0, 6, 1.0, 4, 1.0, 2, 0, 1], [30, 0.8, 0, 0.0, 40, 0.0, 2, 0, 1], [8, 0.0, 60, 0.0, 0, 0.0, 2, 0, 1], [45, 0.1, 6, 0.0, 60, 0.1, 2, 0, 1],
    # Named as main text: linked blocks among linked ones are a menu.
    [6, 0.0, 9, 1.0, 70, 0.0, 1, 1, 1], [2, 0.0, 90, 0.0, 30, 0.0, 1, 0, 1], [45, 0.1, 6, 1.0, 60, 0.1, 1, 0, 1], [12, 0.9, 50, 0.0, 30, 0.0, 1, 0, 1],
    [2, 0.0, 0, 0.0, 3, 0.0, 1, 0, 1], [20, 1.0, 40, 0.0, 35, 0.2, 1, 0, 1], [3, 1.0, 50, 0.1, 60, 0.0, 1, 0, 1], [9, 0.0, 2, 1.0, 4, 0.0, 1, 0, 1],
    [5, 1.0, 6, 1.0, 4, 1.0, 1, 0, 0], [2, 1.0, 3, 1.0, 2, 1.0, 1, 0, 0], [9, 0.9, 4, 1.0, 5, 0.8, 1, 0, 0], [4, 1.0, 5, 1.0, 6, 1.0, 1, 0, 0],
    # Unknown places: prose and what stands beside it stays, however short.
    [55, 0.0, 60, 0.0, 9, 0.0, 0, 0, 1], [40, 0.1, 70, 0.0, 0, 0.0, 0, 0, 1], [70, 0.0, 0, 0.0, 3, 1.0, 0, 0, 1], [120, 0.0, 4, 1.0, 90, 0.0, 0, 0, 1],
    [35, 0.05, 60, 0.0, 50, 0.0, 0, 0, 1], [50, 0.0, 8, 0.0, 40, 0.0, 0, 0, 1], [20, 0.0, 60, 0.0, 45, 0.0, 0, 0, 1], [22, 0.0, 30, 0.0, 4, 1.0, 0, 0, 1],
    [6, 0.0, 50, 0.0, 60, 0.0, 0, 0, 1], [1, 0.0, 45, 0.0, 70, 0.0, 0, 0, 1], [1, 0.0, 0, 0.0, 60, 0.0, 0, 0, 1], [2, 0.0, 1, 0.0, 50, 0.0, 0, 0, 1],
    [9, 0.0, 3, 1.0, 60, 0.0, 0, 1, 1], [3, 0.0, 45, 0.0, 70, 0.0, 0, 1, 1], [1, 0.0, 80, 0.0, 2, 0.0, 0, 0, 1], [8, 0.0, 70, 0.0, 1, 0.0, 0, 0, 1],
    [2, 0.0, 0, 0.0, 2, 0.0, 0, 0, 1], [3, 0.0, 2, 0.0, 25, 0.0, 0, 0, 1], [5, 0.0, 6, 0.0, 7, 0.0, 0, 0, 1], [4, 0.0, 9, 0.0, 0, 0.0, 0, 0, 1],
    [12, 0.9, 60, 0.0, 50, 0.0, 0, 0, 1], [15, 0.6, 40, 0.0, 30, 0.1, 0, 0, 1], [25, 0.5, 45, 0.1, 20, 0.0, 0, 0, 1], [3, 1.0, 55, 0.0, 70, 0.0, 0, 0, 1],
    # Linked blocks beside linked ones, and bits of text among them, go.
    [2, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0], [5, 0.8, 3, 1.0, 4, 1.0, 0, 0, 0], [1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0], [2, 1.0, 1, 1.0, 0, 0.0, 0, 0, 0],
    [3, 1.0, 4, 1.0, 30, 0.0, 0, 0, 0], [4, 1.0, 50, 0.0, 3, 1.0, 0, 0, 0], [30, 0.7, 4, 1.0, 25, 0.8, 0, 0, 0], [14, 0.5, 6, 1.0, 5, 1.0, 0, 0, 0],
    [4, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0], [7, 0.0, 3, 1.0, 5, 0.0, 0, 0, 0], [6, 0.0, 2, 1.0, 0, 0.0, 0, 0, 0], [3, 0.0, 0, 0.0, 2, 1.0, 0, 0, 0],
    [6, 0.9, 0, 0.0, 3, 0.0, 0, 0, 0], [8, 0.0, 4, 1.0, 6, 0.7, 0, 0, 0], [10, 0.1, 3, 1.0, 9, 0.0, 0, 0, 0], [2, 0.0, 0, 0.0, 1, 1.0, 0, 0, 0],
])


def grow_tree(rows: np.ndarray, depth: int = 10) -> tuple:
    """A binary decision tree by Gini impurity: (feature, threshold, left, right) or a label."""
    x, y = rows[:, :-1], rows[:, -1]
    share = y.mean()
    if depth == 0 or share in (0.0, 1.0):
        return (bool(share >= 0.5),)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= t
            a, b = y[left], y[~left]
            cost = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, float(t), left)
    if best is None:
        return (bool(share >= 0.5),)
    _, f, t, left = best
    return (f, t, grow_tree(rows[left], depth - 1), grow_tree(rows[~left], depth - 1))


def keeps(tree: tuple, features: tuple) -> bool:
    while len(tree) == 4:
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree[0]


@functools.lru_cache(10_000)
def _vote(tag: str, attributes: str) -> int:
    """-3 reader comments, -2 outside, -1 a frame, 1 named as main text, 2 an article, 0 nothing known."""
    frame = main = False
    for m in _ROLE.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            parts = set(re.split(r"[^a-z]+", name))
            if parts & REMARKS:
                continue
            if parts & COMMENT_WORDS:
                return -3
            frame |= bool(parts & FRAME_WORDS)
            main |= bool(parts & MAIN_WORDS) and not parts & FRAME_WORDS
    if tag in MAIN_TAGS:
        return 2
    if tag in OUTSIDE_TAGS:
        return -2
    if tag in FRAME_TAGS or (frame and not main and tag not in ("body", "html")):
        return -1
    return int(main)


def blocks(page: str) -> list[tuple[str, int, float, int, bool]]:
    """Text, word count, link density, place and heading of each block of a page.

    Nothing inside an outside element or a reader's comment leads back to main
    text; an article inside a frame does. The header of an article is no
    frame. On a page without an article, an element that holds more than half
    of the page's words outside links is no frame either, whatever its name.
    """
    text: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int, tuple[int, ...]]] = []
    found: list[tuple[str, int, float, int, tuple[int, ...], bool]] = []
    place, frames, links, heading, at, end = 0, (), 0, False, 0, len(page)
    n_frames = 0

    def flush():
        whole = " ".join(html.unescape("".join(text)).split())
        text.clear()
        inside = sum(len(html.unescape(x).split()) for x in linked)
        linked.clear()
        if whole:
            n = whole.count(" ") + 1
            found.append((whole, n, min(1.0, inside / n), place, frames, heading))

    m = _TOKEN.search(page)
    while m:
        if m.start() > at:
            piece = page[at : m.start()]
            text.append(piece)
            if links:
                linked.append(piece)
        at = m.end()
        this, tag = m, m[2]
        if tag and not m[1] and (raw := RAW.get(tag.lower())) and not m[3].endswith("/"):
            over = raw.search(page, at)
            at = over.end() if over else end
            text.append(" ")
            tag = None
        m = _TOKEN.search(page, at)
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), bool(this[1]), this[3]
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            continue
        flush()
        links = 0
        if closing:
            if any(x[0] == tag for x in stack):
                while stack and stack.pop()[0] != tag:
                    pass
                _, place, frames = stack[-1] if stack else ("", 0, ())
            if tag in HEADINGS:
                heading = False
        elif tag not in EMPTY:
            if tag == "p" and stack and stack[-1][0] == "p":
                stack.pop()
            _, outer, around = stack[-1] if stack else ("", 0, ())
            vote = _vote(tag, attributes)
            place, frames = outer, around
            if vote <= -2:
                place = -2
            elif vote == -1:
                if outer > -2 and not (tag == "header" and outer == 2):
                    n_frames += 1
                    frames = (*around, n_frames)
            elif outer > -2 and vote:
                place, frames = (2, ()) if vote == 2 else (max(outer, 1), around)
            stack.append((tag, place, frames))
            heading = tag in HEADINGS
    if at < end:
        text.append(page[at:end])
        if links:
            linked.append(page[at:end])
    flush()

    wide: set[int] = set()
    if n_frames and not any(p == 2 for _, _, _, p, _, _ in found):
        held, total = [0.0] * (n_frames + 1), 0.0
        for _, n, density, p, inside, _ in found:
            if p > -2:
                total += n * (1 - density)
                for x in inside:
                    held[x] += n * (1 - density)
        wide = {x for x in range(1, n_frames + 1) if held[x] > total / 2}
    return [(t, n, d, -1 if p > -2 and not wide.issuperset(inside) else p, h) for t, n, d, p, inside, h in found]


def main_text(page: str | None, tree: tuple | None = None) -> str:
    """Main text of a whole page: kept blocks in page order, two line ends between them."""
    if not page:
        return ""
    found = blocks(page)
    tree = tree or grow_tree(LABELLED)
    none = ("", 0, 0.0, 0, False)
    out = []
    for i, (text, n, density, place, heading) in enumerate(found):
        before, after = found[i - 1] if i else none, found[i + 1] if i + 1 < len(found) else none
        if keeps(tree, (n, density, before[1], before[2], after[1], after[2], place, heading)):
            out.append(text)
    return "\n\n".join(out)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Main text of every page: page_id, url, text (empty if none), n_chars.

    Null html counts as empty; null ids and urls stay null; repeated rows give
    repeated results; very long pages are read whole; extra columns, whatever
    their names, are dropped; an empty table gives an empty one. One pass, no
    shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = grow_tree(LABELLED)
        for batch in batches:
            for part in batches_of(batch, "html", 4 << 20):
                text = [main_text(x, tree) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
