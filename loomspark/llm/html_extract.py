"""Main text of web pages by minimum-cut labelling of their blocks.

Each block has a cost for being content and one for being boilerplate: the log odds of a logistic regression over its
text, and bounded evidence of the names around it. Neighbouring blocks and blocks of one parent are tied by edges that
are stronger the closer they lie in the tree. The minimum cut between content and boilerplate labels all blocks of a
page together; both kinds of evidence are of the edges' scale, so blocks that say little by themselves, such as short
lines, headings and captions, go with their surroundings.

The regression is learned from the pages themselves: blocks inside article or main elements against blocks inside
elements that are boilerplate by their tag or names. It sees no names, so it also serves pages that have none.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import cut

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var img wbr".split())
#: Elements whose text is never shown as text of the page.
HIDDEN = frozenset("script style noscript template head title svg math iframe object canvas audio video textarea select option button datalist".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog".split())
#: Words of class, id and role that mark boilerplate; the second set counts around an article as well.
HINTS = frozenset("ad ads advert adverts advertisement advertising adsbygoogle banner promo promotion sponsor sponsored sidebar side widget menu nav navbar navigation topbar toolbar breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notification alert popup modal overlay share sharing social newsletter subscribe subscription signup login search pager pagination toc hidden copyright legal disclaimer tags".split())
STRONG = frozenset("comment comments commentlist discussion disqus respond replies reply reviews related recommended recommendations".split())
#: Those of the second set that mark what readers write.
READERS = frozenset("comment comments commentlist discussion disqus respond replies reply reviews".split())
#: Elements that hold text rather than parts of a page.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption".split())
MAIN = frozenset("article main content post entry story body text".split())
_SPLIT = re.compile(r"[^a-z0-9]+")
_SENTENCE = re.compile(r"[.!?…]['\"»”)]*(?:\s|$)")


@dataclass(slots=True)
class _Node:
    """An open element: what holds for text inside it."""

    parent: _Node | None
    tag: str
    depth: int
    hidden: bool
    bad: bool
    worse: bool
    main: bool


@dataclass(slots=True)
class Block:
    text: str
    link_chars: int
    node: _Node


class _Blocks(HTMLParser):
    """Splits a page into blocks of text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.node = _Node(None, "", 0, False, False, False, False)
        self.open: dict[str, int] = {}
        self.pieces: list[str] = []
        self.links = 0
        self.at: _Node | None = None

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.blocks.append(Block(text, self.links, self.at))
            self.pieces, self.links, self.at = [], 0, None

    def _pop(self, tag: str) -> None:
        while self.node.tag != tag:
            self.open[self.node.tag] -= 1
            self.node = self.node.parent
        self.open[tag] -= 1
        self.node = self.node.parent

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            if tag == "br":
                self.pieces.append(" ")
            elif tag not in INLINE:
                self.flush()
            return
        if tag not in INLINE:
            self.flush()
            if self.open.get("p"):
                self._pop("p")
            if tag in ("li", "tr", "td", "th", "dt", "dd", "option") and self.node.tag == tag:
                self._pop(tag)
        above = self.node
        names = [name for k, v in attrs if v and k in ("class", "id", "role") for name in v.lower().split()]
        words = {w for name in names if not name.startswith(("with-", "has-", "no-", "without-")) for w in _SPLIT.split(name)}
        article = tag in ("article", "main")
        top = tag in ("html", "body")
        # an article's classes name its topics, and those of a paragraph in it what it says: only readers' words exclude them
        said = article or above.main and tag in TEXTUAL
        worse = above.worse or (not top and bool(words & (READERS if said else STRONG))) or tag in BOILERPLATE
        bad = not article and (above.bad or (not top and not said and bool(words & HINTS)) or tag == "header" and not above.main)
        self.node = _Node(above, tag, above.depth + 1, above.hidden or tag in HIDDEN, bad, worse, above.main or article or (not top and bool(words & MAIN)))
        self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            if tag == "br":
                self.pieces.append(" ")
            return
        if tag not in INLINE:
            self.flush()
        if self.open.get(tag):
            self._pop(tag)

    def handle_data(self, data: str) -> None:
        if self.node.hidden:
            return
        if self.at is None and data.strip():
            self.at = self.node
            while self.at.tag in INLINE:
                self.at = self.at.parent
        self.pieces.append(data)
        if self.open.get("a"):
            self.links += len(data.strip())


def blocks_of(html: str) -> list[Block]:
    """Blocks of a page in order; a tag that the end of the page cuts off is left out."""
    last = html.rfind("<")
    if last > html.rfind(">") and re.match(r"<[a-zA-Z/!?]", html[last : last + 2]):
        html = html[:last]
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.blocks


#: What the regression sees of a block's text.
FEATURES = ("log_words", "link_share", "sentence", "commas_a_word", "capital_share", "copyright")
#: Bound of the regression's log odds; evidence of a main element around a block, of one elsewhere on the page, and of boilerplate names.
TEXT_BOUND, INSIDE, OUTSIDE, NAMED = 2.5, 2.0, -1.5, -8.0


@dataclass(frozen=True)
class Costs:
    """Log odds that a block is content, from its text: an intercept and a weight for each of FEATURES."""

    intercept: float = -2.5
    weights: tuple[float, ...] = (0.9, -5.0, 1.0, 1.0, -0.5, -3.0)

    def of(self, values: list[float]) -> float:
        odds = self.intercept + sum(w * v for w, v in zip(self.weights, values, strict=True))
        return max(-TEXT_BOUND, min(TEXT_BOUND, odds))


def features(block: Block) -> list[float]:
    text = block.text
    words = text.count(" ") + 1
    return [
        math.log(words), min(1.0, block.link_chars / len(text)), float(bool(_SENTENCE.search(text))), min(1.0, text.count(",") / words),
        sum(map(str.isupper, text)) / len(text), float("©" in text or text.lower().startswith("copyright")),
    ]


def evidence(blocks: list[Block], costs: Costs) -> list[float]:
    """Log odds of each block of a page by itself: its text's, and what the names around it say."""
    whole = any(b.node.main for b in blocks)
    place = lambda n: (INSIDE if n.main else OUTSIDE if whole else 0.0) + (NAMED if n.bad or n.worse else 0.0)
    return [costs.of(features(b)) + place(b.node) for b in blocks]


def fit(pages: DataFrame, html: str = "html", max_pages: int = 2000) -> Costs:
    """Learns the regression from about max_pages pages at most, chosen by a hash of the page.

    A block inside an article or main element and under no boilerplate name counts as content, one under a boilerplate
    name as boilerplate, others are left out. Without blocks of both kinds the default weights are returned.
    """
    total = pages.count()
    drawn = pages.select(F.col(html).alias("html")).filter(F.pmod(F.xxhash64("html"), F.lit(1_000_000)) < F.lit(1_000_000 * min(1.0, max_pages / max(1, total))))

    def labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for block in (b for page in batch["html"] if page for b in blocks_of(page)):
                named = block.node.bad or block.node.worse
                if named or block.node.main:
                    rows.append((features(block), float(not named)))
            yield pd.DataFrame(rows, columns=["x", "label"])

    seen = cut(drawn.mapInPandas(labelled, "x array<double>, label double"))
    if seen.select("label").distinct().count() < 2:
        return Costs()
    found = LogisticRegression(featuresCol="features", maxIter=60, regParam=0.01, standardization=False).fit(seen.select(array_to_vector("x").alias("features"), "label"))
    return Costs(round(found.intercept, 3), tuple(round(float(w), 3) for w in found.coefficients))


#: Weight of an edge between neighbouring blocks by the steps between their elements in the tree, and of edges further on.
NEAR, FAR = (1.5, 1.2, 1.2, 0.4), 0.2


def _weight(a: _Node, b: _Node) -> float:
    """Blocks of one element or of sibling elements are tied closely, others the less the further up they meet."""
    for weight in NEAR:
        if a is b:
            return weight
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        if a is None or b is None:
            break
    return FAR


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: a node with odds x costs max(0, x) as boilerplate or max(0, -x) as content, an edge its weight if it is cut.

    Nodes whose odds outweigh all their edges are settled first, which no minimum cut contradicts; maximum flow by
    shortest augmenting paths labels the rest. Where both labels cost the same, boilerplate is taken.
    """
    n = len(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    pull, label = list(odds), [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is not None or abs(pull[i]) <= sum(near[i].values()):
            continue
        label[i] = pull[i] > 0
        for j, w in near[i].items():
            pull[j] += w if label[i] else -w
            del near[j][i]
            queue.append(j)
        near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        source, sink = n, n + 1
        flow: dict[int, dict[int, float]] = {i: dict(near[i]) for i in rest}
        flow[source], flow[sink] = {}, {}
        for i in rest:
            flow[source][i], flow[i][source] = max(0.0, pull[i]), 0.0
            flow[i][sink], flow[sink][i] = max(0.0, -pull[i]), 0.0
        while True:
            came, queue = {source: source}, deque([source])
            while queue and sink not in came:
                i = queue.popleft()
                for j, room in flow[i].items():
                    if room > 1e-9 and j not in came:
                        came[j] = i
                        queue.append(j)
            if sink not in came:
                break
            path, j = [], sink
            while j != source:
                path.append((came[j], j))
                j = came[j]
            room = min(flow[i][j] for i, j in path)
            for i, j in path:
                flow[i][j] -= room
                flow[j][i] += room
        for i in rest:
            label[i] = i in came
    return label


def ties(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbouring blocks, and from each block to the last one before its neighbour that has the same parent."""
    edges = [(i, i + 1, _weight(blocks[i].node, blocks[i + 1].node)) for i in range(len(blocks) - 1)]
    last: dict[int, int] = {}
    for i, block in enumerate(blocks):
        family = id(block.node.parent)
        if family in last and last[family] < i - 1:
            edges.append((last[family], i, 0.5))
        last[family] = i
    return edges


def main_text(html: str | None, costs: Costs | None = None) -> str:
    """The content blocks of a page, in order, joined by single blanks."""
    if not html:
        return ""
    blocks = blocks_of(html)
    labels = min_cut(evidence(blocks, costs or Costs()), ties(blocks))
    return " ".join(b.text for b, content in zip(blocks, labels, strict=True) if content)


def extracted(html: str | Column, costs: Costs | None = None) -> Column:
    """Main text of a column of pages; '' for null, empty and pages without content."""

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(p, costs) for p in pages], dtype=object)

    return extract(html)


def extract(pages: DataFrame, html: str = "html", into: str = "text", costs: Costs | None = None) -> DataFrame:
    """pages with the main text in the column `into` (replaced if there is one); rows and other columns stay as they are.

    Null, empty and malformed pages give the text that is left of them, '' at least. Pages of any length are taken
    whole. Where both labels cost the same, a block is left out. An empty table gives an empty result.
    """
    return pages.withColumn(into, extracted(html, costs))
