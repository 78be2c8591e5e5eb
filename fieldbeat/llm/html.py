"""Main text of web pages: a conditional random field over a page's leaf blocks.

A page is the sequence of its blocks of text, each with features of its ancestors (tags,
classes, the nearest landmark) and of its text. A linear-chain CRF with two labels is trained on
a bounded sample of pages whose blocks are labelled by their markup; Viterbi decoding picks the
blocks of the article. Some training pages are varied: landmarks are hidden, so that the text's
own features carry pages without such markup, or blocks are put into other elements, so that the
landmark and not the element decides where there is one.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from math import exp, log, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

from fieldbeat.llm.shared import in_batches, replaced, slices, texts, with_fields

#: Pages that the weights are learned from, blocks of such a page at most, and passes over them.
SAMPLE_ROWS, SAMPLE_BLOCKS, EPOCHS = 400, 500, 8
RATE, L2 = 0.5, 1e-4

# HTML's elements by their role.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split())
BREAKS = frozenset(
    "address article aside blockquote body button caption dd details dialog div dl dt fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav"
    " ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title"
    " tr ul".split())
HIDDEN = frozenset("script style template noscript svg math iframe object canvas head".split())
#: Elements that show none of their text; a head's title is a block.
UNSEEN = HIDDEN - {"head"}
CONTENT = frozenset("article main".split())
BOILERPLATE = frozenset(
    "nav header footer aside form menu button select textarea dialog title".split())
#: Words in classes, ids and roles that tell what inside an article is not part of it, and words
#: that say nothing beside them. A name counts if it has one of the first and none but these.
NAMES = frozenset(
    "ad ads adsbox advert adverts advertisement banner breadcrumb breadcrumbs comment comments"
    " complementary consent contentinfo cookie cookies disclaimer discussion disqus footer header legal"
    " masthead menu nav navbar navigation newsletter notice notices pagination popup promo related replies"
    " reply respond search share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
NEUTRAL = frozenset(
    "area bar block body bottom box buttons container content form inner item items left links list main outer"
    " page panel post posts reader right section slot text top unit user wrap wrapper".split())
#: What every page with a block of the article has.
ARTICLE = r"(?i)<(?:article|main)[\s/>]"
LANDMARKS = frozenset({"content", "boilerplate"})


def _says_boilerplate(names: str) -> bool:
    """Whether one of the names (classes, ids and role) is made of such words only."""
    for name in names.split():
        words = [w for w in re.split("[^a-z]+", name) if w]
        if not NAMES.isdisjoint(words) and all(w in NAMES or w in NEUTRAL for w in words):
            return True
    return False


class Node:
    """An open element, and what it and those around it are to a block inside: the role of the
    nearest one that has a role, all tags, the innermost that breaks lines, and whether one links.

    The element decides its role; names do for other elements inside an article, or where there is no
    article around.
    """

    __slots__ = ("tag", "names", "parent", "role", "tags", "leaf", "links")

    def __init__(self, tag: str = "", names: str = "", parent: Node | None = None):
        self.tag, self.names, self.parent = tag, names, parent
        around = ("none", frozenset(), "", False) if parent is None else (
            parent.role, parent.tags, parent.leaf, parent.links)
        self.role, self.tags, self.leaf, self.links = around
        if tag in BOILERPLATE:
            self.role = "boilerplate"
        elif tag in CONTENT:
            self.role = "content"
        elif names and _says_boilerplate(names):
            self.role = "boilerplate"
        if tag and tag not in self.tags:
            self.tags = self.tags | {tag}
        if tag in BREAKS:
            self.leaf = tag
        self.links = self.links or tag == "a"


@dataclass
class Block:
    """A leaf block: its text, the innermost open element, and its linked characters."""

    text: str
    node: Node
    linked: int


#: Elements whose start ends an open one of the same kind, unless a list or table is nearer.
IMPLIED = {"li": "li", "dd": "dd", "dt": "dt", "td": "td", "th": "td", "tr": "tr", "option": "option"}


class Blocks(HTMLParser):
    """Collects the blocks of a page; ends that are missing are closed as browsers do. Time and
    memory grow with the page, however deep it is."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.path: list[Node] = [Node()]
        self.open: dict[str, list[int]] = {}  # where in the path a tag is open
        self.pieces: list[str] = []
        self.linked = 0
        self.hidden = 0  # open elements of UNSEEN

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            self.blocks.append(Block(text, self.path[-1], self.linked))
        self.pieces, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.hidden:
            pass  # it breaks nothing that shows
        elif tag in BREAKS:
            self.flush()
            if tag in IMPLIED:
                self._close(IMPLIED[tag], ("ul", "ol", "dl", "table", "select"))
            self._close("p", ("td", "th", "li", "button"))
        else:
            self.pieces.append(" " if tag == "br" else "")
        if tag not in VOID:
            names = " ".join(v.lower() for k, v in attrs if v and k in ("class", "id", "role"))
            self.open.setdefault(tag, []).append(len(self.path))
            self.path.append(Node(tag, names, self.path[-1]))
            self.hidden += tag in UNSEEN

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in BREAKS | HIDDEN:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BREAKS and not self._inside_hidden(tag):
            self.flush()
        self._close(tag)

    def _inside_hidden(self, tag: str) -> bool:
        """Whether the innermost open element of this tag is in a hidden one."""
        if not self.hidden or not self.open.get(tag):
            return False
        return self.open[tag][-1] >= min(self.open[t][0] for t in UNSEEN if self.open.get(t))

    def _close(self, tag: str, limits: tuple[str, ...] = ()) -> None:
        """Closes the innermost open element of this tag, unless one of the limits is nearer;
        with limits, the close is implied and does not reach out of a hidden element."""
        places = self.open.get(tag)
        if not places:
            return
        at = places[-1]
        for other in (*limits, *UNSEEN) if limits else ():
            if other != tag and self.open.get(other) and self.open[other][-1] > at:
                return
        for node in self.path[at:]:
            self.open[node.tag].pop()
            self.hidden -= node.tag in UNSEEN
        del self.path[at:]

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        self.pieces.append(data)
        if self.path[-1].links:
            self.linked += len(data)


def blocks(html: str) -> list[Block]:
    """The blocks of a whole page in page order; none for an empty one."""
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.blocks


def features(block: Block, position: float) -> list[str]:
    size = min((block.text.count(" ") + 1).bit_length(), 7)
    return [
        "bias",
        f"landmark={block.node.role}",
        *(f"in={t}" for t in block.node.tags if t not in ("html", "body", "b", "i", "em", "strong")),
        f"tag={block.node.leaf}",
        f"words={size}",
        f"links={round(4 * block.linked / max(1, len(block.text)))}",
        f"ends={block.text[-1] in '.!?:;”\"»…'}",
        f"commas={min(3, block.text.count(','))}",
        f"mark={block.text[0] in '©®™|·»›'}",
        f"at={min(3, int(4 * position))}",
    ]


def labels(page: list[Block]) -> list[int]:
    """1 for blocks that the markup says are the article's."""
    return [int(b.node.role == "content") for b in page]


def _sequence(page: list[Block]) -> list[list[str]]:
    """Each block's features. That a block has no landmark tells something only on pages where
    others have that of an article."""
    sequence = [features(b, i / len(page)) for i, b in enumerate(page)]
    return sequence if any("landmark=content" in row for row in sequence) else _hidden(sequence)


def _hidden(sequence: list[list[str]]) -> list[list[str]]:
    """The sequence without what the article's own elements tell."""
    named = {"landmark=content", "landmark=none", *(f"in={t}" for t in CONTENT)}
    return [[f for f in row if f not in named] for row in sequence]


def _moved(page: list[Block]) -> list[Block]:
    """The page with every third block put into boilerplate, and the others into other elements."""
    wrappers = [*((t, "") for t in sorted(BOILERPLATE)), *(("div", n) for n in (
        "ad", "comments", "sidebar", "notice", "cookie", "share", "related", "menu"))]
    elements = "h2 h3 li blockquote pre td dd figcaption div p p p".split()
    moved = []
    for i, b in enumerate(page):
        node, around = b.node, b.node.parent
        if around is not None and i % 3 == 2:
            node = Node(node.tag, node.names, Node(*wrappers[i // 3 % len(wrappers)], around))
        elif around is not None and i % 3 == 1:
            node = Node(elements[i // 3 % len(elements)], node.names, around)
        moved.append(Block(b.text, node, b.linked))
    return moved


def _training(page: list[Block], i: int) -> tuple[list[list[str]], list[int]]:
    if i % 4 == 2:
        return _hidden(_sequence(page)), labels(page)
    if i % 2:
        page = page[i % 5 :] + page[: i % 5] if i % 4 == 3 else page
        page = _moved(page)
    return _sequence(page), labels(page)


def _add(a: float, b: float) -> float:
    high, low = (a, b) if a >= b else (b, a)
    return high + log(1 + exp(low - high)) if low - high > -40 else high


@dataclass
class Crf:
    """Weights of (feature, label 1 against 0) and of label pairs."""

    states: dict[str, float] = field(default_factory=dict)
    moves: list[float] = field(default_factory=lambda: [0.0] * 4)

    def scores(self, sequence: list[list[str]]) -> list[float]:
        get = self.states.get
        return [sum(get(f, 0.0) for f in row) for row in sequence]

    def decode(self, sequence: list[list[str]]) -> list[int]:
        """The likeliest labels; label 0 on a tie."""
        if not sequence:
            return []
        m, back = self.moves, []
        scores = self.scores(sequence)
        zero, one = 0.0, scores[0]
        for s in scores[1:]:
            to_zero, to_one = int(one + m[2] > zero + m[0]), int(one + m[3] > zero + m[1])
            back.append((to_zero, to_one))
            zero, one = (max(zero + m[0], one + m[2]), max(zero + m[1], one + m[3]) + s)
        label = int(one > zero)
        path = [label]
        for step in reversed(back):
            label = step[label]
            path.append(label)
        return path[::-1]

    def marginals(self, scores: list[float]) -> tuple[list[float], list[float]]:
        """Probability of label 1 at each place, and the expected count of each label pair."""
        m, n = self.moves, len(scores)
        ahead = [(0.0, scores[0])]
        for s in scores[1:]:
            z, o = ahead[-1]
            ahead.append((_add(z + m[0], o + m[2]), _add(z + m[1], o + m[3]) + s))
        after = [(0.0, 0.0)] * n
        for i in range(n - 2, -1, -1):
            z, o = after[i + 1]
            o += scores[i + 1]
            after[i] = (_add(m[0] + z, m[1] + o), _add(m[2] + z, m[3] + o))
        total = _add(*ahead[-1])
        ones = [exp(a[1] + b[1] - total) for a, b in zip(ahead, after, strict=True)]
        pairs = [0.0] * 4
        for i in range(n - 1):
            for k in range(4):
                gain = after[i + 1][k & 1] + (scores[i + 1] if k & 1 else 0.0)
                pairs[k] += exp(ahead[i][k >> 1] + m[k] + gain - total)
        return ones, pairs


def train(pages: list[tuple[list[list[str]], list[int]]]) -> Crf:
    """Maximises the likelihood of the labels by adaptive gradient steps."""
    crf, seen, seen_moves = Crf(), {}, [1e-6] * 4
    for _ in range(EPOCHS):
        for sequence, truth in pages:
            ones, pairs = crf.marginals(crf.scores(sequence))
            gradient: dict[str, float] = {}
            for row, p, y in zip(sequence, ones, truth, strict=True):
                for f in row:
                    gradient[f] = gradient.get(f, 0.0) + y - p
            for f, g in gradient.items():
                w = crf.states.get(f, 0.0)
                g -= L2 * w
                seen[f] = seen.get(f, 1e-6) + g * g
                crf.states[f] = w + RATE * g / sqrt(seen[f])
            for k in range(4):
                real = sum(1 for a, b in zip(truth, truth[1:]) if 2 * a + b == k)
                g = real - pairs[k] - L2 * crf.moves[k]
                seen_moves[k] += g * g
                crf.moves[k] += RATE * g / sqrt(seen_moves[k])
    return crf


def fit(pages: DataFrame, column: str = "html", key: str = "page_id") -> Crf:
    """Learns from a bounded sample of the distinct pages with a block of the article, taken by
    the hash of ``key`` and the page.

    Without any such page the weights are empty, every block has label 0, and a warning says so.
    """
    order = F.xxhash64(F.col(key).cast("string"), F.col(column))
    given = (
        pages.where(F.col(column).isNotNull() & (F.length(column) <= 1 << 18) & F.col(column).rlike(ARTICLE))
        .select(F.col(column).alias("html"), order.alias("order"), F.xxhash64(column).alias("content")))
    picked = (
        in_batches(given, _labelled, "order long, content long")
        .groupBy("content").agg(F.min("order").alias("order"))
        .orderBy("order", "content").limit(SAMPLE_ROWS).collect())
    if not picked:
        warnings.warn("no page has a block of an article: all main texts will be empty", stacklevel=2)
        return train([])
    rows = given.where(F.col("order").isin([r["order"] for r in picked])).select("order", "html").distinct()
    learned = [blocks(r["html"])[:SAMPLE_BLOCKS] for r in sorted(rows.collect())]
    return train([_training(page, i) for i, page in enumerate(learned)])


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pages whose first blocks hold one of the article, without their text."""
    for batch in batches:
        for part in slices(batch, "html"):
            found = [any(labels(blocks(t)[:SAMPLE_BLOCKS])) for t in texts(part, "html")]
            yield part.select(["order", "content"]).filter(pa.array(found, pa.bool_()))


def main_text(html: str, crf: Crf) -> str:
    """The article's blocks, joined by line ends."""
    page = blocks(html)
    chosen = crf.decode(_sequence(page))
    return "\n".join(b.text for b, label in zip(page, chosen, strict=True) if label)


def extract(pages: DataFrame, crf: Crf, column: str = "html", to: str = "text") -> DataFrame:
    """Adds each whole page's main text as ``to`` (an existing column is replaced).

    Empty for a null or empty page and where no block belongs to an article.
    """
    shared = pages.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                found = [main_text(t, shared.value) for t in texts(part, column)]
                yield replaced(part, **{to: pa.array(found, pa.string())})

    return in_batches(pages, run, with_fields(pages.schema, StructField(to, StringType())))
