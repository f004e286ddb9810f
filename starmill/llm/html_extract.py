"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read once into blocks: runs of text between block-level tags, each below a path of open
elements. A classifier gives every block a score, a sum of bounded terms: what the nearest of its
ancestors' tags, classes and roles say, whether the page has an article and the block lies outside
it (or, on a page without one, in a part that holds little of the text), its length, its
punctuation, its share of link text, a notice of rights. A positive score is the capacity from the
source to the block, a negative one the capacity from the block to the sink. Smoothness edges join
neighbours in page order, every block with its container, and every container with the one around it;
they are of the scores' size, so that a block goes with its surroundings unless it has much to say for
itself. The minimum cut labels the blocks: those that no longer reach the sink in the residual
graph are content (where several cuts are minimal, the one that keeps most text). Only what is never
shown (scripts, styles, the head) is no block at all.

A block whose own capacity exceeds all its smoothness edges together is on its own side in every
minimum cut; it is fixed beforehand and its edges become capacities of its neighbours. The flow is
computed over what is left.

Text: character references are decoded, white space inside a block (a line break included) becomes
one space, blocks are joined in page order by one line end. Nothing else is dropped or cut.

Defined results: null html is an empty page with empty text; null keys and URLs are carried;
repeated rows are extracted row by row; extra columns are ignored; an empty table gives an
empty result; unclosed and stray tags are taken as browsers do (a block tag ends an open paragraph,
a closing tag without its opening tag is ignored, an unclosed script runs to the end).
"""

from __future__ import annotations

import html
import re
from collections import defaultdict, deque
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starmill.llm.words import as_text, struct_udf

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+[^>]*)(?:>|$)",
    re.S,
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")

# Element names by their part in a page.
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main "
    "menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr "
    "ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
NEVER = RAW | set("head template noscript svg math object select button datalist canvas".split())
FURNITURE = set("nav footer aside form menu dialog fieldset".split())
ARTICLE = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PARAGRAPHS = {"p", "blockquote", "pre", "figcaption"}
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
SCOPE = set("article aside body dl div footer form header main nav ol section table ul".split())

# Words in classes, ids and roles.
FURNITURE_NAMES = set(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment "
    "comments consent cookie cookies copyright dialog disclaimer disqus footer form login menu "
    "modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted "
    "promotion related recommended replies reply search share sharing sidebar signup social "
    "sponsor sponsored subscribe toolbar widget".split()
)
HEADER_NAMES = {"header", "masthead", "topbar"}
CONTENT_NAMES = set("article content entry main post story".split())

# Scores, in hundredths.
FURNITURE_SCORE, HEADER_SCORE, HINT_SCORE = -300, -250, -140
ARTICLE_SCORE, CONTENT_SCORE, OUTSIDE_SCORE, MINOR_SCORE = 130, 60, -260, -160
LONG_SCORE, SHORT_SCORE, CHAR_SCORE, SENTENCE_SCORE, OPEN_SCORE = 120, -80, 2, 60, -40
LINK_SCORE, RIGHTS_SCORE, HEADING_SCORE, PARAGRAPH_SCORE = -100, -180, 40, 20
NEXT_EDGE, NEXT_IN_CONTAINER, CONTAINER_EDGE, OUTER_EDGE = 20, 60, 60, 10
MINOR_SHARE = 4  # a part with less than a fourth of the largest one's text is minor
RIGHTS = re.compile(r"^(?:©|\(c\)\s|copyright\b)|\ball rights reserved\b", re.I)


@dataclass
class Element:
    name: str
    container: int  # index of the nearest container
    against: int  # strongest evidence against content, from here and above
    content: int  # best evidence for content since the last furniture
    article: bool
    link: bool
    hidden: bool = False  # never shown, nor what is below


@dataclass
class Block:
    text: str
    container: int
    score: int
    against: int
    content: int
    in_article: bool


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    containers: list[int] = field(default_factory=lambda: [-1])  # parent of each container


def _named(attributes: str) -> tuple[set[str], set[str]]:
    """Names in classes, ids and roles: what an element is (a whole name, or the last part of a
    compound: ``site-footer``), and what compounds only mention (``share-prices``)."""
    whole, mentioned = set(), set()
    for groups in NAMES.findall(attributes):
        for token in "".join(groups).lower().split():
            parts = [p for p in SPLIT.split(token) if p]
            whole.update(parts[-1:])
            mentioned.update(parts[:-1])
    return whole, mentioned


def _entered(name: str, attributes: str, parent: Element, page: Page) -> Element:
    against, content, article = parent.against, parent.content, parent.article
    whole: set[str] = set()
    mentioned: set[str] = set()
    if "=" in attributes and name not in ("html", "body"):
        whole, mentioned = _named(attributes)
    header = (name == "header" or whole & HEADER_NAMES) and not article
    if name in FURNITURE or whole & FURNITURE_NAMES or header:
        against, content = min(against, HEADER_SCORE if header else FURNITURE_SCORE), 0
    elif mentioned & FURNITURE_NAMES:
        against = min(against, HINT_SCORE)
    if name in ARTICLE:  # one within furniture is a teaser at most
        content = max(content, CONTENT_SCORE if against <= HEADER_SCORE else ARTICLE_SCORE)
        article = True
    elif whole & CONTENT_NAMES:
        content = max(content, CONTENT_SCORE)
    container = parent.container
    if name in SCOPE:
        page.containers.append(container)
        container = len(page.containers) - 1
    hidden = parent.hidden or name in NEVER
    return Element(name, container, against, content, article, parent.link or name == "a", hidden)


def _score(element: Element, text: str, linked: int) -> int:
    """What the text alone says; what its place says comes with the page."""
    score = min(LONG_SCORE, SHORT_SCORE + CHAR_SCORE * len(text))
    score += SENTENCE_SCORE if text[-1] in ".!?…。" else OPEN_SCORE
    if 2 * linked > len(text):
        score += LINK_SCORE
    if RIGHTS.search(text):
        score += RIGHTS_SCORE
    if element.name in HEADINGS:
        score += HEADING_SCORE
    elif element.name in PARAGRAPHS:
        score += PARAGRAPH_SCORE
    return score


def scores_of(page: Page) -> list[int]:
    """The blocks' scores: their text's, and one term for their place in the page."""
    if any(b.in_article and b.against + b.content + b.score > 0 for b in page.blocks):
        return [
            b.score + b.content + (b.against if b.in_article else min(b.against, OUTSIDE_SCORE))
            for b in page.blocks
        ]
    minor = minor_places(page)
    return [
        b.score + b.content + min(b.against, MINOR_SCORE if b.container in minor else 0)
        for b in page.blocks
    ]


def minor_places(page: Page) -> set[int]:
    """Containers in parts of the page that hold little text. A container with over three fourths
    of all text is the page's frame; its blocks are never minor. A part is a largest container
    that is no frame; it is minor against the largest part or what a frame holds directly (which
    counts as a few of its longest blocks at most, as many short ones are no text)."""
    held = [0] * len(page.containers)
    for b in page.blocks:
        held[b.container] += len(b.text)
    direct = held[:]
    for c in range(len(held) - 1, 0, -1):  # a container comes after the one around it
        held[page.containers[c]] += held[c]
    frame = [4 * h > 3 * held[0] for h in held]
    longest = [0] * len(held)
    for b in page.blocks:
        longest[b.container] = max(longest[b.container], len(b.text))
    most = max(
        min(direct[c], MINOR_SHARE * longest[c]) if frame[c] else held[c] for c in range(len(held))
    )
    part = [0] * len(held)  # the mass of the part that a container lies in
    for c, parent in enumerate(page.containers):
        if not frame[c]:
            part[c] = held[c] if frame[parent] else part[parent]
    return {c for c in range(len(held)) if direct[c] and not frame[c] and MINOR_SHARE * part[c] < most}


def parse(source: str) -> Page:
    """The blocks of a page with their scores."""
    page = Page()
    stack = [Element("", 0, 0, 0, False, False)]
    pieces: list[str] = []
    linked = 0

    def flush(owner: Element) -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text and not owner.hidden:
                page.blocks.append(Block(
                    text, owner.container, _score(owner, text, linked), owner.against,
                    owner.content, owner.article,
                ))
            pieces.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if stack[-1].link:
            linked += len(text.strip())

    def owner() -> Element:
        """The block-level element that the present text belongs to."""
        for element in reversed(stack):
            if element.name in BLOCK or element.name in NEVER or not element.name:
                return element
        return stack[0]

    def close(names: set[str], stops: set[str]) -> None:
        """Close the nearest open element of ``names`` that no element of ``stops`` hides."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                del stack[k:]
                return
            if stack[k].name in stops:
                return

    at, size = 0, len(source)
    while at < size:
        opened = source.find("<", at)
        if opened < 0:
            add(source[at:])
            break
        if opened > at:
            add(source[at:opened])
        token = TOKEN.match(source, opened)
        if token is None:
            add("<")
            at = opened + 1
            continue
        at = token.end()
        if token.group(2) is None:
            continue
        name = token.group(2).lower()
        breaks = name in BLOCK or name in NEVER
        if breaks:
            flush(owner())
        if token.group(1):
            close({name}, set())
            continue
        if name == "br":
            pieces.append(" ")
        if name in VOID:
            continue
        if name in BLOCK:
            close({"p"}, SCOPE)
        if name in CLOSES:
            close(CLOSES[name], SCOPE - {"div"} if name in ("td", "th", "tr") else SCOPE)
        if name == "body":
            close({"head"}, set())
        attributes = token.group(3)
        if attributes.endswith("/") and name in ("svg", "math"):
            continue
        stack.append(_entered(name, attributes, stack[-1], page))
        if name in RAW:
            ending = re.compile(rf"</{name}(?=[\s/>]|$)", re.I).search(source, at)
            at = ending.start() if ending else size
    flush(owner())
    return page


def max_flow(capacity: list[dict[int, int]], source: int, sink: int) -> set[int]:
    """Nodes that reach the sink in the residual graph of a maximum flow (Dinic). ``capacity`` is
    changed to the residual capacities; an edge has its reverse in it, if only with 0."""
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for v, c in capacity[u].items():
                if c > 0 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            break
        edges = [iter(list(capacity[u])) for u in range(len(capacity))]
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                flow = min(capacity[a][b] for a, b in zip(path, path[1:]))
                cut = len(path)
                for k in range(len(path) - 2, -1, -1):
                    a, b = path[k], path[k + 1]
                    capacity[a][b] -= flow
                    capacity[b][a] = capacity[b].get(a, 0) + flow
                    if not capacity[a][b]:
                        cut = k + 1
                del path[cut:]
                edges_at = path[-1]
                edges[edges_at] = iter(list(capacity[edges_at]))
                continue
            for v in edges[u]:
                if capacity[u][v] > 0 and level.get(v) == level[u] + 1:
                    path.append(v)
                    break
            else:
                level.pop(u, None)
                path.pop()
    reaching, queue = {sink}, deque([sink])
    while queue:
        v = queue.popleft()
        for u in capacity[v]:
            if u not in reaching and capacity[u].get(v, 0) > 0:
                reaching.add(u)
                queue.append(u)
    return reaching


def smoothness(page: Page) -> dict[tuple[int, int], int]:
    """Edges between blocks (numbered from 0) and containers (after the blocks)."""
    edges: dict[tuple[int, int], int] = defaultdict(int)
    count = len(page.blocks)
    for i, block in enumerate(page.blocks):
        edges[i, count + block.container] += CONTAINER_EDGE
        if i:
            same = page.blocks[i - 1].container == block.container
            edges[i - 1, i] += NEXT_IN_CONTAINER if same else NEXT_EDGE
    for container, parent in enumerate(page.containers):
        if parent >= 0:
            edges[count + parent, count + container] += OUTER_EDGE
    return edges


def label(scores: list[int], edges: dict[tuple[int, int], int], nodes: int) -> list[bool]:
    """True for the blocks on the source's side of the minimum cut; nodes beyond ``scores`` have
    no capacity of their own and no label."""
    own = scores + [0] * (nodes - len(scores))
    around = [0] * nodes
    for (a, b), weight in edges.items():
        around[a] += weight
        around[b] += weight
    fixed = [abs(s) > total for s, total in zip(own, around)]
    labels = [s > 0 for s in own]
    if all(fixed[: len(scores)]):
        return labels[: len(scores)]
    free = [i for i in range(nodes) if not fixed[i]]
    place = {node: k for k, node in enumerate(free)}
    source, sink = len(free), len(free) + 1
    capacity: list[dict[int, int]] = [{} for _ in range(len(free) + 2)]

    def join(a: int, b: int, weight: int, back: int) -> None:
        capacity[a][b] = capacity[a].get(b, 0) + weight
        capacity[b][a] = capacity[b].get(a, 0) + back

    def terminal(node: int, score: int) -> None:
        if score > 0:
            join(source, place[node], score, 0)
        elif score < 0:
            join(place[node], sink, -score, 0)

    for node in free:
        terminal(node, own[node])
    for (a, b), weight in edges.items():
        if fixed[a] and fixed[b]:
            continue
        if fixed[a] or fixed[b]:
            known, other = (a, b) if fixed[a] else (b, a)
            terminal(other, weight if labels[known] else -weight)
        else:
            join(place[a], place[b], weight, weight)
    lost = max_flow(capacity, source, sink)
    for node in free:
        labels[node] = place[node] not in lost
    return labels[: len(scores)]


def labelled(source: str) -> tuple[Page, list[int], list[bool]]:
    """A page's blocks, their scores and whether they are content."""
    page = parse(source)
    scores = scores_of(page)
    if not page.blocks:
        return page, scores, []
    return page, scores, label(scores, smoothness(page), len(page.blocks) + len(page.containers))


def main_text(source: str) -> str:
    page, _, labels = labelled(source)
    return "\n".join(b.text for b, content in zip(page.blocks, labels) if content)


def _extract(sources: pa.Array) -> pa.Array:
    return pa.array([main_text(source) for source in as_text(sources)], pa.string())


def extract(
    df: DataFrame, key: str = "page_id", url: str = "url", source: str = "html"
) -> DataFrame:
    """``key``, ``url``, ``text`` and ``n_chars`` (code points) of every row."""
    narrow = df.select(
        F.col(key).alias("key"), F.col(url).alias("url"), F.col(source).alias("source")
    )
    texts = narrow.select("key", "url", struct_udf("string", _extract)(F.col("source")).alias("text"))
    return texts.select(
        F.col("key").alias(key), F.col("url").alias(url), "text",
        F.length("text").cast("long").alias("n_chars"),
    )
