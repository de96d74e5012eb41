"""Main text of web pages by minimum-cut labelling of their text blocks."""

import html
import math
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygauge.llm.common import per_row, text_of

# Element and class names with a customary meaning.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup "
    "option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset(
    "script style noscript template textarea svg math iframe object canvas audio video title noframes xmp".split()
)
AWAY_NAMES = frozenset("nav footer aside form button select menu dialog fieldset datalist search".split())
HOME_NAMES = frozenset(("article", "main"))
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words for what no article is, words for what stands beside one, and words that only hint at either.
OTHER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement sponsor sponsored comment comments disqus replies respond cookie cookies "
    "consent gdpr".split()
)
BESIDE_WORDS = frozenset(
    "promo promotion banner notice notices alert newsletter subscribe subscription related recommended recommendations "
    "trending breadcrumb breadcrumbs menu nav navbar navigation sidebar toolbar pagination pager popup modal sitemap".split()
)
HINT_WORDS = frozenset(
    "reviews signup login register share sharing social teaser overlay widget copyright disclaimer masthead skip tags".split()
)
#: A name that begins or ends with one of these says what a page has or what it is filed under.
STATE_FIRST = frozenset("has with no is not category tag format type status".split())
STATE_LAST = frozenset("open closed free off enabled disabled".split())
EDGE_WORDS = frozenset("header footer top bottom side aside".split())
HOME_WORDS = frozenset("article content main post entry story body text".split())
_SENTENCE_ENDS = ".!?:;…。！？\"'”’»)"

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/><]*)((?:[^>\"']++|\"[^\"<]*\"|'[^'<]*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/><]*)([^>]*)>|</?[a-zA-Z][^>]*\Z|</[^a-zA-Z>]?[^>]*>",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|style|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_CLOSERS = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>?", re.I) for n in UNSEEN}
#: Elements that a '/' at the end of their tag closes, and that may hold others of their name.
_NESTED = {n: re.compile(rf"<(/?){n}(?=[\s/>])((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>?", re.I) for n in ("svg", "math")}

#: What a container may mean: nothing, a hint in a class or id, a name, element or role made for what is
#: left out, text that is not shown.
NOTHING, HINT, NAMED, HIDDEN = range(4)
#: Log-odds that a container's meaning adds to its blocks' classifier scores, which lie within +-LIMIT: in the
#: article, and left out. Hints leave the cut to decide; a score and edges do not outweigh a name.
HOME, AWAY, LIMIT = 3.0, (0.0, 3.0, 9.0, 20.0), 5.0
#: A named container of this many words of prose may turn out to be a wrapper of the page; names nested
#: deeper than that stand.
WRAPPER_WORDS, NESTED_NAMES = 50, 16
#: Weights of the edges to the next block and to the next one below the same container; capacities are
#: integers of this unit.
ADJACENT, PROXIMITY, UNIT = 0.7, 0.5, 1000
TRAIN_PAGES = 2000
#: Coefficients where there is nothing to learn from; one per feature of ``features``.
PRIOR = (-2.0, 0.9, -4.0, 1.0, 0.8, 1.2, -0.8, -0.3)


class Block:
    """A run of text between block boundaries."""

    __slots__ = ("parts", "linked", "home", "made", "away", "names", "parent", "depth", "path", "name")

    def __init__(self, frame):
        self.parts, self.linked = [], 0
        self.name, self.home, self.made, self.away, self.names, self.parent, self.depth, self.path = frame


def _named(value: str, inside: bool) -> tuple[bool, int, bool]:
    """What the words of a class or id say: of an article, how surely of what is left out, and whether
    of something that no article is. A word means its container where it begins or ends a name."""
    home, away, other = False, NOTHING, False
    for word in value.split():
        parts = re.split(r"[-_:]+", word)
        if parts[0] in STATE_FIRST or parts[-1] in STATE_LAST:
            continue
        ends = {parts[0], parts[-1]}
        if ends & OTHER_WORDS or ends & BESIDE_WORDS:
            away, other = NAMED, other or bool(ends & OTHER_WORDS)
            continue
        own = HOME_WORDS.intersection(parts)
        home |= bool(own)
        hints = not (OTHER_WORDS | BESIDE_WORDS | HINT_WORDS).isdisjoint(parts)
        if hints or (EDGE_WORDS.intersection(parts) and not own and not inside):
            away = max(away, HINT)
    return home, away, other


def _meaning(name: str, attributes: str, inside: bool) -> tuple[bool, bool, int, bool]:
    """Whether an element marks the article, whether it is made for that, how surely it marks what is left
    out, and whether as something that no article is."""
    made, words_home, other = name in HOME_NAMES, False, False
    away = NAMED if name in AWAY_NAMES or (name == "header" and not inside) else NOTHING
    if attributes and name not in ("html", "body"):
        for key, *values in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), "".join(values).lower()
            if key == "role":
                made |= value in ("main", "article")
                away = max(away, NAMED * (value in AWAY_ROLES))
            elif key in ("hidden", "aria-hidden"):
                away = max(away, HIDDEN * (value != "false"))
            elif key == "style":
                plain = value.replace(" ", "")
                away = max(away, HIDDEN * ("display:none" in plain or "visibility:hidden" in plain))
            else:
                said = _named(value, inside)
                words_home, away, other = words_home or said[0], max(away, said[1]), other or said[2]
    if made and away == HINT and words_home:
        away = NOTHING  # an article that also names, say, its topic
    return made or words_home, made and away == NOTHING, away, other


def _end_of(name: str, page: str, at: int) -> int:
    """Where the unseen element whose tag ends at ``at`` ends; the end of the page without a closer."""
    if name not in _NESTED:
        closer = _CLOSERS[name].search(page, at)
        return closer.end() if closer else len(page)
    depth = 1
    for tag in _NESTED[name].finditer(page, at):
        depth += -1 if tag[1] else not tag[2].endswith("/")
        if not depth:
            return tag.end()
    return len(page)


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order, with what their containers mean and where they hang.

    Unclosed, stray and crossed tags are taken as browsers do, roughly: a closing tag closes all up to
    its element, or nothing; a block closes an open paragraph; items and cells close the one before.
    """
    frame = ("body", False, False, NOTHING, (), 0, 0, None)
    stack, open_names, made, block = [("", frame)], {}, [], None
    links, at, containers = 0, 0, 0

    def pop_to(name):
        nonlocal links
        while True:
            top = stack.pop()[0]
            open_names[top] -= 1
            links -= top == "a"
            if top == name:
                return

    def add(raw):
        nonlocal block
        if raw and not raw.isspace():
            if block is None:
                block = Block(stack[-1][1])
                made.append(block)
            if "&" in raw:
                raw = html.unescape(raw)
            block.parts.append(raw)
            if links:
                block.linked += len(raw)
        elif raw and block is not None:
            block.parts.append(" ")

    while True:
        token = _TOKEN.search(page, at)
        if token is None:
            add(page[at:])
            break
        add(page[at:token.start()])
        at = token.end()
        name = token[2] or token[5]
        if not name:
            if token[0].startswith("<![CDATA["):
                add(token[0][9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if name in BLOCKS:
            block = None
        if token[1] or token[4]:
            if open_names.get(name):
                pop_to(name)
            continue
        if name in UNSEEN:
            if name not in _NESTED or not (token[3] or token[6] or "").endswith("/"):
                at = _end_of(name, page, at)
            continue
        if name in VOID:
            if block is not None:
                block.parts.append(" ")
            continue
        attributes = token[3] or token[6] or ""
        if name in BLOCKS and open_names.get("p"):
            pop_to("p")
        if name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1][0] == name:
            pop_to(name)
        if name == "a" and open_names.get("a"):
            pop_to("a")
        _, home, made_for, away, names, parent, depth, path = stack[-1][1]
        marks_home, marks_made, marks_away, other = _meaning(name, attributes, home)
        if marks_made and away == HINT:
            away = NOTHING
        if name in BLOCKS or marks_home or marks_away:
            containers += 1
            if marks_home or marks_away:
                block = None
            if marks_away == NAMED and len(names) < NESTED_NAMES:
                names, marks_away = (*names, (containers, other)), NOTHING
            inner = (name, home or marks_home, made_for or marks_made, max(away, marks_away), names, containers, depth + 1, (parent, path))
        else:
            inner = stack[-1][1]
        if not attributes.endswith("/") or name in BLOCKS:
            stack.append((name, inner))
            open_names[name] = open_names.get(name, 0) + 1
            links += name == "a"
    return made


def text_of_block(block: Block) -> str:
    return " ".join("".join(block.parts).split())


def features(block: Block, text: str) -> tuple[float, ...]:
    words = text.count(" ") + 1
    return (
        1.0, math.log1p(words), min(1.0, block.linked / max(1, len(text))), float(text[-1] in _SENTENCE_ENDS),
        float(block.name == "p"), float(block.name in ("h1", "h2", "h3", "h4", "h5", "h6")),
        float(block.name in ("li", "dt", "dd", "option")), float(block.name in ("td", "th", "caption")),
    )


def settle_names(blocks: list[Block], texts: list[str]) -> None:
    """Turn the names around each block into its ``away``, but for those of wrappers.

    A page with prose in a free article or main has no wrappers. Elsewhere the outermost named
    container with more prose than all free blocks is one, if it holds an article or main or
    WRAPPER_WORDS of prose and is not named for what no article is; the names in it count as before.
    """
    words = [0 if b.away >= NAMED or 2 * b.linked > len(t) else t.count(" ") + 1 for b, t in zip(blocks, texts)]
    while True:
        free, held, article, other = 0, {}, set(), {}
        for b, n in zip(blocks, words):
            if not n:
                continue
            if not b.names:
                if b.made:
                    held = {}
                    break
                free += n
                continue
            key, other[b.names[0][0]] = b.names[0]
            held[key] = held.get(key, 0) + n
            if b.made:
                article.add(key)
        fit = [(n, -k) for k, n in held.items() if n > free and (k in article or n >= WRAPPER_WORDS and not other[k])]
        if not fit:
            break
        wrapper = -max(fit)[1]
        for b in blocks:
            if b.names and b.names[0][0] == wrapper:
                b.names = b.names[1:]
    for b in blocks:
        if b.names:
            b.away = max(b.away, NAMED)


def seed(block: Block) -> float:
    """Above 0 in the article, below in what is left out (also inside the article), 0 where nothing says."""
    return -AWAY[block.away] if block.away else HOME if block.home else 0.0


def distance(a: Block, b: Block) -> int:
    """Steps in the tree of containers from one block's container to the other's."""
    (x, x_depth, x_path), (y, y_depth, y_path) = (a.parent, a.depth, a.path), (b.parent, b.depth, b.path)
    steps = 0
    while x != y:
        if x_depth >= y_depth:
            x, x_path = x_path
            x_depth -= 1
        else:
            y, y_path = y_path
            y_depth -= 1
        steps += 1
    return steps


def minimum_cut(odds: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """The labelling (True: on the source's side) of least cost: a node on the wrong side of its odds
    costs their size, an edge between the sides its weight. Of equal ones, the largest source side.

    Nodes whose odds outweigh all their edges are settled first and become odds of their
    neighbours; shortest augmenting paths saturate what is left.
    """
    near: list[dict[int, int]] = [{} for _ in odds]
    for i, j, weight in edges:
        if i != j and weight:
            near[i][j] = near[i].get(j, 0) + weight
            near[j][i] = near[j].get(i, 0) + weight
    odds, label = list(odds), [None] * len(odds)
    queue = deque(range(len(odds)))
    while queue:
        i = queue.popleft()
        if label[i] is None and (odds[i] >= (total := sum(near[i].values())) or -odds[i] > total):
            label[i] = odds[i] >= total
            for j, weight in near[i].items():
                del near[j][i]
                odds[j] += weight if label[i] else -weight
                queue.append(j)
            near[i] = {}
    left = [i for i, known in enumerate(label) if known is None]
    if left:
        for i, side in zip(left, _augment([odds[i] for i in left], left, near)):
            label[i] = side
    return label


def _augment(odds, names, near):
    """Dinic's algorithm on the nodes left; returns the largest source side."""
    place = {n: i for i, n in enumerate(names)}
    source, sink = len(names), len(names) + 1
    room: list[dict[int, int]] = [{place[j]: w for j, w in near[n].items()} for n in names] + [{}, {}]
    for i, o in enumerate(odds):
        a, b = (source, i) if o > 0 else (i, sink)
        if o:
            room[a][b] = room[a].get(b, 0) + abs(o)
            room[b].setdefault(a, 0)
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            i = queue.popleft()
            for j, r in room[i].items():
                if r and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if sink not in level:
            break
        ways = [list(r) for r in room]
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                flow = min(room[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    room[a][b] -= flow
                    room[b][a] += flow
                path = [source]
                continue
            while ways[i] and not (room[i][ways[i][-1]] and level.get(ways[i][-1]) == level[i] + 1):
                ways[i].pop()
            if ways[i]:
                path.append(ways[i][-1])
            else:
                path.pop()
                if path:
                    ways[path[-1]].pop()
    # nodes that still reach the sink are on its side
    reach, queue = {sink}, deque([sink])
    while queue:
        j = queue.popleft()
        for i in room[j]:
            if i not in reach and room[i].get(j):
                reach.add(i)
                queue.append(i)
    return [i not in reach for i in range(len(names))]


def label_blocks(blocks: list[Block], texts: list[str], weights: tuple[float, ...]) -> list[bool]:
    odds, edges, last = [], [], {}
    for i, (block, text) in enumerate(zip(blocks, texts)):
        score = max(-LIMIT, min(LIMIT, sum(w * x for w, x in zip(weights, features(block, text)))))
        odds.append(round(UNIT * (score + seed(block))))
        if i:
            edges.append((i - 1, i, round(UNIT * ADJACENT / max(1, distance(blocks[i - 1], block) - 1))))
        up = block.path[0] if block.path else 0
        if up in last and last[up] < i - 1:
            edges.append((last[up], i, round(UNIT * PROXIMITY)))
        last[up] = i
    return minimum_cut(odds, edges)


def read_page(page: str) -> tuple[list[Block], list[str]]:
    """The blocks of a page that have text, with what their containers mean, and their texts."""
    found = [(b, t) for b in blocks_of(page) if (t := text_of_block(b))]
    blocks, texts = [b for b, _ in found], [t for _, t in found]
    settle_names(blocks, texts)
    return blocks, texts


def main_text(page: str, weights: tuple[float, ...] = PRIOR) -> str:
    """The blocks of ``page`` on the content side of the minimum cut, one per line."""
    blocks, texts = read_page(page)
    return "\n".join(t for t, keep in zip(texts, label_blocks(blocks, texts, weights)) if keep)


def train(df: DataFrame, html_col: str = "html", train_pages: int = TRAIN_PAGES) -> tuple[float, ...]:
    """Weights of a logistic classifier for blocks, to which their containers' meaning is added.

    Labelled rows are the blocks of about ``train_pages`` pages (those that hash lowest) whose
    containers do say what they are. Sums for each combination of features, rounded, come to
    the driver; without both labels the weights are PRIOR.
    """
    pages = df.select(text_of(html_col).alias("html"))
    count = pages.count()
    share = min(1.0, train_pages / max(1, count))
    some = pages.where(F.pmod(F.xxhash64("html"), F.lit(1 << 20)) < share * (1 << 20))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in batch.column(0).to_pylist():
                rows = [(1 if seed(b) > 0 else -1, *(round(4 * x) for x in features(b, t)))
                        for b, t in zip(*read_page(page)) if seed(b)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in zip(*rows)], names=names)

    names = ["label", *(f"x{i}" for i in range(len(PRIOR)))]
    seen = some.mapInArrow(sample, ", ".join(f"{n} int" for n in names)).groupBy(*names).count().toArrow()
    label = seen["label"].to_numpy() > 0 if len(seen) else np.empty(0, bool)
    if not label.any() or label.all():
        return PRIOR
    x = np.stack([seen[n].to_numpy() / 4 for n in names[1:]], 1)
    n = seen["count"].to_numpy().astype(float)
    n /= np.where(label, n[label].sum(), n[~label].sum())
    weights, prior = np.array(PRIOR), np.array(PRIOR)
    for _ in range(25):  # Newton's steps; the ridge holds the weights near the prior
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (n * (label - p)) - 0.02 * (weights - prior)
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + 0.02 * np.eye(len(weights))
        weights = weights + np.linalg.solve(curve, slope)
    return tuple(np.clip(weights, -20, 20).tolist())


def extract_text(
    df: DataFrame, id_col: str = "page_id", html_col: str = "html", weights: tuple[float, ...] | None = None,
) -> DataFrame:
    """(id, text) per row: the page's main text, blocks in page order joined by a line feed.

    A page is cut into blocks of text at block elements. A block's classifier score plus a term for the
    customary meaning of its containers is its capacity towards source (content) or sink (boilerplate);
    names, elements and roles made for what is left out outweigh any score, hints do not; a named container
    that wraps the page's article or nearly all its prose, a page-wide form say, means nothing by
    its name (``settle_names``); hidden text stays out. Edges tie it to the next block, the weaker the farther apart they hang in the tree, and to the next one
    under the same grandparent; the minimum cut separates the two. Character references are decoded,
    white space becomes single spaces, and empty blocks go; scripts, styles and markup are never text.

    The classifier is fitted on ``df`` unless weights are given. A page is handled whole in one
    call, in time that grows with its length; nothing is shuffled but the classifier's sums.
    A null or empty page, and one without content, gives an empty text; repeated rows give
    repeated rows; an empty table gives none. Other columns are not read. An id may be a struct.
    """
    weights = weights or train(df, html_col)

    def open_task():
        return lambda pages: ([main_text(p, weights) for p in pages],)

    return per_row(df, {"id": F.col(id_col) if isinstance(id_col, str) else id_col, "html": text_of(html_col)}, "text string", open_task)
