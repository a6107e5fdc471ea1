"""Main text of web pages by minimum cuts.

A page is read into blocks: runs of text between block-level tags, with the containers that they stand in. A logistic
classifier of block features gives each block a cost of being called content and one of being called boilerplate; they
become the capacities of its edges to the two terminals. Smoothness edges join blocks that follow each other and blocks
that share a container, the stronger the nearer their lowest common container is. A maximum flow finds the cheapest
labelling, which parts content from boilerplate.

The classifier is a logistic model, trained here from pages that mark their parts by name (article, main against nav,
aside, footer and the like): such blocks are labels for the features that aren't names. It stays near its prior weights,
the fixed values below, as far as a bounded sample of ``SAMPLE`` pages gives no reason to move. Scripts, styles,
comments, forms' controls and other parts that are never text are dropped when the page is read.

Defined results: null or empty html is a page without text; a page without a block of content has an empty text and
length 0; unclosed and misnested tags end with the container around them; repeated rows are read each; an empty table
gives an empty result; other columns are ignored.
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

from stumpline.llm.cluster import hashed_sample, ship

SAMPLE = 2_000

# Tags that begin a block of text, tags without text, and names of containers.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SILENT_TAGS = frozenset("script style head noscript template svg math iframe object canvas select textarea button audio video map".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SELF_CLOSING = {
    "p": frozenset(("p",)), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")),
    "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",)),
}
CONTENT_NAMES = re.compile(r"\b(article|main|content|post|story|entry|body-?text|prose)\b")
BOILERPLATE_NAMES = re.compile(
    r"\b(nav|navbar|navigation|menu|header|masthead|banner|footer|foot|sidebar|aside|related|recommend\w*|promo\w*|ads?|advert\w*|sponsor\w*|cookies?|consent|"
    r"notice|alert|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|breadcrumbs?|pagination|pager|tags?|toolbar|copyright|legal|"
    r"comments?|comment-?\w*|disqus|replies|reply|discussion|widget|skip|search|form)\b"
)
CONTENT_TAGS = frozenset(("article", "main"))
BOILERPLATE_TAGS = frozenset(("nav", "aside", "footer", "form", "menu", "dialog", "fieldset", "label"))
COMMENT_NAMES = re.compile(r"\b(comments?|comment-?\w*|disqus|replies|reply|discussion|respond)\b")

FEATURES = (
    "bias", "in_content_tag", "in_boilerplate_tag", "content_name", "boilerplate_name", "page_header", "words", "links", "all_links", "list", "sentence", "heading",
    "heads_page", "content_name_below", "boilerplate_below",
)
# Prior weights, in log-odds of being content.
PRIOR = np.array([-1.5, 5.0, -7.0, 2.5, -6.0, -5.0, 1.5, -2.0, -1.5, -0.5, 1.0, 0.5, -0.5, 1.0, -7.0])
#: The names of containers are the labels; what is learned is what the other features say.
LEARNED = np.array([n in ("bias", "words", "links", "all_links", "list", "sentence", "heading", "heads_page") for n in FEATURES])
# Prefixes of names that describe a layout rather than a part of the page.
LAYOUT_PREFIXES = ("with-", "has-", "no-")
STIFFNESS = 200.0
FOLLOWING, SHARED = 0.4, 0.8

_PART = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role|aria-label|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORD = re.compile(r"\w+")


@dataclass(slots=True)
class Container:
    tag: str
    parent: Container | None
    depth: int
    content_tag: bool
    boilerplate_tag: bool
    content_name: bool
    boilerplate_name: bool
    header: bool
    boilerplate_below: bool  # a boilerplate part within a content part


@dataclass(slots=True)
class Block:
    text: str
    within: Container
    linked: int  # characters within links


def _names(tag: str, attributes: str) -> str:
    """Class, id and role names that say what a container holds.

    Names on html and body describe the page's layout (``has-sidebar``, ``with-comments``, ``no-js``), not a part of it,
    and so do names that begin with a layout prefix anywhere: neither counts.
    """
    if not attributes or tag in ("html", "body"):
        return ""
    words = " ".join(x.strip("\"'") for x in _ATTRIBUTE.findall(attributes)).lower().replace("_", "-").split()
    return " ".join(w for w in words if not w.startswith(LAYOUT_PREFIXES))


def _opened(tag: str, attributes: str, parent: Container) -> Container:
    names = _names(tag, attributes)
    content = bool(names and CONTENT_NAMES.search(names))
    comment = bool(names and COMMENT_NAMES.search(names))
    boilerplate = bool(names and tag not in CONTENT_TAGS and BOILERPLATE_NAMES.search(names)) or comment
    is_content, is_boilerplate = tag in CONTENT_TAGS and not comment, tag in BOILERPLATE_TAGS
    header = tag == "header"
    inside = parent.content_tag or parent.content_name
    # a content tag starts afresh: boilerplate names of the wrappers around it don't reach into it
    inherited = parent.boilerplate_name and not is_content
    return Container(
        tag, parent, parent.depth + 1, parent.content_tag or is_content, parent.boilerplate_tag or is_boilerplate, parent.content_name or content,
        inherited or boilerplate, parent.header or header, parent.boilerplate_below or (inside and (is_boilerplate or header or boilerplate)) or comment,
    )


def blocks_of(page: str) -> list[Block]:
    """Runs of text between block-level tags, in page order."""
    root = Container("", None, 0, False, False, False, False, False, False)
    here, stack, blocks = root, [], []
    text: list[str] = []
    linked = links = 0
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal text, linked
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            if words:
                blocks.append(Block(words, here, linked))
            text, linked = [], 0

    while at < n:
        m = _PART.match(page, at)
        if m is None:  # a "<" whose tag never ends
            text.append(page[at])
            at += 1
            continue
        at = m.end()
        if (run := m[3]) is not None:
            text.append(run)
            if links:
                linked += len(run)
            continue
        if (tag := m[1]) is None:
            continue
        tag = tag.lower()
        closing = page[m.start() + 1] == "/"
        if tag in SILENT_TAGS and not closing:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else (n if tag in ("script", "style", "textarea", "template", "svg") else at)
            text.append(" ")
        elif tag == "br" or tag in ("img", "input", "wbr") and tag not in BLOCK_TAGS:
            text.append(" " if tag == "br" else "")
        elif tag == "a":
            links = 0 if closing else 1
        elif tag in BLOCK_TAGS:
            flush()
            links = 0
            if tag == "hr":
                continue
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
            else:
                ends = SELF_CLOSING.get(tag)
                if ends and stack and stack[-1].tag in ends:
                    stack.pop()
                stack.append(_opened(tag, m[2], stack[-1] if stack else root))
            here = stack[-1] if stack else root
        elif tag in ("label", "option", "output") and not closing:
            flush()
            stack.append(_opened("label", m[2], stack[-1] if stack else root))
            here = stack[-1]
        elif tag in ("label", "option", "output"):
            flush()
            if stack and stack[-1].tag == "label":
                stack.pop()
            here = stack[-1] if stack else root
    flush()
    return blocks


def described(blocks: list[Block]) -> np.ndarray:
    """The features of every block."""
    rows = []
    seen_content = False
    for b in blocks:
        c, n = b.within, len(b.text)
        words = b.text.count(" ") + 1
        share = min(1.0, b.linked / n)
        heading = c.tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        seen_content = seen_content or c.content_tag or c.content_name
        rows.append(
            (
                1.0, c.content_tag, c.boilerplate_tag, c.content_name, c.boilerplate_name, c.header and not c.content_tag, min(1.0, words / 25), share, share > 0.9,
                c.tag in ("li", "dt", "dd"), b.text[-1] in ".!?…:;\"'»”" or b.text[-1] == ".", heading, heading and not seen_content, c.content_name and not c.content_tag,
                c.boilerplate_below,
            )
        )
    return np.array(rows, float).reshape(-1, len(FEATURES))


# The cut.


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness: each block with the next one, and with the next one of its container where others stand between."""
    found = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        container = b.within.parent or b.within
        if i:
            found.append((i - 1, i, FOLLOWING / (1 + _apart(blocks[i - 1].within, b.within))))
        before = last.get(id(container))
        if before is not None:
            found.append((before, i, SHARED))
        last[id(container)] = i
    return found


def _apart(a: Container, b: Container) -> int:
    """Containers to leave and to enter from one to the other."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def minimum_cut(content: np.ndarray, boilerplate: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Labels (True: content) that cost least: ``content[i]`` for calling i content, ``boilerplate[i]`` for the other,
    and an edge's weight where its ends differ. The flow runs from the content terminal to the boilerplate one, along
    shortest ways with room left, level by level."""
    n = len(content)
    push = np.minimum(content, boilerplate)
    out = (boilerplate - push).tolist()  # room from the content terminal: lost if i is called boilerplate
    into = (content - push).tolist()
    near: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[float] = []
    for a, b, w in edges:
        near[a].append(len(to))
        near[b].append(len(to) + 1)
        to += [b, a]
        room += [w, w]
    tiny = 1e-12
    while True:
        level = [-1] * n
        queue = [i for i in range(n) if out[i] > tiny]
        for i in queue:
            level[i] = 0
        found = False
        for i in queue:
            found = found or into[i] > tiny
            for e in near[i]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if not found:
            return np.array([x >= 0 for x in level], bool)
        next_edge = [0] * n
        for source in [i for i in range(n) if level[i] == 0]:
            path: list[int] = []
            i = source
            while out[source] > tiny:
                if into[i] > tiny:
                    flow = min([out[source], into[i], *(room[e] for e in path)])
                    out[source] -= flow
                    into[i] -= flow
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    path, i = [], source
                    continue
                while next_edge[i] < len(near[i]):
                    e = near[i][next_edge[i]]
                    if room[e] > tiny and level[to[e]] == level[i] + 1:
                        break
                    next_edge[i] += 1
                else:
                    if not path:
                        break
                    e = path.pop()
                    i = to[e ^ 1]
                    next_edge[i] += 1
                    continue
                path.append(e)
                i = to[e]


def labels_of(blocks: list[Block], weights: np.ndarray) -> np.ndarray:
    odds = described(blocks) @ weights
    cost = np.logaddexp(0, -odds), np.logaddexp(0, odds)
    return minimum_cut(*cost, edges_of(blocks))


def main_text(page: str | None, weights: np.ndarray = PRIOR) -> str:
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    return "\n".join(b.text for b, content in zip(blocks, labels_of(blocks, weights), strict=True) if content)


def trained(features: np.ndarray, labels: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Weights that fit the labelled blocks and stay near the prior: only those of features that aren't names move."""
    weights = PRIOR.copy()
    if not len(labels) or labels.all() or not labels.any():
        return weights
    x = features[:, LEARNED]
    fixed = features[:, ~LEARNED] @ PRIOR[~LEARNED]
    balance = np.where(labels, 0.5 / labels.sum(), 0.5 / (~labels).sum())
    stiff = STIFFNESS / (STIFFNESS + len(labels))
    move = np.zeros(x.shape[1])
    for _ in range(rounds):
        odds = np.clip(x @ (PRIOR[LEARNED] + move) + fixed, -30, 30)
        slope = x.T @ ((1 / (1 + np.exp(-odds)) - labels) * balance) + stiff * move
        move -= 0.5 / (0.25 * x.shape[1] + stiff) * slope
    weights[LEARNED] += move
    return weights


# The Spark side.

_DESCRIBED = "features array<double>, label boolean"


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each of a page's kinds of marked block: the mean of its features."""
    for batch in batches:
        rows, labels = [], []
        for page in batch.column("html").to_pylist():
            blocks = blocks_of(page or "")
            if not blocks:
                continue
            x = described(blocks)
            content = (x[:, 1] > 0) & (x[:, 2] == 0) & (x[:, 14] == 0)
            boilerplate = (x[:, 1] == 0) & (x[:, 2] > 0)
            for label, mask in ((True, content), (False, boilerplate)):
                if mask.any():
                    rows.append(x[mask].mean(0).tolist())
                    labels.append(label)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.bool_())], ["features", "label"])


def fitted(pages: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights from at most ``sample`` pages, those whose url's hash is least."""
    ship(pages.sparkSession)
    chosen = hashed_sample(pages, sample, "url", "page_id").select(F.col("html").cast("string").alias("html"))
    got = chosen.mapInArrow(_described, _DESCRIBED).collect()  # two rows a page
    return trained(np.array([r["features"] for r in got], float).reshape(-1, len(FEATURES)), np.array([r["label"] for r in got], bool))


def extracted(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    ship(pages.sparkSession)
    weights = fitted(pages) if weights is None else weights

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                rows = batch.slice(low, 256)
                texts = [main_text(page, weights) for page in rows.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
                )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
