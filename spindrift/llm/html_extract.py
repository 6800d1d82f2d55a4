"""Main text of web pages by a minimum cut.

A page is cut into blocks, the texts between block-level tags.  A classifier gives each
block the probability of being content; its costs, the negative logarithms, become the
capacities from the source (cost of calling the block boilerplate) and to the sink (cost of
calling it content).  Smoothness edges join blocks that follow each other, stronger the
closer they are in the DOM, and blocks that are the next one under the same parent.  The
minimum cut is the labelling with the least total cost; a maximum flow finds it exactly.

The classifier is a logistic regression over the text's shape (length, links, punctuation,
case, digits, neighbours), fitted in one task by Newton's method on the blocks of at most
``SAMPLE`` pages, those with the least hash of page_id, whose place says what they are:
inside article or main they are content, inside nav, footer, aside, header, form, menu or
elements with such a class or id they aren't.  The place itself is no feature, so pages
without such tags profit.  That sample is the only bounded thing here, and a parameter.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.shipping import ship

SAMPLE = 400
FOLLOW = 0.6
SIBLING = 0.8

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!(?!--)[^>]*>?|<\?[^>]*>?"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>?",
    re.S | re.I,
)
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
# elements whose content is skipped; without an end tag HTML gives the rest of the page to those of _RAW
_RAW = frozenset("script style textarea".split())
_SKIPPED = _RAW | frozenset("noscript template svg".split())
_IN_HEAD = frozenset("meta link base basefont bgsound script style noscript template title".split())
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in _SKIPPED | {"title"}}
_VOID = frozenset("hr br img input meta link".split())
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}}
_GOOD, _BAD = frozenset({"article", "main"}), frozenset({"nav", "footer", "aside", "header", "form", "menu"})
_MARK = re.compile(r"(?:class|id|role)\s*=\s*[\"']?[^\"'>]*\b(?:ads?|advert\w*|banner|sidebar|menu|nav\w*|footer|cookie\w*|breadcrumbs?|promo|share|social)\b", re.I)
_SPACE = re.compile(r"\s+")
_PUNCT = re.compile(r"[.,;:!?]")
_END = re.compile(r"[.!?…][\"'”’)]*$")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"\d")


def blocks(page: str) -> tuple[list[str], list[float], list[int], list[int], list[str], list[int]]:
    """Of each block: text, share of linked characters, parent element, place (1 content,
    0 boilerplate, -1 unknown) and tag; last, the parent of every element.

    The head ends at its end tag or at the first text or tag that can't be in it.  Skipped
    elements without end tag lose only their tag, but script, style and textarea take the
    rest of the page."""
    texts: list[str] = []
    links: list[float] = []
    owner: list[int] = []
    place: list[int] = []
    tags: list[str] = []
    parents, names, marks = [-1], ["#"], [-1]
    stack = [0]
    pieces: list[str] = []
    linked, linked_chars, at = 0, 0, 0
    in_head, endless = False, set()

    def flush():
        nonlocal linked_chars
        if pieces:
            text = _SPACE.sub(" ", html.unescape("".join(pieces))).strip()
            if text:
                texts.append(text)
                links.append(min(1.0, linked_chars / len(text)))
                owner.append(stack[-1])
                place.append(marks[stack[-1]])
                tags.append(names[stack[-1]])
            pieces.clear()
        linked_chars = 0

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            piece = page[at : m.start()]
            pieces.append(piece)
            if in_head and not piece.isspace():
                in_head = False
            if linked:
                linked_chars += len(piece)
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if name == "head":
            in_head = not m.group(1)
            continue
        if not m.group(1) and (name in _SKIPPED or in_head and name == "title") and not (name == "svg" and m.group().endswith("/>")):
            end = None if name in endless else _ENDS[name].search(page, at)
            if end:
                at = end.end()
            elif name in _RAW:
                at = len(page)
            else:
                endless.add(name)
        if in_head:
            if name in _IN_HEAD:
                continue
            in_head = False
        if name == "a":
            linked = 0 if m.group(1) else 1
        elif name in _BLOCK:
            flush()
            if m.group(1):
                for k in range(len(stack) - 1, 0, -1):
                    if names[stack[k]] == name:
                        del stack[k:]
                        break
            else:
                closes = _CLOSES.get(name)
                if closes:
                    while len(stack) > 1 and names[stack[-1]] in closes:
                        stack.pop()
                if name in _VOID:
                    continue
                mark = marks[stack[-1]]
                if name in _BAD or (m.group(3) and _MARK.search(m.group(3))):
                    mark = 0
                elif name in _GOOD and mark != 0:
                    mark = 1
                parents.append(stack[-1])
                names.append(name)
                marks.append(mark)
                stack.append(len(parents) - 1)
        elif name == "br":
            pieces.append("\n")
    if at < len(page):
        pieces.append(page[at:])
    flush()
    return texts, links, owner, place, tags, parents


FEATURES = 11


def features(texts: list[str], links: list[float], tags: list[str]) -> np.ndarray:
    n = len(texts)
    out = np.zeros((n, FEATURES))
    words = [t.count(" ") + 1 for t in texts]
    for i, t in enumerate(texts):
        size = len(t)
        w = words[i]
        out[i] = (
            1.0,
            math.log1p(w),
            links[i],
            min(size / w, 30.0) / 10,
            len(_PUNCT.findall(t)) / w,
            1.0 if _END.search(t) else 0.0,
            len(_UPPER.findall(t)) / size,
            len(_DIGIT.findall(t)) / size,
            1.0 if len(tags[i]) == 2 and tags[i][0] == "h" else 0.0,
            math.log1p(words[i - 1]) if i else 0.0,
            math.log1p(words[i + 1]) if i + 1 < n else 0.0,
        )
    return out


DEFAULT = np.array([-2.0, 0.9, -4.0, 0.0, 2.0, 0.5, -2.0, -2.0, 0.5, 0.2, 0.2])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by damped Newton steps; ``DEFAULT`` without both classes."""
    if len(np.unique(y)) < 2:
        return DEFAULT
    w = np.zeros(x.shape[1])
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut.

    ``edges`` are undirected.  Flow through single nodes is taken first; what is left of
    the terminals is joined by Dinic's algorithm.  Nodes that could be on either side are
    on the sink's.
    """
    n = len(source)
    rest = [a - b for a, b in zip(source, sink)]
    to: list[int] = []
    cap: list[float] = []
    near: list[list[int]] = [[] for _ in range(n)]
    for u, v, c in edges:
        near[u].append(len(to))
        to.append(v)
        cap.append(c)
        near[v].append(len(to))
        to.append(u)
        cap.append(c)
    eps = 1e-9
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if rest[i] > eps)
        for i in queue:
            level[i] = 0
        reached = False
        while queue:
            u = queue.popleft()
            if rest[u] < -eps:
                reached = True
                continue
            for e in near[u]:
                v = to[e]
                if cap[e] > eps and level[v] < 0:
                    level[v] = level[u] + 1
                    queue.append(v)
        if not reached:
            return [lv >= 0 for lv in level]
        turn = [0] * n
        for s in range(n):
            while rest[s] > eps:
                path: list[int] = []
                u = s
                while True:
                    if rest[u] < -eps:
                        flow = min(rest[s], -rest[u], min((cap[e] for e in path), default=math.inf))
                        for e in path:
                            cap[e] -= flow
                            cap[e ^ 1] += flow
                        rest[s] -= flow
                        rest[u] += flow
                        break
                    while turn[u] < len(near[u]):
                        e = near[u][turn[u]]
                        if cap[e] > eps and level[to[e]] == level[u] + 1:
                            break
                        turn[u] += 1
                    if turn[u] < len(near[u]):
                        path.append(near[u][turn[u]])
                        u = to[path[-1]]
                    elif path:
                        e = path.pop()
                        u = to[e ^ 1]
                        turn[u] += 1
                    else:
                        u = -1
                        break
                if u < 0:
                    break


def edges(owner: list[int], parents: list[int]) -> list[tuple[int, int, float]]:
    """Smoothness: blocks in a row, by their distance in the DOM, and next siblings."""
    depth = [0] * len(parents)
    for e in range(1, len(parents)):
        depth[e] = depth[parents[e]] + 1
    out, last = [], {}
    for i, a in enumerate(owner):
        if i:
            u, v = owner[i - 1], a
            steps = 0
            while u != v:
                if depth[u] >= depth[v]:
                    u = parents[u]
                else:
                    v = parents[v]
                steps += 1
            out.append((i - 1, i, FOLLOW / (1 + steps)))
        group = parents[a]
        if group in last:
            out.append((last[group], i, SIBLING))
        last[group] = i
    return out


def extract(page: str, w: np.ndarray) -> tuple[str, int, int]:
    """Content text, blocks and content blocks of a page."""
    texts, links, owner, _, tags, parents = blocks(page)
    if not texts:
        return "", 0, 0
    z = np.clip(features(texts, links, tags) @ w, -30, 30)
    lose, gain = np.log1p(np.exp(z)).tolist(), np.log1p(np.exp(-z)).tolist()
    inside = min_cut(lose, gain, edges(owner, parents))
    kept = [t for t, k in zip(texts, inside) if k]
    return "\n".join(kept), len(texts), len(kept)


def trained(pages: DataFrame, *, sample: int = SAMPLE) -> np.ndarray:
    """Weights fitted on the pages with the ``sample`` least hashes of page_id."""
    ship(pages.sparkSession)
    picked = pages.where("html is not null and page_id is not null").select("page_id", F.xxhash64("page_id").alias("h"), F.col("html").cast("string").alias("html")).orderBy("h", "page_id", "html").limit(sample)

    def run(batches):
        xs, ys = [np.zeros((0, FEATURES))], [np.zeros(0)]
        for batch in batches:
            for page in sorted(batch.column(0).to_pylist()):
                texts, links, _, place, tags, _ = blocks(page)
                if texts:
                    known = np.array(place) >= 0
                    xs.append(features(texts, links, tags)[known])
                    ys.append(np.array(place, float)[known])
        yield pa.RecordBatch.from_arrays([pa.array([fit(np.concatenate(xs), np.concatenate(ys)).tolist()])], names=["w"])

    got = picked.select("html").coalesce(1).mapInArrow(run, "w array<double>").collect()
    return np.array(got[0]["w"]) if got else DEFAULT


def extracted(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """(page_id, text, n_blocks, n_content): every page's content blocks, one a line.

    A null or empty page has empty text and no blocks.  Pages of any length are cut whole.
    Blocks with equal costs on both sides of the cut count as boilerplate.  Rows without
    page_id are kept, repeated rows are done each.  Other columns are not looked at.  An
    empty table gives an empty result.
    """
    ship(pages.sparkSession)
    w = trained(pages) if weights is None else weights
    pages = pages.select(F.col("page_id"), F.col("html").cast("string").alias("html"))
    key = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            got = [extract(p or "", w) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32())],
                names=["page_id", "text", "n_blocks", "n_content"],
            )

    return pages.mapInArrow(run, f"page_id {key}, text string, n_blocks int, n_content int")
