"""Main text of web pages: blocks are told from boilerplate by a minimum cut."""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewarden.llm.page_blocks import Block, Element, blocks
from pricewarden.llm.pieces import sliced

# Costs of a label against what the page says about a block, in nats.
SAYS_CONTENT = 4.0  # inside an element that says it is the article
SAYS_OTHER = 8.0  # inside one that says it is something else: menus, adverts, comments, sidebars, ...
GOOD_NAME = 1.0  # inside one whose class or id speaks of content
PRIOR = 0.25  # for content, where nothing else is known
MOST_LEARNED = 2.5  # the most that the learned features weigh together
SMOOTH = 0.8  # of two neighbours with one parent; falls with the distance in the tree

WORD_STEPS = (3, 8, 16, 40)
LINK_STEPS = (0.0, 0.2, 0.6)
STOPS = tuple(".!?…:;。！？")


def features(block: Block) -> tuple[tuple[str, int], ...]:
    """What is learned about: length in words, share of linked text, end of a sentence, commas, kind of element."""
    words = block.text.count(" ") + 1
    name = block.name
    kind = 1 if name[0] == "h" and name[1:].isdigit() else 2 if name in ("p", "blockquote", "pre") else 3 if name in ("li", "dd", "dt") else 4 if name in ("td", "th") else 0
    return (
        ("words", sum(words > s for s in WORD_STEPS)), ("links", sum(block.links / len(block.text) > s for s in LINK_STEPS)),
        ("ends", int(block.text.endswith(STOPS))), ("commas", min(2, block.text.count(","))), ("kind", kind),
    )


def says(block: Block) -> tuple[bool, bool, bool]:
    """Whether elements around a block say it is the article, say it is something else, or have a name of content.

    A name, a header or a form around the article itself says nothing.
    """
    way, element = [], block.element
    while element is not None and element.said is None:
        way.append(element)
        element = element.parent
    content, other, good = element.said if element is not None else (False, False, False)
    for element in reversed(way):
        content |= element.content and not element.frame
        other |= element.other or (element.frame and not element.holds)
        good |= element.good
        element.said = content, other, good
    return content, other, good


def costs(found: list[Block], weights: dict[tuple[str, int], float]) -> list[float]:
    """What labelling each block as boilerplate costs above labelling it as content."""
    out = []
    for block in found:
        content, other, good = says(block)
        learned = sum(weights.get(f, 0.0) for f in features(block))
        learned = max(-MOST_LEARNED, min(MOST_LEARNED, learned))
        out.append(PRIOR + learned + SAYS_CONTENT * content - SAYS_OTHER * other + GOOD_NAME * good)
    return out


def _distance(a: Element, b: Element) -> int:
    """Steps from one element to the other through the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth and a.parent is not None:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def links(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours in the page, and the next block of the same parent when others stand between."""
    out, last = [], {}
    for i, block in enumerate(found):
        if i:
            out.append((i - 1, i, SMOOTH * 2 / (2 + _distance(found[i - 1].element, block.element))))
        parent = id(block.element.parent)
        if last.get(parent, i - 1) != i - 1:
            out.append((last[parent], i, SMOOTH * 2 / (2 + _distance(found[last[parent]].element, block.element))))
        last[parent] = i
    return out


def _cut(cost: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Blocks on the source side of the minimum cut of a graph with a source, a sink and the given edges (Dinic's maximum flow)."""
    n = len(cost)
    source, sink = n, n + 1
    to, room, out = [], [], [[] for _ in range(n + 2)]

    def edge(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((forth, back))

    for i, c in enumerate(cost):
        if c > 0:
            edge(source, i, c, 0.0)
        elif c < 0:
            edge(i, sink, -c, 0.0)
    for a, b, w in edges:
        edge(a, b, w, w)
    least = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > least and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        place = [0] * (n + 2)
        path: list[int] = []
        at = source
        while True:
            if at == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                path, at = [], source
                continue
            while place[at] < len(out[at]):
                e = out[at][place[at]]
                if room[e] > least and level[to[e]] == level[at] + 1:
                    break
                place[at] += 1
            if place[at] < len(out[at]):
                path.append(out[at][place[at]])
                at = to[path[-1]]
            elif path:
                e = path.pop()
                at = to[e ^ 1]
                place[at] += 1
            else:
                break


def label(cost: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Content or not, at the least sum of costs of labels and of edges between unlike labels; of equal cuts the one with least content.

    A block whose own cost outweighs all its edges is settled; its edges then count for its neighbours. What is left goes
    to the maximum flow.
    """
    n = len(cost)
    cost, near = list(cost), [[] for _ in range(n)]
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    room = [sum(w for _, w in own) for own in near]
    settled: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if settled[i] is not None or -room[i] < cost[i] <= room[i] + 1e-12:
            continue
        settled[i] = cost[i] > 0
        for j, w in near[i]:
            if settled[j] is None:
                cost[j] += w if settled[i] else -w
                room[j] -= w
                queue.append(j)
    rest = [i for i in range(n) if settled[i] is None]
    if rest:
        number = {i: k for k, i in enumerate(rest)}
        inner = [(number[a], number[b], w) for a, b, w in edges if a in number and b in number]
        for i, side in zip(rest, _cut([cost[i] for i in rest], inner), strict=True):
            settled[i] = side
    return [bool(s) for s in settled]


def _observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of blocks about which the page itself speaks, counted by what it says."""
    counts: Counter = Counter()
    for batch in batches:
        for html in batch.column("html"):
            for block in blocks(html.as_py()):
                content, other, _ = says(block)
                if content or other:
                    counts.update((*f, other) for f in features(block))
    rows = sorted(counts.items())
    names = ["feature", "step", "other", "n"]
    kinds = [pa.string(), pa.int32(), pa.bool_(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array([(*k, n)[i] for k, n in rows], t) for i, t in enumerate(kinds)], names)


def learn_weights(pages: DataFrame) -> dict[tuple[str, int], float]:
    """Log-odds of content by feature, from the blocks of all pages that stand inside an article, menu, footer and the like.

    One pass; the driver sees one number for each step of each feature and label, some forty.
    """
    found = pages.mapInArrow(_observed, "feature string, step int, other boolean, n long").groupBy("feature", "step", "other").agg(F.sum("n").alias("n")).collect()
    counts = {(r.feature, r.step, r.other): r.n for r in found}
    total = Counter()
    for (feature, _, other), n in counts.items():
        total[feature, other] += n
    share = lambda f, s, other: (counts.get((f, s, other), 0) + 1) / (total[f, other] + 6)
    return {(f, s): math.log(share(f, s, False) / share(f, s, True)) for f, s, _ in counts}


def _extracted(batches: Iterator[pa.RecordBatch], weights: dict[tuple[str, int], float]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in sliced(batch, "html"):
            texts, many, kept = [], [], []
            for html in part.column("html").to_pylist():
                found = blocks(html)
                labels = label(costs(found, weights), links(found))
                texts.append(" ".join(b.text for b, own in zip(found, labels, strict=True) if own))
                many.append(len(found))
                kept.append(sum(labels))
            columns = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(many, pa.int64()), pa.array(kept, pa.int64())], ["page_id", "url", "text", "n_chars", "n_blocks", "n_content"])


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars, n_blocks, n_content.

    A page becomes a graph of its blocks. Terminal capacities come from a classifier: what the elements around a block say, and
    weights of text features learned from the blocks of all pages about which their page speaks. Neighbouring blocks, and
    blocks of one parent, are joined by edges that weaken with their distance in the tree. The minimum cut labels them; the
    text of content blocks is joined in page order. Two passes over the pages, no shuffle of texts.

    Null or empty html, and pages without text: an empty text. Null id or url: kept. Repeated rows: each for itself. An empty
    table gives an empty table. Further columns are not read.
    """
    source = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"))
    weights = learn_weights(source.select("html"))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    schema = f"page_id {kinds['page_id']}, url string, text string, n_chars long, n_blocks long, n_content long"
    return source.mapInArrow(lambda it: _extracted(it, weights), schema)
