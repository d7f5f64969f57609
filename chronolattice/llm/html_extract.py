"""HTML extraction by minimum cut.

A page is cut into blocks at its block-level tags. A logistic classifier, fitted on the labelled pages of
``html_lessons``, turns each block's features (the elements it stands in, their class and id words, share of link text,
length, sentence marks) into log odds: the capacity to one of the two terminals. Neighbouring blocks, and blocks near
each other in the element tree, are joined by smoothness edges, whose strength is the one that labels the blocks of
further lessons best. The maximum flow's minimum cut is the labelling of least total cost; of equal cuts, the one
that calls the fewest blocks content.

What is never text: markup, comments, scripts, styles, templates, heads, and form controls.

Defined results: null or empty html gives empty text; unclosed or misnested tags close with the element that ends around
them; a page of plain text is one block; repeated rows each give a row; other columns are passed over; an empty table gives
an empty result.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, deque
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolattice.llm.html_lessons import lesson

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(/?)>", re.S)
#: Fixed values of HTML: elements whose content is raw or never shown, that have no content, and that begin a block.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript iframe object svg math canvas select option datalist textarea button input noembed noframes audio video map dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
SECTION = frozenset("article aside body div footer form header main nav section table ul ol dl fieldset".split())
#: An opening tag that ends open elements of these names (a p ends at any block).
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Where a search for an open p, or for an open element of CLOSES, ends.
HOLDS_P = SECTION | frozenset(("li", "td", "th", "dd", "blockquote", "figure", "details"))
HOLDS_ITEM = frozenset(("ul", "ol", "dl", "table", "menu", "select"))
ITEMS = frozenset(x for names in CLOSES.values() for x in names)
#: Words in a class, id or role that are features, and groups of elements that are.
AGAINST = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion comment comments reply replies discussion disqus respond sidebar side aside rail widget related recommended recommendations menu nav navbar navigation navigational breadcrumb breadcrumbs footer foot header masthead cookie cookies consent gdpr notice notices alert warning popup modal overlay newsletter subscribe subscription signup login share sharing social toolbar tags pagination pager copyright legal disclaimer form search skip".split())
FOR = frozenset("article content contents main body story post entry text prose maincontent articlebody".split())
GROUPS = (("nav", "menu"), ("footer",), ("aside",), ("form", "fieldset"), ("article",), ("main",), ("header",))
GOOD = 1 << 4 | 1 << 5 | 1 << 8  # article, main and words that speak for
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
SPACES = re.compile(r"\s+")
WORD = re.compile(r"[a-z]+")


class Node:
    """An open element, and what holds for all inside it: groups and cue words around (a bit each; what speaks against
    ends what speaks for further out), the section it is in, the open p and list items that a tag would end."""

    __slots__ = ("name", "parent", "around", "hidden", "link", "home", "p", "items")

    def __init__(self, name: str, parent: Node | None, attributes: str = ""):
        self.name, self.parent = name, parent
        self.hidden = bool(parent and parent.hidden) or name in HIDDEN
        self.link = bool(parent and parent.link) or name == "a"
        self.home = self if name in SECTION or not parent else parent.home
        self.p = self if name == "p" else None if name in HOLDS_P or not parent else parent.p
        self.items = {} if name in HOLDS_ITEM or not parent else parent.items
        if name in ITEMS:
            self.items = self.items | {name: self}
        around = parent.around if parent else 0
        own = name == "header" and around & GOOD  # a header inside an article is the article's own
        for i, names in enumerate(GROUPS):
            if name in names and not own:
                around = around | 1 << i if 1 << i & GOOD else around & ~GOOD | 1 << i
        if attributes and ("=" in attributes or "hidden" in attributes):
            found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(attributes)}
            if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
                self.hidden = True
            tokens = set(WORD.findall(" ".join(found.get(k, "") for k in ("class", "id", "role"))))
            if tokens & AGAINST and not own:
                around = around & ~GOOD | 1 << 7
            elif tokens & FOR:
                around |= 1 << 8
        self.around = around


def parse(html: str) -> list[tuple[str, Node, int]]:
    """Blocks in page order: (text, the element it begins in, characters of it that are link text)."""
    root = node = Node("html", None)
    out: list[tuple[str, Node, int]] = []
    buffer: list[str] = []
    home, linked = root, 0

    def flush() -> None:
        nonlocal buffer, linked
        if buffer:
            text = SPACES.sub(" ", entities.unescape("".join(buffer))).strip()
            if text:
                out.append((text, home, linked))
        buffer, linked = [], 0

    def say(raw: str) -> None:
        nonlocal home, linked
        if raw and not node.hidden:
            if not buffer or not any(x.strip() for x in buffer):
                home = node
            buffer.append(raw)
            if node.link:
                linked += len(raw.strip())

    count = Counter()  # open elements by name, so that a stray closing tag costs nothing

    def close(x: Node) -> None:
        nonlocal node
        while node is not x.parent:
            count[node.name] -= 1
            node = node.parent

    # past the last > there is no tag, so nothing that looks like the beginning of one is followed to the end of the page
    at, n, last = 0, len(html), html.rfind(">")
    while at < n:
        m = TOKEN.search(html, at) if at <= last or html.find("<!--", at) >= 0 else None
        if not m:
            say(html[at:])
            break
        say(html[at : m.start()])
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:  # a closing tag ends the nearest open element of its name, and all inside
            if name in BLOCK:
                flush()
            if count[name]:
                x = node
                while x.name != name:
                    x = x.parent
                close(x)
            continue
        if name == "html":
            continue
        if name in BLOCK:
            flush()
            if node.p:
                close(node.p)
        for ended in CLOSES.get(name, ()):
            if ended in node.items:
                close(node.items[ended])
        if name == "br":
            say(" ")
        if name in VOID:
            continue
        if name == "body":
            while node.name == "head" or (node.parent and node.parent.name == "head"):
                close(node)
        if m[4]:
            continue
        node = Node(name, node, m[3])
        count[name] += 1
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = end.end() if end else n
            close(node)
    flush()
    return out


def features(text: str, node: Node, linked: int) -> list[float]:
    n = len(text)
    density = min(1.0, linked / n)
    marks = min(3, sum(map(text.count, ".!?;,"))) / 3
    x = [1.0, math.log1p(n) - 3.2, density, marks, float(node.name in HEADING), float(node.name in ("p", "blockquote", "pre", "b", "i", "em", "strong")), float(node.name == "li"), float(n < 30 and text[-1] not in ".!?")]
    return x + [float(node.around >> i & 1) for i in range(len(GROUPS) + 2)]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 25) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


#: Lessons that weights are fitted on, and further ones that choose the strength of smoothness.
LESSONS, CHOICE, STRENGTHS = range(300), range(300, 450), (0.0, 0.5, 1.0, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0)


@lru_cache(1)
def model() -> tuple[tuple[float, ...], float]:
    """(weights, strength of smoothness); the same in every run."""
    rows, truth = [], []
    for i in LESSONS:
        page, content = lesson(i)
        for b in parse(page):
            rows.append(features(*b))
            truth.append(b[0] in content)
    w = tuple(round(v, 6) for v in fit(np.array(rows), np.array(truth, float)).tolist())
    pages = [(parse(p), c) for p, c in map(lesson, CHOICE)]
    wrong = [sum(k != (b[0] in c) for found, c in pages for b, k in zip(found, label(found, (w, s)), strict=True)) for s in STRENGTHS]
    return w, STRENGTHS[wrong.index(min(wrong))]


def minimum_cut(gain: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Labels of least total cost. gain: capacity to the content terminal less that to the other; edges: (i, j, cost of
    labelling them differently). Blocking flows along shortest paths, kept in flat lists."""
    n = len(gain)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(i: int, j: int, c: int, back: int) -> None:
        out[i].append(len(to))
        to.append(j)
        cap.append(c)
        out[j].append(len(to))
        to.append(i)
        cap.append(back)

    for i, x in enumerate(gain):
        if x > 0:
            add(s, i, x, 0)
        elif x < 0:
            add(i, t, -x, 0)
    for i, j, c in edges:
        add(i, j, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            i = queue.popleft()
            for e in out[i]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        seen = [0] * (n + 2)
        path: list[int] = []
        i = s
        while True:
            if i == t:
                least = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= least
                    cap[e ^ 1] += least
                k = next(k for k, e in enumerate(path) if not cap[e])
                i = to[path[k] ^ 1]
                del path[k:]
                continue
            while seen[i] < len(out[i]):
                e = out[i][seen[i]]
                if cap[e] and level[to[e]] == level[i] + 1:
                    break
                seen[i] += 1
            if seen[i] < len(out[i]):
                path.append(out[i][seen[i]])
                i = to[path[-1]]
            elif i == s:
                break
            else:
                level[i] = -1
                i = to[path.pop() ^ 1]


def label(blocks: list[tuple[str, Node, int]], fitted: tuple[Sequence[float], float] | None = None) -> list[bool]:
    """True for content."""
    weights, strength = fitted or model()
    unit = 1000
    gain = [round(unit * sum(map(float.__mul__, features(*b), weights))) for b in blocks]
    full, edges, last_of = round(unit * strength), [], {}
    home = [b[1].home for b in blocks]
    for i in range(len(blocks)):
        if i:  # neighbours in the page, less if in other sections
            edges.append((i - 1, i, full if home[i] is home[i - 1] else full // 10))
        key = id(home[i])
        j = last_of.get(key)
        if j is not None and j < i - 1:  # near in the tree: the section's block before
            edges.append((j, i, full * 2 // 3))
        last_of[key] = i
    return minimum_cut(gain, [e for e in edges if e[2]])


def extract(html: str | None, fitted: tuple[Sequence[float], float] | None = None) -> str:
    """The main text of a page."""
    found = parse(html) if html else []
    return "\n\n".join(b[0] for b, keep in zip(found, label(found, fitted), strict=True) if keep) if found else ""


def extract_pages(pages: DataFrame, *, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` with text, n_chars, n_blocks and n_kept of every page."""
    fields = [f for c in keep for f in pages.schema if f.name == c]
    fitted = model()
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["text string, n_chars long, n_blocks int, n_kept int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n, kept = [], [], []
            for x in batch.column(0):
                found = parse(x.as_py() or "")
                on = label(found, fitted) if found else []
                texts.append("\n\n".join(b[0] for b, k in zip(found, on, strict=True) if k))
                n.append(len(found))
                kept.append(sum(on))
            cols = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int32()), pa.array(kept, pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(1 + i) for i in range(len(keep))] + cols, [*keep, "text", "n_chars", "n_blocks", "n_kept"])

    return pages.select(F.col(html).alias("__h"), *keep).mapInArrow(run, out)
