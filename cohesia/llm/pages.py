"""Main text of web pages by a tree-structured graphical model over DOM nodes.

Nodes are block elements and runs of text between block boundaries. A node wraps main text, belongs to it or is
off it; it has an emission probability for its features (tag, words of class, id and role, shape of a text) and a
transition probability from its parent's state. Sum-product messages go from the leaves up and from the root down;
a run of text is kept if its marginal of main text is over one half. All tables are counted from labelled pages.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .seed_pages import PAGES

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|data-main|data-off)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
# Elements of HTML: fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
NEVER = frozenset("head script style noscript template iframe svg form select textarea input option title".split())
BLOCK = frozenset("html body address article aside blockquote center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption legend dialog head svg select option button".split())
CLOSES_P = BLOCK - frozenset("html body head button select option td th tr tbody thead tfoot caption svg".split())
SELF_ENDING = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)), "tbody": ("tbody thead tfoot tr td th", ("table",)), "thead": ("tbody thead tfoot tr td th", ("table",)), "tfoot": ("tbody thead tfoot tr td th", ("table",))}
# Elements that no implied end looks beyond.
CLOSED = ("table", "button", "article", "section", "div", "aside", "main", "body", "form", "ul", "ol", "blockquote")
# Class names that begin so tell of the page's state, not of the element.
STATE = re.compile(r"(?:has|with|without|no|is|not)[-_]")
# Blocks that carry text and follow the state of the container around them.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd pre blockquote table thead tbody tfoot tr td th caption figure figcaption hgroup address summary".split())
TEMPER = 0.25  # of the evidence of text and its blocks: they are many and alike, so each counts less
WRAPS, MAIN, OFF = 0, 1, 2


def _scaled(v: list[float]) -> list[float]:
    s = sum(v)
    return [x / s for x in v]


class Node:
    __slots__ = ("tag", "naming", "parent", "children", "text", "linked", "off", "main")

    def __init__(self, tag, naming, parent, off, main):
        self.tag, self.naming, self.parent, self.off, self.main = tag, naming, parent, off, main
        self.children: list[Node] = []
        self.text = None
        self.linked = 0


def _attributes(source: str) -> tuple[tuple[str, ...], bool | None]:
    """Words of class, id and role, and whether the element is marked as main text."""
    words, main = set(), None
    for name, a, b, c in ATTRIBUTE.findall(source):
        if name[:5] == "data-":
            main = name == "data-main"
        else:
            for label in (a or b or c).split():
                if not STATE.match(label):
                    words.update(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", label).lower()))
    return tuple(sorted(words)), main


def parse(source: str) -> list[Node]:
    """Nodes in page order, the root first. Broken markup is read leniently and in linear time."""
    root = Node("html", (), None, False, False)
    nodes, here, links = [root], root, 0
    stack: list[tuple[str, Node]] = [("html", root)]
    places: dict[str, list[int]] = defaultdict(list)  # where the open elements of a tag are in the stack
    runs: list[str] = []
    linked = 0

    def flush():
        nonlocal linked
        if runs:
            text = " ".join(html.unescape("".join(runs)).split())
            if text:
                leaf = Node("#text", (), here, here.off, here.main)
                leaf.text, leaf.linked = text, linked
                here.children.append(leaf)
                nodes.append(leaf)
            runs.clear()
        linked = 0

    def words(a, z):
        nonlocal linked
        if z > a and not here.off:
            runs.append(source[a:z])
            if links:
                linked += z - a

    def pop(to: int):
        nonlocal here
        if any(t in BLOCK for t, _ in stack[to:]):
            flush()
        for t, _ in stack[to:]:
            places[t].pop()
        del stack[to:]
        here = stack[-1][1]

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    at, size = 0, len(source)
    while at < size:
        m = MARKUP.search(source, at)
        if m is None:
            words(at, size)
            break
        words(at, m.start())
        at = m.end()
        tag = m[2]
        if not tag:
            if m[0].startswith("<![CDATA["):
                words(m.start() + 9, m.end() - 3)
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            if tag == "br":
                runs.append(" ")
            k = last((tag,))
            if k and (tag in BLOCK or k >= last(("td", "th", "table"))):
                pop(k)
            continue
        if tag in ("br", "wbr", "img"):
            runs.append(" " if tag != "wbr" else "")
        if tag == "a":
            links = 1
        if tag in VOID and tag != "hr":
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
            at = source.find(">", end.start()) + 1 or size if end else size
            continue
        if tag in ("html", "body") and any(t == tag for t, _ in stack[:2]) and tag == "html":
            root.main = root.main or bool(_attributes(m[3])[1])
            continue
        if tag in CLOSES_P or tag in SELF_ENDING:
            ends, within = SELF_ENDING.get(tag, ("", ()))
            ends = ("p", *ends.split())
            closed = last([t for t in (*within, *CLOSED) if t not in ends])
            while (k := last(ends)) > closed:
                found = stack[k][0]
                pop(k)
                if found == tag != "p":
                    break
        if tag == "hr":
            flush()
            continue
        if tag in BLOCK:
            flush()
            links = 0
            naming, main = _attributes(m[3]) if m[3] else ((), None)
            node = Node(tag, naming, here, here.off or tag in NEVER, here.main if main is None else main)
            here.children.append(node)
            nodes.append(node)
            here = node
        places[tag].append(len(stack))
        stack.append((tag, here))
    flush()
    return nodes


def _features(n: Node) -> tuple:
    if n.text is None:
        return (("tag", n.tag),)
    size = len(n.text)
    length = 0 if size < 25 else 1 if size < 90 else 2 if size < 250 else 3
    link = 0 if n.linked == 0 else 1 if 2 * n.linked < size else 2
    ends = n.text[-1] in ".!?…:;\"'”»)"
    return (("length", length), ("link", link), ("ends", ends), ("in", n.parent.tag, link > 1))


def _kind(n: Node) -> str:
    """What the transition from the parent depends on."""
    return "text" if n.text is not None else "block" if n.tag in TEXTUAL else "container"


def _states(nodes: list[Node]) -> dict[int, int]:
    """State of every node of a labelled page, by id(): an element outside the marks wraps if main text is below it."""
    state = {id(n): MAIN if n.main else OFF for n in nodes}
    for n in reversed(nodes):
        if n.parent is not None and state[id(n)] != OFF and not n.parent.main:
            state[id(n.parent)] = WRAPS
    return state


class Model:
    """Smoothed tables of root, transition and emission probabilities, counted from labelled pages.

    A node in a labelled page is main text if its nearest mark says so; a node outside all marks is not.
    Words and other features that no labelled page has say nothing.
    """

    def __init__(self, pages: list[str], smooth: float = 0.1):
        emit: dict[tuple, list[float]] = defaultdict(lambda: [smooth] * 3)
        move = defaultdict(lambda: [smooth] * 3)
        roots = [smooth] * 3
        for source in pages:
            nodes = parse(source)
            state = _states(nodes)
            for n in nodes:
                y = state[id(n)]
                for f in (*_features(n), *(("word", w) for w in n.naming)):
                    emit[f][y] += 1
                if n.parent is None:
                    roots[y] += 1
                else:
                    move[_kind(n), state[id(n.parent)]][y] += 1
        self.root = [r / sum(roots) for r in roots]
        self.move = {(kind, y): [m / sum(move[kind, y]) for m in move[kind, y]] for kind in ("text", "block", "container") for y in (WRAPS, MAIN, OFF)}
        total = defaultdict(lambda: [smooth] * 3)
        for f, c in emit.items():
            total[f[0]] = [t + x for t, x in zip(total[f[0]], c)]
        self.emit = {f: [x / t for x, t in zip(c, total[f[0]])] for f, c in emit.items()}
        self.seen: dict[tuple, list[float]] = {}

    def evidence(self, n: Node) -> list[float]:
        """Emission of a node for each state, up to a factor: that of its words, and the rest tempered for texts and their blocks."""
        features = _features(n)
        out = self.seen.get(features)  # few: tags of blocks and shapes of texts
        if out is None:
            power = 1.0 if _kind(n) == "container" else TEMPER
            out = [1.0] * 3
            for f in features:
                out = [o * e**power for o, e in zip(out, self.emit.get(f, (1.0,) * 3))]
            out = self.seen[features] = _scaled(out)
        for w in n.naming:
            if ("word", w) in self.emit:
                out = _scaled([o * e for o, e in zip(out, self.emit["word", w])])
        return out

    def marginals(self, nodes: list[Node], root: list[float] | None = None) -> list[float]:
        """Probability of main text for each node, exact on the tree; messages are scaled to sum to one."""
        place = {id(n): i for i, n in enumerate(nodes)}
        belief = [self.evidence(n) for n in nodes]
        parent = [-1 if n.parent is None else place[id(n.parent)] for n in nodes]
        table = [[self.move[_kind(n), y] for y in (WRAPS, MAIN, OFF)] for n in nodes]
        up: list = [None] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            a, b, c = belief[i]
            l, m, n = table[i]  # noqa: E741
            x, y, z = l[0] * a + l[1] * b + l[2] * c, m[0] * a + m[1] * b + m[2] * c, n[0] * a + n[1] * b + n[2] * c
            s = x + y + z
            up[i] = x, y, z = x / s, y / s, z / s
            p = belief[parent[i]]
            a, b, c = p[0] * x, p[1] * y, p[2] * z
            s = a + b + c
            belief[parent[i]] = a / s, b / s, c / s
        out: list = [None] * len(nodes)
        out[0] = _scaled([b * r for b, r in zip(belief[0], root or self.root)])
        for i in range(1, len(nodes)):
            q, u = out[parent[i]], up[i]
            a, b, c = q[0] / u[0], q[1] / u[1], q[2] / u[2]  # the parent without this child's message
            s = a + b + c
            a, b, c = a / s, b / s, c / s
            l, m, n = table[i]  # noqa: E741
            e = belief[i]
            x, y, z = e[0] * (a * l[0] + b * m[0] + c * n[0]), e[1] * (a * l[1] + b * m[1] + c * n[1]), e[2] * (a * l[2] + b * m[2] + c * n[2])
            s = x + y + z
            out[i] = x / s, y / s, z / s
        return [p[MAIN] for p in out]

    def main_text(self, source: str | None) -> str:
        if not source:
            return ""
        nodes = parse(source)
        for root in (None, [0.0, 1.0, 0.0]):  # a page that keeps nothing is read again as main text from its root down
            kept = [n.text for n, p in zip(nodes, self.marginals(nodes, root)) if n.text is not None and p > 0.5]
            if kept:
                break
        return "\n\n".join(kept)


def extract(pages: DataFrame, labelled: list[str] = PAGES) -> DataFrame:
    """page_id, url, text and n_chars (code points of text) for every row of pages(page_id, url, html).

    `labelled` are pages whose elements with data-main hold main text (data-off ends one). Runs of text
    between block boundaries are decoded, have white space runs as one space, and are joined by an empty
    line in page order; nothing else is dropped or cut. A null, empty or textless page has an empty text.
    Repeated rows get a row each; other columns are ignored. One pass over the pages, no shuffle.
    """
    model = Model(labelled)

    def run(batches):
        for b in batches:
            texts = [model.main_text(s) for s in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
