"""Main-text extraction from HTML by gradient-boosted trees over DOM nodes.

Method. A page's tags are read into a tree (optional end tags are supplied, void elements and raw text are known). Every element gets features: what kind it is and what kinds stand above
it, its attributes' tokens, depth, place among its siblings, text, link and tag density of its subtree, and how its siblings compare. Gradient-boosted trees, fitted here on the nodes of a bounded sample of
pages, give each node the odds that its subtree holds main text. Decoding is hierarchical: a node below a closed node is closed, and of all such labellings the one with the
largest sum of log odds is taken, so an ancestor and its descendants never contradict. Text below open nodes only is kept: white space inside a block becomes one space, blocks are joined by a
line feed. Pages are independent: one pass, no shuffle; the trees (a few kB) are what executors get.

Learning. At most FIT_PAGES pages, and of them no more than have FIT_NODES nodes together (both in expectation), by a hash of their ids; the page's size is bounded by PAGE_NODES there, and nowhere else. Their nodes are labelled by what the markup itself says: inside article or main, and not below what is named or
marked as navigation, header, footer, aside, advert, notice, form, comment or script. VARIANTS copies of each page, whose closed parts get other names and places and whose main element may lose its
name, are learnt from as well, so that no template is learnt by heart. Each tree sees a part of the features, so that no single hint decides.

Cases. Null html counts as empty; a page without text gives ''. Character references are decoded as browsers do; a tag that the page's end cuts off is left out, as browsers do; reading takes time in proportion to the page, however deep or broken it is. Repeated rows are extracted each; very long
pages are one row; empty tables give empty ones; columns named like an output are replaced.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, materialize

#: Pages that the trees are fitted on, at most (in expectation: pages are taken by a hash).
FIT_PAGES = 800
#: Varied copies of each of them that are learnt from besides.
VARIANTS = 3
#: Nodes that the trees are fitted on, at most (in expectation), and nodes of a page that is learnt from.
FIT_NODES, PAGE_NODES = 60_000, 4_000
#: Trees deeper than this are walked node by node instead of level by level.
DEEP = 256
TREES, DEPTH, RATE, SHARE, BINS, LEAF = 60, 4, 0.2, 0.7, 32, 40

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option p pre script section select style summary table tbody td template textarea tfoot th thead title tr ul".split())
CLOSES_P = BLOCKS - frozenset("td th tr tbody thead tfoot caption li dd dt option legend summary head title script style noscript template textarea".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table select html body article section div main td th".split())
KINDS = {
    "heading": "h1 h2 h3 h4 h5 h6 hgroup", "paragraph": "p blockquote pre figcaption", "list": "ul ol dl menu", "item": "li dd dt", "link": "a", "inline": "b i em strong span u s small sub sup code q cite mark abbr time br",
    "box": "div section center", "content": "article main", "nav": "nav", "edge": "header footer", "aside": "aside dialog", "form": "form input button select option label fieldset textarea", "hidden": "script style noscript template head title meta link svg iframe object", "table": "table tr td th tbody thead tfoot caption",
}
KIND_OF = {tag: i for i, tags in enumerate(KINDS.values()) for tag in tags.split()}
KIND_NAMES = list(KINDS)
BOILER = frozenset("ad ads advert advertisement adsense banner sponsor sponsored promo promoted promotion nav navigation navbar menu menubar breadcrumb breadcrumbs sidebar side aside rail widget footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login comment comments reply replies respond disqus discussion share sharing social related recommended recommendations pagination pager copyright legal disclaimer search form hidden".split())
CONTENT = frozenset("article content main post entry body story text prose page blog news document".split())
CLOSED_KINDS = tuple(KIND_NAMES.index(k) for k in ("nav", "edge", "aside", "form", "hidden"))

# Attributes as browsers read them: a name, and a value in quotes or up to white space or >. A value without quotes may hold quotes; a quote that is never closed is part of a name. All parts are possessive,
# so a tag is read in one pass whatever it holds, and one that the page's end cuts off gives an empty last group.
_ATTRIBUTE = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'>])[^\s>]++)?+)?+"""
TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]++|{_ATTRIBUTE})*+)(>?)", re.S)
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|((?!["'>])[^\s>]++))?+)?+""")
CLOSED_ITSELF = re.compile(r"""(?:^|[\s"'])/$""")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
SPACE = re.compile(r"[\x20\x09-\x0D]+")


class Dom:
    """A page's nodes in document order, the root first, as lists; runs of text with the node that holds each."""

    def __init__(self):
        self.tag, self.parent, self.kind, self.depth, self.place, self.children = ["#root"], [0], [KIND_NAMES.index("box")], [0], [0], [0]
        self.boiler, self.content, self.hidden = [0], [0], [0]
        self.runs: list[tuple[int, str]] = []

    def add(self, tag: str, parent: int, attrs: str) -> int:
        boiler, content, hidden = attribute_marks(attrs) if attrs.strip(" /") else (0, 0, 0)
        for store, x in ((self.tag, tag), (self.parent, parent), (self.kind, KIND_OF.get(tag, 6)), (self.depth, self.depth[parent] + 1), (self.place, self.children[parent]), (self.children, 0), (self.boiler, boiler), (self.content, content), (self.hidden, hidden)):
            store.append(x)
        self.children[parent] += 1
        return len(self.tag) - 1


def attribute_marks(attrs: str) -> tuple[int, int, int]:
    """How many boilerplate and content tokens class, id and role hold, and whether the element is hidden."""
    boiler = content = hidden = 0
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            tokens = {p.lower() for p in PARTS.findall(value)}
            boiler += len(tokens & BOILER)
            content += len(tokens & CONTENT)
        elif name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "").lower()) or (name == "aria-hidden" and value == "true"):
            hidden = 1
    return boiler, content, hidden


class Open:
    """The open elements, with the places at which each tag stands among them, so that closing costs what it closes."""

    def __init__(self):
        self.stack, self.tags, self.places = [0], ["#root"], {}

    def push(self, tag: str, node: int) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(node)
        self.tags.append(tag)

    def last(self, tags) -> int:
        """The highest place of any of tags; 0 without one."""
        return max((own[-1] for t in tags if (own := self.places.get(t))), default=0)

    def close(self, tags, scope=frozenset()) -> None:
        """Close the innermost of tags and all that it holds, unless an element of scope stands between."""
        at = self.last(tags)
        if at > self.last(scope):
            while len(self.stack) > at:
                self.stack.pop()
                self.places[self.tags.pop()].pop()


def parse(page: str) -> Dom:
    dom, opened, at = Dom(), Open(), 0
    stack, runs = opened.stack, dom.runs
    while m := TOKEN.search(page, at):
        if m.start() > at:
            runs.append((stack[-1], html.unescape(page[at : m.start()])))
        at = m.end()
        if m[2] is None or not m[4]:
            continue
        tag = m[2].lower()
        if m[1]:
            opened.close((tag,))
            continue
        if tag in CLOSES_P:
            opened.close(("p",), SCOPES)
        if tag in CLOSED_BY:
            opened.close(CLOSED_BY[tag], SCOPES - CLOSED_BY[tag])
        new = dom.add(tag, stack[-1], m[3])
        if tag in VOID or tag not in BLOCKS and CLOSED_ITSELF.search(m[3]):
            if tag == "br":
                runs.append((new, "\n"))
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            body = page[at : end.start() if end else len(page)]
            if body:
                runs.append((new, body if tag in ("script", "style") else html.unescape(body)))
            at = end.end() if end else len(page)
            continue
        opened.push(tag, new)
    if at < len(page):
        runs.append((stack[-1], html.unescape(page[at:])))
    return dom


FEATURES = [f"is_{k}" for k in KIND_NAMES] + [f"under_{k}" for k in KIND_NAMES] + ["boiler", "content", "hidden", "boiler_above", "content_above", "marked", "marked_above", "depth", "place", "siblings", "children", "text", "words", "links", "tags", "stops", "share", "sibling_text", "before"]


def _sum_up(sums: tuple[np.ndarray, ...], parent: np.ndarray) -> None:
    """Add each node's numbers to its parent's, children first: a parent stands before its children."""
    up = parent.tolist()
    for a in sums:
        total = a.tolist()
        for i in range(len(up) - 1, -1, -1):
            if up[i] != i:
                total[up[i]] += total[i]
        a[:] = total


def _hand_down(out: np.ndarray, parent: np.ndarray, kind: np.ndarray) -> None:
    """Fill the features of what stands above each node, parents first."""
    k, base = len(KIND_NAMES), 2 * len(KIND_NAMES)
    under = [0] * len(parent)
    above = out[:, [base, base + 1, base + 5]].tolist()  # boilerplate tokens, content tokens, marked
    best = [[0.0, 0.0, 0.0] for _ in above]
    for i, (p, own) in enumerate(zip(parent.tolist(), kind.tolist())):
        if p != i:
            under[i] = under[p] | 1 << int(kind[p])
            best[i] = [max(x, y) for x, y in zip(best[p], above[p])]
    bits = np.array(under, dtype=np.int64)
    out[:, k:base] = bits[:, None] >> np.arange(k) & 1
    out[:, base + 3 : base + 5] = np.array(best)[:, :2]
    out[:, base + 6] = np.array(best)[:, 2]


def describe(doms: list[Dom]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row of FEATURES for each node of all pages, the pages' n + 1 offsets in the rows, and each row's parent row."""
    k = len(KIND_NAMES)
    offsets = np.cumsum([0, *[len(d.tag) for d in doms]])
    n = int(offsets[-1])
    joined = lambda name: np.array([x for d in doms for x in getattr(d, name)], dtype=np.int64)
    parent = joined("parent") + np.repeat(offsets[:-1], np.diff(offsets))
    kind, depth, children = joined("kind"), joined("depth"), joined("children")
    runs = [(i + at, r) for d, at in zip(doms, offsets.tolist()) for i, r in d.runs]
    where = np.array([i for i, _ in runs], dtype=np.int64)
    size = np.array([len(r.strip()) for _, r in runs], dtype=np.float64)
    gather = lambda values: np.bincount(where, weights=values, minlength=n) if len(where) else np.zeros(n)
    text = gather(size)
    words = gather(np.array([r.count(" ") for _, r in runs], dtype=np.float64) + (size > 0))
    stops = gather(np.array([r.count(".") + r.count(",") for _, r in runs], dtype=np.float64))
    links = np.where(kind == KIND_NAMES.index("link"), text, 0.0)
    tags = np.ones(n)
    running = np.cumsum(text) - text
    before = running - running[offsets[:-1]].repeat(np.diff(offsets))
    order = np.argsort(depth, kind="stable")
    deep = n > 0 and int(depth.max()) > DEEP
    levels = np.split(order, np.searchsorted(depth[order], np.arange(1, int(depth.max()) + 1))) if n and not deep else []
    sums = (text, words, links, stops, tags)
    for rows in levels[:0:-1]:
        for a in sums:
            np.add.at(a, parent[rows], a[rows])
    if deep:
        _sum_up(sums, parent)
    out = np.zeros((n, len(FEATURES)), dtype=np.float32)
    out[np.arange(n), kind] = 1
    base = 2 * k
    for j, values in enumerate((joined("boiler"), joined("content"), joined("hidden"))):
        out[:, base + j] = values
    out[:, base + 5] = np.isin(kind, CLOSED_KINDS) | (out[:, base] > 0) | (out[:, base + 2] > 0)
    for rows in levels[1:]:
        up = parent[rows]
        out[rows, k:base] = np.maximum(out[up, k:base], out[up, :k])
        out[rows, base + 3 : base + 5] = np.maximum(out[up, base + 3 : base + 5], out[up, base : base + 2])
        out[rows, base + 6] = np.maximum(out[up, base + 6], out[up, base + 5])
    if deep:
        _hand_down(out, parent, kind)
    whole = np.maximum(1, text[offsets[:-1]]).repeat(np.diff(offsets))
    siblings = children[parent]
    rest = (depth, joined("place"), siblings, children, np.log1p(text), np.log1p(words), links / np.maximum(text, 1), tags / np.maximum(words, 1), stops / np.maximum(words, 1), text / whole, text[parent] / np.maximum(siblings, 1) / whole, before / whole)
    for j, values in enumerate(rest, base + 7):
        out[:, j] = values
    return out, offsets, parent


def teach(dom: Dom) -> np.ndarray:
    """What the markup says of each node: 1 where main text stands below it."""
    n, main = len(dom.tag), KIND_NAMES.index("content")
    closed, inside = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    for i in range(n):
        p = dom.parent[i]
        closed[i] = closed[p] or dom.kind[i] in CLOSED_KINDS or bool(dom.boiler[i]) or bool(dom.hidden[i])
        inside[i] = inside[p] or dom.kind[i] == main
    label = np.zeros(n, dtype=bool)
    for i, run in dom.runs:
        label[i] |= bool(run.strip()) and not closed[i] and (inside[i] or not inside.any())
    for i in range(n - 1, 0, -1):
        label[dom.parent[i]] |= label[i]
    return label.astype(np.int8)


def vary(dom: Dom, label: np.ndarray, rng: np.random.Generator) -> tuple[Dom, np.ndarray]:
    """The page as other sites might mark it up, with the same labels: what is closed gets another kind or attribute token and may stand inside the
    main element, and the main element may be a box with or without a content token."""
    n = len(dom.tag)
    main = next((i for i in range(n) if label[i] and dom.kind[i] == KIND_NAMES.index("content")), 0)
    head = [i for i in range(1, n) if dom.tag[i] == "head"]
    tops = [i for i in range(1, n) if not label[i] and label[dom.parent[i]] and dom.parent[i] != main and i not in head]
    kind, boiler, content, parent = list(dom.kind), list(dom.boiler), list(dom.content), list(dom.parent)
    for i in tops:
        choice = rng.integers(0, 7)
        if choice:
            kind[i], boiler[i] = [0, *(KIND_NAMES.index(k) for k in ("box", "box", "aside", "form", "edge", "nav"))][choice], int(choice in (1, 2) or rng.random() < 0.3)
        if main and rng.random() < 0.5:
            parent[i] = main
    if main and rng.random() < 0.6:
        kind[main] = KIND_NAMES.index("box")
        content[main] = int(rng.random() < 0.7)
    tag, hidden, runs = list(dom.tag), list(dom.hidden), list(dom.runs)
    texts = [r for i, r in dom.runs if label[i] and len(r) > 20]
    for i in tops:
        for _ in range(int(rng.integers(1, 4)) if texts and rng.random() < 0.6 else 0):  # paragraphs as long as those of the main text
            for store, x in ((tag, "p"), (kind, KIND_OF["p"]), (boiler, 0), (content, 0), (hidden, 0), (parent, i)):
                store.append(x)
            runs.append((len(tag) - 1, texts[int(rng.integers(0, len(texts)))]))
    given, n = n, len(tag)
    label = np.append(label, np.zeros(n - given, dtype=label.dtype))
    moved = set()
    for i in range(1, n):
        if i >= given or parent[i] != dom.parent[i] or parent[i] in moved:
            moved.add(i)
    order = [i for i in range(n) if i not in moved] + sorted(moved)
    new = {old: i for i, old in enumerate(order)}
    out = Dom()
    out.tag = [tag[i] for i in order]
    out.parent = [new[parent[i]] for i in order]
    out.kind, out.boiler, out.content, out.hidden = ([x[i] for i in order] for x in (kind, boiler, content, hidden))
    out.depth, out.place, out.children = [0] * n, [0] * n, [0] * n
    for i in range(1, n):
        p = out.parent[i]
        out.depth[i], out.place[i] = out.depth[p] + 1, out.children[p]
        out.children[p] += 1
    out.runs = sorted(((new[i], r) for i, r in runs), key=lambda x: x[0])
    return out, label[order]


def grow(x: np.ndarray, y: np.ndarray, seed: int = 7) -> dict:
    """Gradient-boosted trees of fixed depth with logistic loss: arrays of feature, threshold and leaf value by tree."""
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    prior = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    raw = np.full(len(y), prior)
    inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
    feature, threshold, value = np.zeros((TREES, inner), dtype=np.int32), np.full((TREES, inner), np.inf, dtype=np.float32), np.zeros((TREES, leaves))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p) + 1e-9
        at = np.zeros(len(y), dtype=np.int64)
        for level in range(DEPTH):
            first, width = (1 << level) - 1, 1 << level
            best = np.full(width, 1e-6)
            cut = np.full(width, -1)
            pick = np.zeros(width, dtype=np.int64)
            own = at - first
            for j in sorted(rng.choice(x.shape[1], max(1, int(SHARE * x.shape[1])), replace=False)):
                if not len(edges[j]):
                    continue
                key, size = own * BINS + binned[:, j], width * BINS
                sums = [np.bincount(key, weights=w, minlength=size).reshape(width, BINS).cumsum(axis=1) for w in (g, h, None)]
                lg, lh, ln = (s[:, :-1] for s in sums)
                ag, ah, an = (s[:, -1:] for s in sums)
                gain = lg**2 / (lh + 1) + (ag - lg) ** 2 / (ah - lh + 1) - ag**2 / (ah + 1)
                gain[(ln < LEAF) | (an - ln < LEAF)] = 0
                k = gain.argmax(axis=1)
                better = gain[np.arange(width), k] > best
                best[better], cut[better], pick[better] = gain[np.arange(width), k][better], k[better], j
            for i in np.flatnonzero(cut >= 0):
                feature[t, first + i] = pick[i]
                threshold[t, first + i] = edges[pick[i]][cut[i]] if cut[i] < len(edges[pick[i]]) else np.inf
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[t, at]] > threshold[t, at])
        leaf = at - inner
        value[t] = RATE * np.bincount(leaf, weights=g, minlength=leaves) / (np.bincount(leaf, weights=h, minlength=leaves) + 1)
        raw += value[t][leaf]
    return {"prior": prior, "feature": feature, "threshold": threshold, "value": value}


def odds(model: dict, x: np.ndarray) -> np.ndarray:
    """Log odds of each row."""
    raw = np.full(len(x), model["prior"])
    rows = np.arange(len(x))
    for feature, threshold, value in zip(model["feature"], model["threshold"], model["value"]):
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(DEPTH):
            at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
        raw += value[at - (1 << DEPTH) + 1]
    return raw


def decode(parent: list[int], raw: np.ndarray) -> list[bool]:
    """Which nodes are open: the labelling with the largest sum of log probabilities in which all above an open node is open."""
    best, shut = (-np.logaddexp(0, -raw)).tolist(), (-np.logaddexp(0, raw)).tolist()
    for i in range(len(parent) - 1, 0, -1):
        best[parent[i]] += max(best[i], shut[i])
        shut[parent[i]] += shut[i]
    out = [True] * len(parent)
    for i in range(1, len(parent)):
        out[i] = out[parent[i]] and best[i] >= shut[i]
    return out


def assemble(dom: Dom, opened: list[bool]) -> str:
    """Text of the open nodes: blocks in page order. A block that stands between two runs of another one parts them."""
    block, blocks = [0] * len(dom.tag), [0] * len(dom.tag)
    for i in range(1, len(dom.tag)):
        own = dom.tag[i] in BLOCKS
        block[i] = i if own and dom.tag[i] != "hr" else block[dom.parent[i]]
        blocks[i] = blocks[i - 1] + own
    parts, last, seen = [], -1, 0
    for i, run in dom.runs:
        if not opened[dom.parent[i] if dom.tag[i] in VOID else i]:
            continue
        if block[i] != last or i > seen and blocks[i] > blocks[seen]:
            parts.append([])
        parts[-1].append(run)
        last, seen = block[i], max(seen, i)
    done = (SPACE.sub(" ", "".join(p)).strip(" ") for p in parts)
    return "\n".join(x for x in done if x)


def main_texts(pages: list[str], model: dict) -> list[str]:
    doms = [parse(p) for p in pages]
    x, offsets, _ = describe(doms)
    raw = odds(model, x)
    return [assemble(d, decode(d.parent, raw[a:b])) for d, a, b in zip(doms, offsets, offsets[1:])]


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> dict | None:
    """Trees fitted on a bounded sample of pages; None without any page. Pages of more than PAGE_NODES nodes are not learnt from."""
    total = pages.count()
    rows = pages.select(F.xxhash64(f"`{id_col}`").alias("h"), F.col(f"`{html_col}`").alias("__html"))
    place = F.pmod("h", F.lit(1 << 30))
    if total > FIT_PAGES:
        rows = rows.where(place < int((1 << 30) * (FIT_PAGES / total)))

    def extract(texts: pa.Array) -> list[pa.Array]:
        made = []
        for page in texts.to_pylist():
            dom = parse(page or "")
            if len(dom.tag) > PAGE_NODES:
                made.append(b"")
                continue
            label, rng = teach(dom), np.random.default_rng(len(page or ""))
            both = [(dom, label), *(vary(dom, label, rng) for _ in range(VARIANTS))]
            x, offsets, _ = describe([d for d, _ in both])
            made.append(np.delete(np.column_stack([x, np.concatenate([y for _, y in both])]), offsets[:-1], axis=0).astype(np.float32).tobytes())
        return [pa.array(made, pa.binary())]

    made = materialize(add_columns(rows, "__html", [("rows", T.BinaryType(), pa.binary())], extract, keep=["h"]), "nodes")
    nodes = (made.agg(F.sum(F.length("rows"))).first()[0] or 0) / (4 * (len(FEATURES) + 1))
    if nodes > FIT_NODES:
        made = made.where(place < int((1 << 30) * min(1.0, FIT_PAGES / total) * FIT_NODES / nodes))

    def train(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("h", kind="stable")
        table = np.frombuffer(b"".join(part["rows"]), dtype=np.float32).reshape(-1, len(FEATURES) + 1)
        if not len(table):
            return pd.DataFrame({"prior": [], "feature": [], "threshold": [], "value": []})
        model = grow(table[:, :-1], table[:, -1].astype(np.float64))
        return pd.DataFrame({"prior": [model["prior"]], "feature": [model["feature"].ravel()], "threshold": [model["threshold"].ravel()], "value": [model["value"].ravel()]})

    found = made.groupBy().applyInPandas(train, "prior double, feature array<int>, threshold array<float>, value array<double>").collect()
    if not found:
        return None
    r = found[0]
    return {"prior": r["prior"], "feature": np.array(r["feature"], dtype=np.int32).reshape(TREES, -1), "threshold": np.array(r["threshold"], dtype=np.float32).reshape(TREES, -1), "value": np.array(r["value"]).reshape(TREES, -1)}


def extract(pages: DataFrame, model: dict | None = None, id_col: str = "page_id", html_col: str = "html", out_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """pages (or its columns keep) with out_col, the main text; without a model, one is fitted on pages."""
    model = model or fit(pages, id_col, html_col)
    step = lambda texts: [pa.array(main_texts([t or "" for t in texts.to_pylist()], model) if model else [""] * len(texts), pa.string())]
    return add_columns(pages, html_col, [(out_col, T.StringType(), pa.string())], step, keep)
