"""HTML extraction: gradient-boosted trees over DOM-node features, decoded along the tree.

A tolerant parser builds the tree of elements and text leaves. Each node is described by
its tag group, attribute tokens, depth, siblings, text and link density of its subtree,
position and what its ancestors are; boosted trees give the chance that its subtree
holds main text. Decoding picks the most likely labelling in which a node is main only if
its parent is (a two-state dynamic program over the tree), so a paragraph is never kept
inside a dropped menu, nor an empty wrapper for its own sake.

The trees are fitted on a bounded sample of pages: the pages as they are, main text being
their semantic article, and the same pages rebuilt with other wrappers, class names and
unwanted parts, so that the model does not hang on one site's markup.
"""

from __future__ import annotations

import html
import math
import pickle
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linelift.llm.common import need_columns, ship_package

MAX_PAGES = 256
"""Pages that the trees are fitted on."""
MAX_CHARS = 1 << 20
"""Default of ``train``'s ``max_chars``: longer pages are not fitted on, which bounds the sample in
characters too. All pages are extracted whole."""
REBUILT_PAGES = 320
TREES, DEPTH, RATE, EDGES = 80, 4, 0.3, 24

# ------------------------------------------------------------------ parsing

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript iframe xmp noembed noframes template svg "
          "object canvas select".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt "
            "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
            "legend li main menu nav ol option p pre section summary table tbody tfoot thead tr "
            "ul".split())
CLOSES_P = BLOCK - set("body caption dd dt head html legend li option tbody tfoot thead tr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"},
          "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"},
          "p": {"td", "th", "table", "button", "caption", "html"}}

_MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)"
    r"((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", re.I)
_TOKEN = re.compile(r"[a-z]+")


class Page:
    """Nodes in page order; node 0 is the root. Text leaves have the tag ``#text``."""

    def __init__(self):
        self.tag, self.parent, self.tokens, self.text, self.block = ["#root"], [-1], [()], [""], [0]

    def add(self, tag: str, parent: int, tokens: tuple, text: str, block: int) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.tokens.append(tokens)
        self.text.append(text)
        self.block.append(block)
        return len(self.tag) - 1


def _attribute_tokens(attributes: str) -> tuple:
    """The words of class, id and role; NAMED first if one of the names is a wanted part's alone."""
    if "=" not in attributes:
        return ()
    values = [v.lower().strip("\"'") for v in _ATTRIBUTE.findall(attributes)]
    words = tuple(t for v in values for t in _TOKEN.findall(v))
    return (NAMED, *words) if any(_TOKENS.get(name) == GOOD for v in values for name in v.split()) else words


def token_groups(tokens: tuple) -> set[int]:
    """The groups that an element's words belong to: of a "post comment-count" the wanted one
    alone, of a "comment-content" both."""
    return {GOOD} if NAMED in tokens else {_TOKENS[t] for t in tokens if t in _TOKENS}


def parse(source: str | None) -> Page:
    """The page's tree. Unclosed and misnested tags are closed as browsers do for
    paragraphs, list items and table cells; a stray end tag is ignored."""
    page = Page()
    source = source or ""
    stack = [(0, "#root")]
    open_at: dict[str, list[int]] = {}  # tag -> places in the stack, so none is searched for
    block, at = 0, 0

    def last(tags) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    def close(k: int) -> None:
        while len(stack) > k:
            open_at[stack.pop()[1]].pop()

    def text(upto: int) -> None:
        if upto > at:
            piece = source[at:upto]
            if "&" in piece:
                piece = html.unescape(piece)
            page.add("#text", stack[-1][0], (), piece, block)

    while (m := _MARK.search(source, at)) is not None:
        text(m.start())
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):
            if name in BLOCK:
                block += 1
            elif name in ("td", "th"):
                page.add("#text", stack[-1][0], (), " ", block)
            if open_at.get(name):
                close(open_at[name][-1])
            continue
        for closed, scope in ((CLOSES.get(name), SCOPES.get(name)),
                              ({"p"} if name in CLOSES_P else None, SCOPES["p"])):
            if closed and (k := last(closed)) > last(scope - closed):
                close(k)
        if name in BLOCK:
            block += 1
        if name in ("br", "td", "th"):
            page.add("#text", stack[-1][0], (), " ", block)
        node = page.add(name, stack[-1][0], _attribute_tokens(m.group(3)), "", block)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            at = end.end() if end else len(source)
        elif name not in VOID and not m.group(3).endswith("/"):
            open_at.setdefault(name, []).append(len(stack))
            stack.append((node, name))
    text(len(source))
    return page


# ------------------------------------------------------------------ features

TAG_GROUPS = [{"article", "main"}, {"nav", "menu"}, {"header"}, {"footer"}, {"aside", "dialog"},
              {"form", "fieldset", "button", "label", "input", "legend"}, {"h1", "h2", "h3", "h4"},
              {"p", "blockquote", "pre"}, {"ul", "ol", "dl"}, {"li", "dt", "dd"}, {"a"},
              {"div", "section"}, {"table", "tbody", "tr", "td"}, {"#text"}, RAW | {"head"}]
_GROUP = {t: i for i, g in enumerate(TAG_GROUPS) for t in g}

TOKEN_GROUPS = [
    "article content main post entry story body text prose".split(),
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc".split(),
    "header masthead topbar banner hero logo".split(),
    "footer copyright colophon legal bottom".split(),
    "sidebar aside rail related recommended widget widgets tags trending".split(),
    "ad ads adv advert advertisement adverts advertising sponsor sponsored promo promotion "
    "adsense dfp".split(),
    "cookie cookies consent notice gdpr alert popup modal overlay banner toast".split(),
    "comment comments reply replies discussion disqus respond thread".split(),
    "form search login signup subscribe newsletter share social sharing register".split(),
]
_TOKENS = {}
for _i, _g in enumerate(TOKEN_GROUPS):
    for _t in _g:
        _TOKENS.setdefault(_t, _i)
GOOD, NAMED = 0, "*"
MOST_OF_PAGE = 0.8

N_FEATURES = 2 * len(TAG_GROUPS) + 2 * len(TOKEN_GROUPS) + 14


def node_features(page: Page) -> np.ndarray:
    """One row per node."""
    n = len(page.tag)
    tags, tokens = len(TAG_GROUPS), len(TOKEN_GROUPS)
    x = np.zeros((n, N_FEATURES), np.float32)
    chars, links, elements, marks, depth = ([0] * n for _ in range(5))
    children, index = [0] * n, [0] * n
    parent = page.parent
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        index[i] = children[p]
        children[p] += 1
        if page.tag[i] == "#text":
            t = page.text[i]
            chars[i] = len(t) - t.count(" ") if t.isspace() is False else 0
            marks[i] = t.count(".") + t.count(",") + t.count("!") + t.count("?")
    before = [0] * n
    seen = 0
    for i in range(n):
        before[i] = seen
        seen += chars[i]
    for i in range(n - 1, 0, -1):
        p = parent[i]
        if page.tag[i] == "a":
            links[i] = chars[i]
        chars[p] += chars[i]
        links[p] += links[i]
        marks[p] += marks[i]
        elements[p] += elements[i] + (page.tag[i] != "#text")
    total = max(1, chars[0])
    rest = 2 * tags + 2 * tokens
    for i in range(n):
        row = x[i]
        p = parent[i]
        if p >= 0:  # what the ancestors are
            row[tags:2 * tags] = x[p, :tags]
            np.maximum(row[tags:2 * tags], x[p, tags:2 * tags], out=row[tags:2 * tags])
            a, b = 2 * tags, 2 * tags + tokens
            np.maximum(x[p, a:b], x[p, b:b + tokens], out=row[b:b + tokens])
        g = _GROUP.get(page.tag[i])
        if g is not None:
            row[g] = 1
        for k in token_groups(page.tokens[i]):
            # an element with most of the page's text is not a part of it, whatever its theme's words
            if k == GOOD or chars[i] < MOST_OF_PAGE * total:
                row[2 * tags + k] = 1
    c, e = np.array(chars, np.float32), np.array(elements, np.float32)
    li, d = np.array(links, np.float32), np.array(depth, np.float32)
    par = np.maximum(np.array(parent), 0)
    kids, ix = np.array(children, np.float32), np.array(index, np.float32)
    x[:, rest:] = np.stack([
        d, np.log1p(c), np.log1p(c / (e + 1)), li / np.maximum(c, 1), np.log1p(e),
        np.log1p(kids), np.log1p(kids[par]), ix / np.maximum(kids[par], 1), c / total,
        c / np.maximum(c[par], 1), np.array(marks, np.float32) / np.maximum(c, 1),
        np.array(before, np.float32) / total, np.log1p(c[par]), (li / np.maximum(c, 1))[par]], 1)
    return x


# ------------------------------------------------------------------ boosted trees

def fit_trees(x: np.ndarray, y: np.ndarray, *, trees: int = TREES, depth: int = DEPTH,
              rate: float = RATE, l2: float = 1.0) -> dict:
    """Boosted depth-``depth`` trees for logistic loss, on features cut at their quantiles.

    Every node of a tree level splits on its best feature and edge by second-order gain.
    """
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, EDGES + 2)[1:-1], method="nearest"))
             for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    width = EDGES + 2
    prior = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    margin = np.full(len(y), math.log(prior / (1 - prior)))
    features, cuts, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        leaf = np.zeros(len(y), np.int64)
        tree_f, tree_c = np.zeros(2 ** depth - 1, np.int64), np.full(2 ** depth - 1, np.inf)
        for level in range(depth):
            size = 2 ** level
            best = np.full(size, 1e-6)
            split = [None] * size
            for j in range(x.shape[1]):
                if not len(edges[j]):
                    continue
                cell = leaf * width + binned[:, j]
                gs = np.cumsum(np.bincount(cell, g, size * width).reshape(size, width), 1)
                hs = np.cumsum(np.bincount(cell, h, size * width).reshape(size, width), 1)
                gl, hl = gs[:, :len(edges[j])], hs[:, :len(edges[j])]
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = (gl ** 2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2)
                        - gt ** 2 / (ht + l2))
                k = gain.argmax(1)
                for s in range(size):
                    if gain[s, k[s]] > best[s]:
                        best[s], split[s] = gain[s, k[s]], (j, k[s])
            right = np.zeros(len(y), np.int64)
            for s, found in enumerate(split):
                if found:
                    j, k = found
                    tree_f[size - 1 + s], tree_c[size - 1 + s] = j, edges[j][k]
                    rows = leaf == s
                    right[rows] = binned[rows, j] > k
            leaf = 2 * leaf + right
        gs, hs = (np.bincount(leaf, v, 2 ** depth) for v in (g, h))
        value = -rate * gs / (hs + l2)
        margin += value[leaf]
        features.append(tree_f)
        cuts.append(tree_c)
        values.append(value)
    return {"bias": math.log(prior / (1 - prior)), "depth": depth, "features": features,
            "cuts": [c.astype(np.float32) for c in cuts], "values": values}


def margins(model: dict, x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), model["bias"])
    rows = np.arange(len(x))
    for f, c, v in zip(model["features"], model["cuts"], model["values"]):
        leaf = np.zeros(len(x), np.int64)
        for level in range(model["depth"]):
            at = leaf + 2 ** level - 1
            leaf = 2 * leaf + (x[rows, f[at]] > c[at])
        out += v[leaf]
    return out


# ------------------------------------------------------------------ decoding

def decode(page: Page, margin: np.ndarray) -> np.ndarray:
    """The likeliest labels in which a main node's parent is main."""
    n = len(page.tag)
    keep, drop = (-np.logaddexp(0, s * margin) for s in (-1, 1))
    keep, drop = keep.tolist(), drop.tolist()
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    main = np.zeros(n, bool)
    for i in range(n):
        p = page.parent[i]
        main[i] = (p < 0 or main[p]) and keep[i] > drop[i]
    return main


def whole_runs(page: Page, main: np.ndarray) -> np.ndarray:
    """``main`` with the leaves of a run of text (one block under one block element) decided
    together, by its characters: a word before a link says little alone. Elements inside
    the run with words of unwanted parts are left out of it."""
    n = len(page.tag)
    holder, own = [0] * n, [True] * n  # the nearest block element; no unwanted element up to it
    runs: dict[tuple, list[int]] = {}
    for i in range(1, n):
        p, tag = page.parent[i], page.tag[i]
        if tag in BLOCK or tag in ("td", "th"):
            holder[i] = i
            continue
        holder[i] = holder[p]
        own[i] = (own[p] or holder[p] == p) and tag not in RAW and not token_groups(page.tokens[i]) - {GOOD}
        if tag == "#text" and own[i]:
            runs.setdefault((page.block[i], holder[i]), []).append(i)
    main = main.copy()
    for leaves in runs.values():
        kept = sum(len(page.text[i]) for i in leaves if main[i])
        if kept and 2 * kept >= sum(len(page.text[i]) for i in leaves):
            for i in leaves:
                while not main[i]:  # up to the block element, which is main as another leaf is
                    main[i] = True
                    i = page.parent[i]
    return main


def blocks(page: Page, main: np.ndarray) -> str:
    """Text of the main leaves: white space to one space inside a block, blocks joined by
    an empty line."""
    out: list[str] = []
    run: list[str] = []
    at = None
    for i, tag in enumerate(page.tag):
        if tag != "#text":
            continue
        if page.block[i] != at:
            out.append(" ".join("".join(run).split()))
            run, at = [], page.block[i]
        if main[i] or page.text[i] == " ":
            run.append(page.text[i])
    out.append(" ".join("".join(run).split()))
    return "\n\n".join(b for b in out if b)


def extract(model: dict, sources: list[str | None]) -> list[str]:
    pages = [parse(s) for s in sources]
    if not pages:
        return []
    x = [node_features(p) for p in pages]
    margin = margins(model, np.concatenate(x))
    out, at = [], 0
    for page, rows in zip(pages, x):
        out.append(blocks(page, whole_runs(page, decode(page, margin[at:at + len(rows)]))))
        at += len(rows)
    return out


# ------------------------------------------------------------------ fitting

def labels_from(page: Page, is_main) -> np.ndarray:
    """1 for the leaves that ``is_main(ancestors-or-self nodes)`` takes and all above them."""
    y = np.zeros(len(page.tag), np.float64)
    path_main = [False] * len(page.tag)
    for i in range(len(page.tag)):
        p = page.parent[i]
        path_main[i] = is_main(page, i, path_main[p] if p >= 0 else False)
        if page.tag[i] == "#text" and path_main[i] and page.text[i].strip():
            while i >= 0 and not y[i]:
                y[i] = 1
                i = page.parent[i]
    return y


# Attribute words of wanted parts that name unwanted ones.
TRAPS = ["comment-count", "has-sidebar", "no-ads", "share-enabled", "with-header", "nav-open",
         "popup-enabled", "footer-visible", "related-off", "hentry has-banner"]

_UNWANTED = {"nav", "header", "footer", "aside", "form", "dialog", "menu"} | RAW
MAIN_MARK, JUNK_MARK = "zzmain", "zzjunk"


def _semantic(page: Page, i: int, inside: bool) -> bool:
    """Inside a semantic article, but for unwanted elements and those whose attributes have
    words of unwanted parts."""
    if page.tag[i] in _UNWANTED or token_groups(page.tokens[i]) - {GOOD}:
        return False
    return inside or page.tag[i] in ("article", "main")


def _planted(page: Page, i: int, inside: bool) -> bool:
    if JUNK_MARK in page.tokens[i] or page.tag[i] in RAW:
        return False
    return inside or MAIN_MARK in page.tokens[i]


def _rebuilt(rng: random.Random, texts: list[str]) -> str:
    """A page of another make around some of ``texts``, its parts marked."""
    def some(n: int, longest: int) -> list[str]:
        out = []
        for _ in range(n):
            words = rng.choice(texts).split()
            k = rng.randint(2, max(3, longest))
            start = rng.randrange(max(1, len(words) - k))
            out.append(html.escape(" ".join(words[start:start + k]) or "text"))
        return out

    def attribute(group: int, mark: str) -> str:
        kind = rng.choice(("class", "id", "class"))
        token = rng.choice(TOKEN_GROUPS[group])
        token = rng.choice((token, f"{token}-{rng.choice(('box', 'inner', 'wrap', 'x'))}",
                            f"site-{token}"))
        other = 'id' if kind == "class" else "class"
        return f' {kind}="{token}" {other}="{mark}"'

    def junk(group: int) -> str:
        tag = rng.choice({1: ["nav", "div", "ul"], 2: ["header", "div"], 3: ["footer", "div"],
                          4: ["aside", "div", "section"], 5: ["div", "aside", "ins"],
                          6: ["div", "section", "dialog"], 7: ["section", "div", "ol"],
                          8: ["form", "div"]}[group])
        plain = tag in ("nav", "header", "footer", "aside", "form", "dialog") and rng.random() < .5
        attr = f' class="{JUNK_MARK}"' if plain else attribute(group, JUNK_MARK)
        if group in (1, 4, 8) and rng.random() < .7:
            inner = "<ul>" + "".join(f'<li><a href="#">{t}</a></li>' for t in some(
                rng.randint(2, 8), 4)) + "</ul>"
        elif group == 7:
            inner = "".join(f"<div class=\"comment\"><b>{a}</b><p>{b}</p></div>" for a, b in zip(
                some(rng.randint(1, 5), 2), some(5, 60)))
        elif group == 8:
            inner = "".join(f"<label>{t}</label><input name=q>" for t in some(2, 4))
            inner += f"<button>{some(1, 2)[0]}</button>"
        else:
            inner = rng.choice(("<p>%s</p>", "%s", "<div>%s</div>", "<a href='#'>%s</a>")) % some(
                1, 30)[0]
        return f"<{tag}{attr}>{inner}</{tag}>"

    body = [f"<h1>{some(1, 10)[0]}</h1>"] if rng.random() < .8 else []
    for t in some(rng.randint(1, 12), 120):
        kind = rng.random()
        if kind < .75:
            body.append(f"<p>{t}</p>" if rng.random() < .8 else f"<p><b>{t}<br>")
        elif kind < .82:
            body.append(f"<h2>{t[:60]}</h2>")
        elif kind < .9:
            item = rng.choice(("<li>%s</li>", "<li>%s</li>", "<li><a href='#'>%s</a></li>",
                               "<li><p>%s <a href='#'>more</a></p></li>"))
            body.append("<ul>" + "".join(item % x for x in some(rng.randint(2, 5), 20)) + "</ul>")
        elif kind < .95:
            body.append(f"<blockquote>{t} <a href='#'>{some(1, 3)[0]}</a></blockquote>")
        else:
            body.append("<table>" + "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in zip(
                some(3, 4), some(3, 4))) + "</table>")
    for group in (4, 5, 5, 7, 8, 6):
        if rng.random() < .25:
            body.insert(rng.randint(1, len(body)), junk(group))
    tag = rng.choice(("article", "main", "div", "div", "section"))
    attr = (attribute(GOOD, MAIN_MARK) if tag in ("div", "section") or rng.random() < .3
            else f' class="{MAIN_MARK}"')
    if tag == "div" and rng.random() < .3:
        attr = f' class="{MAIN_MARK}"'
    if rng.random() < .35 and (tag in ("article", "main") or rng.choice(TOKEN_GROUPS[GOOD]) in attr):
        attr = f' class="{MAIN_MARK} {rng.choice(TOKEN_GROUPS[GOOD])} {rng.choice(TRAPS)}"'
    elif rng.random() < .2 and tag in ("article", "main"):
        attr = f' class="{MAIN_MARK} {rng.choice(TRAPS)}"'
    main = f"<{tag}{attr}>{''.join(body)}</{tag}>"
    before = [junk(g) for g in (1, 2, 5, 6) if rng.random() < .6]
    after = [junk(g) for g in (4, 7, 3, 8, 5, 6, 1) if rng.random() < .45]
    rng.shuffle(before)
    page = "".join(before) + main + "".join(after)
    for _ in range(rng.randint(0, 2)):
        page = rng.choice(('<div>%s</div>', '<div id="page">%s</div>', '<div class="wrap">%s</div>',
                           f'<div class="site {rng.choice(TRAPS)}">%s</div>')) % page
    theme = f' class="{rng.choice(TRAPS)} {rng.choice(TRAPS)}"' if rng.random() < .3 else ""
    return (f"<html><head><title>t</title><style>p{{}}</style></head><body{theme}>" + page
            + "<script>x=1;</script></body></html>")


def _unmarked(page: Page) -> Page:
    page.tokens = [tuple(t for t in ts if t not in (MAIN_MARK, JUNK_MARK)) for ts in page.tokens]
    return page


def fit_pages(sources: list[str]) -> dict:
    """A model from sample pages; without any, from pages rebuilt of filler words."""
    rng = random.Random(11)
    xs, ys, texts = [], [], []
    for source in sources:
        page = parse(source)
        y = labels_from(page, _semantic)
        texts += [t for t in page.text if len(t.split()) > 8][:40]
        if y.any():
            xs.append(node_features(page))
            ys.append(y)
    texts = texts or ["some words of a text, which has a few sentences. It goes on, and on."]
    for _ in range(REBUILT_PAGES):
        page = parse(_rebuilt(rng, texts))
        ys.append(labels_from(page, _planted))
        xs.append(node_features(_unmarked(page)))
    return fit_trees(np.concatenate(xs), np.concatenate(ys))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sources = [s for batch in batches for s in batch.column(0).to_pylist()]
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_pages(sources))], pa.binary())],
                                     ["model"])


def train(pages: DataFrame, *, max_pages: int = MAX_PAGES, max_chars: int = MAX_CHARS) -> dict:
    """Fit on the ``max_pages`` pages whose page_id has the smallest MD5, of those of at most
    ``max_chars`` characters."""
    ship_package(pages.sparkSession)
    order = F.md5(F.col("page_id").cast("string").cast("binary"))
    chosen = (pages.where(F.col("page_id").isNotNull()
                          & (F.length("html") <= max_chars))
              .select("page_id").distinct().orderBy(order).limit(max_pages))
    rows = (pages.join(F.broadcast(chosen), "page_id")  # max_pages rows
            .groupBy("page_id").agg(F.max(F.when(F.length("html") <= max_chars,
                                                 F.col("html"))).alias("html")))
    models = (rows.repartition(1).sortWithinPartitions(order).select("html")
              .mapInArrow(_fit, "model binary").collect())
    return pickle.loads(bytes(models[0]["model"])) if models else fit_pages([])


def main_text(pages: DataFrame, *, model: dict | None = None,
              max_pages: int = MAX_PAGES) -> DataFrame:
    """The main text of every row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    Character references are decoded, white space inside a block is one space, blocks are
    joined by two newlines. A null or empty html, or a page without main text, gives the
    text ''. Repeated rows and null ids stay, other columns are ignored; an empty table
    gives no rows. ``model``: from ``train``, fitted on the pages themselves if not given.
    """
    need_columns(pages, "page_id", "url", "html")
    spark = pages.sparkSession
    ship_package(spark)
    pages = pages.select("page_id", "url", "html")
    table = spark.sparkContext.broadcast(model or train(pages, max_pages=max_pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                texts = extract(table.value, batch.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")
