"""HTML extraction: gradient-boosted trees over DOM nodes, and a hierarchical decoding.

A page becomes a tree of block elements whose leaves are runs of text. Each node has a log-odds of holding main text, from boosted
trees over its tag, attribute tokens, depth, siblings, and the densities of its subtree. No word of an attribute decides alone: the
training pages put such words on main text too, and a token's weight depends on what stands beside it. The labelling of highest likelihood under the
rule that a node which holds main text has parents which do is found by one pass over the tree; the kept leaves are the text.

The trees are fitted here, on TRAIN_PAGES pages that are generated from a grammar of layouts with known labels.
"""

from __future__ import annotations

import functools
import html
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES = 900
TREES, DEPTH, RATE, BINS = 80, 5, 0.25, 32
HASHED = 16
#: Counts of siblings and children go no further in features, so that long pages are like others.
MOST = 30
#: Features but tags and hashed tokens.
PLAIN = 32

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
# Elements by role.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea svg iframe object canvas select title head".split())
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
TAGS = "body main article section div p h1 h2 h3 ul ol li table td blockquote pre figure figcaption nav header footer aside form #text".split()
CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "tr": frozenset(["tr", "td", "th"]), "dd": frozenset(["dd", "dt"]), "dt": frozenset(["dd", "dt"])}
NOT_IN_P = frozenset("article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
PROSE = frozenset("p blockquote pre h1 h2 h3 h4 li dd td".split())
BAD = frozenset("nav menu breadcrumb breadcrumbs header masthead banner footer foot sidebar side aside ad ads advert advertisement sponsor sponsored promo notice cookie cookies consent popup modal alert form search login signup subscribe newsletter comment comments reply respond disqus share social related recommended tags widget toolbar pagination pager copyright legal".split())
GOOD = frozenset("article content main post entry story body text articlebody page prose".split())


class Node:
    __slots__ = ("tag", "tokens", "parent", "kids", "text", "depth", "links", "raw", "size", "nodes", "inside", "place", "prose", "heads", "largest")

    def __init__(self, tag, tokens, parent):
        self.tag, self.tokens, self.parent, self.kids = tag, tokens, parent, []
        self.text = self.links = ""
        self.depth = parent.depth + 1 if parent else 0
        self.raw = self.size = self.nodes = self.inside = self.place = self.prose = self.heads = self.largest = 0


def parse(page: str) -> Node:
    """The tree of block elements; runs of text between block borders are #text leaves, with the text in links kept apart too."""
    root = top = Node("body", (), None)
    run: list[str] = []
    linked: list[str] = []
    in_link = False
    at, end = 0, len(page)

    def flush():
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                leaf = Node("#text", (), top)
                leaf.text, leaf.links = text, " ".join(html.unescape("".join(linked)).split())
                top.kids.append(leaf)
            run.clear()
            linked.clear()

    while at < end:
        m = _TOKEN.search(page, at)
        cut = m.start() if m else end
        if cut > at:
            run.append(page[at:cut])
            if in_link:
                linked.append(page[at:cut])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in RAW and not m[1]:
            if not m[3].endswith("/"):
                close = RAW_END[tag].search(page, at)
                # a head that isn't closed ends at the body
                body = re.compile(r"<body[\s>]", re.I).search(page, at) if tag == "head" else None
                at = min(close.end() if close else end, body.start() if body else end)
        elif tag in INLINE:
            if tag == "a":
                in_link = not m[1]
        elif tag == "br" or tag == "hr":
            flush()
        elif tag in VOID or tag in ("html", "body") or tag in RAW:
            flush()
        elif m[1]:
            flush()
            up = top
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                top = up.parent
            in_link = False
        else:
            flush()
            if tag in NOT_IN_P and top.tag == "p":
                top = top.parent
            while top is not root and top.tag in CLOSES.get(tag, ()):
                top = top.parent
            names = [x for a in _ATTR.finditer(m[3]) for x in _WORD.findall((a[1] or a[2] or a[3] or "").lower())] if m[3] else []
            node = Node(tag, tuple(names), top)
            top.kids.append(node)
            top = node
    flush()
    return root


def flat(root: Node) -> list[Node]:
    """Nodes in page order, parents first, with the sums of their subtrees."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        node.place = len(out)
        out.append(node)
        todo.extend(reversed(node.kids))
    for node in reversed(out):
        node.size, node.raw, node.nodes = len(node.text), len(node.links), 1
        if node.text and node.parent.tag in PROSE and 2 * node.raw < node.size:
            node.prose = node.size
        node.heads = int(node.tag == "h1")
        for k in node.kids:
            node.size += k.size
            node.raw += k.raw
            node.nodes += k.nodes
            node.prose += k.prose
            node.heads += k.heads
            node.largest = max(node.largest, k.size)
    return out


def features(nodes: list[Node]) -> np.ndarray:
    total, count = max(1, nodes[0].size), len(nodes)
    rows = np.zeros((count, PLAIN + len(TAGS) + HASHED), np.float32)
    bad_above, good_above, by_tag = [0.0] * count, [0] * count, {}
    prose, heads = max(1, nodes[0].prose), nodes[0].heads
    for i, n in enumerate(nodes):
        up = n.parent
        bad = sum(t in BAD for t in n.tokens) / max(1, len(n.tokens)) + (n.tag in ("nav", "header", "footer", "aside", "form"))
        good = sum(t in GOOD for t in n.tokens) + (n.tag in ("article", "main"))
        if up is not None:
            bad_above[i] = bad_above[up.place] + bad
            good_above[i] = good_above[up.place] + good
        kids = up.kids if up is not None else [n]
        if up is not None and up.place not in by_tag:
            seen: dict[str, int] = {}
            for k, x in enumerate(kids):
                x.inside = k
                seen[x.tag] = seen.get(x.tag, 0) + 1
            by_tag[up.place] = seen
        text = n.text or (n.kids[0].text if n.kids else "")
        r = rows[i]
        r[:PLAIN] = (
            n.prose / prose, n.prose / max(1, n.size), n.heads > 0, heads > 0, n.size / max(1, up.largest) if up is not None else 1, up.prose / prose if up is not None else 1, len(n.tokens), np.log1p(n.prose),
            up.parent.prose / prose if up is not None and up.parent is not None else 1, up.parent.tag in TAGS[:4] if up is not None and up.parent is not None else 0,
            bad, good, bad_above[i], good_above[i], n.depth, min(n.inside, MOST), min(len(kids), MOST), n.inside / len(kids), min(by_tag[up.place][n.tag], MOST) if up is not None else 1, min(len(n.kids), MOST),
            np.log1p(n.size), n.size / total, n.raw / max(1, n.size), n.size / n.nodes, i / count, text.count(",") + text.count("."), sum(map(str.isupper, text[:200])) / max(1, min(200, len(text))),
            up.size / total if up is not None else 1, up.raw / max(1, up.size) if up is not None else 0, up.size / up.nodes if up is not None else 0, np.log1p(kids[n.inside - 1].size) if n.inside else 0, np.log1p(kids[n.inside + 1].size) if n.inside + 1 < len(kids) else 0,
        )
        if n.tag in _TAG_AT:
            r[PLAIN + _TAG_AT[n.tag]] = 1
        for t in n.tokens:
            r[PLAIN + len(TAGS) + zlib.crc32(t.encode()) % HASHED] = 1
    return rows


_ALL_NAMES = sorted(BAD | GOOD)
_TAG_AT = {t: i for i, t in enumerate(TAGS)}


# --- boosted trees ------------------------------------------------------------------------------------------------------------


class Boosted:
    """Logistic boosting of trees on binned features; complete trees, a split a level and node."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        flags = np.flatnonzero(np.all((x == 0) | (x == 1), axis=0))  # features of two values share one product a level
        on = np.ascontiguousarray(x[:, flags], dtype=np.float64)
        plain = np.setdiff1d(np.arange(x.shape[1]), flags)
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        for j in flags:
            self.edges[j] = np.zeros(1)
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1)
        self.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        score, self.trees = np.full(len(y), self.base), []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            at = np.zeros(len(y), np.int64)
            levels = []
            for depth in range(DEPTH):
                width = 1 << depth
                best, feature, cut = np.full(width, 1e-6), np.zeros(width, np.int64), np.full(width, BINS, np.int64)
                side = np.zeros((len(y), width))
                side[np.arange(len(y)), at] = 1
                gt, ht = side.T @ g, side.T @ h
                g1, h1 = (side * g[:, None]).T @ on, (side * h[:, None]).T @ on
                g0, h0 = gt[:, None] - g1, ht[:, None] - h1
                gain = g0**2 / (h0 + 1) + g1**2 / (h1 + 1) - (gt**2 / (ht + 1))[:, None]
                gain[(h0 < 1e-2) | (h1 < 1e-2)] = 0
                if len(flags):
                    k = gain.argmax(axis=1)
                    better = gain[np.arange(width), k] > best
                    best[better], feature[better], cut[better] = gain[np.arange(width), k][better], flags[k[better]], 0
                for j in plain:
                    key = at * BINS + binned[:, j]
                    gs, hs = (np.bincount(key, v, width * BINS).reshape(width, BINS).cumsum(axis=1) for v in (g, h))
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(hs < 1e-2) | (ht - hs < 1e-2)] = 0
                    k = gain.argmax(axis=1)
                    better = gain[np.arange(width), k] > best
                    best[better], feature[better], cut[better] = gain[np.arange(width), k][better], j, k[better]
                levels.append((feature, np.array([self.edges[f][c] if c < len(self.edges[f]) else np.inf for f, c in zip(feature, cut, strict=True)])))
                at = at * 2 + (binned[np.arange(len(y)), feature[at]] > cut[at])
            gs, hs = (np.bincount(at, v, 1 << DEPTH) for v in (g, h))
            leaves = RATE * gs / (hs + 1)
            score = score + leaves[at]
            self.trees.append((levels, leaves))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for levels, leaves in self.trees:
            at = np.zeros(len(x), np.int64)
            for feature, cut in levels:
                at = at * 2 + (x[rows, feature[at]] > cut[at])
            out += leaves[at]
        return out


# --- training pages -----------------------------------------------------------------------------------------------------------


MARK = "\x01"


def training_nodes(page: str) -> tuple[list[Node], np.ndarray]:
    """The nodes of a training page without MARK, and whether each holds main text."""
    root = parse(page)
    todo, main = [root], set()
    while todo:
        node = todo.pop()
        todo += node.kids
        if MARK in node.text:
            node.text, node.links = node.text.replace(MARK, ""), node.links.replace(MARK, "")
            while node is not None and id(node) not in main:
                main.add(id(node))
                node = node.parent
    nodes = flat(root)
    return nodes, np.array([id(n) in main for n in nodes], np.float64)


#: Ways in which a training page wraps its main text.
WRAPS = 14


def training_page(rng: random.Random, wraps: tuple[int, ...] = tuple(range(WRAPS))) -> tuple[str, list[str]]:
    """A page of a random layout, and its main blocks of text in order. Words of main text begin with MARK; training_nodes takes it off."""
    main: list[str] = []

    def word():
        return "".join(rng.choice(["ta", "re", "on", "li", "su", "é", "ver"]) for _ in range(rng.randint(1, 4)))

    def words(n, mark=""):
        return " ".join(mark + (word().capitalize() if rng.random() < 0.15 else word()) + rng.choice(["", "", "", ",", "."]) for _ in range(n))

    def text(lo, hi):
        got = words(rng.randint(lo, hi), MARK)
        main.append(got.replace(MARK, ""))
        cut = got.split(" ")
        k = rng.randrange(len(cut))
        cut[k] = rng.choice(["<b>{}</b>", "<a href='/x'>{}</a>", "<em>{}</em>", "{}", "{}"]).format(cut[k])
        return " ".join(cut)

    def any_name():
        """Attribute words that say nothing: those of menus and notices too, by themselves or beside others."""
        pool = [rng.choice(_ALL_NAMES), word(), word(), rng.choice(_ALL_NAMES)]
        return rng.choice(["-", " ", "_"]).join(rng.sample(pool, rng.randint(1, 3)))

    def attr(odds, *names):
        """A class or id: one of `names`, sometimes with more words; by `odds` one that says nothing; or none."""
        r = rng.random()
        if r < odds:
            return f' {rng.choice(["class", "class", "id"])}="{any_name()}"'
        if not names or r > 0.97:
            return ""
        name = rng.choice(names)
        return f' {rng.choice(["class", "class", "id"])}="{name if rng.random() < 0.7 else name + rng.choice(["-", " "]) + word()}"' if name else ""

    def links(tag="ul"):
        rows = [f'<a href="/{i}">{words(rng.randint(1, 3))}</a>' for i in range(rng.randint(2, 9))]
        return f"<{tag}>" + "".join(f"<li>{r}</li>" if tag == "ul" else r + " | " for r in rows) + f"</{tag}>"

    def junk(where):
        kind = rng.randrange(12)
        if kind == 0:
            return f'<div{attr(0, "ad", "ad-box", "advert", "ads", "sponsored", "promo")}>{words(rng.randint(3, 40))}</div>'
        if kind == 1:
            return f'<aside{attr(0.1, "", "sidebar", "related")}><h3>{words(2)}</h3>{links()}<p>{words(rng.randint(2, 25))}</p></aside>'
        if kind == 2:
            return f'<div{attr(0, "sidebar", "side-column", "widget-area")}><p>{words(rng.randint(5, 40))}</p>{links()}</div>'
        if kind == 3:
            return f'<div{attr(0, "cookie-notice", "consent-banner", "notice", "alert", "cookies")}><p>{words(rng.randint(5, 40))}</p><a href="#">{words(1)}</a></div>'
        if kind == 4:
            return f'<form{attr(0.1, "search", "newsletter", "login")}><label>{words(3)}</label><input><p>{words(rng.randint(1, 15))}</p><button>{words(1)}</button></form>'
        if kind == 5:
            return f'<div{attr(0.1, "share", "social-links", "tags")}>{links("div")}</div>'
        if kind == 6:
            return f'<nav{attr(0.1, "breadcrumbs")}>{links("div")}</nav>'
        if kind == 7 and where == "after":
            t = rng.choice(["div", "li", "article"])
            rows = "".join(f'<{t}{attr(0, "comment", "reply")}><p>{words(rng.randint(4, 60))}</p></{t}>' for _ in range(rng.randint(1, 6)))
            outer = rng.choice(["section", "div"])
            return f'<{outer}{attr(0, "comments", "responses", "comment-list")}><h3>{words(1)}</h3>{rows}</{outer}>'
        if kind == 8:
            return f'<div{attr(0.1, "related", "recommended", "more-stories")}><h3>{words(2)}</h3>{links()}</div>'
        return ""

    def body(least=1):
        out = [f"<h1{attr(0.1)}>{text(2, 12)}</h1>"] if rng.random() < 0.9 else []
        for _ in range(rng.randint(least, 9) if rng.random() > 0.03 else rng.randint(40, 400)):
            r = rng.random()
            if r < 0.72:
                out.append(f"<p{attr(0.08)}>{text(2, 130)}" + rng.choice(["</p>", "</p>", "</p>", "", "<br>" + text(1, 20) + "</p>"]))
            elif r < 0.8:
                out.append(f"<h2{attr(0.1)}>{text(1, 7)}</h2>")
            elif r < 0.86:
                out.append("<ul>" + "".join(f"<li>{text(2, 20)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif r < 0.9:
                out.append(f"<blockquote><p>{text(5, 40)}</p></blockquote>")
            elif r < 0.93:
                out.append(f"<pre>{text(3, 20)}</pre>")
            elif r < 0.95:
                out.append("<table><tr>" + "".join(f"<td>{text(1, 5)}</td>" for _ in range(4)) + "</tr></table>")
            else:
                out.append(junk("in"))
        return "".join(out)

    def wrap():
        kind = rng.choice(wraps)
        if kind < 3:
            return f"<article{attr(0.3)}>{body()}</article>"
        if kind == 3:
            return f'<article{attr(0.4, "post", "entry", "hentry")}><div{attr(0.4, "body", "text")}>{body()}</div></article>'
        if kind == 4:
            return f"<main{attr(0.3)}>{body()}</main>"
        if kind == 5:
            return f'<main><article{attr(0.4, "post")}>{body()}</article></main>'
        if kind == 6:
            return f'<div{attr(0.25, "content", "post-body", "entry-content", "article-text", "story")}>{body()}</div>'
        if kind == 7:
            return f'<div{attr(0.2, "content", "main", "page")}><div{attr(0.3)}>{body()}</div></div>'
        if kind == 8:
            return f"<section{attr(0.3)}>{body(2)}</section>"
        if kind == 9:
            return f"<div{attr(0.3)}><div{attr(0.3)}><div{attr(0.3)}>{body(3)}</div></div></div>"
        if kind == 10:
            return f'<main{attr(0.2)}><header{attr(0.2)}><h1>{text(2, 9)}</h1></header><section{attr(0.3)}>{body(2)}</section></main>'
        if kind == 11:
            return f"<table><tr><td{attr(0.3)}>{links()}</td><td{attr(0.3)}>{body(3)}</td></tr></table>"
        if kind == 12:
            return body(3)
        return f'<div{attr(0.2, "container", "wrapper")}>{junk("before")}<div{attr(0.3, "column")}>{body(2)}</div>{junk("after")}</div>'

    head = rng.choice([lambda: f"<nav{attr(0.2)}>{links()}</nav>", lambda: f'<header{attr(0.2)}><div class="logo">{words(2)}</div><nav>{links()}</nav></header>', lambda: f'<div{attr(0.1, "menu")}>{links()}</div>', lambda: f'<div{attr(0.1, "header")}><h2>{words(3)}</h2>{links("div")}</div>', lambda: f'<div{attr(0.1, "top")}><h1>{words(2)}</h1></div>'])()
    before = junk("before") + junk("before")
    inner = wrap()
    after = junk("after") + junk("after")
    foot = rng.choice([lambda: f"<footer{attr(0.2)}>&copy; {words(rng.randint(2, 30))}</footer>", lambda: f'<div{attr(0, "footer")}><p>{words(rng.randint(2, 20))}</p>{links("div")}</div>', lambda: f'<div{attr(0, "footer")}>{links()}&copy; {words(3)}</div>', lambda: ""])()
    page = f"<!DOCTYPE html><html><head><title>{words(4)}</title></head><body>{head}<!-- x -->{before}{inner}{after}{foot}</body></html>"
    if rng.random() < 0.1:
        cut = rng.randint(len(page) // 2, len(page))
        page = page[:cut]
    return page, main


@functools.lru_cache(maxsize=1)
def model(pages: int = TRAIN_PAGES, seed: int = 11, wraps: tuple[int, ...] = tuple(range(WRAPS))) -> Boosted:
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        nodes, own = training_nodes(training_page(rng, wraps)[0])
        xs.append(features(nodes))
        ys.append(own)
    return Boosted().fit(np.concatenate(xs), np.concatenate(ys))


def decode(nodes: list[Node], odds: np.ndarray) -> list[str]:
    """The kept leaves. all0: log-likelihood that a subtree holds no main text; best1: that its root does, at the best choice below."""
    no, yes = -np.logaddexp(0, odds), -np.logaddexp(0, -odds)
    all0, best1 = no.tolist(), yes.tolist()
    for i in range(len(nodes) - 1, 0, -1):
        up = nodes[i].parent.place
        best1[up] += max(best1[i], all0[i])
        all0[up] += all0[i]
    kept = [False] * len(nodes)
    out = []
    for i, n in enumerate(nodes):
        kept[i] = best1[i] > all0[i] and (i == 0 or kept[n.parent.place])
        if kept[i] and n.text:
            out.append(n.text)
    return out


def _extract(boosted: Boosted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                trees = [flat(parse(t.as_py() or "")) for t in part.column(2)]
                odds = boosted.score(np.concatenate([features(t) for t in trees]))
                blocks, at = [], 0
                for t in trees:
                    blocks.append(decode(t, odds[at : at + len(t)]))
                    at += len(t)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(blocks, pa.list_(pa.string()))], names=["id", "url", "blocks"])

    return run


def extract_main(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, blocks, text): the blocks of main text of each page in order, and their join by one space.

    Character references are decoded, white space in a block is one space; nothing is cut short.

    - A null or empty page, or one without main text, has no blocks and an empty text. What is left open at the end is closed there.
    - Null and repeated ids and rows are kept, each row by itself. Other columns don't matter. No rows give no rows.
    """
    src = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    out = src.mapInArrow(_extract(model()), "id long, url string, blocks array<string>")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "blocks", F.array_join("blocks", " ").alias("text"))


def op4_extract_main(spark, sf_dir: str) -> DataFrame:
    out = extract_main(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
