"""Main-text extraction by gradient-boosted trees over DOM nodes with hierarchical decoding.

Every element gets features: its tag, attribute words of itself and its ancestors, depth, place in the page, lengths and
densities of its own text and subtree (text per tag, share of linked text, punctuation) and statistics of its siblings.
Boosted regression trees (trained here, on pages written by `training_pages` with known main text) give each
element log-odds of being main text. A tree programme then decodes the best consistent choice: from the root down an
element may turn from outside to main once, and from main to an excluded box once; below a box nothing is main again.
So no element is chosen against its ancestors. Where nothing is chosen, what stands outside all boxes (menus, headers,
footers, asides, forms, and elements whose attributes name notices, adverts, comments and the like) is the main text.

Edge cases: a null or empty html gives ''; markup that never closes or is cut off closes at its parent's end or the
end of the page; pages without markup, or without an element around their paragraphs, keep all text outside boxes; texts
of any length are read whole, in time linear in it; repeated rows give the same text; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vecspark.llm.common import slices, table
from vecspark.llm.html_dom import HIDDEN, Page, attribute_words, clean, parse

# Tag groups and attribute word groups that are features of nodes.
TAG_GROUPS = ("p", "h1", "h2 h3 h4 h5 h6", "article", "main", "section", "div", "nav menu", "header", "footer", "aside", "form fieldset label legend", "ul ol dl", "li dt dd", "a", "table tbody thead tr td th caption", "span b i em strong u small sub sup code", "blockquote pre figure figcaption", "body html")
ABOVE_GROUPS = ("article", "main", "nav menu", "header", "footer", "aside", "form fieldset", "a", "ul ol dl", "table", "p", "h1 h2 h3 h4 h5 h6")
WORD_GROUPS = (
    "article articlebody content post entry main story body text blog maincontent primary prose",
    "ad ads advert adverts advertisement adsense adslot banner promo promotion promoted sponsor sponsored dfp outbrain taboola",
    "comment comments reply replies disqus discussion respond responses reader readers feedback guestbook thread",
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pager pagination tabs toc skip",
    "notice cookie cookies consent gdpr alert popup modal overlay warning message banner announcement paywall",
    "sidebar side aside related recommended recommendations recent popular trending widget widgets more rail secondary",
    "footer foot copyright legal colophon bottom contentinfo",
    "header masthead head top logo tagline brand branding",
    "form login signin signup subscribe subscription newsletter search register contact",
    "share sharing social facebook twitter follow like buttons toolbar",
    "hidden",
)
TAG_NUMBER = {t: k for k, g in enumerate(TAG_GROUPS) for t in g.split()}
ABOVE_BIT = {t: 1 << k for k, g in enumerate(ABOVE_GROUPS) for t in g.split()}
WORD_BITS: dict[str, int] = {}
for _k, _g in enumerate(WORD_GROUPS):
    for _t in _g.split():
        WORD_BITS[_t] = WORD_BITS.get(_t, 0) | 1 << _k

BOX_TAGS = frozenset("nav menu header footer aside form fieldset legend label".split())
BOX_WORDS = sum(1 << k for k in range(1, len(WORD_GROUPS)))  # all groups but that of main text

N_FEATURES = len(TAG_GROUPS) + len(ABOVE_GROUPS) + 2 * len(WORD_GROUPS) + 18
TREES, DEPTH, BINS, RATE = 80, 4, 32, 0.2
TRAINING_PAGES = 800  # written by the generator, whatever the corpus


@dataclass
class Nodes:
    features: np.ndarray
    own: np.ndarray  # characters of text directly in each element
    hidden: np.ndarray
    boxed: np.ndarray  # in an element that is no main text by its name


def node_features(page: Page, pieces: list[str]) -> Nodes:
    """Features of all elements of a page; pieces: its decoded texts."""
    n = len(page.tag)
    parent = np.array(page.parent, np.int64)
    depth = np.array(page.depth, np.float64)
    above, words_above, own_words, hidden, boxed = [0] * n, [0] * n, [0] * n, [False] * n, [False] * n
    for k in range(n):
        tag, up = page.tag[k], page.parent[k]
        bits = 0
        if page.attributes[k]:
            for w in attribute_words(page.attributes[k]):
                bits |= WORD_BITS.get(w, 0)
        own_words[k] = bits
        hidden[k] = tag in HIDDEN
        boxed[k] = tag in BOX_TAGS or (bits & BOX_WORDS > 0 and not bits & 1)
        if up >= 0:
            above[k] = above[up] | ABOVE_BIT.get(page.tag[up], 0)
            words_above[k] = words_above[up] | own_words[up]
            hidden[k] = hidden[k] or hidden[up]
            boxed[k] = boxed[k] or boxed[up]
    own, marks, linked = np.zeros(n), np.zeros(n), np.zeros(n)
    in_link = [(a & 128) > 0 or page.tag[k] == "a" for k, a in enumerate(above)]
    for node, piece in zip(page.text_node, pieces):
        if not hidden[node]:
            size = len(piece.strip())
            own[node] += size
            marks[node] += piece.count(".") + piece.count(",") + piece.count("!") + piece.count("?")
            linked[node] += size if in_link[node] else 0
    total, tags, stops, links = own.copy(), np.ones(n), marks.copy(), linked.copy()
    for k in range(n - 1, 0, -1):  # children come after their parents
        up = parent[k]
        total[up] += total[k]
        tags[up] += tags[k]
        stops[up] += stops[k]
        links[up] += links[k]
    up = np.maximum(parent, 0)
    siblings = np.bincount(up[1:], minlength=n).astype(float) if n > 1 else np.zeros(n)
    child_text = siblings.copy()
    child_text[:] = np.bincount(up[1:], weights=total[1:], minlength=n) if n > 1 else 0
    number = np.zeros(n)
    seen = [0] * n
    for k in range(1, n):
        number[k] = seen[page.parent[k]]
        seen[page.parent[k]] += 1
    all_text = max(total[0], 1.0)
    place = np.arange(n) / max(n, 1)
    of_tag = np.array([TAG_NUMBER.get(t, -1) for t in page.tag])
    same = np.zeros(n)
    if n > 1:
        key = up * 64 + of_tag + 1
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        same = counts[inverse] / np.maximum(siblings[up], 1)
    text_before = np.cumsum(own) - own
    group = (of_tag[:, None] == np.arange(len(TAG_GROUPS))).astype(float)
    bits = lambda x, m: ((np.array(x, np.int64)[:, None] >> np.arange(m)) & 1).astype(float)
    dense = np.column_stack([
        np.log1p(own), np.log1p(total), np.log1p(tags), np.log1p(total / tags), links / np.maximum(total, 1), total / all_text, depth, place,
        number, np.log1p(siblings[up]), np.log1p(child_text[up] / np.maximum(siblings[up], 1)), same, stops / np.maximum(total, 1) * 100,
        links[up] / np.maximum(total[up], 1), np.log1p(total[up] / tags[up]), text_before / all_text, np.full(n, np.log1p(all_text)), total[up] / all_text,
    ])
    x = np.concatenate([group, bits(above, len(ABOVE_GROUPS)), bits(own_words, len(WORD_GROUPS)), bits(words_above, len(WORD_GROUPS)), dense], 1)
    return Nodes(x.astype(np.float32), own, np.array(hidden), np.array(boxed))


# --- boosted trees


@dataclass
class Trees:
    """Complete binary trees of DEPTH levels: feature and threshold by inner node, value by leaf."""

    feature: np.ndarray  # trees x (2 ** DEPTH - 1)
    threshold: np.ndarray
    value: np.ndarray  # trees x 2 ** DEPTH
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - (2**DEPTH - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
    """Newton boosting of the logistic loss over histograms of quantile bins."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    mean = float((weight * y).sum() / weight.sum())
    base = float(np.log(mean / (1 - mean)))
    score = np.full(len(y), base)
    inner = 2**DEPTH - 1
    features, thresholds, values = [], [], []
    flat = binned + np.arange(x.shape[1]) * BINS
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            if rows.size >= 20:
                keys = flat[rows].ravel()
                size = x.shape[1] * BINS
                gs = np.bincount(keys, weights=np.repeat(g[rows], x.shape[1]), minlength=size).reshape(-1, BINS).cumsum(1)
                hs = np.bincount(keys, weights=np.repeat(h[rows], x.shape[1]), minlength=size).reshape(-1, BINS).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < 2) | (ht - hs < 2)] = 0
                j, b = divmod(int(gain.argmax()), BINS)
                if gain[j, b] > 1e-3 and b < len(cuts[j]):
                    feature[node], threshold[node] = j, cuts[j][b]
            at[rows] = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
        leaf = at - inner
        gl, hl = np.bincount(leaf, weights=g, minlength=inner + 1), np.bincount(leaf, weights=h, minlength=inner + 1)
        value = RATE * gl / (hl + 1)
        score += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(np.array(features), np.array(thresholds, np.float32), np.array(values), base)


# --- decoding

SWITCH = 3.0  # what a turn to main text, or to an excluded box, must gain


def decode(page: Page, nodes: Nodes, log_odds: np.ndarray) -> list[bool]:
    """Whether each element is main text, by the best consistent assignment."""
    n = len(page.tag)
    gain = (np.clip(log_odds, -6, 6) * np.log2(1 + nodes.own) * ~nodes.hidden).tolist()
    outside, main, boxed = [0.0] * n, gain[:], [0.0] * n
    # best sums below each element when it is outside, main or boxed; nothing outside or boxed counts
    enter, leave = [False] * n, [False] * n
    for k in range(n - 1, 0, -1):
        up = page.parent[k]
        enter[k] = main[k] - SWITCH > outside[k]
        leave[k] = main[k] < boxed[k] - SWITCH
        outside[up] += main[k] - SWITCH if enter[k] else outside[k]
        main[up] += -SWITCH if leave[k] else main[k]
    enter[0] = main[0] - SWITCH > outside[0]
    state = [0] * n  # 0 outside, 1 main, 2 boxed
    state[0] = int(enter[0])
    for k in range(1, n):
        above = state[page.parent[k]]
        state[k] = int(enter[k]) if above == 0 else (2 if leave[k] else 1) if above == 1 else 2
    chosen = [s == 1 and not h for s, h in zip(state, nodes.hidden.tolist())]
    if not any(c and o for c, o in zip(chosen, nodes.own.tolist())):
        chosen = (~(nodes.hidden | nodes.boxed)).tolist()
    return chosen


def main_text(page: Page, pieces: list[str], chosen: list[bool]) -> str:
    blocks: list[str] = []
    run: list[str] = []
    edge = -1
    for node, piece, e in zip(page.text_node, pieces, page.edges):
        if e != edge:
            blocks.append("".join(run))
            run, edge = [], e
        if chosen[node]:
            run.append(piece)
    blocks.append("".join(run))
    return "\n".join(x for x in (clean_block(b) for b in blocks) if x)


def clean_block(block: str) -> str:
    return " ".join(block.split())


def extract(sources: list[str | None], trees: Trees) -> list[str]:
    """The main text of each page; the trees see all nodes of the pages at once."""
    pages = [parse(x or "") for x in sources]
    pieces = [[clean(p) for p in page.text] for page in pages]
    nodes = [node_features(page, p) for page, p in zip(pages, pieces)]
    if not nodes:
        return []
    log_odds = trees.log_odds(np.concatenate([x.features for x in nodes]))
    ends = np.cumsum([len(x.own) for x in nodes])
    return [main_text(page, p, decode(page, x, log_odds[e - len(x.own) : e])) for page, p, x, e in zip(pages, pieces, nodes, ends.tolist())]


# --- training pages


MARK = "\ue000"


def training_pages(n: int = TRAINING_PAGES, seed: int = 7) -> Iterator[str]:
    """Pages of many layouts; main text carries the mark U+E000 in front of each of its texts."""
    rng = random.Random(seed)
    syllables = "an er the on re in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ción é ä pf".split()

    def words(a: int, b: int) -> str:
        w = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(a, b))]
        w = [x + rng.choice(["."] * 2 + [","] + [""] * 12) for x in w]
        return " ".join(w).capitalize() + rng.choice([".", ".", "", "&amp;", "!"])

    def cls(*names: str) -> str:
        name = rng.choice(names)
        return rng.choice([f' class="{name}"', f' id="{name}"', f' class="{name} x{rng.randint(1, 9)}"', f' class="col {name}"'])

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(k))

    def nav() -> str:
        body = f"<ul>{links(rng.randint(3, 9))}</ul>"
        return rng.choice([f"<nav>{body}</nav>", f"<div{cls('menu', 'navbar', 'nav', 'navigation', 'breadcrumbs')}>{body}</div>", f"<nav><a href=/>{words(1, 2)}</a> | <a href=/b>{words(1, 2)}</a></nav>"])

    def ad() -> str:
        return rng.choice([f"<div{cls('ad', 'ads', 'advert', 'banner', 'sponsored', 'promo')}>{words(2, 40)}</div>", f"<aside{cls('ad', 'promo')}><p>{words(3, 30)}</p></aside>"])

    def sidebar() -> str:
        body = f"<h3>{words(1, 3)}</h3><ul>{links(rng.randint(2, 6))}</ul>" + rng.choice(["", f"<p>{words(5, 40)}</p>"])
        return rng.choice([f"<aside>{body}</aside>", f"<div{cls('sidebar', 'related', 'widget', 'recent-posts', 'recommended')}>{body}</div>", f"<aside{cls('sidebar')}><p>{words(5, 60)}</p></aside>"])

    def notice() -> str:
        return rng.choice([f"<div{cls('cookie-notice', 'consent', 'notice', 'alert', 'popup', 'gdpr-banner')}><p>{words(5, 40)}</p><button>{words(1, 2)}</button></div>", f"<div role=\"alert\">{words(4, 25)}</div>", f"<section{cls('notice')}>{words(4, 25)}</section>"])

    def form() -> str:
        body = f"<label>{words(1, 4)}</label><input name=e><button>{words(1, 2)}</button>"
        return rng.choice([f"<form action=/s>{body}<p>{words(3, 20)}</p></form>", f"<div{cls('newsletter', 'subscribe', 'signup')}><p>{words(3, 25)}</p><form>{body}</form></div>", f"<form{cls('search', 'contact')}>{body}<select><option>{words(1, 2)}<option>{words(1, 2)}</select><textarea>{words(0, 5)}</textarea></form>"])

    def comments() -> str:
        one = lambda: rng.choice([f"<div{cls('comment')}><p>{words(4, 70)}</p></div>", f"<li{cls('comment', 'reply')}><b>{words(1, 2)}</b><p>{words(4, 70)}</p></li>", f"<p>{words(4, 50)}</p>", f"<article{cls('comment')}><p>{words(4, 60)}</p></article>"])
        body = f"<h2>{words(1, 3)}</h2>" + "".join(one() for _ in range(rng.randint(1, 5)))
        return rng.choice([f"<section{cls('comments', 'discussion', 'responses')}>{body}</section>", f"<div{cls('comments', 'disqus-thread', 'reader-comments')}>{body}</div>", f"<ul{cls('comments', 'comment-list')}>{body}</ul>"])

    def share() -> str:
        body = rng.choice([f"<a href=/f>{words(1, 1)}</a><a href=/t>{words(1, 1)}</a>", words(1, 4), f"<span>{words(1, 3)}</span><button>{words(1, 1)}</button>"])
        return f"<div{cls('share', 'social', 'share-buttons', 'sharing')}>{body}</div>"

    m = MARK
    closed = lambda tag, body: f"<{tag}>{body}" + (f"</{tag}>" if rng.random() < 0.9 else "")

    def paragraph() -> str:
        kind = rng.random()
        if kind < 0.6:
            return closed("p", m + words(1, rng.choice([8, 40, 160])))
        if kind < 0.68:
            return f"<p>{m}{words(2, 30)} <a href=/x>{m}{words(1, 3)}</a> {m}{words(2, 30)}</p>"
        if kind < 0.76:
            return f"<p><b>{m}{words(2, 30)}<br>"
        if kind < 0.82:
            return f"<h{rng.randint(2, 4)}>{m}{words(1, 8)}</h2>"
        if kind < 0.87:
            return "<ul>" + "".join(f"<li>{m}{words(2, 20)}</li>" for _ in range(rng.randint(1, 6))) + "</ul>"
        if kind < 0.9:
            return "<table>" + "".join(f"<tr><td>{m}{words(1, 4)}</td><td>{m}{words(1, 8)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>"
        if kind < 0.94:
            return f"<blockquote><p>{m}{words(4, 40)}</p></blockquote>"
        if kind < 0.97:
            return f"<div>{m}{words(4, 60)}</div>"
        return f"<figure><img src=a><figcaption>{m}{words(2, 15)}</figcaption></figure>"

    for _ in range(n):
        title = words(1, 10)
        inner = [f"<h1>{m}{title}</h1>" if rng.random() < 0.9 else ""]
        inner += [paragraph() for _ in range(rng.choice([0, 1, 1, 2, 4, 8, 16]))] or [""]
        if len("".join(inner)) < 8:
            inner.append(f"<p>{m}{words(1, 30)}</p>")
        for maker, p in ((ad, 0.15), (share, 0.12), (sidebar, 0.06), (comments, 0.08), (form, 0.06), (notice, 0.05)):
            if rng.random() < p:
                inner.insert(rng.randint(1, len(inner)), maker())
        inside = "".join(inner)
        root = rng.random()
        if root < 0.06:  # nothing around the paragraphs
            main = inside
        elif root < 0.5:
            main = f"<article>{inside}</article>"
        elif root < 0.62:
            main = f"<main>{inside}</main>"
        elif root < 0.74:
            main = f"<main><article{cls('post', 'entry')}>{inside}</article></main>"
        elif root < 0.92:
            main = f"<div{cls('content', 'post', 'entry-content', 'article-body', 'story', 'main', 'text')}>{inside}</div>"
        else:
            main = f"<section{cls('content', 'article')}>{inside}</section>"
        before = [x for maker, p in ((nav, 0.85), (notice, 0.2), (ad, 0.5), (form, 0.15)) if rng.random() < p for x in [maker()]]
        if rng.random() < 0.35:
            before.insert(0, rng.choice([f"<header><h1>{words(1, 3)}</h1><p>{words(2, 12)}</p></header>", f"<header>{words(1, 6)}</header>", f"<div{cls('header', 'masthead')}>{words(1, 6)}</div>"]))
        after = [x for maker, p in ((ad, 0.2), (sidebar, 0.35), (comments, 0.3), (share, 0.15), (form, 0.15), (notice, 0.1)) if rng.random() < p for x in [maker()]]
        rng.shuffle(after)
        if rng.random() < 0.15:
            before, after = before + after, []
        if rng.random() < 0.06:  # main text alone
            before, after = [], []
        foot = rng.choice([f"<footer>&copy; {words(1, 25)}</footer>", f"<footer><p>{words(2, 30)}</p><ul>{links(2)}</ul></footer>", f"<div{cls('footer')}>{words(2, 25)}</div>", ""])
        body = "".join(before) + main + "".join(after) + foot
        if rng.random() < 0.25:
            body = f"<div{cls('wrapper', 'page', 'container')}>{body}</div>"
        head = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
        yield head + body + ("</body></html>" if rng.random() < 0.9 else "")


@functools.cache
def train_trees(n: int = TRAINING_PAGES) -> Trees:
    xs, ys, ws = [], [], []
    for source in training_pages(n):
        page = parse(source)
        marked = np.zeros(len(page.tag), bool)
        some = np.zeros(len(page.tag), bool)
        for node, piece in zip(page.text_node, page.text):
            if piece.strip():
                some[node] = True
                marked[node] |= MARK in piece
        nodes = node_features(page, [clean(p.replace(MARK, "")) for p in page.text])
        use = some & ~nodes.hidden
        xs.append(nodes.features[use])
        ys.append(marked[use])
        ws.append(np.log2(2 + nodes.own[use]))
    return fit_trees(np.concatenate(xs), np.concatenate(ys).astype(float), np.concatenate(ws))


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract_pages(pages: DataFrame, trees: Trees) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages (page_id, url, html); no shuffle."""
    shared = pages.sparkSession.sparkContext.broadcast((trees.feature, trees.threshold, trees.value, trees.base))  # some 20 kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Trees(*shared.value)
        for part in slices(batches, "html", max_bytes=1 << 20):
            texts = extract(part.column("html").to_pylist(), own)
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, SCHEMA)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"), train_trees())
