"""Main-text extraction by a tree-structured graphical model over the DOM.

Every DOM node is a variable, content or not. A node's own features give its unary potential, and each parent-child edge
has a potential that depends on the kind of the parent. Sum-product messages, upward and then downward, give the exact
marginal of every node; text of nodes whose content marginal is over one half is kept, block by block in page order. All
pages of a batch are one forest, and messages go level by level as numpy arrays. The weights maximise the exact
conditional likelihood of labelled pages.

Cases: null or empty html, and html without content, give an empty text. Broken and unclosed markup is read as browsers
do. A null url stays null; repeated rows get repeated results; an empty table gives an empty result. Very long and very
deep pages are read whole. White space is what Python's str.split takes for it, no-break spaces included. Other columns
pass through only where they are named; the text takes the place of a kept column of its name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, quoted, read
from .html_dom import Page, block_texts, parse
from .html_pages import MARK, labelled_pages

#: Kinds of elements; others are "other".
KINDS = {
    "top": "#root html body", "article": "article", "main": "main", "section": "section", "div": "div center", "p": "p", "h1": "h1", "heading": "h2 h3 h4 h5 h6 hgroup", "list": "ul ol dl menu dir",
    "item": "li dt dd", "quote": "blockquote pre", "figure": "figure figcaption", "table": "table thead tbody tfoot tr caption", "cell": "td th", "nav": "nav", "header": "header", "footer": "footer",
    "aside": "aside", "form": "form fieldset label button select option legend optgroup", "dialog": "dialog", "address": "address", "inline": "a span b i em strong small code time",
}
#: What words in class, id and role say.
HINTS = {
    "content": "content article post entry story main body text paragraph prose", "nav": "nav navigation navbar menu menubar breadcrumb breadcrumbs tabs pagination pager toc toolbar",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adslot dfp", "footer": "footer foot copyright legal bottom contentinfo colophon",
    "header": "header masthead topbar branding logo top", "side": "sidebar aside widget related recommended recommend popular trending rail secondary complementary teaser",
    "notice": "notice cookie cookies consent alert alertdialog dialog newsletter subscribe modal popup overlay paywall gdpr toast disclaimer warning",
    "comment": "comment comments reply replies respond discussion disqus", "share": "share sharing social follow tweet buttons", "form": "form search login signup register", "meta": "byline meta author date tags tag caption timestamp",
}
KIND_OF = {t: k for k, ts in enumerate(KINDS.values()) for t in ts.split()}
HINT_OF = {w: k for k, ws in enumerate(HINTS.values()) for w in ws.split()}
OTHER = len(KINDS)
N_KINDS = OTHER + 1
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Hints of what is no content.
BOILER = {k for k, h in enumerate(HINTS) if h not in ("content", "meta")}
BOILER_TAGS = set("nav footer header aside form dialog address".split())
#: Kind, hints, hidden, no text, log length in steps, share of links in steps, marks, copyright sign, kind of the parent,
#: and what stands above: an article, a content hint, a boilerplate element, a boilerplate hint, each within or not.
N_FEATURES = N_KINDS + len(HINTS) + 1 + 1 + 6 + 4 + 2 + 1 + N_KINDS + 5


def hints(attrs: dict[str, str]) -> set[int]:
    return {HINT_OF[w.lower()] for a in ("class", "id", "role") if a in attrs for w in _WORD.findall(attrs[a]) if w.lower() in HINT_OF}


def hidden(attrs: dict[str, str]) -> bool:
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()


@dataclass
class Forest:
    """Nodes of several pages. parent: -1 at roots; levels: places of the nodes of each depth."""

    x: np.ndarray
    kind: np.ndarray
    parent: np.ndarray
    levels: list[np.ndarray]
    starts: list[int]


def forest(pages: list[Page]) -> Forest:
    starts = np.cumsum([0, *(len(p.tag) for p in pages)]).tolist()
    n = starts[-1]
    kind = np.array([KIND_OF.get(t, OTHER) for p in pages for t in p.tag], np.int64)
    parent = np.array([-1 if a < 0 else a + s for p, s in zip(pages, starts, strict=False) for a in p.parent], np.int64)
    depth = np.zeros(n, np.int64)
    for k in range(n):  # a parent comes before its children
        if parent[k] >= 0:
            depth[k] = depth[parent[k]] + 1
    own = np.zeros((n, 4))  # characters, of links, marks, copyright signs
    for p, s in zip(pages, starts, strict=False):
        for node, _, t, link in p.pieces:
            size = len(t.strip())
            own[node + s] += (size, size * link, t.count(".") + t.count(",") + t.count("!") + t.count("?"), "©" in t)
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if n else []
    total = own.copy()
    for at in reversed(levels[1:]):
        np.add.at(total, parent[at], total[at])
    x = np.zeros((n, N_FEATURES), np.float32)
    rows = np.arange(n)
    x[rows, kind] = 1
    at = N_KINDS
    above = np.zeros((n, 4), np.int8)
    for p, s in zip(pages, starts, strict=False):
        for k, (tag, attrs) in enumerate(zip(p.tag, p.attrs, strict=True)):
            found = hints(attrs) if attrs else set()
            for hint in found:
                x[s + k, at + hint] = 1
            x[s + k, at + len(HINTS)] = hidden(attrs)
            here = (tag in ("article", "main"), 0 in found, tag in BOILER_TAGS, bool(found & BOILER) and 0 not in found)
            up = above[s + p.parent[k]] if k else np.zeros(4, np.int8)
            above[s + k] = up | here
    at += len(HINTS) + 1
    x[:, at] = total[:, 0] == 0
    at += 1
    x[rows, at + np.clip(np.log2(total[:, 0] + 1).astype(int) // 2, 0, 5)] = 1
    at += 6
    x[rows, at + np.digitize(total[:, 1] / np.maximum(total[:, 0], 1), [0.05, 0.35, 0.75])] = 1
    at += 4
    x[:, at] = own[:, 2] > 0
    x[:, at + 1] = np.minimum(1, 20 * own[:, 2] / np.maximum(own[:, 0], 1))
    x[:, at + 2] = own[:, 3] > 0
    at += 3
    x[rows, at + kind[np.maximum(parent, 0)]] = parent >= 0
    at += N_KINDS
    x[:, at : at + 4] = above
    x[:, at + 4] = (above[:, 0] > 0) & (above[:, 2] == 0) & (above[:, 3] == 0)
    return Forest(x, kind, parent, levels, starts)


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis, keepdims=True))).squeeze(axis)


def sum_product(f: Forest, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of nodes (n, 2), of edges (n, parent's label, child's label; zero at roots), and the log partition.
    unary: log potentials (n, 2); pair: by kind of the parent (kinds, 2, 2)."""
    n = len(unary)
    up, sent, down, edge = np.zeros((n, 2)), np.zeros((n, 2)), np.zeros((n, 2)), np.zeros((n, 2, 2))
    theta = pair[f.kind[np.maximum(f.parent, 0)]]
    for at in reversed(f.levels[1:]):
        sent[at] = _lse((unary[at] + up[at])[:, None, :] + theta[at], 2)
        np.add.at(up, f.parent[at], sent[at])
    for at in f.levels[1:]:
        p = f.parent[at]
        rest = unary[p] + up[p] + down[p] - sent[at]
        both = rest[:, :, None] + theta[at]
        down[at] = _lse(both, 1)
        down[at] -= down[at].max(1, keepdims=True)
        full = both + (unary[at] + up[at])[:, None, :]
        edge[at] = np.exp(full - _lse(full.reshape(-1, 4), 1)[:, None, None])
    belief = unary + up + down
    roots = f.levels[0] if n else np.empty(0, np.int64)
    return np.exp(belief - _lse(belief, 1)[:, None]), edge, float(_lse(belief[roots], 1).sum()) if n else 0.0


@dataclass
class Weights:
    unary: np.ndarray
    pair: np.ndarray

    def marginals(self, f: Forest) -> np.ndarray:
        score = f.x @ self.unary
        return sum_product(f, np.stack([np.zeros_like(score), score], 1), self.pair)[0][:, 1]


def labels_of(pages: list[Page], f: Forest) -> np.ndarray:
    """A node is content if most of the text in it is; one without text is as its parent."""
    n = f.starts[-1]
    sums = np.zeros((n, 2))
    for p, s in zip(pages, f.starts, strict=False):
        marked = np.zeros(len(p.tag), bool)
        for k, attrs in enumerate(p.attrs):
            marked[k] = MARK in attrs or (p.parent[k] >= 0 and marked[p.parent[k]] and not hints(attrs))
        for node, _, t, _ in p.pieces:
            sums[node + s, int(marked[node])] += len(t.strip())
    own = sums.sum(1) > 0
    for at in reversed(f.levels[1:]):
        np.add.at(sums, f.parent[at], sums[at])
    y = (sums[:, 1] > sums[:, 0]).astype(np.int64)
    for at in f.levels[1:]:
        y[at] = np.where(sums[at].sum(1) > 0, y[at], y[f.parent[at]])
    assert own.any() or not n
    return y


def fit(pages: list[Page], rounds: int = 140, l2: float = 0.001, rate: float = 0.2) -> Weights:
    """Adam on the exact log likelihood: observed less expected features."""
    f = forest(pages)
    y = labels_of(pages, f)
    n, child, x = len(y), np.flatnonzero(f.parent >= 0), f.x.astype(float)
    seen_pair = np.zeros((N_KINDS, 2, 2))
    np.add.at(seen_pair, (f.kind[f.parent[child]], y[f.parent[child]], y[child]), 1)
    w, pair = np.zeros(N_FEATURES), np.zeros((N_KINDS, 2, 2))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(pair), np.zeros_like(pair)]
    for k in range(1, rounds + 1):
        score = x @ w
        node, edge, _ = sum_product(f, np.stack([np.zeros(n), score], 1), pair)
        made = np.zeros_like(pair)
        np.add.at(made, f.kind[f.parent[child]], edge[child])
        for j, (theta, g) in enumerate(((w, x.T @ (y - node[:, 1]) / n - l2 * w), (pair, (seen_pair - made) / n - l2 * pair))):
            a, b = moments[2 * j], moments[2 * j + 1]
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            theta += rate * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-6)
    return Weights(w, pair)


@lru_cache(2)
def trained(pages: int = 260, seed: int = 1) -> Weights:
    """The model that the labelled pages of this seed give."""
    return fit([parse(h) for h in labelled_pages(pages, seed)])


def extract(htmls: list[str], w: Weights) -> list[str]:
    pages = [parse(h) for h in htmls]
    f = forest(pages)
    keep = w.marginals(f) > 0.5 if f.starts[-1] else np.zeros(0, bool)
    return ["\n".join(block_texts(p, keep[s : s + len(p.tag)])) for p, s in zip(pages, f.starts, strict=False)]


def extract_html(df: DataFrame, keep: tuple[str, ...] = (), html_col: str = "html", text_col: str = "text", weights: Weights | None = None) -> DataFrame:
    """The columns in keep and the main text of each row."""
    w = weights or trained()
    return map_texts(df, keep, F.coalesce(quoted(html_col), F.lit("")), [(text_col, T.StringType())], lambda x: [pa.array(extract(x.to_pylist(), w), pa.string())], rows=64)


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_html(read(spark, sf_dir, "pages"), ("page_id", "url"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
