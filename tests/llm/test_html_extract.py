"""The reader, exact marginals against enumeration, held-out accuracy, known pages and odd rows."""

from __future__ import annotations

import itertools
import re
import time
from html import unescape

import numpy as np
import pytest
from compare import DATA

from thresher.llm.html_dom import block_texts, parse
from thresher.llm.html_extract import N_KINDS, Forest, extract, extract_html, forest, labels_of, sum_product, trained
from thresher.llm.html_pages import labelled_pages
from thresher.llm.queries import QUERIES


def all_text(html: str) -> list[str]:
    p = parse(html)
    return block_texts(p, [True] * len(p.tag))


def test_reader():
    assert all_text("<p>a <b>b</b>\n c<p>d<br>e</p>f &amp; &eacute;&am &copy 2") == ["a b c", "d e", "f & é&am © 2"]
    assert all_text("<ul><li>a<li>b<ul><li>c</ul></ul>d<script>x<p>y</script>e<!-- no <p> -->f") == ["a", "b", "c", "def"]
    assert all_text('<p title="a > b">x</p><p title=\'q>\'>y</p><table><tr><td>1<td>2<tr><td>3</table>') == ["x", "y", "1", "2", "3"]
    assert all_text("a < b <3 <p>c</q></b>d<div") == ["a < b <3", "cd"]
    assert all_text("<head><title>t</title><style>s</style></head>") == [] == all_text("") == all_text("<!-- x")
    assert all_text("<script>never closed") == []


def test_reader_is_linear():
    for bad in ("<div>" * 100_000, "<p " * 50_000, '<a "' * 50_000, "<" * 200_000, "</p>" * 100_000, "<li>x" * 50_000, "<b>x" * 50_000, "&" * 200_000, "<!--" * 50_000):
        at = time.time()
        parse(bad)
        assert time.time() - at < 20


def test_marginals_are_exact():
    rng = np.random.default_rng(1)
    parent = np.array([-1, 0, 0, 1, 1, 2, -1, 6])
    kind = rng.integers(0, N_KINDS, 8)
    f = Forest(np.zeros((8, 1)), kind, parent, [np.array([0, 6]), np.array([1, 2, 7]), np.array([3, 4, 5])], [0, 8])
    unary, pair = rng.normal(size=(8, 2)), rng.normal(size=(N_KINDS, 2, 2))
    total, node = 0.0, np.zeros((8, 2))
    for y in itertools.product((0, 1), repeat=8):
        w = np.exp(sum(unary[k, y[k]] for k in range(8)) + sum(pair[kind[parent[k]], y[parent[k]], y[k]] for k in range(8) if parent[k] >= 0))
        total += w
        node[range(8), y] += w
    got, edge, log_z = sum_product(f, unary, pair)
    assert np.allclose(got, node / total) and np.isclose(log_z, np.log(total)) and np.allclose(edge[3].sum(0), got[3])


def test_held_out_pages():
    w, pages = trained(), [parse(h) for h in labelled_pages(150, 77)]
    f = forest(pages)
    y, m = labels_of(pages, f), w.marginals(f) > 0.5
    want = got = both = 0
    for p, s in zip(pages, f.starts, strict=False):
        a, b = (set(block_texts(p, k[s : s + len(p.tag)])) for k in (y, m))
        want, got, both = want + len(a), got + len(b), both + len(a & b)
    assert both / want > 0.93 and both / got > 0.93


def test_known_pages(spark):
    sf = DATA / "sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op10_html_extract"](spark, str(sf)).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"(?s)<article>(.*?)(</article>|<footer|$)", pages[r.page_id].html)[1].replace("<br>", " ")
        blocks = (" ".join(unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        assert r.text == "\n".join(x for x in blocks if x) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_article_among_everything_else():
    article = "<article><h1>A title</h1><p>First words of it, and more of them.</p><div class='ad'>Buy this now!</div><p>Short.</p><ul><li>One point</li><li>Another</li></ul></article>"
    page = (
        "<html><body><div class='cookie-banner'><p>We use cookies, please accept them.</p></div><header><a href='/'>Site</a></header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav>"
        f"<main>{article}</main><aside class=sidebar><p>Most read of all the pages here</p></aside><section id='comments'><div class='comment'><p>I disagree with all of this, it is wrong.</p></div></section>"
        "<form><label>Mail</label><input></form><footer>&copy; Site. All rights reserved.</footer></body></html>"
    )
    assert extract([page], trained()) == ["A title\nFirst words of it, and more of them.\nShort.\nOne point\nAnother"]


def test_odd_rows(spark):
    rows = [(1, None, "n"), (2, "", None), (3, "<div>" * 3000 + "x", "n"), (3, "<div>" * 3000 + "x", "n"), (4, "<article><p>" + "word, " * 60_000, "n"), (None, "plain", "n")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string").selectExpr("*", "1 AS main", "1 AS x", "1 AS __html", "1 AS `a.b`")
    found = extract_html(df, ("page_id", "text", "main", "x", "__html", "a.b"), text_col="main")
    assert found.columns == ["page_id", "text", "x", "__html", "a.b", "main"]
    got = found.collect()
    assert len(got) == 6 and {r.main for r in got if r.page_id in (1, 2)} == {""}
    assert next(len(r.main) for r in got if r.page_id == 4) == 359_999
    assert extract_html(df.limit(0), ("page_id",)).count() == 0


@pytest.mark.parametrize("make", [
    lambda n: "<div>" * n + "<body>" * n, lambda n: "<li><ul>" + "<span>" * n + "<li>x</li>" * n, lambda n: "<p><button>" + "<span>" * n + "<div></div>" * n, lambda n: "<b>" * n + "</i>" * n,
    lambda n: '<a x="' + '>" <a y="' * n, lambda n: "<div>" * n + "</p>" * n + "</div>" * n, lambda n: "<a <" * n, lambda n: "<!--" * n, lambda n: "&" * n + "<" * n, lambda n: "<table><td>" * n,
])
def test_reading_grows_with_the_length(make):
    def seconds(n):
        html, at = make(n), time.perf_counter()
        parse(html)
        return time.perf_counter() - at

    seconds(500)
    small, large = min(seconds(3000) for _ in range(3)), seconds(24_000)
    assert large < 24 * small + 0.2  # eight times as long; quadratic would be 64
