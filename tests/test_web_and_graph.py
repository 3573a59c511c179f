"""Crawl rules, PageRank, keywords, the knowledge graph, evaluation, readers and writers on small tables."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from thresher.operators import crawl, evaluate, graph, keywords, kg, topics
from thresher.sources import files, sinks


def test_page(spark):
    html = "<html><title> A &amp; B </title><script>'<p>no</p>'</script><p>First one here</p><p>tiny</p><p>has <b>tags</b></p><p class=x>copyright notice</p><p>Last &amp; best</p><a id=1 href=\"/x.htm\"><b>go</b> on</a><a href='/no'>n</a>"
    df = spark.createDataFrame([("http://h.edu/a", html), ("http://h.edu/b", None)], "url string, html string")
    r = df.select(crawl.page_title(F.col("html")).alias("t"), crawl.page_text(F.col("html")).alias("x")).collect()
    assert (r[0].t, r[0].x) == ("A &amp; B", "First one here Last & best") and r[1].t is None
    assert [tuple(x) for x in crawl.links(df).collect()] == [("http://h.edu/a", 0, "/x.htm", "go on")]


def test_link_rules(spark):
    rows = [("http://h.edu", h, "t") for h in ("http://h.edu/z", "http://bbs.h.edu", "http://h.edu", "/a.html", "/b.pdf", "/c.docx", "/d", "x.pdf", "/h.edu/e.htm")] + [("http://h.edu/p.htm", "/q.html", "t")]
    got = {(r.linked_url, r.kind) for r in crawl.link_rules(spark.createDataFrame(rows, "base_url string, href string, hook string"), "h.edu").collect()}
    assert got == {("http://h.edu/z", "site"), ("http://h.edu/a.html", "page"), ("http://h.edu/b.pdf", "pdf"), ("http://h.edu/c.docx", "doc"), ("/h.edu/e.htm", "site"), ("http://h.edu/h.edu/e.htm", "page")}


def test_frontier(spark):
    t = lambda *x: spark.createDataFrame([(u,) for u in x], "url string")
    todo, used = crawl.frontier_step(t("a", "b", "b", "c", None), t("c", "d"), t("a"))
    assert {r.url for r in todo.collect()} == {"b", "c", "d"} and sorted(r.url for r in used.collect()) == ["a", "b", "c", "d"]
    assert {r.url for r in crawl.remove_urls(t("a", "b"), t("a")).collect()} == {"b"}
    table = spark.createDataFrame([(1, "a", None), (2, "b", "old")], "id int, url string, title string")
    assert {r.url: r.title for r in crawl.with_titles(table, spark.createDataFrame([("a", "new")], "url string, title string")).collect()} == {"a": "new", "b": "old"}
    assert tuple(crawl.agreement(t("a"), t("a", "b"), t("a", "b", "c")).first()) == (3, 2)


def test_pagerank(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = {r.node: r.value for r in graph.pagerank(e, tolerance=1e-12).collect()}
    nodes, out = "abcd", {"a": ["b"], "b": ["a"], "c": ["a", "d"], "d": []}
    x = dict.fromkeys(nodes, 0.25)
    for _ in range(200):
        loose = x["d"] / 4
        x = {n: 0.15 / 4 + 0.85 * (loose + sum(x[m] / len(out[m]) for m in nodes if n in out[m])) for n in nodes}
    assert got == {n: pytest.approx(x[n], abs=1e-6) for n in nodes} and sum(got.values()) == pytest.approx(1)
    assert graph.pagerank(e.limit(0), iterations=2).count() == 0
    pages = spark.createDataFrame([("a",), ("z",)], "url string")
    assert {r.url: r.value for r in graph.with_ranks(pages, graph.pagerank(e, iterations=3)).collect()}["z"] == 1e-6


def test_converged_pagerank_in_full_precision(spark):
    rng = np.random.default_rng(7)
    n, links = 2000, sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 1500, 6000), (rng.pareto(1, 6000) * 40).astype(int) % 2000, strict=True)})
    got = {r.node: r.value for r in graph.pagerank(spark.createDataFrame(links, "src long, dst long"), tolerance=1e-12).collect()}
    nodes = sorted({x for e in links for x in e})
    at, n = {x: k for k, x in enumerate(nodes)}, len(nodes)
    a, b = np.array([[at[x], at[y]] for x, y in links]).T
    out, x = np.bincount(a, minlength=n), np.full(n, 1 / n)
    for _ in range(300):
        x = 0.15 / n + 0.85 * (x[out == 0].sum() / n + np.bincount(b, x[a] / out[a], minlength=n))
    want = dict(zip(nodes, x.tolist(), strict=True))
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-8
    assert max(want.values()) - min(want.values()) > 1e-3  # a uniform result differs


def test_textrank_returns_k_whatever_the_iterations(spark):
    docs = spark.createDataFrame([(1, " ".join(f"word{chr(97 + i % 20)}" for i in range(90)))], "doc_id long, text string")
    assert [keywords.textrank(docs, k, iterations=n).count() for k, n in ((5, 7), (3, 2))] == [5, 3]


def test_keywords_and_topics(spark, tmp_path):
    docs = spark.createDataFrame([(1, "apple apple pear river"), (2, "river river stone"), (3, ""), (4, None), (5, "stone pear apple")], "doc_id long, text string")
    top = {(r.doc_id, r.rank): r.term for r in keywords.keywords(docs, 1).collect()}
    assert top == {(1, 1): "apple", (2, 1): "river", (5, 1): "stone"}
    assert {r.doc_id for r in keywords.textrank(docs, 2).collect()} == {1, 2, 5}
    pairs = {(r.a, r.b): r.n for r in keywords.cooccurrences(docs.where("doc_id = 2")).collect()}
    assert pairs == {("river", "stone"): 2, ("stone", "river"): 2}
    model = topics.fit_lda(docs, k=2, iterations=3)
    assert all(sum(r.topics) == pytest.approx(1) or sum(r.topics) == 0 for r in topics.document_topics(model, docs).collect())
    topics.save(model, f"{tmp_path}/m")
    assert topics.document_topics(topics.load(f"{tmp_path}/m"), docs).count() == 5
    assert len(topics.fit_lsi(docs, k=2)[1]) == 2


def test_lda_takes_all_documents_and_words(spark):
    # Each word is in one document only, so a document that is left out leaves its words without weight of their own.
    docs = spark.createDataFrame([(d, " ".join(f"w{d}x{j}" for j in range(10))) for d in range(600)], "doc_id long, text string").repartition(3)
    model = topics.fit_lda(docs, k=2, iterations=2)
    assert len(model.stages[0].vocabulary) == 6000
    weight = model.stages[2].topicsMatrix().toArray().sum(1)
    assert weight.min() > 0.5 * weight.max() > 0
    got = topics.word_topics(model, docs.selectExpr("explode(split(text, ' ')) AS term")).collect()
    assert len(got) == 6000 and all(sum(r.topics) == pytest.approx(1) for r in got)
    assert topics.topic_keywords(model, docs, k=20).count() == 6000
    assert topics.topic_words(model, 3).count() == 6


def test_lsi_decomposes_all_words(spark):
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(d, " ".join(f"w{x}" for x in (rng.pareto(0.7, 60) * 20).astype(int) % 4000)) for d in range(300)], "doc_id long, text string")
    vec, values, terms = topics.fit_lsi(docs, k=3)
    rows = vec.transform(topics.words(docs)).select("tfidf").collect()
    m = np.array([r.tfidf.toArray() for r in rows])
    _, want, v = np.linalg.svd(m, full_matrices=False)
    assert m.shape[1] == docs.selectExpr("explode(split(text, ' '))").distinct().count() > 1000
    assert values == pytest.approx(want[:3].tolist())
    got = {r.term: r.weights for r in terms.collect()}
    w = np.array([got[t] for t in vec.stages[0].vocabulary])
    assert np.allclose(np.abs((w * v[:3].T).sum(0)), 1)


FRAME = (["Ann", "B", "likes", "red", "tea", "today"], [(2, [("A0", 0, 1), ("A0-CRD", 5, 5), ("A1", 3, 4), ("ARGM-TMP", 5, 5)]), (4, [("A1", 3, 3)])])


def test_knowledge_graph(spark, tmp_path):
    rows = spark.createDataFrame([(7, *FRAME), (8, *FRAME), (9, [], [])], f"doc_id long, tokens array<string>, frames {kg.FRAMES}")
    t = kg.triples(rows)
    assert {tuple(r) for r in t.where("doc_id = 7").collect()} == {(7, "A0", "AnnB", "likes", "A1", "redtea"), (7, "A0", "AnnB", "likes", "A0-CRD", "today")}
    sinks.write_statements(t, f"{tmp_path}/s")
    back = files.read_statements(spark, f"{tmp_path}/s")
    assert "merge (m:A0{name:'AnnB'})-[r:likes]-(n:A1{name:'redtea'}) ON CREATE SET r.value=1 on match set r.value=r.value+1;" in {r.line for r in back.collect()}
    assert sorted(kg.parse_statements(back).collect()) == sorted(t.drop("doc_id").collect())
    assert files.read_statements(spark, f"{tmp_path}/s", first_line_only=True).count() == files.read_statements(spark, f"{tmp_path}/s").select("path").distinct().count()
    g = kg.merge_edges(t)
    assert {(r.m_name, r.n_name, r.value) for r in g.collect()} == {("AnnB", "redtea", 2), ("AnnB", "today", 2)}
    turned = t.select(F.col("n_label").alias("m_label"), F.col("n_name").alias("m_name"), "rel", F.col("m_label").alias("n_label"), F.col("m_name").alias("n_name"))
    assert {r.value for r in kg.merge_edges(turned, g).collect()} == {4}
    assert {r.name for r in kg.neighbours(g, "redtea", "likes").collect()} == {"AnnB"}
    ask = spark.createDataFrame([(["who", "likes", "red", "tea"], [(1, [("A1", 2, 3)])]), (["x"], [(0, [])])], f"tokens array<string>, frames {kg.FRAMES}")
    assert [(r.name, r.value, r.asked) for r in kg.answer(g, ask).collect()] == [("AnnB", 2, "object")]
    both = spark.createDataFrame([(["AnnB", "likes", "redtea"], [(1, [("A0", 0, 0), ("A0", 0, 0), ("A1", 2, 2)])])], ask.schema)
    assert sorted((r.name, r.asked) for r in kg.answer(g, both).collect()) == [("AnnB", "object")] * 2 + [("redtea", "subject")] * 2 + [("today", "subject")] * 2


def test_evaluation(spark, tmp_path):
    rows = [("t1", [("A b", "is", "c"), ("d", "is", "e")], [("a  B", "is", "c"), ("x", "is", "y")]), ("t2", None, [("q", "r", "s")]), ("t3", [], None)]
    df = spark.createDataFrame(rows, f"text string, spo_list {evaluate.SPO}, spo_list_pred {evaluate.SPO}")
    r = evaluate.scores(df).first()
    assert (r.precision, r.recall, r.f1) == (pytest.approx(1 / 3), pytest.approx(1 / 2), pytest.approx(2 / 5))
    assert evaluate.scores(df.limit(0)).first().f1 == pytest.approx(1)
    sinks.write_predictions(df, f"{tmp_path}/p")
    back = [json.loads(x.value) for x in spark.read.text(f"{tmp_path}/p").collect()]
    assert {x["text"]: (len(x["new"]), len(x["lack"])) for x in back} == {"t1": (1, 1), "t2": (1, 0), "t3": (0, 0)}
    s = spark.createDataFrame([([0.7, 0.1, 0.9], [0.2, 0.6, 0.1], [[0.7, 0.0], [0.0, 0.9]], [[0.0, 0.9], [0.8, 0.0]])], "a array<double>, b array<double>, c array<array<double>>, d array<array<double>>")
    got = s.select(evaluate.decode_spans(F.col("a"), F.col("b")).alias("x"), evaluate.decode_objects(F.col("c"), F.col("d")).alias("y")).first()
    assert [tuple(p) for p in got.x] == [(0, 1)] and [tuple(p) for p in got.y] == [(0, 1, 0)]


def test_readers_and_writers(spark, tmp_path):
    for p, x in {"b/x.txt": "one\ntwo", "a/y.txt.bak": "three", "a/z.md": "no"}.items():
        (tmp_path / "d" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "d" / p).write_text(x)
    got = files.read_texts(spark, f"{tmp_path}/d").orderBy("doc_id").collect()
    assert [(r.doc_id, r.path.rsplit("/", 1)[1], r.text) for r in got] == [(0, "y.txt.bak", "three"), (1, "x.txt", "one\ntwo")]
    assert {(r.block, r.text) for r in files.read_blocks(spark, f"{tmp_path}/d").collect()} == {("b", "one\ntwo"), ("a", "three"), ("a", "no")}
    assert {r.text for r in files.read_lines(spark, f"{tmp_path}/d/b/x.txt").collect()} == {"one", "two"} == {r.word for r in files.read_words(spark, f"{tmp_path}/d/b/x.txt").collect()}
    (tmp_path / "l.csv").write_text("0,h,/x,/b\n1,h,/x,/b\n2,h2,/y,/b\nbad\n")
    assert {tuple(r) for r in graph.edges_of(files.read_links(spark, f"{tmp_path}/l.csv"), "base", "link").collect()} == {("/b", "/x"), ("/b", "/y")}
    (tmp_path / "t.json").write_text('{"text": "t", "spo_list": [{"subject": "a", "predicate": "p", "object": "b"}]}\n')
    assert files.read_triples(spark, f"{tmp_path}/t.json").first().spo_list[0].predicate == "p"
    (tmp_path / "s.json").write_text('{"predicate": "z", "x": 1}\n{"predicate": "a"}\n{"predicate": "z"}\n')
    assert {r.predicate: r.id for r in files.read_predicates(spark, f"{tmp_path}/s.json").collect()} == {"z": 0, "a": 1}
    pages = spark.createDataFrame([(1, "long enough text"), (2, "short")], "id long, text string")
    sinks.write_page_texts(pages, f"{tmp_path}/pages")
    assert [r.id for r in spark.read.parquet(f"{tmp_path}/pages").collect()] == [1]
    sinks.log_query(spark, f"{tmp_path}/log", "u", "normal", "q")
    sinks.log_query(spark, f"{tmp_path}/log", "u", "normal", "q")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 2
    sinks.replace(pages, f"{tmp_path}/r")
    sinks.append(pages, f"{tmp_path}/r")
    assert spark.read.parquet(f"{tmp_path}/r").count() == 4
    sinks.write_fields(spark.createDataFrame([("A b", "/p", "b c b")], "title string, path string, content string"), f"{tmp_path}/f")
    assert {(r.field, r.term): r.positions for r in spark.read.parquet(f"{tmp_path}/f").collect()} == {("title", "a"): [0], ("title", "b"): [1], ("content", "b"): [0, 2], ("content", "c"): [1]}
