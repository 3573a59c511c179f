"""That steps which grew faster than their input don't any more: what is shuffled, and what a row costs."""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
from compare import same
from pyspark.sql import functions as F

from thresher.functions import codecs
from thresher.functions import text as tx
from thresher.operators import evaluate, graph, index, keywords, kg, tolerant, topics, training
from thresher.plans import queries


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_textrank_makes_no_rows_of_pairs(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma alpha"), (2, ""), (3, None), (4, "one")], "doc_id long, text string")
    df = keywords.textrank(docs, 2)
    assert "Exchange" not in plan_of(df) and "Generate" not in plan_of(df)
    got = [(r.doc_id, r["rank"], r.term) for r in df.orderBy("doc_id", "rank").collect()]
    assert got == [(1, 1, "alpha"), (1, 2, "gamma")]
    many = spark.range(3).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(300_000)), lambda x: F.concat(F.lit("w"), (x % 1000).cast("string")))).alias("text"))
    assert keywords.textrank(many, 2, iterations=2).count() == 6  # groups of rows are cut by words


def test_postings_of_rows_need_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None), (4, "a")], "doc_id long, text string")
    df = index.row_postings(docs)
    assert "Exchange" not in plan_of(df)
    assert {(r.doc_id, r.term): r.positions for r in df.collect()} == {(1, "a"): [1], (1, "b"): [0, 2], (4, "a"): [0]}


def test_runs_do_not_carry_all_words(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, ""), (3, None)], "doc_id long, text string").select("doc_id", tx.tokens("text").alias("w"))
    df = docs.select("doc_id", F.posexplode(tx.runs("w", 2)).alias("k", "tokens"))
    assert [(r.doc_id, r.k, r.tokens) for r in df.orderBy("k").collect()] == [(1, 0, ["a", "b"]), (1, 1, ["c", "d"]), (1, 2, ["e"])]


def test_arrays_of_triples_are_worked_out_once(spark):
    rows = spark.createDataFrame([(["a", "b", "c"], [(1, [("A0", 0, 0), ("A1", 2, 2)])]), (["d"], [])], f"tokens array<string>, frames {kg.FRAMES}")
    df = kg.triples(rows)
    assert "size(transform" not in plan_of(df)
    assert [(r.m_name, r.rel, r.n_name) for r in df.collect()] == [("a", "b", "c")]


def test_triples_are_compared_by_hashing(spark):
    rows = spark.createDataFrame([([("A  b", "p\nq", "C"), ("x", None, "y"), ("x", "", "y")], [("a b", "p\nq", "c"), (None, None, None)])], f"spo_list {evaluate.SPO}, spo_list_pred {evaluate.SPO}")
    r = evaluate.compare(rows).first()
    assert [tuple(x) for x in r.right] == [("a b", "p\nq", "c")] and [tuple(x) for x in r.new] == [("", None, "")]
    assert [tuple(x) for x in r.lack] == [("x", None, "y"), ("x", "", "y")]
    assert dict(rows.select(evaluate.comparable(F.col("spo_list")).alias("k")).dtypes)["k"] == "array<string>"


def test_topics_leave_words_off_the_driver(spark):
    docs = spark.createDataFrame([(d, " ".join(f"w{d % 7}x{j} all{j % 3}" for j in range(6))) for d in range(40)], "doc_id long, text string").repartition(5)
    model = topics.fit_lda(docs, k=2, iterations=1)
    assert topics.topic_words(model, 4).count() == 8
    assert [tuple(r) for r in topics.word_topics(model, spark.createDataFrame([("nowhere",)], "term string")).collect()] == [("nowhere", [0.0, 0.0])]
    # Rows of a part reach the right words of a block: in one step, the weights of all topics add up to the tf-idf of the words.
    weights = {t: sum(w) - 1 for r in topics._rows(model, lambda t, idf, w: pa.RecordBatch.from_arrays([t, topics._lists(w)], names=["t", "w"]), "t string, w array<double>").collect() for t, w in [r]}
    df = {t: sum(t in x.text.split() for x in docs.collect()) for t in weights}
    tf = {t: sum(x.text.split().count(t) for x in docs.collect()) for t in weights}
    assert all(abs(w - tf[t] * np.log(41 / (df[t] + 1))) < 1e-3 for t, w in weights.items()) and len(weights) == 45
    assert "pipeline" not in model.__dict__ and "_words" not in model.__dict__


def test_inference_stops_where_plain_steps_do():
    rng = np.random.default_rng(5)
    n = rng.integers(1, 40, 50)
    w, beta, alpha = rng.random(n.sum()) * 3, rng.dirichlet(np.ones(3), n.sum()).T, np.array([0.2, 0.3, 0.5])
    gamma, theta, ratio = topics.infer(n, w, beta, alpha, np.ones(3))
    ends = np.cumsum(n)
    for d in range(50):
        some = slice(ends[d] - n[d], ends[d])
        assert np.allclose(ratio[some] * (theta[:, d] @ beta[:, some]), w[some])
        assert np.abs(theta[:, d] * (beta[:, some] @ ratio[some]) + alpha - gamma[:, d]).mean() < 2 * topics.STILL


def test_predictions_need_no_shuffle(spark, tmp_path):
    text = "one two three four five six seven eight nine ten eleven twelve"
    for name, ids in (("once", [1, 2, 3, 4, None]), ("again", [1, 2, 2, 4, 4])):
        rows = list(zip(ids, [text, text[14:], "", None, "a b c d"], strict=True))
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / name / "documents.parquet"))
    df = queries.QUERIES["spo_compare"](spark, str(tmp_path / "once"))
    assert "Exchange" not in plan_of(df)
    assert {tuple(r) for r in df.collect()} == {(1, 2, 0, 1), (2, 1, 1, 1), (None, 1, 0, 0)}
    # Where an id repeats, its rows are one document.
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/again/documents.parquet/*.parquet')")
    assert same(queries.QUERIES["spo_compare"](spark, str(tmp_path / "again")), con, queries.SQL["spo_compare"]) == ""


def test_edges_of_runs_are_the_triples_of_their_rows(spark):
    words = [["a", "b", "c", "d", "e"], [], ["f"], ["a", "b", "c", "d"]]
    args = [("A0", 0, 1), ("A1", 3, 3), ("A2", 0, 4), ("ARGM-X", 0, 0), ("A0", 2, 2)]
    row, t = kg.run_edges(pa.array(words), 5, 2, args, "+")
    whole = [(n, w, [(2, [a for a in args if a[2] < len(w)])]) for n, w in enumerate(words) if len(w) > 2]
    want = kg.triples(spark.createDataFrame(whole, f"nth int, tokens array<string>, frames {kg.FRAMES}"), "+").collect()
    assert [(int(n), *x.values()) for n, x in zip(row, t.to_pylist(), strict=True)] == [tuple(r) for r in want]


def test_codecs_work_on_whole_batches():
    lists = [[1, 5, 900], None, [], [0], [2**62, 2**62 + 5], [7]]
    for some in (lists, [[]], [None], [], lists[2:]):
        a = pa.array(some, pa.list_(pa.int64()))
        for write, read in ((codecs.fixed_bytes, codecs.from_fixed_bytes), (codecs.variable_bytes, codecs.from_variable_bytes)):
            data = write.func(a)
            assert isinstance(data, pa.Array) and read.func(data).equals(a)
            assert read.func(data.slice(1)).equals(a.slice(1)) and write.func(a.slice(1)).equals(data.slice(1))
        assert codecs.ungap.func(pa.array([None if x is None else np.diff(x, prepend=0).astype(int).tolist() for x in some], a.type)).equals(a)


def test_postings_and_pairs_are_made_over_many_rows_at_once(spark):
    docs = spark.createDataFrame([(3, "b a b"), (1, "a b a b"), (2, ""), (4, None), (None, "c"), (1, "b a")], "doc_id long, text string").coalesce(1)
    lists, pairs = index.collection_postings(docs), tolerant.biwords(docs)
    for df in (lists, pairs):
        assert "Generate" not in plan_of(df)
    assert {r.term: r.docs for r in lists.collect()} == {"a": [1, 3], "b": [1, 3], "c": []}
    assert {tuple(r) for r in pairs.collect()} == {("b", "a", 3), ("a", "b", 2)}


def test_statements_are_parsed_in_one_match(spark):
    rows = [("A", "it's '})-[r:x]-(n:B{name:'y", "r", "B", "z"), ("A", "a", "r", "B", "u v\u0085w")]
    found = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in kg.EDGE))
    lines = kg.statements(found).union(spark.createDataFrame([("no statement",), (None,), ("",)], "line string"))
    df = kg.parse_statements(lines)
    assert "regexp_extract" not in plan_of(df) and {tuple(r) for r in df.collect()} == set(rows)


def test_examples_are_searched_for_once(spark):
    rows = spark.createDataFrame([("x", ["a", "b"], [(["a"], "p", ["b"])]), ("y", ["a"], [])], "id string, tokens array<string>, spo_list array<struct<subject:array<string>,predicate:string,object:array<string>>>")
    e = training.span_examples(rows, ["p"])
    assert plan_of(e).count("array_distinct(coalesce") == 1 and [r.id for r in e.collect()] == ["x"]
    # Ranges are sampled from what was written, not from examples made for that.
    made = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: (made.add(1), x)[1], "string").asNondeterministic()
    assert training.batches(e.withColumn("id", seen("id")), 4, ["id"]).count() == 1 and made.value == 1


def test_ranks_of_a_crawl_take_as_many_jobs_for_all_iterations(spark):
    # Links lead out of the crawl: pages that link are not linked, so iterations need no pass over the links.
    links = spark.createDataFrame([(f"p{k}", f"q{k * j % 7}") for k in range(9) for j in (1, 2, 3)] + [("p0", "q0")], "src string, dst string").distinct()
    sc, jobs = spark.sparkContext, []
    for name, options in (("few", {"iterations": 2}), ("many", {"iterations": 60}), ("converged", {"tolerance": 1e-14})):
        sc.setJobGroup(name, name)
        assert abs(sum(r.value for r in graph.pagerank(links, **options).collect()) - 1) < 1e-12
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(name)))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs[0] == jobs[1] == jobs[2]


def test_ranks_of_all_kinds_of_nodes(spark, monkeypatch):
    monkeypatch.setattr(graph, "LINKS", 4, raising=False)  # a hub's links are in several lists
    rows = [("h", f"x{k}") for k in range(20)] + [("h", "h"), ("x1", "h"), ("x2", "x3"), ("x3", "x2"), ("r1", "x1"), ("r1", "end"), ("r2", "x1"), ("r3", "end"), ("x1", "end"), ("h", "x5"), (None, "x9"), ("x9", None)]
    links = [x for x in rows if None not in x]
    nodes = sorted({x for e in links for x in e})
    n, out = len(nodes), {u: sum(a == u for a, _ in links) for u in nodes}
    x = dict.fromkeys(nodes, 1 / n)
    for k in range(1, 6):
        loose = sum(x[u] for u in nodes if not out[u])
        x = {v: 0.15 / n + 0.85 * (loose / n + sum(x[a] / out[a] for a, b in links if b == v)) for v in nodes}
        if k in (1, 2, 5):
            got = {r.node: r.value for r in graph.pagerank(spark.createDataFrame(rows, "src string, dst string"), iterations=k).collect()}
            assert got.keys() == x.keys() and max(abs(got[v] - x[v]) for v in nodes) < 1e-14
