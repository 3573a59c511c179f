"""Boolean, phrase, tolerant and ranked retrieval on a small corpus, the persisted index, and the stream."""

from __future__ import annotations

import math
import random
import shutil

import pytest
from pyspark.sql import functions as F

from thresher.operators import boolean, index, rank, tolerant
from thresher.operators.boolean import Not, Op, Phrase, QueryError, Word
from thresher.streaming import index as stream

CORPUS = {
    0: "Easy to implement and clean. One of the advantages clean models have.",
    1: "Based on the day: a boolean of the based day.",
    2: "The boolean is based on the terms; it is the the disadvantage.",
    3: "Retrieval, of the activity based kind.",
    4: "",
    5: None,
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(CORPUS.items()), "doc_id long, text string")


@pytest.fixture(scope="module")
def stored(docs, tmp_path_factory):
    return index.Index.build(docs, str(tmp_path_factory.mktemp("index")))


QUERIES = {
    "based": {1, 2, 3}, "day": {1}, "boolean": {1, 2}, "BOOLEAN": {1, 2}, "the": {0, 1, 2, 3}, "based&&!day": {2, 3}, "day||boolean": {1, 2}, "(based&&!day)&&(based&&day)": set(), "!the": {4, 5},
    "((based&&!day)||boolean)||(based&&day)": {1, 2, 3}, "based&&day&&boolean": {1}, '"advantages clean"': {0}, '"easy to implement"&&the': {0}, '"the the"': {2}, '"of the"': {0, 1, 3}, '!"of the" && the': {2},
    "!!day": {1}, "nothing": set(), "!nothing": {0, 1, 2, 3, 4, 5}, '"on the" || clean': {0, 1, 2},
}


@pytest.mark.parametrize("query", QUERIES)
def test_boolean(docs, stored, query):
    assert {r.doc_id for r in boolean.search(docs, query).collect()} == QUERIES[query]
    assert {r.doc_id for r in boolean.search_index(stored, query).collect()} == QUERIES[query]


@pytest.mark.parametrize("query", ["", "a &&", "a b", "(a", "a)", '""', '"a', "a & b", "|| a", '"a b" "c d"'])
def test_ill_formed(query):
    with pytest.raises(QueryError):
        boolean.parse(query)


def test_random_expressions_against_sets(docs):
    rng, words = random.Random(3), ["the", "based", "day", "boolean", "clean", "of", "zzz"]
    texts = {i: (t or "").lower().translate(str.maketrans(":;.,", "    ")).split() for i, t in CORPUS.items()}

    def make(depth: int):
        k = rng.random()
        if depth == 0 or k < 0.25:
            w = rng.choice(words)
            return w, {i for i, t in texts.items() if w in t}
        if k < 0.45:
            s, x = make(depth - 1)
            return f"!({s})", set(CORPUS) - x
        (s, x), (t, y) = make(depth - 1), make(depth - 1)
        return (f"({s}) && ({t})", x & y) if k < 0.75 else (f"({s}) || ({t})", x | y)

    made = [make(4) for _ in range(25)]
    flags = docs.select("doc_id", *(boolean.compile_(boolean.parse(q), lambda w: F.array_contains(boolean.tx.tokens("text"), w.text)).alias(f"q{k}") for k, (q, _) in enumerate(made))).collect()
    for k, (q, want) in enumerate(made):
        assert {r.doc_id for r in flags if r[f"q{k}"]} == want, q


def test_parse_tree():
    assert boolean.parse('a || b && !"c d"') == Op("or", (Word("a"), Op("and", (Word("b"), Not(Phrase(("c", "d")))))))


def test_index(spark, docs, stored):
    assert stored.lookup("the").count() == 4 and stored.lookup("zzz").count() == 0
    assert [r.positions for r in stored.lookup("based").orderBy("doc_id").collect()] == [[0, 8], [3], [4]]
    assert {(r.term, r.cf, r.df) for r in stored.stats.where("term IN ('the', 'based')").collect()} == {("the", 8, 4), ("based", 4, 3)}
    assert [r.doc_id for r in stored.phrase(["the", "the"]).collect()] == [2]
    assert [r.term for r in stored.scan().collect()] == sorted({w for r in index.tokens(docs).collect() for w in [r.term]})
    stored.append(spark.createDataFrame([(9, "the zebra"), (0, "not taken")], "doc_id long, text string"))
    assert stored.lookup("zebra").first().doc_id == 9 and stored.documents.count() == 7 and stored.lookup("taken").count() == 0
    assert {(r.cf, r.df) for r in stored.stats.where("term = 'the'").collect()} == {(9, 5)}


def test_conjunction_and_ids(docs):
    t = index.doc_terms(docs, [])
    ids = lambda df: {r.doc_id for r in df.collect()}
    assert ids(index.conjunction(t, "based zzz day")) == {1} and ids(index.conjunction(t, "based zzz", strict=True)) == set() == ids(index.conjunction(t, "zzz")) == ids(index.conjunction(t, ""))
    found = {r.term: r.id for r in index.term_ids(index.tokens(docs)).collect()}
    assert found["easy"] == 0 and found["to"] == 1 and sorted(found.values()) == list(range(len(found)))
    assert index.term_ids(index.tokens(docs.limit(0))).count() == 0


def test_merge_keeps_repeats(spark):
    block = spark.createDataFrame([("a", [1, 3]), ("b", [2])], "term string, docs array<bigint>")
    got = {r.term: r.docs for r in index.merge_postings(block, spark.createDataFrame([("a", [2, 3])], block.schema)).collect()}
    assert got == {"a": [1, 2, 3, 3], "b": [2]}


def test_correction(spark, docs):
    vocab = tolerant.vocabulary(docs)
    words = spark.createDataFrame([(w,) for w in ("adavntages", "actvty", "based", "qqqq", "bolean")], "word string")
    assert {r.word: r.corrected for r in tolerant.correct(words, vocab).collect()} == {"adavntages": "advantages", "actvty": "activity", "based": "based", "qqqq": "qqqq", "bolean": "boolean"}
    best = tolerant.candidates(words.where("word = 'adavntages'"), vocab).where("rank = 1").first()
    assert best.term == "advantages" and best.distance == 2 and best.jaccard == pytest.approx(6 / 14)
    tree = tolerant.correct_query(spark, 'adavntages && "advantages claen"', vocab)
    assert {r.doc_id for r in boolean.search(docs, tree).collect()} == {0}
    assert {r.term for r in tolerant.wildcard_terms(vocab, "b*n").collect()} == {"boolean"}
    with pytest.raises(ValueError):
        tolerant.correct(words, vocab, pick="neither")


def test_vsm_and_bm25(spark, docs):
    got = {r.doc_id: r.score for r in rank.vsm_scores(docs, "based day based").collect()}
    based, day = math.log(6 / 3), math.log(6 / 1)
    q, d = {"based": 2 * based, "day": day}, {"based": 2 * based, "day": 2 * day}
    want = (2 * q["based"] * d["based"] + q["day"] * d["day"]) / (2 * d["based"] ** 2 + d["day"] ** 2)
    assert got == {1: pytest.approx(want)}
    assert rank.vsm_scores(docs, "zzz").count() == 0
    scores = {r.doc_id: r.score for r in rank.bm25_scores(docs, "day boolean").collect()}
    assert scores.keys() == {1, 2} and scores[1] > scores[2]
    assert [r.doc_id for r in rank.top(rank.bm25_scores(docs, "day boolean"), 1).collect()] == [1]
    files = spark.createDataFrame([("annual plan", "/a"), ("old list", "/b"), ("plan of list", "/c")], "hook string, linked_url string")
    assert {r.linked_url for r in rank.attachments(files, "plan list").collect()} == {"/a", "/b", "/c"}
    assert {r.linked_url for r in rank.attachments(files, "plan list", last_only=True).collect()} == {"/b", "/c"}


def test_stream(spark, docs, tmp_path):
    docs.where("doc_id < 2").coalesce(1).write.parquet(f"{tmp_path}/in")
    source = stream.document_stream(spark, f"{tmp_path}/in")
    stream.follow(source, f"{tmp_path}/index", f"{tmp_path}/state").awaitTermination()
    docs.where("doc_id >= 2").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream.follow(source, f"{tmp_path}/index", f"{tmp_path}/state").awaitTermination()
    ix = stream.opened(spark, f"{tmp_path}/index")
    assert {r.doc_id for r in ix.lookup("the").collect()} == {0, 1, 2, 3} and ix.documents.count() == 6
    assert {(r.cf, r.df) for r in ix.stats.where("term = 'the'").collect()} == {(8, 4)}
    assert {r.doc_id for r in boolean.search_index(ix, '"of the" && based').collect()} == {1, 3}


def test_an_interrupted_append_is_made_again(spark, tmp_path):
    t = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    ix = index.Index.build(t((1, "a b")), str(tmp_path / "ix"))
    ix.append(t((2, "b c"), (3, "c c")))
    (batch,) = [p for p in (tmp_path / "ix" / "documents").iterdir() if p.name not in ("batch=first",)]
    shutil.rmtree(batch)  # as if it had stopped before the last table
    ix.append(t((2, "b c"), (3, "c c"), (1, "not taken")))
    ix.append(t((3, "c c")))
    assert {(r.term, r.cf, r.df) for r in ix.stats.collect()} == {("a", 1, 1), ("b", 2, 2), ("c", 3, 2)}
    assert ix.lookup("c").count() == 2 and ix.documents.count() == 3


def test_an_index_is_deleted(spark, tmp_path):
    ix = index.Index.build(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), str(tmp_path / "gone"))
    assert ix.stats.count() == 2
    ix.delete()
    ix.delete()
    assert not (tmp_path / "gone").exists()
