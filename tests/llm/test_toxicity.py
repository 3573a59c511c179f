"""Held-out accuracy, calibration and odd rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
from compare import DATA

from thresher.llm.queries import QUERIES
from thresher.llm.toxicity import FIXED, GRAMS, INSULTS, features, fit_trees, gram_counts, isotonic, learned_from, score_texts, train, undone


def area(score, label):
    order = np.argsort(score, kind="stable")
    _, inv, n = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[inv]
    ones = label.sum()
    assert len(order) == len(label)
    return (rank[label == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(label) - ones))


def test_held_out_accuracy(spark):
    sf = DATA / "sf0.01"
    got = QUERIES["op5_toxicity"](spark, str(sf)).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(r.score, label[r.doc_id]) for r in got if r.held_out and r.doc_id in label]
    score, y = map(np.array, zip(*rows, strict=True))
    assert area(score, y) > 0.85
    assert ((score >= 0.5) & (y == 0)).sum() <= 2


def test_scores_do_not_depend_on_held_out_labels(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id long, toxic int")
    assert {r.doc_id for r in learned_from(labels).collect()} == {k for k in range(50) if zlib.crc32(str(k).encode()) % 5}


def test_trees_learn_an_interaction_and_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = fit_trees(x[:3000], y[:3000])
    assert ((m.margin(x[3000:]) > 0) == y[3000:]).mean() > 0.97
    a, b = isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1]))
    assert b.tolist() == sorted(b.tolist()) and b[0] == 0 and b[-1] == 1 and 0.5 in b


def test_odd_rows(spark):
    rng = random.Random(1)
    text = lambda bad: " ".join(rng.choice(["idiot", "scum", "you"] if bad and k % 4 == 0 else ["tree", "house", "river"]) for k in range(60))
    rows = [(k, text(k % 2), "q") for k in range(300)]
    odd = [(900, None, "q"), (901, "", None), (None, "you idiot", "q"), (902, "x" * 200_000, "q"), (902, "x" * 200_000, "q")]
    docs = spark.createDataFrame([*rows, *odd], "doc_id long, text string, label string").selectExpr("*", *(f"1 AS `{c}`" for c in ("id", "__id", "score", "x", "__text", "fold", "first", "a.b")))
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)] + [(None, 1), (5, None), (6, 7)], "doc_id long, toxic int")
    m = train(docs, labels)
    found = score_texts(docs, m, tuple(docs.columns))
    assert found.columns == [*(c for c in docs.columns if c != "score"), "score"]
    got = found.collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r.score for r in got}
    assert by[900] == by[901] and all(by[k] < 0.5 for k in range(0, 300, 2)) and all(by[k] > 0.5 for k in range(1, 300, 2))
    assert score_texts(docs.limit(0), m, ("doc_id",)).count() == 0
    alone = train(docs, labels.where("toxic = 0"))
    assert {r.score for r in score_texts(docs, alone).collect()} == {0.0}
    assert {r.score for r in score_texts(docs, train(docs, labels.limit(0))).collect()} == {0.0}


def test_features_by_plain_code():
    """Densities, words near a second person, and trees, each by its definition."""
    text = "You are an IDIOT and a m0ron, honestly!! s c u m f*ck st*pid xx 12 a1b the idiots of tomorrow; worthless."
    f = dict(zip(FIXED, features(text, ("idiot", "iots")), strict=False))
    n = 23
    words = ["you", "are", "an", "idiot", "and", "a", "m0ron", "honestly", "s", "c", "u", "m", "f*ck", "st*pid", "xx", "12", "a1b", "the", "idiots", "of", "tomorrow", "worthless"]
    n = len(words)
    assert f["insults"] == f["insults_en"] == 3 / n and f["insults_de"] == 0 and f["undone"] == 6 / n
    assert f["near_you"] == 2 / n  # idiot by You; idiots seven words after "u"... and worthless too far
    assert f["shouted"] == 1 / n and f["mixed"] == 4 / n and f["spaced"] == 1 / n and f["exclamation"] == 2 / n
    assert f["distinct"] == len(set(words)) / n and f["log_words"] == np.log1p(n)
    plain = len(text.split())
    assert features(text, ("idiot", "iots"))[len(FIXED) :] == [2 / plain, 1 / plain]
    assert gram_counts("aaaa", ("aa", "aaa")) == [3, 2] and gram_counts("x", ()) == []
    assert undone("1d10t") and undone("$hit") and undone("f*ck") and not undone("w0rd") and not undone("***")
    assert all(x == x.lower() and " " not in x for x in INSULTS)


def test_trees_by_plain_code():
    rng = np.random.default_rng(5)
    x = rng.random((600, 4)).round(2)
    m = fit_trees(x, (x[:, 1] + x[:, 2] > 1).astype(float), rounds=20)

    def one(row):
        bins = [sum(c < v for c in cuts) for v, cuts in zip(row, m.cuts, strict=True)]
        total = m.base
        for feature, split, leaf in zip(m.feature, m.split, m.leaf, strict=True):
            at = 0
            while at < len(feature):
                at = 2 * at + (2 if bins[feature[at]] > split[at] else 1)
            total += leaf[at - len(feature)]
        return total

    assert np.allclose(m.margin(x), [one(r) for r in x])


def test_fragments_are_chosen_and_calibrated_out_of_fold(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(["blorfik"] * (k % 2) + [rng.choice(["tree", "house", "river", "cloud"]) for _ in range(30)])) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    m = train(docs, spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, toxic int"))
    assert any(g in "blorfik" for g in m.grams) and len(m.grams) <= GRAMS
    s = m.score([t for _, t in rows])
    assert ((s > 0.5) == np.arange(400) % 2).all() and set(m.knots[1]) <= {0.0, 1.0}
