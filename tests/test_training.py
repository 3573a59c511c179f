"""Examples, batches, best epochs and averaged weights against plain Python."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from thresher.operators import training

ROWS = "id string, tokens array<string>, spo_list array<struct<subject:array<string>,predicate:string,object:array<string>>>, found int"


def test_examples(spark):
    t = "a b c a b d".split()
    rows = [
        ("one", t, [(["a", "b"], "p", ["c"]), (["c"], "q", ["b", "d"]), (["a", "b"], "q", ["d"]), (["a", "b"], "q", ["d"])], 1),
        ("none", t, [(["x"], "p", ["c"]), (["a"], "other", ["c"]), ([], "p", ["c"]), (None, "p", None)], 1),
        ("null", None, None, 1), ("empty", [], [(["a"], "p", ["a"])], 1), (None, ["u"], [(["u"], "p", ["u"]), None], 1), (None, ["u"], [(["u"], "p", ["u"])], 1),
    ]
    df = spark.createDataFrame(rows, ROWS)
    e = training.span_examples(df, ["p", "q"])
    got = {r.id: r for r in e.collect()}
    assert set(got) == {"one", None} and e.count() == 3
    assert [tuple(x) for x in got["one"].subjects] == [(0, 1), (2, 2)]
    objects = {(0, 1): {(2, 2, 0), (5, 5, 1)}, (2, 2): {(4, 5, 1)}}
    draws = set()
    for seed in range(20):
        r = training.span_examples(df.where("id = 'one'"), ["p", "q"], seed).first()
        draws.add(tuple(r.subject))
        assert {tuple(x) for x in r.objects} == objects.get(tuple(r.subject), set())
    assert draws == {(0, 1), (0, 2), (2, 2)}
    assert training.span_examples(df, []).count() == 0 and training.span_examples(df.limit(0), ["p"]).count() == 0


def test_labels_and_batches(spark):
    rows = [(f"{k:02}", ["w"] * (k % 5) + ["a", "b"], [(["a"], "p", ["b"])], 0) for k in range(11)]
    e = training.span_examples(spark.createDataFrame(rows, ROWS), ["p", "q"])
    got = sorted(training.batches(e, 4, ["id"], pad="").collect())
    assert [(b.batch, [r.id for r in b.rows]) for b in got] == [(n, [f"{k:02}" for k in range(11)[4 * n : 4 * n + 4]]) for n in range(3)]
    for b in got:
        longest = max(r.n_tokens for r in b.rows)
        assert all(len(r.tokens) == longest and r.tokens[r.n_tokens :] == [""] * (longest - r.n_tokens) for r in b.rows)
    m = e.where("id = '02'").select(training.subject_labels(F.col("subjects"), F.lit(5)).alias("s"), training.object_labels(F.col("objects"), F.lit(4), 2).alias("o"), training.subject_labels(F.col("subjects"), F.lit(0)).alias("z")).first()
    o = np.zeros((4, 2, 2), int)
    o[3, 0] = 1
    assert m.s == [[0, 0], [0, 0], [1, 1], [0, 0], [0, 0]] and np.array(m.o).tolist() == o.tolist() and m.z == []
    assert training.batches(e.limit(0), 4, ["id"]).count() == 0


def test_epochs_keep_the_last_of_the_best(spark):
    t = lambda *x: [(s, "p", "o") for s in x]
    rows = [(0, t("a", "b"), t("a")), (1, t("a", "b"), t("a", "b")), (2, t("a", "b"), t()), (3, t("a", "b"), t("b", "a"))]
    spo = "array<struct<subject:string,predicate:string,object:string>>"
    got = training.epochs(spark.createDataFrame(rows, f"epoch int, spo_list {spo}, spo_list_pred {spo}")).orderBy("epoch").collect()
    assert [r.kept for r in got] == [True, True, False, True]
    assert [r.best for r in got] == [pytest.approx(x) for x in (2 / 3, 1, 1, 1)]


def test_averaged_weights(spark):
    rng = np.random.default_rng(3)
    steps = {n: rng.normal(size=(k, 4)) for n, k in (("a", 30), ("b", 1))}
    rows = [(n, k, [float(x) for x in w]) for n, ws in steps.items() for k, w in enumerate(ws)]
    rng.shuffle(rows)
    rows = [(str(n), int(k), list(w)) for n, k, w in rows]
    got = {r.name: r.weights for r in training.averaged_weights(spark.createDataFrame(rows, "name string, step int, weights array<double>"), 0.9).collect()}
    for n, ws in steps.items():
        want = ws[0]
        for w in ws[1:]:
            want = 0.9 * want + (1 - 0.9) * w
        assert got[n] == pytest.approx(want.tolist())
