"""Text functions and codecs on hand-checked values, and round trips."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from thresher.functions import codecs
from thresher.functions import text as tx


def values(spark, f, inputs, kind="string"):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], f"k int, x {kind}")
    return [r.y for r in df.select("k", f("x").alias("y")).orderBy("k").collect()]


def test_tokens(spark):
    got = values(spark, tx.tokens, ["The  quick, brown-fox!", r"back\slash · mark’s", " \n", "", None, "a_b c"])
    assert got == [["the", "quick", "brown", "fox"], ["back\\slash", "·", "mark’s"], [], [], [], ["a", "b", "c"]]
    assert values(spark, lambda c: tx.tokens(c, contractions=True), ["I cannot; gimme"]) == [["i", "can", "not", "gim", "me"]]
    assert values(spark, tx.raw_tokens, ["The Fox, ran"]) == [["The", "Fox,", "ran"]]
    assert values(spark, tx.distinct_terms, ["the fox the dog"]) == [["dog", "fox"]]
    assert values(spark, tx.content_words, ["the fox a x dog"]) == [["fox", "dog"]]


def test_soundex(spark):
    words = {"Ashcraft": "A226", "tymczak": "T522", "pfister": "P236", "advantages": "A315", "activity": "A231", "actvty": "A231", "2010": "0000", "": "0000", "é": "0000", "oh-my-god": "O523"}
    assert values(spark, tx.soundex, list(words)) == list(words.values())


def test_grams_and_rotations(spark):
    assert values(spark, tx.kgrams, ["the", "a", ""]) == [["$th", "the", "he$"], ["$a$"], []]
    assert values(spark, tx.rotations, ["abc", "a", ""]) == [["abc", "bca", "cab"], ["a"], []]
    df = spark.createDataFrame([(["a", "b", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert df.select(tx.jaccard("a", "b")).first()[0] == pytest.approx(1 / 3)
    assert df.select(tx.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))).first()[0] == 0


def test_sequences(spark):
    df = spark.createDataFrame([(list("abcab"), list("ca"), ["x"], [])], "s array<string>, p array<string>, q array<string>, e array<string>")
    got = df.select(tx.find_sequence("p", "s"), tx.find_sequence("q", "s"), tx.find_sequence("s", "p"), tx.span("s", F.lit(1), F.lit(3)), tx.bigrams("e"), F.size(tx.bigrams("s")), tx.positions("s", "b"), tx.has_phrase("s", ["b", "c"]), tx.has_phrase("s", ["c", "b"])).first()
    assert list(got) == [2, -1, -1, "bca", [], 4, [1, 4], True, False]


def test_codec_goldens(spark):
    one = lambda f, x, kind="array<bigint>": values(spark, f, [x], kind)[0]
    assert one(codecs.gamma, [2, 3, 4, 0]) == "10111000110010"
    assert one(codecs.gaps, [3, 7, 8]) == [3, 4, 1] and one(codecs.ungap, [3, 4, 1]) == [3, 7, 8]
    assert one(codecs.fixed_bytes, [1, 258]) == b"\x01" + b"\0" * 7 + b"\x02\x01" + b"\0" * 6
    assert one(codecs.variable_bytes, [5, 829]) == bytes([0x85, 0x06, 0xB8])  # gaps 5 and 824


def test_codec_round_trips(spark):
    rng = random.Random(1)
    lists = [None, [], [0], [2**62], *(sorted(rng.sample(range(rng.choice([200, 10**6, 2**40])), rng.randint(1, 60))) for _ in range(60))]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k int, p array<bigint>")
    for f, g in ((codecs.gaps, codecs.ungap), (codecs.gamma, codecs.ungamma), (codecs.fixed_bytes, codecs.from_fixed_bytes), (codecs.variable_bytes, codecs.from_variable_bytes)):
        assert [r.y for r in df.select("k", g(f("p")).alias("y")).orderBy("k").collect()] == lists


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(0, 2**60), max_size=30, unique=True).map(sorted))
def test_variable_bytes_alone(x):
    assert codecs.read_variable(codecs.write_variable(x)).tolist() == x


def test_segments(spark):
    words = ["中国", "科学", "学院", "科学院", "中国科学院", "a.b"]
    df = spark.createDataFrame([("中国科学院在a.b 北京x1",), ("",), (None,)], "t string")
    got = [list(r[0]) for r in df.select(tx.segments("t", words)).collect()]
    assert got == [["中国科学院", "在", "a.b", "北", "京", "x1"], [], []]
    search = [list(r[0]) for r in df.select(tx.segments("t", words, search=True)).collect()]
    assert search[0] == ["中国", "科学", "学院", "科学院", "中国科学院", "在", "a.b", "北", "京", "x1"]
