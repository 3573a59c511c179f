"""Exact and line dedup against brute force on odd and hot rows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from thresher.llm.exact_dedup import exact_dedup, exact_groups
from thresher.llm.line_dedup import line_bitmaps, line_dedup

ROWS = [(k, random.Random(k % 7).choice(["aa", "AA", "Ab", "a" * 300 + str(k % 3), "É", "é", ""]), "d") for k in range(80)] + [(90, None, "d"), (91, "", "d"), (91, "", "d"), (None, "aa", "d"), (None, "only", None), (95, "q" * 400_000, "d"), (96, "q" * 400_000, "d")]


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, keep_id string").repartition(4)
    return df.selectExpr("*", *(f"1 AS `{c}`" for c in ("id", "_id", "__id", "digest", "__digest", "n", "p", "d", "t", "row", "a.b")))


@pytest.mark.parametrize("options", [{}, {"digest_all": True}, {"prefix": 1}, {"broadcast_keys": 0}])
def test_exact_groups(docs, options):
    size = Counter(low(t) for _, t, _ in ROWS)
    most = {}
    for i, t, _ in ROWS:
        most[low(t)] = max(i if i is not None else -1, most.get(low(t), -1))
    got = exact_groups(docs, **options).collect()
    assert Counter((r.id, r.keep_id, r.group_size) for r in got) == Counter((i, most[low(t)] if most[low(t)] >= 0 else None, size[low(t)]) for i, t, _ in ROWS)
    assert sum(r.kept for r in got) == len(size)
    if options.get("digest_all"):
        assert {bytes(r.d).hex() for r in got} == {hashlib.sha256(t.encode()).hexdigest() for t in size}


def test_exact_dedup(docs):
    got = exact_dedup(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert sorted(low(r.text) for r in rows) == sorted({low(t) for _, t, _ in ROWS})
    assert exact_groups(docs.limit(0)).count() == 0 and exact_dedup(docs.limit(0)).count() == 0


def lines_of(rng):
    return "\n".join(rng.choice(["shared", " Shared\t", "SHARED", "", "  ", f"own{rng.random()}", "rare", "\x0bpage\r"]) for _ in range(rng.randint(0, 12)))


def test_line_dedup(spark):
    rng = random.Random(4)
    rows = [(k, lines_of(rng), "n") for k in range(60)] + [(70, None, "n"), (71, "", "n"), (None, "shared\nx", "n"), (72, "shared\n" * 50_000, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines string").selectExpr("*", *(f"1 AS `{c}`" for c in ("id", "k1", "__k1", "runs", "lines", "_lines", "line", "pos", "a.b")))
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    n = Counter(k for _, t, _ in rows for k in {key(x) for x in (t or "").split("\n")})
    gone = {k for k, c in n.items() if c >= 10 and k}
    want = {i: "\n".join(x for x in (t or "").split("\n") if key(x) not in gone) for i, t, _ in rows}
    got = line_dedup(df, min_docs=10).collect()
    assert {r.doc_id: r.text for r in got} == want and len(got) == len(rows)
    for r, t in ((r, next(t for i, t, _ in rows if i == r.doc_id)) for r in got):
        assert r.n_lines == len((t or "").split("\n")) and r.n_dropped == sum(key(x) in gone for x in (t or "").split("\n"))
    assert line_dedup(df.limit(0)).count() == 0 and set(line_dedup(df).columns) == {*df.columns, "n_dropped"}
    first = {r.doc_id: r.text for r in line_dedup(df.where("doc_id < 60"), min_docs=10, mode="first").collect()}
    assert sum(key(x) == "shared" for t in first.values() for x in t.split("\n")) == 1
    with pytest.raises(ValueError):
        line_bitmaps(df, mode="some")


def test_line_dedup_counts_equal_rows_once(spark):
    def dropped(rows):
        return sum(r.n_dropped for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=10).collect())

    assert dropped([(7, "a\nb")] * 12) == dropped([(None, "a\nb")] * 12) == 0
    assert dropped([(7, f"a\n{k}") for k in range(10)]) == dropped([(None, f"a\n{k}") for k in range(10)]) == 10
    assert dropped([(k, "a\nb") for k in range(10)] + [(3, "a\nb")]) == 22
