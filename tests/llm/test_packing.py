"""Ids against the tokenizers library, packing against its contract, bounds against exhaustive search, and odd rows."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from compare import DATA
from test_pipeline import check_packing
from tokenizers import Tokenizer

from thresher.llm.packing import ByteTokens, best_fit, cut, lower_bound, pack, token_pieces
from thresher.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_are_the_library_s(library):
    rng, own = random.Random(4), ByteTokens(PATH)
    pools = ["abcdeE 's'll've", " \n\t\r\x0b\x0c\x1c\x85\xa0 　", "éßñçœ日本語한국어אבגדעربي", "0123456789½²٣", "!?.,;:#$%&*()[]<|>\\/", "‍́\U0001f600\U0001f1eb\x00\x7f﻿\U00010348"]
    texts = ["", "<|endoftext|>", " <|endoftext|> a", "a" * 5000, " " * 3000, "I'll  we've\n\n\n x"]
    texts += ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(1, 120))) for _ in range(3000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert own.encode(texts) == want


def test_added_tokens_in_texts(spark):
    t = Tokenizer.from_file(PATH)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "  <|endoftext|>  \n", "<|endoftext|", "<|<|endoftext|>|>", "'<|endoftext|>s", ""]
    want = [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
    assert ByteTokens(PATH).encode(texts) == want and np.array([50256], "<u4").tobytes() == want[1]
    rows = token_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).collect()
    assert {r.doc_id: r.ids_crc32 for r in rows} == {k: zlib.crc32(x + bytes(4)) for k, x in enumerate(want)}


def test_op6_keeps_its_contract(spark, library):
    sf = DATA / "sf0.01"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = {i: [*e.ids, 0] for i, e in zip(docs, library.encode_batch(list(docs.values()), add_special_tokens=False), strict=True)}
    rows = QUERIES["op6_packing"](spark, str(sf)).collect()
    check_packing(rows, ids)
    assert len({r.sequence_id for r in rows}) <= 1.002 * lower_bound(np.array([r.length for r in rows])) + 1


def test_cut():
    assert cut(5, 8) == [(0, 5)] and cut(8, 8) == [(0, 8)] and cut(17, 8) == [(0, 1), (1, 8), (9, 8)] and cut(16, 8) == [(0, 8), (8, 8)]


def fewest(lengths: list[int], capacity: int) -> int:
    for n in range(1, len(lengths) + 1):
        for of in itertools.product(range(n), repeat=len(lengths)):
            if all(sum(x for x, k in zip(lengths, of, strict=True) if k == j) <= capacity for j in range(n)):
                return n
    return 0


def test_bounds_hold_and_bins_are_sound():
    rng = random.Random(2)
    for _ in range(150):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 6))]
        a = np.array(lengths)
        bins, offsets = best_fit(a, 20)
        assert lower_bound(a, 20) <= fewest(lengths, 20) <= bins.max() + 1
        for j in range(bins.max() + 1):
            got = sorted((offsets[k], a[k]) for k in np.flatnonzero(bins == j))
            assert [o for o, _ in got] == np.cumsum([0, *(n for _, n in got)])[:-1].tolist() and sum(n for _, n in got) <= 20
    assert lower_bound(np.array([11] * 7), 20) == 7 and lower_bound(np.empty(0, np.int64), 20) == 0


def test_partitions_exchange_and_odd_rows(spark):
    rng = random.Random(8)
    rows = [(k % 700, " ".join("tok" for _ in range(rng.randint(0, 900))), "s") for k in range(1400)]
    rows += [(None, None, "s"), (None, "", "s"), (3, "x" * 90_000, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")
    pieces = token_pieces(docs, PATH)
    whole, dealt = pack(pieces).collect(), pack(pieces, part=200).collect()
    assert len(whole) == len(dealt) == pieces.count()
    for got in (whole, dealt):
        seqs: dict[int, list] = {}
        for r in got:
            seqs.setdefault(r.sequence_id, []).append(r)
        for ps in seqs.values():
            assert sum(r.length for r in ps) <= 2048 and sorted(r.offset for r in ps)[0] == 0
    assert len({r.sequence_id for r in dealt}) <= 1.04 * len({r.sequence_id for r in whole}) + 1
    assert pack(token_pieces(docs.limit(0), PATH)).count() == 0


def test_equal_rows_are_dealt_apart(spark):
    docs = spark.createDataFrame([(None, "tok tok tok")] * 3000 + [(4, "tok tok")] * 3000, "doc_id long, text string").repartition(4)
    rows = pack(token_pieces(docs, PATH), part=500, rounds=1).collect()
    sizes = np.unique([r.sequence_id >> 32 for r in rows], return_counts=True)[1]
    assert len(rows) == 6000 and len(sizes) == 12 and sizes.max() < 1000
