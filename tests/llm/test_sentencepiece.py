"""Ids and decoded texts against the sentencepiece library."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from compare import DATA

from thresher.llm.queries import QUERIES
from thresher.llm.sentencepiece_bpe import PieceModel, encode_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_are_the_library_s(library):
    rng, own = random.Random(2), PieceModel(PATH)
    pools = ["abcdehlost", "   ", "▁▁ ", "éßñœ日本語한국אבгд", "0123456789", "!?.,<>/s[]", "\n\t\r\x00\u200b\xa0\U0001f600\U0001f1eb", "aaaa"]
    texts = ["", " ", "  ", "▁", "</s>", "<s> a <unk>", "a" * 3000, " " * 1000, "x" + " " * 777 + "y", "<0x41>", "\n\n\n", "�"]
    texts += ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(1, 80))) for _ in range(3000)]
    for t in texts:
        ids = library.encode(t)
        assert own.encode(t) == ids, repr(t)
        assert own.decode(ids) == library.decode(ids), repr(t)


def test_decoding_any_ids(library):
    rng, own = random.Random(3), PieceModel(PATH)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(3, 259), rng.randrange(3)]) for _ in range(rng.randint(0, 12))]
        assert own.decode(ids) == library.decode(ids), ids


def test_op3(spark, library):
    sf = DATA / "sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op3_sentencepiece"](spark, str(sf)).collect()}
    assert got == want


def test_odd_rows(spark, library):
    rows = [(1, None, "i"), (2, "", "i"), (3, "long word " * 30_000, "i"), (3, "long word " * 30_000, "i"), (None, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").selectExpr("*", "1 AS x", "1 AS __text", "1 AS `a.b`")
    found = encode_pieces(df, PATH, ("doc_id", "ids", "x", "__text", "a.b"))
    assert found.columns == ["doc_id", "x", "__text", "a.b", "ids", "decoded"]
    got = found.collect()
    assert len(got) == 5 and all(r.ids == [] and r.decoded == "" for r in got if r.doc_id in (1, 2))
    assert next(r.ids for r in got if r.doc_id == 3) == library.encode("long word " * 30_000)
    assert encode_pieces(df.limit(0), PATH, ("doc_id",)).count() == 0
