"""Every stage of the pipeline against a brute-force version, on its own input."""

from __future__ import annotations

import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from compare import DATA
from tokenizers import Tokenizer

from thresher.llm.toxicity import learned_from, train

SF = str(DATA / "sf0.001")


def shingles(text: str) -> set[bytes]:
    ws = text.encode().lower().split()
    return {b" ".join(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], SF).write.parquet(f"{tmp_path}/{k}")
        frames.append(spark.read.parquet(f"{tmp_path}/{k}"))
        assert k == 3 or frames[-1].columns == columns, name
    start, clean, single, apart, packed = (f.collect() for f in frames)
    text = {r.doc_id: r.text or "" for r in start}

    model = train(docs, learned_from(spark.read.parquet(f"{SF}/labels.parquet")))
    score = dict(zip(text, model.score(list(text.values())), strict=True))
    assert {r.doc_id for r in clean} == {i for i, s in score.items() if s < 0.5}

    best: dict[str, int] = {}
    for r in clean:
        key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")
        best[key] = max(r.doc_id, best.get(key, -1))
    assert sorted(r.doc_id for r in single) == sorted(best.values())

    # Components of all pairs of a similarity of 0.8 or more; of each the smallest id stays.
    sets = {r.doc_id: shingles(r.text or "") for r in single}
    root = {i: i for i in sets}
    pairs = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in pairs:
        before = dict(root)
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
        if root == before:
            break
    assert {r.doc_id for r in apart} == {i for i in sets if root[i] == i}

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    check_packing(packed, {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0] for r in apart})


def check_packing(rows, ids: dict[int, list[int]], capacity: int = 2048) -> None:
    """Every document is there once, in order, its pieces whole; every sequence is gapless and not too long."""
    by: dict[int, list] = {}
    seqs: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    assert by.keys() == ids.keys()
    for i, pieces in by.items():
        pieces.sort(key=lambda r: r.piece)
        at = 0
        for k, r in enumerate(pieces):
            assert (r.piece, r.start) == (k, at)
            part = np.array(ids[i][at : at + r.length], "<u4")
            assert r.ids_crc32 == zlib.crc32(part.tobytes()) and (r.length == capacity or k == 0)
            at += r.length
        assert at == len(ids[i])
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


def test_stages_on_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    odd = spark.createDataFrame([(None, None), (None, "a b c"), (-1, ""), (-1, ""), (-2, "word " * 50_000), (-3, "Word " * 50_000)], "doc_id long, text string")
    both = docs.unionByName(odd, allowMissingColumns=True).selectExpr("*", *(f"1 AS `{c}`" for c in ("id", "__id", "digest", "__digest", "score", "__score", "x", "node", "group", "n", "a.b")))
    for start in (both, both.limit(0)):
        now = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, SF)
            assert now.columns == both.columns, name
        left = {r.doc_id: r.text for r in now.where("doc_id < 0 OR doc_id IS NULL").collect()}
        assert start is not both or (left.keys() <= {None, -1, -2} and left[-2] and left[None] == "a b c")
        packed = corpus_pipeline.STAGES[-1][1](spark, now, SF)
        assert (packed.count() > 0) == (start is both)
