"""Packing of documents into sequences by bound-certified best-fit decreasing.

Pieces of documents are dealt to partitions of bounded size. Each is packed best-fit decreasing and gets a lower bound of
its number of bins from dual-feasible functions. Where the two agree the partition is certified and done; the bins of the
others are dealt anew, so that they exchange documents, and are packed again. A partition never ends with more bins than
it was dealt. Only ids and lengths take part, and nothing of a partition reaches the driver but a count.

Cases: a null or empty text is the end token alone. A row is a document even if its id is null or repeated. Only documents
longer than a sequence are cut. Ids may be of any simple type. An empty table gives an empty result. Other columns are not
looked at, whatever their names.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_row, checkpoint, quoted, read, texts

CAPACITY = 2048
#: Pieces in a partition on average.
PART = 32_768
#: Fixed value: how byte-level vocabularies of this kind split a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteTokens:
    """Ids of a byte-level BPE file of the tokenizers library, as little-endian 32-bit numbers. Where its merges are in
    the order of the ids that they make, tiktoken's engine, which merges by rank, gives the same ids in a third of the
    time; other files are refused. The string of an added token in a text is that token, as by the library's default."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pre = spec["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"]:
            raise ValueError("not a byte-level vocabulary")
        # Printable bytes stand for themselves, the others for the code points from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(not t["special"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens are not plain special ones")
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in vocab.items() if t not in special}
        for k, m in enumerate(merges):
            if vocab["".join(m.split(" ") if isinstance(m, str) else m)] != 256 + k:
                raise ValueError("merges are not in the order of ids")
        self.engine = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, batch: list[str]) -> list[bytes]:
        return [self.engine.encode_to_numpy(t, allowed_special="all").astype("<u4").tobytes() for t in batch]


@lru_cache(2)
def tokens(path: str) -> ByteTokens:
    return ByteTokens(path)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of n tokens; the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of all pieces."""
    source = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType
    last = np.array([end], "<u4").tobytes()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for i, ids in zip(b.column(0).to_pylist(), tokens(path).encode(texts(b)), strict=True):
            ids += last
            rows += [(i, k, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])) for k, (at, n) in enumerate(cut(len(ids) // 4, capacity))]
        cols = zip(*rows, strict=True) if rows else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()], strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return source.mapInArrow(by_row(run), f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, best-fit decreasing."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room that is left
    some = made = 0  # bit r of some: there is a bin with room r
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        fit = some >> n << n
        if fit:
            room = (fit & -fit).bit_length() - 1
            j = open_[room].pop()
            if not open_[room]:
                some ^= 1 << room
        else:
            room, j = capacity, made
            made += 1
        bins[k], offsets[k] = j, capacity - room
        if room > n:
            open_[room - n].append(j)
            some |= 1 << (room - n)
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best of several families of dual-feasible functions; all are sums over counts of lengths."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1)
    best = -(-int(count @ x) // capacity)
    n, mass = np.r_[0, np.cumsum(count)], np.r_[0, np.cumsum(count * x)]
    lam = np.arange(1, capacity // 2 + 1)  # over capacity - lam counts whole, under lam not at all
    big, mid = n[-1] - n[capacity - lam + 1], mass[capacity - lam + 1] - mass[lam]
    best = max(best, int((-(-(big * capacity + mid) // capacity)).max()))
    half = 2 * x > capacity
    for k in range(1, 101):  # rounding to k-ths
        exact = x * (k + 1) % capacity == 0
        best = max(best, -(-int(count @ np.where(exact, x * k, x * (k + 1) // capacity * capacity)) // (k * capacity)))
    for a in range(2, capacity // 2 + 1):  # how many of size a a bin still holds beside it
        whole = capacity // a
        best = max(best, -(-int(count @ np.where(half, 2 * (whole - (capacity - x) // a), np.where(2 * x == capacity, whole, 2 * (x // a)))) // (2 * whole)))
    return best


def _pack(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Packs one partition; keeps what it was dealt if that has as few bins."""
    pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"]).reset_index(drop=True)
    lengths = pdf["length"].to_numpy(np.int64)
    bins, offsets = best_fit(lengths, capacity)
    n, old = bins.max() + 1, pdf["sequence_id"].dropna()
    part = int(pdf["part"].iloc[0])
    if not len(old) or n < old.nunique():
        pdf["sequence_id"], pdf["offset"] = (part << 32) + bins, offsets
    pdf["sequence_id"] = pdf["sequence_id"].astype("int64")
    pdf["certified"] = min(n, old.nunique() or n) <= lower_bound(lengths, capacity)
    return pdf


def pack(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = 4, part: int = PART) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id, offset and certified."""
    schema = f"doc_id {pieces.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, row long, part long, certified boolean"
    todo = checkpoint(pieces.withColumns({"row": F.monotonically_increasing_id(), "sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")}))
    done: list[DataFrame] = []
    for k in range(rounds):
        count = todo.count()
        if not count:
            break
        parts = -(-count // part)
        # At first a piece is dealt alone, by its number so that equal rows go apart; then a bin is, with what it holds.
        key = F.xxhash64(F.lit(k), *(["sequence_id"] if k else ["doc_id", "piece", "ids_crc32", "start", "row"]))
        dealt = todo.withColumn("part", (F.lit(k) * F.lit(1 << 26) + F.pmod(key, F.lit(parts))).cast("long"))
        packed = checkpoint(dealt.groupBy("part").applyInPandas(lambda pdf: _pack(pdf, capacity), schema))
        if parts == 1 or k == rounds - 1:
            return _union([*done, packed.drop("part", "row")])
        done.append(packed.where("certified").drop("part", "row"))
        todo = packed.where("NOT certified").drop("part", "certified")
    return _union(done) if done else todo.drop("row").withColumn("certified", F.lit(True))


def _union(dfs: list[DataFrame]) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(token_pieces(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
