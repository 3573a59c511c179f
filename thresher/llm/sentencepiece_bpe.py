"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

No piece of such a vocabulary has a space mark after another character, so a text falls apart before each run of space
marks and equal words have equal ids. The words of a batch that the worker hasn't seen are encoded together: their
symbols are one flat numpy array; each round finds the best pair of each word by a segmented minimum of ranks, merges its
leftmost places at once where they don't overlap, and compacts, until no pair remains. A text is then a lookup of words.

Cases: a null text is empty and has no ids. Characters outside the vocabulary become byte pieces. Text that looks like a
control piece stays text. Texts of any length are encoded whole. Repeated rows get repeated results, an empty table an empty
one. ids and decoded take the place of kept columns of their names; other columns may have any name.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, quoted, read

MARK = "▁"
_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Words, and characters of words, that a worker remembers at most between batches; then it starts anew.
REMEMBERED, REMEMBERED_CHARS = 400_000, 8_000_000
NONE = np.iinfo(np.int64).max


def _varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (b[at] & 127) << shift
        shift += 7
        at += 1
        if b[at - 1] < 128:
            return n, at


def _fields(b: bytes) -> Iterable[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer message's fields."""
    at = 0
    while at < len(b):
        key, at = _varint(b, at)
        if key & 7 == 0:
            x, at = _varint(b, at)
        else:
            size, at = _varint(b, at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            x, at = b[at : at + size], at + size
        yield key >> 3, x


def _utf8(raw: bytes) -> str:
    """Each byte that is part of no character becomes one U+FFFD."""
    out = []
    while raw:
        try:
            out.append(raw.decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[: e.start].decode() + "\ufffd")
            raw = raw[e.start + 1 :]
    return "".join(out)


class PieceModel:
    """A BPE model with byte fallback, an identity normaliser and a mark put before the text; others are refused."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            top = list(_fields(f.read()))
        pieces = [dict(_fields(x)) for k, x in top if k == 1]
        trainer, norm = (dict(_fields(next((x for k, x in top if k == n), b""))) for n in (2, 3))
        self.pieces = [p.get(1, b"").decode() for p in pieces]
        kinds = [p.get(3, 1) for p in pieces]
        scores = np.array([np.frombuffer(p[2], "<f4")[0] if 2 in p else 0 for p in pieces])
        normal = [i for i, k in enumerate(kinds) if k == 1]
        if trainer.get(3, 1) != 2 or norm.get(2) or not norm.get(3, 1) or norm.get(4, 1) or not norm.get(5, 1) or kinds.count(6) != 256:
            raise ValueError("not a byte-fallback BPE model with an identity normaliser")
        if any(MARK in self.pieces[i].lstrip(MARK) for i in normal) or {4, 5} & set(kinds):
            raise ValueError("its pieces cross words, or are user-defined or unused")
        self.ids = {self.pieces[i]: i for i in normal}
        self.bytes = np.zeros(256, np.int64)
        self.raw: list[bytes] = []  # what a piece decodes to
        for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)):
            if k == 6:
                self.bytes[int(p[3:5], 16)] = i
            self.raw.append(bytes([int(p[3:5], 16)]) if k == 6 else b"" if k == 3 else " ⁇ ".encode() if k == 2 else p.replace(MARK, " ").encode())
        self.kinds = kinds
        # Equal scores have equal ranks: then the leftmost pair is merged first, whichever it is.
        rank = np.unique(-scores, return_inverse=True)[1]
        self.size = len(pieces)
        halves = ((i, self.ids.get(p[:c]), self.ids.get(p[c:])) for i in normal for p in [self.pieces[i]] for c in range(1, len(p)))
        pairs = sorted((a * self.size + b, rank[i], i) for i, a, b in halves if a is not None and b is not None)
        self.keys, self.ranks, self.made = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        tied = np.flatnonzero(np.bincount(rank[normal]) > 1)
        # Where several pieces share the rank, or the piece made is part of a pair of better rank, what the first merge
        # makes may come next, before the second place: then one place is merged a round, the leftmost.
        parts = np.r_[self.keys // self.size, self.keys % self.size]
        sooner = np.unique(parts[rank[parts] > np.r_[self.ranks, self.ranks]])
        self.tied = np.isin(self.ranks, tied) | np.isin(self.made, sooner)
        # Runs of marks, if their pieces of 2 to 16 share the last rank, fill up from the left: long ones need no rounds.
        runs = [self.ids.get(MARK * n) for n in range(2, 17)]
        self.run = self.ids[MARK * 16] if None not in runs and {int(rank[i]) for i in runs} == {int(rank[normal].max())} and MARK * 17 not in self.ids else None
        # Symbols by code point; those outside the vocabulary are -1 - their code point, and never merge.
        self.codes = -1 - np.arange(0x110000)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.codes[ord(p)] = i
        self.known: dict[str, bytes] = {}
        self.chars = 0

    def _pairs(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rank, piece made and tied of the pairs that begin at these places."""
        nxt = np.minimum(at + 1, len(sym) - 1)
        key = np.where((word[nxt] != word[at]) | (nxt == at) | (sym[at] < 0) | (sym[nxt] < 0), -1, sym[at] * self.size + sym[nxt])
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[k] == key, self.ranks[k], NONE), self.made[k], self.tied[k]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit numbers. A word has marks at its start alone."""
        if not words:
            return []
        long = {k: (len(w) - len(w.lstrip(MARK)) - 17) // 16 for k, w in enumerate(words) if self.run is not None and w.startswith(MARK * 49)}
        if long:
            short = self.encode_words([w[16 * long.get(k, 0) :] for k, w in enumerate(words)])
            return [np.full(long.get(k, 0), self.run, "<i4").tobytes() + ids for k, ids in enumerate(short)]
        flat = "".join(words)
        sym = self.codes[np.frombuffer(flat.encode("utf-32-le"), "<u4")]
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        done_w, done_s = [], []
        # What the pair of each symbol with its next would make; a word's last symbol has none.
        rank, made, tied = self._pairs(sym, word, np.arange(len(sym)))
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(word)])
            least = np.minimum.reduceat(rank, starts)
            live = np.repeat(least < NONE, sizes)
            if not live.all():  # words without pairs are finished and leave
                done_w.append(word[~live])
                done_s.append(sym[~live])
                sym, word, rank, made, tied = (x[live] for x in (sym, word, rank, made, tied))
                sizes, least = sizes[least < NONE], least[least < NONE]
                if not len(sym):
                    break
            # Of places that follow one another without a gap, every second from the left: they would overlap.
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            order = np.arange(len(at))
            head = np.maximum.accumulate(np.where(np.r_[True, np.diff(at) != 1], order, 0))
            at = at[(order - head) % 2 == 0]
            at = at[np.r_[True, word[at[1:]] != word[at[:-1]]] | ~tied[at]]
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            now = at - np.arange(len(at))  # their places once the right halves are gone
            sym, word, rank, made, tied = (x[keep] for x in (sym, word, rank, made, tied))
            now = np.r_[now, now[now > 0] - 1]
            rank[now], made[now], tied[now] = self._pairs(sym, word, now)
        w, s = np.concatenate(done_w), np.concatenate(done_s)
        order = np.argsort(w, kind="stable")
        w, s = w[order], s[order]
        if (s < 0).any():  # UTF-8 bytes in place of characters
            parts = [self.bytes[list(chr(-1 - x).encode())].tolist() if x < 0 else [x] for x in s.tolist()]
            w, s = np.repeat(w, [len(x) for x in parts]), np.array([i for x in parts for i in x], np.int64)
        ends = (4 * np.searchsorted(w, np.arange(len(words)), "right")).tolist()
        flat_ids = s.astype("<i4").tobytes()
        return [flat_ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def split(self, text: str) -> list[str]:
        return _WORDS.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(self.encode_words(self.split(text))), "<i4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """As the library: byte pieces that form no character become U+FFFD each, and the first mark goes."""
        return self.decode_joined(list(ids))

    def decode_joined(self, ids: list[int]) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids))
        first = next((i for i in ids if self.kinds[i] != 3), 0)
        cut = self.kinds[first] == 1 and raw[:1] == b" "
        if any(self.kinds[i] == 3 for i in ids):  # a control piece, itself nothing, ends a run of byte pieces
            runs = itertools.groupby(ids, lambda i: self.kinds[i] == 3)
            return "".join(_utf8(b"".join(map(self.raw.__getitem__, run))) for control, run in runs if not control)[cut:]
        return _utf8(raw[cut:])

    def lookup(self, words: list[list[str]]) -> None:
        """Remember the ids of these words."""
        if len(self.known) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.known.clear()
            self.chars = 0
        new = list(set().union(*words).difference(self.known))
        self.chars += sum(map(len, new))
        for at in range(0, len(new), 100_000):
            some = new[at : at + 100_000]
            self.known.update(zip(some, self.encode_words(some), strict=True))


@lru_cache(2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_pieces(df: DataFrame, path: str, keep: tuple[str, ...] = (), text_col: str = "text") -> DataFrame:
    """The columns in keep, with ids (array<int>) and decoded (the text that the ids decode to)."""
    made = [("ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())]
    return _encoded(df, path, keep, text_col, made, [pa.list_(pa.int32()), pa.string()], lambda ids, text: (ids.tolist(), text))


def _encoded(df: DataFrame, path: str, keep: tuple[str, ...], text_col: str, made: list[tuple[str, T.DataType]], kinds: list[pa.DataType], of) -> DataFrame:
    def encoded(some: pa.Array) -> list[pa.Array]:
        m = model(path)
        words = [m.split(t) for t in some.to_pylist()]
        m.lookup(words)
        rows = []
        for ws in words:
            ids = np.frombuffer(b"".join(map(m.known.__getitem__, ws)), "<i4")
            rows.append(of(ids, m.decode_joined(ids.tolist())))
        return list(map(pa.array, list(zip(*rows, strict=True)) or [()] * len(made), kinds))

    return map_texts(df, keep, F.coalesce(quoted(text_col), F.lit("")), made, encoded, rows=256)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    def digests(ids: np.ndarray, text: str) -> tuple[int, str, str]:
        return len(ids), hashlib.sha256(",".join(map(decimal.__getitem__, ids.tolist())).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    decimal = list(map(str, range(32_000)))
    made = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return _encoded(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ("doc_id",), "text", made, [pa.int64(), pa.string(), pa.string()], digests)
