"""Telephony audio as media columns.

mu-law and A-law samples are expanded by lookup tables; IMA ADPCM is decoded with numpy across all blocks at once, one
step per position in a block; resampling is integer linear interpolation. Long recordings are worked on in pieces, so
memory beyond the recording itself is bounded.

Cases: null media or text is empty. A file that can't be read gives nulls and its error; so does one whose sampling rate is
not from 1,000 to 384,000 a second (FASTEST), whose ADPCM blocks are shorter than 5 bytes or whose result would not fit in a
WAV file. Very long recordings are read whole. Repeated rows get repeated results, equal bytes equal ones. An empty table
gives an empty result. Other columns pass through where they are named; pcm, n_samples and error take the place of kept
columns of their names.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, quoted, read

PIECE = 1 << 18
PCM, ALAW, MULAW, IMA = 1, 6, 7, 17
SLOWEST, FASTEST = 1_000, 384_000
#: ADPCM blocks that are worked on together at most.
BLOCKS = 4096


def _mulaw_table() -> np.ndarray:
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    x = (((u & 0x0F) << 3) + 0x84 << ((u & 0x70) >> 4)) - 0x84
    return np.where(u & 0x80, -x, x).astype("<i2")


def _alaw_table() -> np.ndarray:
    a = np.arange(256, dtype=np.int32) ^ 0x55
    e, m = (a & 0x70) >> 4, (a & 0x0F) << 4
    x = np.where(e == 0, m + 8, m + 0x108 << np.maximum(e - 1, 0))
    return np.where(a & 0x80, x, -x).astype("<i2")


TABLES = {MULAW: _mulaw_table(), ALAW: _alaw_table()}
_ORDER = np.argsort(TABLES[ALAW], kind="stable").astype(np.uint8)
#: The A-law code of each 16-bit sample, from -32768 on: the nearest, of two as near that of the lower sample.
_NEAREST = _ORDER[np.searchsorted((TABLES[ALAW][_ORDER][1:].astype(np.int64) + TABLES[ALAW][_ORDER][:-1]) / 2, np.arange(-32768, 32768))]
STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767])
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8])


def _step(value: np.ndarray, index: np.ndarray, code: np.ndarray) -> None:
    """One ADPCM step in place, for all blocks."""
    size = STEPS[index]
    diff = (size >> 3) + np.where(code & 1, size >> 2, 0) + np.where(code & 2, size >> 1, 0) + np.where(code & 4, size, 0)
    np.clip(value + np.where(code & 8, -diff, diff), -32768, 32767, out=value)
    np.clip(index + MOVES[code & 7], 0, 88, out=index)


def decode_adpcm(data: bytes, block: int = 256) -> np.ndarray:
    """Mono IMA blocks: value int16, index uint8, a zero byte, then codes, low half first. A last block that is cut is
    decoded as far as it goes."""
    full, rest = divmod(len(data), block)
    out = []
    for raw, n in ((data[: full * block], full), (data[full * block :], 1 if rest >= 4 else 0)):
        if n:
            b = np.frombuffer(raw, np.uint8).reshape(n, -1)
            value, index = b[:, :2].copy().view("<i2")[:, 0].astype(np.int64), np.minimum(b[:, 2], 88).astype(np.int64)
            got = np.empty((n, 1 + 2 * (b.shape[1] - 4)), "<i2")
            got[:, 0] = value
            for k in range(got.shape[1] - 1):
                _step(value, index, b[:, 4 + k // 2].astype(np.int64) >> 4 * (k % 2) & 15)
                got[:, k + 1] = value
            out.append(got.reshape(-1))
    return np.concatenate(out) if out else np.empty(0, "<i2")


def encode_adpcm(pcm: np.ndarray, block: int = 256) -> bytes:
    """The inverse as far as ADPCM can be; the last block is filled with its last sample."""
    per = 1 + 2 * (block - 4)
    if not len(pcm):
        return b""
    x = np.pad(pcm.astype(np.int64), (0, -len(pcm) % per), "edge").reshape(-1, per)
    out = np.zeros((len(x), block), np.uint8)
    value, index = x[:, 0].copy(), np.zeros(len(x), np.int64)
    out[:, :2] = x[:, :1].astype("<i2").view(np.uint8)
    for k in range(per - 1):
        d, size = x[:, k + 1] - value, STEPS[index]
        code = np.where(d < 0, 8, 0) | np.minimum((np.abs(d) << 2) // size, 7)
        _step(value, index, code)
        out[:, 4 + k // 2] |= (code << 4 * (k % 2)).astype(np.uint8)
    return out.tobytes()


def write_wav(data: bytes, kind: int = MULAW, rate: int = 8000, block: int = 256) -> bytes:
    bits = {PCM: 16, ALAW: 8, MULAW: 8, IMA: 4}[kind]
    align = block if kind == IMA else bits // 8
    per = 1 + 2 * (block - 4)
    head = struct.pack("<HHIIHH", kind, 1, rate, rate * block // per if kind == IMA else rate * align, align, bits) + (struct.pack("<HH", 2, per) if kind == IMA else b"")
    body = b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(wav: bytes) -> tuple[int, int, int, bytes]:
    """Kind, rate, block size, stored bytes."""
    if wav[:4] != b"RIFF" or wav[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, head = 12, None
    while at + 8 <= len(wav):
        name, size = wav[at : at + 4], int.from_bytes(wav[at + 4 : at + 8], "little")
        if name == b"fmt ":
            if at + 24 > len(wav):
                raise ValueError("its header is cut")
            kind, channels, rate, _, align, _ = head = struct.unpack_from("<HHIIHH", wav, at + 8)
            if channels != 1 or kind not in (PCM, ALAW, MULAW, IMA):
                raise ValueError(f"{channels} channels of format {kind}")
            if not SLOWEST <= rate <= FASTEST:
                raise ValueError(f"a rate of {rate}")
            if kind == IMA and align < 5:
                raise ValueError(f"blocks of {align} bytes")
        elif name == b"data" and head:
            return kind, rate, align, wav[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def expand(kind: int, data: bytes, block: int) -> np.ndarray:
    if kind == PCM:
        return np.frombuffer(data[: len(data) // 2 * 2], "<i2")
    return decode_adpcm(data, block) if kind == IMA else TABLES[kind][np.frombuffer(data, np.uint8)]


def resample(pcm: np.ndarray, rate: int, to: int) -> Iterator[np.ndarray]:
    """Pieces of the recording at another rate."""
    last, n = len(pcm) - 1, len(pcm) * to // rate
    for at in range(0, n, PIECE):
        j = np.arange(at, min(n, at + PIECE), dtype=np.int64) * rate
        i, part = j // to, j % to
        a = pcm[i].astype(np.int64)
        yield (a + (pcm[np.minimum(i + 1, last)] - a) * part // to).astype("<i2")


def decode_media(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = (), rate: int = 16000) -> DataFrame:
    """The columns in keep, with pcm (a WAV file of 16-bit samples at the given rate), n_samples and error."""
    made = [("pcm", T.BinaryType()), ("n_samples", T.LongType()), ("error", T.StringType())]

    def one(x: bytes | None) -> tuple[bytes | None, int | None, str | None]:
        try:
            kind, at, block, data = read_wav(x or write_wav(b""))
            samples = expand(kind, data, block)
            if 2 * len(samples) * rate // at > 0xFFFFFF00:
                raise ValueError("too long for a WAV file")
            pcm = b"".join(y.tobytes() for y in resample(samples, at, rate))
            return write_wav(pcm, PCM, rate), len(pcm) // 2, None
        except ValueError as e:
            return None, None, str(e)

    def decoded(media: pa.Array) -> list[pa.Array]:
        a, n, e = zip(*map(one, media.to_pylist()), strict=True) if len(media) else ((), (), ())
        return [pa.array(a, pa.binary()), pa.array(n, pa.int64()), pa.array(e, pa.string())]

    return map_texts(df, keep, quoted(media_col).cast("binary"), made, decoded, rows=64)


def adpcm_again(many: list[np.ndarray], rate: int, block: int = 256) -> list[np.ndarray]:
    """Recordings after they were stored as ADPCM files, read back and decoded. Blocks of all recordings are worked on
    together, BLOCKS at a time."""
    per = 1 + 2 * (block - 4)
    padded = [np.pad(x, (0, -len(x) % per), "edge") if len(x) else x for x in many]
    ends = np.cumsum([0, *(len(x) // per for x in padded)])
    flat = np.concatenate([*padded, np.empty(0, "<i2")])
    data = b"".join(encode_adpcm(flat[at : at + BLOCKS * per], block) for at in range(0, len(flat), BLOCKS * per))
    data = b"".join(read_wav(write_wav(data[a * block : z * block], IMA, rate, block))[3] for a, z in itertools.pairwise(ends.tolist()))
    back = np.concatenate([*(decode_adpcm(data[at : at + BLOCKS * block], block) for at in range(0, len(data), BLOCKS * block)), np.empty(0, "<i2")])
    return [back[a * per : a * per + len(x)] for a, x in zip(ends.tolist(), many, strict=False)]


def _features(pcm: np.ndarray, rate: int, adpcm: np.ndarray) -> str:
    """Of the expanded samples, and of what is made of them: the stored PCM file at twice the rate and the A-law file, each
    read back and expanded again, and the ADPCM samples that adpcm_again gives."""
    energy = crossings = peak = 0
    for at in range(0, len(pcm), PIECE):
        x = pcm[at : at + PIECE + 1].astype(np.int64)  # one more, for the crossing at the border
        crossings += int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
        energy += int((x[:PIECE] ** 2).sum())
        peak = max(peak, int(np.abs(x[:PIECE]).max()))
    again = []
    for kind, to, data in ((PCM, 2 * rate, b"".join(x.tobytes() for x in resample(pcm, rate, 2 * rate))), (ALAW, rate, compress_alaw(pcm))):
        kind, _, block, data = read_wav(write_wav(data, kind, to))
        again.append(zlib.crc32(expand(kind, data, block).tobytes()))
    return f"rate={rate};samples={len(pcm)};mean_square={energy // max(1, len(pcm))};crossings={crossings};peak={peak};pcm{2 * rate}_crc32={again[0]};adpcm_crc32={zlib.crc32(adpcm.tobytes())};alaw_crc32={again[1]}"


def compress_alaw(pcm: np.ndarray) -> bytes:
    """The A-law codes whose samples are nearest (of two as near, the lower sample's)."""
    return _NEAREST[pcm.astype(np.int64) + 32768].tobytes()


def _stored(some: list[str]) -> list[tuple[int, int, str, int, int, str, str]]:
    rows, many = [], []
    for text in some:
        raw = text.encode()
        wav = write_wav(raw + b"\0" * (-len(raw) % 64 or 64 * (not raw)))
        kind, rate, block, back = read_wav(wav)
        rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(wav), hashlib.sha256(wav).hexdigest()))
        many.append(expand(kind, back, block))
    return [(*r, _features(x, 8000, y)) for r, x, y in zip(rows, many, adpcm_again(many, 8000), strict=True)]


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    long, string = T.LongType(), T.StringType()
    made = [("n_bytes", long), ("payload_bytes", long), ("payload_sha256", string), ("tail_crc32", long), ("media_bytes", long), ("media_sha256", string), ("feature", string)]
    kinds = [pa.int64() if t is long else pa.string() for _, t in made]

    def stored(some: pa.Array) -> list[pa.Array]:
        return list(map(pa.array, list(zip(*_stored(some.to_pylist()), strict=True)) or [()] * len(made), kinds))

    return map_texts(read(spark, sf_dir, "documents"), ("doc_id",), F.coalesce("text", F.lit("")), made, stored, rows=256)
