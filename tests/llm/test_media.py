"""Codecs against their definitions, lossless storage, and odd rows."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from compare import DATA

from thresher.llm.media import ALAW, IMA, MULAW, PCM, TABLES, _features, adpcm_again, compress_alaw, decode_adpcm, decode_media, encode_adpcm, expand, read_wav, resample, write_wav
from thresher.llm.queries import QUERIES


def test_tables():
    mu, a = TABLES[MULAW].astype(int), TABLES[ALAW].astype(int)
    assert (mu[0x00], mu[0x80], mu[0x7F], mu[0xFF]) == (-32124, 32124, 0, 0) and (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    assert len(set(a.tolist())) == 256 and len(set(mu.tolist())) == 255
    assert (np.diff(mu[0x80:]) < 0).all() and (np.diff(mu[:0x80]) > 0).all()


def slow_adpcm(block: bytes) -> list[int]:
    from thresher.llm.media import MOVES, STEPS

    value, index = int.from_bytes(block[:2], "little", signed=True), block[2]
    out = [value]
    for b in block[4:]:
        for code in (b & 15, b >> 4):
            step = int(STEPS[index])
            d = step >> 3
            d += step if code & 4 else 0
            d += step >> 1 if code & 2 else 0
            d += step >> 2 if code & 1 else 0
            value = max(-32768, min(32767, value - d if code & 8 else value + d))
            index = max(0, min(88, index + int(MOVES[code & 7])))
            out.append(value)
    return out


def test_adpcm():
    rng = np.random.default_rng(0)
    blocks = rng.integers(0, 256, (5, 64), dtype=np.uint8)
    blocks[:, 2] = rng.integers(0, 89, 5)
    assert decode_adpcm(blocks.tobytes(), 64).tolist() == [x for b in blocks for x in slow_adpcm(b.tobytes())]
    assert decode_adpcm(blocks.tobytes()[:150], 64).tolist() == [x for b in (blocks[0], blocks[1], blocks[2, :22]) for x in slow_adpcm(b.tobytes())]
    tone = (8000 * np.sin(np.arange(4000) / 9)).astype(np.int16)
    assert np.abs(decode_adpcm(encode_adpcm(tone))[:4000].astype(int) - tone)[50:].mean() < 400
    assert encode_adpcm(tone[:0]) == b"" and not len(decode_adpcm(b""))


def test_wav_and_resampling():
    for kind, data in ((PCM, b"\1\0\2\0"), (ALAW, b"abc"), (MULAW, b""), (IMA, bytes(256))):
        k, rate, _, back = read_wav(write_wav(data, kind, 8000))
        assert (k, rate, back) == (kind, 8000, data)
    x = np.array([0, 100, -100], np.int16)
    assert np.concatenate(list(resample(x, 8000, 16000))).tolist() == [0, 50, 100, 0, -100, -100]
    assert np.concatenate(list(resample(x, 8000, 8000))).tolist() == x.tolist()
    for bad in (b"", b"RIFF", write_wav(b"x")[:20]):
        with pytest.raises(ValueError):
            read_wav(bad)


def test_op9(spark):
    sf = DATA / "sf0.001"
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op9_media"](spark, str(sf)).collect()
    assert len(got) == len(docs)
    for r in got:
        raw = docs[r.doc_id]
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        wav = write_wav(padded)
        assert (r.media_bytes, r.media_sha256) == (len(wav), hashlib.sha256(wav).hexdigest())
        pcm = expand(MULAW, padded, 1).astype(int)
        assert f"samples={len(pcm)};mean_square={int((pcm**2).sum()) // len(pcm)};" in r.feature and f"peak={np.abs(pcm).max()};" in r.feature


def test_odd_rows(spark):
    rows = [(1, None, "p"), (2, b"junk", "p"), (3, write_wav(bytes(100_000)), "p"), (3, write_wav(bytes(100_000)), "p"), (None, write_wav(b"\0" * 512, IMA), None)]
    df = spark.createDataFrame(rows, "doc_id long, media binary, pcm string").selectExpr("*", "1 AS x", "1 AS k0", "1 AS `a.b`")
    found = decode_media(df, keep=("doc_id", "pcm", "x", "k0", "a.b"))
    assert found.columns == ["doc_id", "x", "k0", "a.b", "pcm", "n_samples", "error"]
    got = found.collect()
    assert [(r.doc_id, r.n_samples, r.error is None) for r in sorted(got, key=lambda r: r.doc_id or 0)] == [(None, 2020, True), (1, 0, True), (2, None, False), (3, 200_000, True), (3, 200_000, True)]
    assert decode_media(df.limit(0), keep=("doc_id",)).count() == 0


@pytest.mark.parametrize(("kind", "rate", "block"), [(MULAW, 0, 1), (MULAW, 1, 1), (MULAW, 4_000_000_000, 1), (IMA, 8000, 0), (IMA, 8000, 2), (IMA, 8000, 3), (IMA, 8000, 4)])
def test_absurd_headers_are_errors(spark, kind, rate, block):
    wav = bytearray(write_wav(bytes(1000), MULAW, 8000))
    wav[20:22], wav[24:28], wav[32:34] = kind.to_bytes(2, "little"), rate.to_bytes(4, "little"), block.to_bytes(2, "little")
    r = decode_media(spark.createDataFrame([(bytes(wav),)], "media binary")).first()
    assert r.pcm is None and r.n_samples is None and r.error


def test_alaw_is_the_nearest_code():
    x = np.array([*range(-32768, 32768, 37), 32767, 8, -8, 0], np.int16)
    codes = np.frombuffer(compress_alaw(x), np.uint8)
    near = np.abs(TABLES[ALAW].astype(int)[None, :] - x.astype(int)[:, None]).min(1)
    assert (np.abs(TABLES[ALAW][codes].astype(int) - x) == near).all()
    assert compress_alaw(TABLES[ALAW]) == bytes(range(256))


def test_features_of_the_query_by_plain_code():
    """Samples, crossings and checksums, computed one sample at a time."""
    data = bytes(random.Random(2).choices(range(256), k=1024))
    pcm = [int(TABLES[MULAW][b]) for b in data]
    twice = [v for k, a in enumerate(pcm) for v in (a, a + (pcm[min(k + 1, len(pcm) - 1)] - a) // 2)]
    rows, known = [], sorted(range(256), key=lambda c: (int(TABLES[ALAW][c]), c))
    for a in pcm:
        rows.append(int(TABLES[ALAW][min(known, key=lambda c: (abs(int(TABLES[ALAW][c]) - a), int(TABLES[ALAW][c])))]))
    crc = lambda xs: zlib.crc32(struct.pack(f"<{len(xs)}h", *xs))
    want = f"rate=8000;samples=1024;mean_square={sum(a * a for a in pcm) // 1024};crossings={sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:], strict=False))};peak={max(map(abs, pcm))};pcm16000_crc32={crc(twice)};"
    samples = np.array(pcm, np.int16)
    got = _features(samples, 8000, adpcm_again([np.empty(0, np.int16), samples[:7], samples, samples[:600]], 8000)[2])
    assert got.startswith(want) and got.endswith(f"alaw_crc32={crc(rows)}")
    adpcm = decode_adpcm(encode_adpcm(np.array(pcm, np.int16)))[:1024]
    assert f";adpcm_crc32={zlib.crc32(adpcm.tobytes())};" in got
