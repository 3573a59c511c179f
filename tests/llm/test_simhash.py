"""Fingerprints and components against brute force, planted near copies, and odd rows."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from compare import DATA
from pyspark.sql import functions as F

from thresher.llm.queries import QUERIES
from thresher.llm.simhash import Scheme, _sifted, bucket_links, cluster_links, exact_scheme, fingerprint, fingerprint_links, hot_keys, part_words, shingle_hashes, similar_scheme, simhash_dedup, simhash_groups


def brute_fingerprint(text: str, k: int = 4) -> int:
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows: list[tuple[int, int]], most: int = 4) -> dict[int, int]:
    fps = sorted({f for _, f in rows})
    x, root = np.array(fps, np.uint64), list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= most):
            root[find(int(j))] = find(i)
    least: dict[int, int] = {}
    where = {f: find(k) for k, f in enumerate(fps)}
    for i, f in rows:
        least[where[f]] = min(i, least.get(where[f], i))
    return {i: least[where[f]] for i, f in rows}


def test_op7_is_brute_force(spark):
    sf = DATA / "sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {r.doc_id: brute_fingerprint(r.text or "") for r in docs}
    components = brute_components(list(want.items()))
    got = QUERIES["op7_simhash"](spark, str(sf)).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{f:016x}", components[i]) for i, f in want.items())


def test_fingerprints_of_odd_texts():
    for t in ["", " \n", "one", "A b c", "a b c d e", "É é\x0bß\x1cx y z " * 900]:
        assert int.from_bytes(fingerprint(t.encode(), Scheme()), "big") == brute_fingerprint(t)


@pytest.mark.parametrize("chunk", [16_384, 40])
def test_links_of_clusters_are_whole_at_any_chunk_size(spark, chunk):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(1500)}
    for _ in range(3):
        c = rng.getrandbits(64)
        fps |= {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(300)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(k, f.to_bytes(8, "big")) for k, f in enumerate(fps)], "node long, fp binary")
    got = fingerprint_links(nodes, Scheme(), chunk).collect()
    assert all((fps[r.a] ^ fps[r.b]).bit_count() <= 4 for r in got)
    want = brute_components(list(enumerate(fps)))
    root = list(range(len(fps)))
    for _ in range(60):
        for r in got:
            root[r.a] = root[r.b] = min(root[r.a], root[r.b])
    assert root == [want[k] for k in range(len(fps))]


def test_hot_keys_only_change_the_dealing(spark, monkeypatch):
    rng = random.Random(8)
    c = rng.getrandbits(64)
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(900)} | {rng.getrandbits(64) for _ in range(300)})
    nodes = spark.createDataFrame([(k, f.to_bytes(8, "big")) for k, f in enumerate(fps)], "node long, fp binary")
    assert len(hot_keys(nodes, len(fps), Scheme())) > 0
    want = brute_components(list(enumerate(fps)))
    for _ in range(2):
        root = list(range(len(fps)))
        links = [(r.a, r.b) for r in fingerprint_links(nodes, Scheme()).collect()]
        for _ in range(40):
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        assert root == [want[k] for k in range(len(fps))]
        monkeypatch.setattr("thresher.llm.simhash.hot_keys", lambda *_: np.empty(0, np.int64))


def test_sifting_is_exact_however_batches_are_cut():
    rng = random.Random(12)
    rows = []
    for key in range(60):
        size = rng.choice([1, 2, 3, 15, 16, 17, 40])
        words = [rng.choice([0, 1, 7, (1 << 62) - 1, 0xFFFF]) for _ in range(size)]
        rows += [(len(rows) + k, key, w) for k, w in enumerate(words)]
    by = {key: [r for r in rows if r[1] == key] for key in range(60)}
    want = [r[0] for key in range(60) for r in by[key] if len(by[key]) > 16 or any(o is not r and (o[2] ^ r[2]).bit_count() <= 2 for o in by[key])]
    for step in (1, 2, 5, 16, 17, 100, len(rows)):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[at : at + step]], pa.int64()) for i in range(3)], names=["node", "key", "word"]) for at in range(0, len(rows), step)]
        assert [n for b in _sifted(iter(batches), 2) for n in b.column(0).to_pylist()] == want, step


def test_a_cluster_does_not_give_all_its_pairs():
    n = 2000
    fp = np.array([[1 << (k % 2) | (k // 2 % 2) << 3] for k in range(n)], np.uint64)
    links = bucket_links(np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), fp, 4)
    assert len(links) == n - 1


def test_schemes_keep_the_pigeonhole_promise():
    for n in (0, 10**6, 10**9, 10**12):
        s = exact_scheme(n)
        assert s.together <= s.blocks - s.max_distance and len(s.keys) == len(set(s.keys))
    with pytest.raises(ValueError):
        Scheme(blocks=6, together=3).keys  # noqa: B018
    assert 130 <= similar_scheme(0.8).max_distance <= 170


def test_dedup_by_similarity_catches_copies_and_leaves_others(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, want = [], set()
    for g in range(40):
        base = [word() for _ in range(300)]
        rows.append((g * 100, " ".join(base), "x"))
        want.add(g * 100)
        for k in range(1, 5):  # one to four words of 300 differ: a similarity of 0.87 or more
            copy = list(base)
            for at in rng.sample(range(300), k):
                copy[at] = word()
            rows.append((g * 100 + k, " ".join(copy), "y"))
        rows.append((g * 100 + 50, " ".join(base[:120] + [word() for _ in range(180)]), "z"))  # 0.25
        want.add(g * 100 + 50)
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string").repartition(5)
    got = simhash_dedup(docs, similarity=0.8)
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect()} == want


def test_similarity_is_exact_for_short_texts_and_below_it(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, want, near = [], set(), set()
    for g in range(0, 2000, 10):
        base = [word() for _ in range(8 + g // 10 % 3)]
        rows += [(g, " ".join(base)), (g + 1, " ".join([*base, word()]))]  # 4 of 5 shingles, 5 of 6, 6 of 7
        want.add(g)
        near.add(g + 1)
    hub = [word() for _ in range(400)]
    for k in range(60):  # of one text, 60 parts that are 0.76 like it, and 0.5 to 0.98 like one another
        rows.append((5000 + k, " ".join(hub[k : k + 308])))
    rows.append((4999, " ".join(hub)))
    for g in range(6000, 6400, 2):  # 300 words, of which the last 36 differ: a similarity of 0.78
        base = [word() for _ in range(300)]
        rows += [(g, " ".join(base)), (g + 1, " ".join(base[:264] + [word() for _ in range(36)]))]
        want |= {g, g + 1}
    got = {r.doc_id for r in simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), similarity=0.8).collect()}
    assert got - near == want | {4999, 5000} and not got & near


@pytest.mark.parametrize("n", [4, 5, 8, 9, 16, 40, 63, 64, 300, 5000, 90_000])
def test_similar_sets_share_a_word_whatever_their_size(n):
    rng = np.random.default_rng(n)
    draw = lambda k: rng.integers(0, 1 << 63, k, np.int64).astype(np.uint64) * np.uint64(2)
    for k in range(2000 if n < 1000 else 20):
        # Just at 0.8: all that differs is in one of the two, or half in each.
        extra = n // 4 if k % 2 else 2 * (n // 9)
        first = extra if k % 2 else extra // 2
        base, more = draw(n if k % 2 else n - extra // 2), draw(extra)
        a, b = np.unique(np.r_[base, more[:first]]), np.unique(np.r_[base, more[first:]])
        assert len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
        x, y = part_words(a, 0.8), part_words(b, 0.8)
        assert len(np.intersect1d(x, y)), (n, k)
        assert len(x) <= 2 * 62
    assert not len(part_words(draw(3), 0.8))


def test_all_pairs_of_a_table_are_found(spark):
    """Against brute force over every pair of the table."""
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    h = {r.doc_id: frozenset(shingle_hashes((r.text or "").encode(), 5).tolist()) for r in docs.collect()}
    names: dict[frozenset, int] = {}
    for i, x in sorted(h.items()):
        names.setdefault(x, i)
    where: dict[int, list[int]] = {}
    sets = list(names)
    for k, x in enumerate(sets):
        for v in x:
            where.setdefault(v, []).append(k)
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, x in enumerate(sets):
        common: dict[int, int] = {}
        for v in x:
            for j in where[v]:
                if j < k:
                    common[j] = common.get(j, 0) + 1
        for j, c in common.items():
            if c >= 0.8 * (len(x) + len(sets[j]) - c) - 1e-9:
                root[find(k)] = find(j)
    least: dict[int, int] = {}
    for k, x in enumerate(sets):
        least[find(k)] = min(names[x], least.get(find(k), names[x]))
    position = {x: k for k, x in enumerate(sets)}
    want = {i: least[find(position[x])] for i, x in h.items()}
    got = {r.id: r.component for r in simhash_groups(docs, similarity=0.8).collect()}
    assert got == want


def test_a_large_cluster_of_near_copies_is_one_group(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for k in range(3000):
        words = list(base)
        words[rng.randrange(200)] = f"v{k}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert [r.doc_id for r in simhash_dedup(docs, similarity=0.8, chunk=500).collect()] == [0]


@pytest.mark.parametrize(("nodes", "size"), [(1000, 1 << 20), (9, 1 << 20), (1000, 900)])
def test_links_of_sets_are_exact_however_clusters_are_dealt(spark, nodes, size):
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 62, 60, np.int64).astype(np.uint64)
    rows, sets = [], {}
    for k in range(120):
        x = np.sort(np.r_[pool[rng.random(60) < 0.9], rng.integers(0, 1 << 62, k % 4, np.int64).astype(np.uint64)])
        sets[k] = set(x.tolist())
        rows.append((k, k % 3, x.tobytes()))
    got = cluster_links(spark.createDataFrame(rows, "node long, root long, hashes binary"), 0.8, nodes, size).collect()
    root, want = list(range(120)), list(range(120))
    for _ in range(60):
        for a, b, _ in got:
            root[a] = root[b] = min(root[a], root[b])
    near = [(a, b) for a in sets for b in sets if a < b and a % 3 == b % 3 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in range(60):
        for a, b in near:
            want[a] = want[b] = min(want[a], want[b])
    assert root == want and len(set(want)) > 3
    if (nodes, size) == (1000, 1 << 20):
        assert {a: b for a, b, whole in got if whole} == {k: r for k, r in enumerate(want) if want.count(r) > 1}


def test_string_ids(spark):
    docs = spark.createDataFrame([("b", "x y z"), ("a", "X y z"), ("c", "q")], "doc_id string, text string")
    assert {r.doc_id for r in simhash_dedup(docs, similarity=0.8).collect()} == {"a", "c"}


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "a b c d e f"), (None, "a b c d e f"), (3, " \n"), (4, "q w e r t y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit(1), "node": F.lit("n")})
    got = {(r.id, bytes(r.fp)): r.component for r in simhash_groups(docs).collect()}
    assert got[(1, bytes(8))] == got[(2, bytes(8))] == got[(3, bytes(8))] == 1
    assert {r.doc_id for r in simhash_dedup(docs).collect()} == {1, None, 4}
    assert simhash_dedup(docs).count() == 3
    assert simhash_groups(docs.limit(0)).count() == 0 and simhash_dedup(docs.limit(0)).count() == 0
