"""SimHash near-duplicate detection over pigeonhole blocks.

A 64-bit fingerprint is cut into blocks; a key is the content of some of the blocks. With all combinations of
``blocks - max_distance`` blocks, fingerprints of at most max_distance differing bits are sure to share a key (pigeonhole).
For a similarity of sets of shingles, which many differing bits go with, the blocks are words of their own: a hash deals the
shingles of a set to parts, and each part has a SimHash of 64 bits. The few shingles in which two similar sets differ touch
few parts, so the words of the others are equal. There are about 57 words, a number that grows with neither the corpus
nor the text, and a pair at the similarity shares none with a chance of 1e-9. A distance of wide fingerprints (512 bits,
which a pair exceeds as seldom) makes clusters, in which the exact Jaccard similarity of the sets then decides.

Equal fingerprints are one node first, so groups of copies of any size are one row from there on. Nodes are joined on
keys, and Hamming distances are verified bucket by bucket with numpy. Of a small bucket all links are reported; in a
larger one a search spreads from node to node and reports one link for each node it reaches, so a cluster of n nodes
gives n - 1 rows, never n squared, and is left out of further comparisons once reached. Buckets beyond ``chunk`` nodes
are dealt into chunks, and each pair of chunks is one task of bounded memory; no partner or candidate is dropped.

Cases: a null text is empty; a text without words has the fingerprint zero and links like any other. A null id is
ignored where the smallest is taken, a group of null ids alone has a null component. Repeated rows are copies. Very long
texts are hashed whole, in pieces. An empty table gives an empty result. Ids may be of any type that has an order. Other
columns are not looked at, whatever their names.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from hashlib import md5
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_row, checkpoint, quoted, read, without_rows
from .components import components

LANES = np.uint64(0x0101010101010101)
#: Nodes of a bucket up to which all of its links are found at once.
SMALL = 16
#: Nodes that one task compares at most with as many others.
CHUNK = 16_384
#: A key that more than one node in so many has is hot.
HOT_SHARE = 256
PIECE = 4096
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Chance that a pair at the similarity shares no word of a part; the distance may miss a pair as seldom.
MISS = 1e-9
#: Nodes and bytes of sets that one task compares at most with as many others (a single set may be larger).
SET_NODES, SET_BYTES = 4096, 8 << 20
#: Digests of texts (32 bytes a row) that are broadcast at most; beyond, the texts are shuffled.
BROADCAST_TEXTS = 250_000
#: Shingles in a part on average, of the largest sets of a class.
PER_PART = 5


@dataclass(frozen=True)
class Scheme:
    """How texts become fingerprints and fingerprints become keys."""

    shingle: int = 4
    words: int = 1  # of 64 bits
    max_distance: int = 4
    blocks: int = 6
    together: int = 2  # blocks in a key
    distinct: bool = False  # count a shingle once
    similarity: float | None = None  # of sets of shingles: keys are words of parts, not blocks

    @cached_property
    def edges(self) -> list[int]:
        return [64 * self.words * k // self.blocks for k in range(self.blocks + 1)]

    @cached_property
    def keys(self) -> list[tuple[int, ...]]:
        if self.together > self.blocks - self.max_distance:
            raise ValueError(f"{self.blocks} blocks and {self.max_distance} differing bits leave {self.blocks - self.max_distance} sure blocks, not {self.together}")
        return list(itertools.combinations(range(self.blocks), self.together))


def exact_scheme(nodes: int, shingle: int = 4, max_distance: int = 4) -> Scheme:
    """64 bits with sure blocks. The more nodes, the more bits in a key, so that unrelated nodes seldom meet in a bucket.
    All choices find the same links."""
    for more in itertools.count(3):
        blocks = max_distance + more
        if nodes << 4 <= 1 << (64 * more // blocks) or blocks > 16:
            return Scheme(shingle=shingle, max_distance=max_distance, blocks=blocks, together=more)


def worst_difference(similarity: float) -> float:
    """The largest probability that a bit differs between two sets of at least that similarity. In large sets it is
    acos(2j / (1 + j)) / pi; in small ones ties, which become 0, can make it larger, so those are counted out."""
    worst = math.acos(2 * similarity / (1 + similarity)) / math.pi
    for c in range(1, 65):  # members in both; a and b in one only
        for more in range(1, int(c / similarity - c + 1e-9) + 1):
            for a in range(more // 2 + 1):
                b, p = more - a, 0.0
                for t in range(c + 1):
                    over = [sum(math.comb(m, x) for x in range(m + 1) if 2 * (t + x) > c + m) / 2**m for m in (a, b)]
                    p += math.comb(c, t) / 2**c * (over[0] * (1 - over[1]) + over[1] * (1 - over[0]))
                worst = max(worst, p)
    return worst


def similar_scheme(similarity: float = 0.8, shingle: int = 5, words: int = 8) -> Scheme:
    """Wide fingerprints and words of parts for a Jaccard similarity of the sets of shingles."""
    p, n = worst_difference(similarity), 64 * words
    return Scheme(shingle=shingle, words=words, max_distance=math.ceil(n * p - NormalDist().inv_cdf(MISS) * math.sqrt(n * p * (1 - p)) + 0.5), distinct=True, similarity=similarity)


def _least_size(similarity: float) -> int:
    """The smallest set that a different one can be similar to."""
    return math.ceil(similarity / (1 - similarity) - 1e-9)


@lru_cache(512)
def dealing(k: int, similarity: float) -> tuple[int, int]:
    """Into how many parts sets of class k are dealt, and how many words they get. Two sets of n that are just similar
    differ in at most ``apart`` shingles, which leave a part alone, with two shingles of both or more, with a chance of
    q; it is so in none of the words with a chance of at most MISS."""
    least = _least_size(similarity)
    lo, hi = max(least, math.ceil(similarity * (least << k) - 1e-9)), (least << k + 1) - 1
    m, q = max(2, round((hi + 1) / PER_PART)), 1.0
    for n in sorted({lo + (hi - lo) * t // 64 for t in range(65)}):
        apart = math.floor(2 * n * (1 - similarity) / (1 + similarity) + 1e-9)
        both, left = n - apart // 2, 1 - 1 / m
        q = min(q, left**apart * (1 - left**both - both / m * left ** (both - 1)))
    return m, math.ceil(math.log(MISS) / math.log1p(-q))


def part_words(h: np.ndarray, similarity: float) -> np.ndarray:
    """Keys of the words of a set of shingle hashes (distinct). Classes of sizes are twice as wide each time; a set at the
    upper end of its class also gets the words of the next, so that similar sets always have a class in common."""
    least, n, out = _least_size(similarity), len(h), []
    if n < least:
        return np.empty(0, np.uint64)
    own = (n // least).bit_length() - 1
    for k in (own, own + 1):
        if k > own and n < similarity * (least << k) - 1e-9:
            break
        m, count = dealing(k, similarity)
        rounds = np.arange(-(-count // m), dtype=np.uint64)
        part = (_scramble(h + (rounds[:, None] + np.uint64(1)) * GOLDEN) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)
        word = (part + rounds[:, None] * np.uint64(m)).reshape(-1).astype(np.int64)
        at = np.flatnonzero(word < count)
        at = at[np.argsort(word[at], kind="stable")]
        word = word[at]
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        sizes = np.diff(np.r_[starts, len(word)])
        bits = np.unpackbits(h[at % n].view(np.uint8).reshape(-1, 8), axis=1)
        made = np.packbits(2 * np.add.reduceat(bits, starts, axis=0, dtype=np.uint32) > sizes[:, None], axis=1).view(np.uint64)[:, 0]
        key = _scramble(made ^ _scramble((word[starts].astype(np.uint64) + np.uint64(1)) * GOLDEN + np.uint64(k)))
        out.append(key[sizes > 1])
    return np.concatenate(out)


def _scramble(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _mix(h: np.ndarray, words: int) -> np.ndarray:
    """Word 0 is the hash itself, the others are independent mixes of it."""
    out = np.empty((len(h), words), np.uint64)
    out[:, 0] = h
    if words > 1:
        out[:, 1:] = _scramble(h[:, None] + GOLDEN * np.arange(1, words, dtype=np.uint64))
    return out


def _counts(h: np.ndarray, words: int) -> np.ndarray:
    """How many of the hashes have each bit, as (words, 64). Eight bits at a time are summed in the bytes of a word, over
    255 rows, which can't overflow."""
    out = np.zeros((words, 8, 8), np.int64)
    for at in range(0, len(h), PIECE):
        x = _mix(h[at : at + PIECE], words)
        for k in range(8):
            lanes = (x >> np.uint64(k)) & LANES
            for a in range(0, len(x), 255):
                out[:, :, k] += lanes[a : a + 255].sum(0).view(np.uint8).reshape(words, 8)
    return out.reshape(words, 64)


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 (seed 42) of the k-word shingles of a text, A-Z lower-cased; of fewer words, of all of them."""
    ws = text.lower().split()
    if not ws:
        return np.empty(0, np.uint64)
    joined = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(ws) - k + 1)
    stops = ends[min(k, len(ws)) - 1 :]
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), stops.tolist(), strict=True)), np.uint64, n)


def _print(h: np.ndarray, words: int) -> bytes:
    return np.packbits(2 * _counts(h, words) > len(h), axis=1, bitorder="little")[:, ::-1].tobytes()


def fingerprint(text: bytes, s: Scheme) -> bytes:
    h = shingle_hashes(text, s.shingle)
    return _print(np.unique(h) if s.distinct else h, s.words)


def shingle_set(text: bytes, k: int) -> bytes:
    """The sorted hashes of the distinct shingles."""
    return np.unique(shingle_hashes(text, k)).astype("<u8").tobytes()


def fingerprints(docs: DataFrame, s: Scheme, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest (MD5 of the text), fp (binary, big-endian words) of each row, and for a similarity, shingles (MD5 of
    their set) and keys (of the words of its parts, 8 bytes each)."""
    source = docs.select(quoted(id_col).alias("id"), F.encode(F.coalesce(quoted(text_col), F.lit("")), "UTF-8").alias("t"))
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), *(T.StructField(c, T.BinaryType()) for c in ["digest", "fp"] + ["shingles", "keys"] * bool(s.similarity))])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t in b.column(1).to_pylist():
            if s.similarity:
                h = np.unique(shingle_hashes(t, s.shingle))
                rows.append((md5(t).digest(), _print(h, s.words), md5(h.astype("<u8").tobytes()).digest(), part_words(h, s.similarity).tobytes()))
            else:
                rows.append((md5(t).digest(), fingerprint(t, s)))
        cols = list(zip(*rows, strict=True)) or [()] * (len(schema) - 1)
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.binary()) for c in cols)], names=schema.names)

    return source.mapInArrow(by_row(run), schema)


def _matrix(column: pa.Array, words: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").reshape(-1, words).astype("<u8")


def block_keys(nodes: DataFrame, s: Scheme, hot: np.ndarray | None = None, only_hot: bool = False) -> DataFrame:
    """node, key, word (the first of the fingerprint) for each table, or for each word of a part. A table's key is a hash
    of its number and the content of its blocks, so a bucket may hold two tables' nodes by accident, which the verified
    distance puts right. hot: sorted keys to leave out, or to give alone."""

    def of_blocks(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        combos = s.keys
        bits = np.unpackbits(_matrix(b.column(1), s.words).view(np.uint8), axis=1, bitorder="little")
        parts = np.zeros((s.blocks, len(bits)), np.uint64)
        for k, (a, z) in enumerate(itertools.pairwise(s.edges)):
            for i in range(a, z):
                parts[k] = parts[k] << np.uint64(1) | bits[:, i]
        keys = np.empty((len(bits), len(combos)), np.uint64)
        for t, combo in enumerate(combos):
            x = np.full(len(bits), t + 1, np.uint64)
            for k in combo:
                x = (x ^ parts[k]) * np.uint64(0xBF58476D1CE4E5B9)
                x ^= x >> np.uint64(32)
            keys[:, t] = x
        return keys.reshape(-1), np.full(len(bits), len(combos))

    def of_parts(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        each = b.column(2).to_pylist()
        return np.frombuffer(b"".join(each), np.uint64), np.array([len(x) // 8 for x in each], np.int64)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        keys, counts = of_parts(b) if s.similarity else of_blocks(b)
        word = _matrix(b.column(1), s.words)[:, 0].view(np.int64)
        cols = [np.repeat(b.column(0).to_numpy(), counts), keys.view(np.int64), np.repeat(word, counts)]
        if hot is not None:
            found = hot[np.minimum(np.searchsorted(hot, cols[1]), len(hot) - 1)] == cols[1]
            cols = [c[found == only_hot] for c in cols]
        return pa.RecordBatch.from_arrays(list(map(pa.array, cols)), names=["node", "key", "word"])

    return nodes.select("node", "fp", *["keys"] * bool(s.similarity)).mapInArrow(by_row(run, 1024), "node long, key long, word long")


def hot_keys(nodes: DataFrame, n: int, s: Scheme) -> np.ndarray:
    """Keys that about one node in HOT_SHARE or more has, as a sample of bounded size shows; there are at most as many as
    tables times HOT_SHARE. They only decide how rows are dealt, not what is compared."""
    step = max(1, n // (16 * HOT_SHARE))
    some = block_keys(nodes.where(F.pmod(F.xxhash64("node", F.lit(step)), F.lit(step)) == 0), s)
    least = max(8, n // step // HOT_SHARE)
    return np.array(sorted(r.key for r in some.groupBy("key").count().where(F.col("count") >= least).select("key").collect()), np.int64)


def _sifted(batches: Iterator[pa.RecordBatch], near: int) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of key: of a bucket of up to SMALL rows those whose word lies within ``near`` bits of another's,
    of a larger bucket all. A task holds no more of a bucket than tells it apart."""
    big: int | None = None  # the key of a large bucket that the last batch ended in
    tail = [np.empty(0, np.int64)] * 3

    def out(cols: list[np.ndarray], last: bool) -> pa.RecordBatch:
        nonlocal big, tail
        node, key, word = cols
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        large = sizes > SMALL
        large[0] |= big == int(key[0])
        stop = len(key) if last or large[-1] else int(starts[-1])
        big, tail = int(key[-1]) if large[-1] else None, [c[stop:] for c in cols]
        of, keep = np.repeat(np.arange(len(starts)), sizes)[:stop], np.repeat(large, sizes)[:stop]
        small, bits = ~keep, word[:stop].view(np.uint64)
        for step in range(1, min(SMALL, int(sizes.max()))):
            at = np.flatnonzero((of[step:] == of[:-step]) & small[step:])
            at = at[np.bitwise_count(bits[at] ^ bits[at + step]) <= near]
            keep[at] = keep[at + step] = True
        return pa.RecordBatch.from_arrays([pa.array(node[:stop][keep]), pa.array(key[:stop][keep])], names=["node", "key"])

    for b in batches:
        if b.num_rows:
            yield out([np.r_[t, b.column(i).to_numpy()] for i, t in enumerate(tail)], False)
    if len(tail[0]):
        yield out(tail, True)


def shared_keys(nodes: DataFrame, s: Scheme) -> DataFrame:
    """node, key for keys by which a node may have met one within the distance. Keys meet in one shuffle and are sorted;
    rows of hot keys are known to be shared and stay where they are made."""
    hot = hot_keys(nodes, nodes.count(), s)
    near = 64 if s.similarity else s.max_distance
    cold = block_keys(nodes, s, hot if len(hot) else None)
    if s.similarity:
        cold = cold.withColumn("word", F.lit(0).cast("long"))
    found = cold.repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: _sifted(batches, near), "node long, key long")
    return found.union(block_keys(nodes, s, hot, only_hot=True).select("node", "key")) if len(hot) else found


def _distance(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(-1, dtype=np.int64)


def _spread(node: np.ndarray, fp: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Links of one bucket that connect all that its links connect: one for each node reached from another."""
    left = np.arange(len(node))
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            v = queue.pop()
            near = np.zeros(len(left), bool)
            for at in range(0, len(left), 65_536):
                near[at : at + 65_536] = _distance(fp[left[at : at + 65_536]] ^ fp[v]) <= most
            hit = left[near]
            queue += hit.tolist()
            left = left[~near]
            yield from ((int(node[v]), int(node[x])) for x in hit)


def bucket_links(node: np.ndarray, key: np.ndarray, part: np.ndarray, fp: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links of whole buckets, which are runs of equal (key, part)."""
    if not len(node):
        return []
    starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
    sizes = np.diff(np.r_[starts, len(node)])
    out: list[tuple[int, int]] = []
    of = np.repeat(np.arange(len(starts)), sizes)
    small = np.repeat(sizes <= SMALL, sizes)
    for step in range(1, min(SMALL, int(sizes.max()))):
        at = np.flatnonzero((of[step:] == of[:-step]) & small[step:])
        at = at[_distance(fp[at] ^ fp[at + step]) <= most]
        out += zip(node[at].tolist(), node[at + step].tolist(), strict=True)
    for k in np.flatnonzero(sizes > SMALL):
        a, z = starts[k], starts[k] + sizes[k]
        out += _spread(node[a:z], fp[a:z], most)
    return out


def _parts(c: Column) -> Column:
    """The parts that a node goes to if its group is dealt into c chunks: one for each pair of its own chunk and another."""
    mine = F.pmod(F.xxhash64("node"), c)
    return F.when(c == 1, F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), c - 1), lambda o: F.least(o, mine) * c + F.greatest(o, mine)))


def _met(nodes: DataFrame, s: Scheme, chunk: int) -> DataFrame:
    """node, key, part: buckets, dealt into parts that are compared whole."""
    keys = checkpoint(shared_keys(nodes, s))
    # Grouped by a struct, so that the join has shuffles of its own: adaptive execution splits a hot key only between two.
    large = keys.groupBy(F.struct("key").alias("g")).agg(F.ceil(F.count("*") / F.lit(chunk)).cast("long").alias("c")).where("c > 1").select("g.key", "c")
    met = keys.join(large, "key", "left").withColumn("c", F.coalesce("c", F.lit(1).cast("long")))
    return met.select("node", "key", F.explode(_parts(F.col("c"))).alias("part"))


def _bucket_pairs(dealt: DataFrame, s: Scheme) -> DataFrame:
    """a, b: links of whole parts of buckets (node, key, part, fp), as bucket_links has them."""
    # The number of tasks follows the rows, as shuffle partitions do; buckets are bounded, so none of them is large. In the
    # order of nodes the searches of many buckets start from the same node and report the same links.
    dealt = dealt.select("node", "key", "part", "fp").repartition("key", "part").sortWithinPartitions("key", "part", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: list[tuple[np.ndarray, ...]] = []  # what there is so far of the last bucket

        def out(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            links = bucket_links(*(np.concatenate(x) for x in zip(*parts, strict=True)), s.max_distance)
            a, b = zip(*links, strict=True) if links else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            cols = (b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), _matrix(b.column(3), s.words))
            _, key, part, _ = cols
            other = np.flatnonzero((key != key[-1]) | (part != part[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if tail and (cut or (tail[0][1][0], tail[0][2][0]) != (key[-1], part[-1])) or cut:
                yield out([*tail, tuple(x[:cut] for x in cols)])
                tail = []
            tail.append(tuple(x[cut:] for x in cols))
        if tail:
            yield out(tail)

    return dealt.mapInArrow(run, "a long, b long")


def fingerprint_links(nodes: DataFrame, s: Scheme, chunk: int = CHUNK) -> DataFrame:
    """a, b: links between nodes (node long, fp binary) that connect all that lie within the distance."""
    return _bucket_pairs(_met(nodes, s, chunk).join(nodes.select("node", "fp").hint("merge"), "node"), s)


def set_links(node: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Of the nodes of one cluster those that pairs of the Jaccard similarity connect, each with the first node connected
    to it, itself included; found exactly. Overlaps with all other sets are counted at once from lists of the sets that
    hold a shingle."""
    sizes = np.array([len(x) for x in sets])
    names, at = np.unique(np.concatenate(sets), return_inverse=True)
    of = np.repeat(np.arange(len(sets)), sizes)
    lists = of[np.argsort(at, kind="stable")]
    stops = np.cumsum(np.bincount(at, minlength=len(names)))
    edges = np.r_[0, np.cumsum(sizes)]
    root = np.arange(len(sets))
    for x in range(len(sets) - 1):
        mine = at[edges[x] : edges[x + 1]]
        n = stops[mine] - np.r_[0, stops][mine]
        common = np.bincount(lists[np.repeat(stops[mine] - np.cumsum(n), n) + np.arange(n.sum())], minlength=len(sets))
        near = (common >= similarity * (sizes + sizes[x] - common) - 1e-9) & (root != root[x])
        if near.any():
            met = np.unique(np.r_[root[x], root[near]])
            root[np.isin(root, met)] = met[0]
            if not root.any():  # all are one
                break
    many = np.bincount(root, minlength=len(sets))[root] > 1
    return list(zip(node[many].tolist(), node[root[many]].tolist(), strict=True))


def cluster_links(sets: DataFrame, similarity: float, nodes: int = SET_NODES, size: int = SET_BYTES) -> DataFrame:
    """a, b, whole: links of clusters (node, root, hashes), as set_links has them. A cluster of many nodes or bytes is dealt
    into chunks, each pair of chunks is one task of bounded memory, and its links are not the whole cluster's."""
    # Grouped by a struct, so that the join can split a large cluster.
    large = sets.groupBy(F.struct("root").alias("g")).agg(F.greatest(F.ceil(F.count("*") / F.lit(nodes)), F.ceil(F.sum(F.octet_length("hashes")) / F.lit(size))).cast("long").alias("c"))
    large = large.where("c > 1").select("g.root", "c")
    met = sets.join(large, "root", "left").withColumn("c", F.coalesce("c", F.lit(1).cast("long")))
    dealt = met.select("node", "root", "hashes", (F.col("c") == 1).alias("whole"), F.explode(_parts(F.col("c"))).alias("part")).repartition("root", "part").sortWithinPartitions("root", "part", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node, some, all_there = None, [], [], True

        def out() -> pa.RecordBatch:
            links = set_links(np.array(node), some, similarity)
            a, b = zip(*links, strict=True) if links else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([all_there] * len(a), pa.bool_())], names=["a", "b", "whole"])

        for b in batches:
            for i, r, x, p, whole in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (r, p) != key:
                    if len(node) > 1:
                        yield out()
                    key, node, some, all_there = (r, p), [], [], whole
                node.append(i)
                some.append(np.frombuffer(x, "<u8"))
        if len(node) > 1:
            yield out()

    return dealt.select("node", "root", "hashes", "part", "whole").mapInArrow(run, "a long, b long, whole boolean")


def similar_nodes(docs: DataFrame, nodes: DataFrame, s: Scheme, text_col: str, chunk: int = CHUNK, broadcast: int = BROADCAST_TEXTS) -> DataFrame:
    """node, root (the smallest node of its component) for nodes (node, fp, text, keys) linked to others by the similarity
    of their shingles. Pairs within the distance that share a key make clusters; within a cluster the sets of shingles
    decide, of all its nodes."""
    dealt = _met(nodes, s, chunk).join(nodes.select("node", "fp").hint("merge"), "node")
    clusters = checkpoint(components(_bucket_pairs(dealt, s), "a", "b"))
    # Sets are made of the texts of nodes in clusters alone, one text for each.
    wanted = checkpoint(clusters.join(nodes.select("node", "text"), "node"))
    few = wanted.limit(broadcast + 1).count() <= broadcast
    source = docs.select(F.coalesce(quoted(text_col), F.lit("")).alias("t")).withColumn("text", F.unhex(F.md5("t"))).join(F.broadcast(wanted) if few else wanted, "text")
    source = source.dropDuplicates(["node"]).select("node", "root", F.encode("t", "UTF-8").alias("t"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([shingle_set(t, s.shingle) for t in b.column(2).to_pylist()], pa.binary())], names=["node", "root", "hashes"])

    links = checkpoint(cluster_links(checkpoint(source.mapInArrow(by_row(run), "node long, root long, hashes binary")), s.similarity))
    met, rest = links.where("whole").select(F.col("a").alias("node"), F.col("b").alias("root")), links.where("NOT whole")
    return met if rest.isEmpty() else met.union(components(rest, "a", "b"))


def simhash_groups(docs: DataFrame, scheme: Scheme | None = None, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, chunk: int = CHUNK) -> DataFrame:
    """id, digest, fp, component (the smallest id reachable) and group (any number) of each row. Give a scheme, or a
    similarity of shingles, which links are verified by; else 4 of 64 bits may differ."""
    if similarity is not None and not (scheme is None and 0.5 <= similarity < 1):
        raise ValueError("a similarity from 0.5 to below 1, without a scheme")
    first = similar_scheme(similarity) if similarity else scheme or Scheme()
    rows = checkpoint(fingerprints(docs, first, id_col, text_col))
    same = ["fp", "shingles"] if similarity else ["fp"]
    more = [F.min("digest").alias("text"), F.first("keys").alias("keys")] if similarity else []
    nodes = rows.groupBy(*same).agg(F.min("id").alias("least"), *more).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    nodes = checkpoint(nodes.withColumn("node", F.monotonically_increasing_id()))  # many parts, as each node has many keys
    s = first if scheme or similarity else exact_scheme(nodes.count())
    met = similar_nodes(docs, nodes, s, text_col, chunk) if similarity else components(fingerprint_links(nodes, s, chunk), "a", "b")
    met = checkpoint(met.join(nodes.select("node", "least").hint("merge"), "node").select("node", "root", "least"))
    of_root = met.groupBy(F.struct("root").alias("g")).agg(F.min("least").alias("component")).select("g.root", "component")
    moved = met.join(of_root.hint("merge"), "root").select("node", "root", "component")
    named = nodes.join(moved.hint("merge"), "node", "left").select(*same, F.coalesce("component", "least").alias("component"), F.coalesce("root", "node").alias("group"))
    return rows.join(named.hint("merge"), same).select("id", "digest", "fp", "component", "group")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each group, one with the smallest id; all columns as they were."""
    found = checkpoint(simhash_groups(docs, id_col=id_col, text_col=text_col, **options))
    of = ["id", "digest"]
    # Grouped by a struct, so that the join can split a large group.
    stays = found.groupBy(F.struct("group").alias("g")).agg(F.min(F.struct(*of)).alias("m"), F.count("*").alias("n")).where("n > 1").select("g.group", "m")
    met = checkpoint(found.join(stays.hint("merge"), "group").groupBy(*of).agg(F.bool_or(F.struct(*of).eqNullSafe(F.col("m"))).alias("stays"), F.count("*").alias("n")))
    digest = F.unhex(F.md5(F.coalesce(quoted(text_col), F.lit(""))))
    return without_rows(docs, quoted(id_col), digest, met.where(~F.col("stays")).select(*of), met.where(F.col("stays") & (F.col("n") > 1)).select(*of))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))
