"""Documents in blocks and their words in parts, for models that pass over all documents again and again.

A block is some thousands of documents as counts of words, which have numbers of the block's own. A part is the words of
one hash range. A step sends each block the rows of its own words, works on the block, and adds up what it sends back where
the words are. So neither a task nor the driver holds a row for each word of the collection, and pairs of document and
word are never shuffled after the blocks are made. Blocks and parts are keyed RDDs with partitioners of their own, whose
unions need no shuffle.
"""

from __future__ import annotations

import gc
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thresher.functions import text as tx

from .index import cut_by_length
from .lineage import _folder, scratch

#: Words of a block and of what a task works on at once, about.
BLOCK, AT_ONCE = 6_000_000, 2_000_000
BINARIES = T.ArrayType(T.BinaryType())


def words(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", tx.content_words("text").alias("words"))


def _same(x: int) -> int:
    return x


def listed(x: pa.Array) -> pa.ListArray:
    """An array as the one value of a list column."""
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)


def _block(held: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
    d = pa.concat_arrays([b.column(1).flatten() for b in held]).dictionary_encode()
    terms, index, used = d.dictionary, np.asarray(d.indices, np.int64), 0
    n, df, cf = max(1, len(terms)), np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
    parts: list[list[bytes]] = [[], [], []]
    for b in held:
        row = np.repeat(np.arange(len(b)), np.asarray(b.column(1).value_lengths()))
        keys, counts = np.unique(row * n + index[used : used + len(row)], return_counts=True)
        used += len(row)
        at = keys % n
        df += np.bincount(at, minlength=len(df))[: len(df)]
        cf += np.bincount(at, counts, minlength=len(cf))[: len(cf)].astype(np.int64)
        for to, x in zip(parts, (np.bincount(keys // n, minlength=len(b)), at, counts), strict=True):
            to.append(x.astype(np.int32).tobytes())
    ids = pa.concat_arrays([b.column(0) for b in held])
    columns = [pa.array([number], pa.int64()), listed(ids), listed(terms), listed(pa.array(df)), listed(pa.array(cf)), *(listed(pa.array(p, pa.binary())) for p in parts)]
    return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "terms", "df", "cf", "lengths", "at", "counts"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size, number = [], 0, TaskContext.get().partitionId() << 20
    for b in batches:
        for some in cut_by_length(b, 1, AT_ONCE):
            held.append(some)
            size += len(some.column(1).flatten())
            if size >= BLOCK:
                yield _block(held, number)
                held, size, number = [], 0, number + 1
    if held:
        yield _block(held, number)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a part: its words with documents and a hash, then for each block the places of its words in the part and in it."""
    found = [b for b in batches if len(b)]
    if not found:
        return
    t = pa.Table.from_batches(found)
    part = TaskContext.get().partitionId()
    d = t["term"].combine_chunks().dictionary_encode()
    here, there, block = np.asarray(d.indices, np.int64), np.asarray(t["i"]), np.asarray(t["block"])
    names = ["part", "block", "terms", "df", "hash", "here", "there"]
    df, h = np.bincount(here, np.asarray(t["df"])), np.zeros(len(d.dictionary), np.int64)
    h[here] = np.asarray(t["hash"])
    nothing = pa.array([None], pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([None], pa.int64()), listed(d.dictionary), pa.array([df.astype(np.int64).tobytes()]), pa.array([h.tobytes()]), nothing, nothing], names=names)
    order = np.argsort(block, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
        to = [pa.array([x[some].astype(np.int32).tobytes()]) for x in (here, there)]
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block[some[0]]], pa.int64()), listed(d.dictionary[:0]), nothing, nothing, *to], names=names)


def ints(x: bytes, kind: type = np.int32) -> np.ndarray:
    return np.frombuffer(bytes(x), kind)


def _by_kind(items: Iterator[tuple]) -> dict[int, dict[str, list[tuple]]]:
    found: dict = defaultdict(lambda: defaultdict(list))
    for key, (kind, *rest) in items:
        found[key][kind].append(rest)
    return found


class Corpus:
    """Blocks and parts of docs (doc_id, text), as tables in the shared folder. vocabulary: all words, or the most frequent."""

    def __init__(self, docs: DataFrame, vocabulary: int | None = None):
        self.docs, self.spark, self.vocabulary = docs, docs.sparkSession, vocabulary
        path, kind = scratch(self.spark), docs.schema["doc_id"].dataType
        longs = T.ArrayType(T.LongType())
        columns = {"block": T.LongType(), "ids": T.ArrayType(kind), "terms": T.ArrayType(T.StringType()), "df": longs, "cf": longs, "lengths": BINARIES, "at": BINARIES, "counts": BINARIES}
        words(docs).mapInArrow(_blocks, T.StructType([T.StructField(*c) for c in columns.items()])).write.parquet(f"{path}/blocks")
        self.table = self.spark.read.parquet(f"{path}/blocks")
        found = self.table.select("block", F.size("ids").alias("n")).collect()  # a row for each block
        self.n, self.numbers = sum(r.n for r in found), {b: i for i, b in enumerate(sorted(r.block for r in found))}
        seen = self.table.select("block", F.posexplode(F.arrays_zip("terms", "df", "cf")).alias("i", "x")).select("block", "i", F.col("x.terms").alias("term"), "x.df", "x.cf")
        if vocabulary:
            seen = seen.join(seen.groupBy("term").agg(F.sum("cf").alias("n")).orderBy(F.desc("n"), "term").limit(vocabulary).select("term"), "term", "left_semi")
        self.size = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        kinds = "part int, block long, terms array<string>, df binary, hash binary, here binary, there binary"
        seen.select("term", "block", "i", "df", F.xxhash64("term").alias("hash")).repartition(self.size, "term").mapInArrow(_parts, kinds).write.parquet(f"{path}/parts")
        parts = self.spark.read.parquet(f"{path}/parts")
        self.parts = parts.where("block IS NULL").select("part", "terms", "df", "hash")
        number = self.numbers
        self.routes = self.to_parts(parts.where("block IS NOT NULL").select("part", "block", "here", "there").rdd.map(lambda r: (r[0], ("route", number[r[1]], bytes(r[2]), bytes(r[3])))))
        self.blocks = self.to_blocks(self.table.select("block", "lengths", "at", "counts").rdd.map(lambda r: (number[r[0]], ("block", *([bytes(x) for x in c] for c in r[1:])))))

    def to_parts(self, rdd: RDD) -> RDD:
        return rdd.partitionBy(self.size, _same)

    def to_blocks(self, rdd: RDD) -> RDD:
        return rdd.partitionBy(max(1, len(self.numbers)), _same)

    def on_parts(self, f: Callable, kind: str, table: DataFrame) -> RDD:
        """f(columns of a part but its number) as the state of a part."""
        return self.to_parts(table.rdd.map(lambda r: (r[0], (kind, f(*r[1:])))))

    def placed(self, idf: RDD) -> RDD:
        """For each block, where the words of each part stand in it, with their idf."""

        def out(items: Iterator[tuple]) -> Iterator[tuple]:
            for part, x in _by_kind(items).items():
                for block, here, there in x["route"]:
                    yield block, ("place", part, there, x["idf"][0][0][ints(here)].tobytes())

        return self.to_blocks(self.routes.union(idf).mapPartitions(out))

    def step(self, state: RDD, places: RDD, send: Callable, work: Callable, receive: Callable | None = None) -> RDD:
        """send(state) are rows of a part's words, each block gets its own, and work(block, idf, rows) is (rows to send back or
        None, anything). Without receive, a block's number and its anything; else the state of a part after receive(state,
        sums of rows sent back, what blocks gave), which each block gives to one part of its own."""

        def out(items: Iterator[tuple]) -> Iterator[tuple]:
            for part, x in _by_kind(items).items():
                rows = np.asarray(send(x["state"][0][0]), np.float32)
                for block, here, _ in x["route"]:
                    yield block, ("rows", part, rows[ints(here)].tobytes())

        def worked(items: Iterator[tuple]) -> Iterator[tuple]:
            for block, x in _by_kind(items).items():
                where, values = {p: (ints(there), ints(v, np.float64)) for p, there, v in x["place"]}, dict(x.pop("rows", []))
                size = 1 + max((int(t.max()) for t, _ in where.values()), default=-1)
                size = max(size, 1 + max((int(a.max()) for a in map(ints, x["block"][0][1]) if len(a)), default=-1))
                width = next((len(v) // 4 // len(where[p][0]) for p, v in values.items()), 0)
                idf, rows = np.zeros(size), np.zeros((width, size), np.float32)
                for p, (there, v) in where.items():
                    idf[there] = v
                    rows[:, there] = ints(values.pop(p), np.float32).reshape(-1, width).T
                back, more = work(_chunks(x["block"][0]), idf, rows)
                if receive is None:
                    yield block, more
                    continue
                for n, (p, (there, _)) in enumerate(where.items()):
                    yield p, ("back", block, np.ascontiguousarray(back[:, there].T, np.float32).tobytes(), more if n == 0 else None)

        def gathered(items: Iterator[tuple]) -> Iterator[tuple]:
            for part, x in _by_kind(items).items():
                state, here, total, mores = x["state"][0][0], {b: ints(h) for b, h, _ in x["route"]}, None, []
                for block, data, more in sorted(x["back"], key=lambda m: m[0]):  # sums in one order
                    at = here[block]
                    rows = ints(data, np.float32).reshape(len(at), -1)
                    total = np.zeros((len(_first(state)), rows.shape[1])) if total is None else total
                    total[at] += rows  # a word stands in a block once
                    mores += [more] if more is not None else []
                yield part, ("state", receive(state, total, mores))

        sent = self.to_blocks(self.routes.union(state).mapPartitions(out))
        done = self.blocks.union(places).union(sent).mapPartitions(worked)
        return done if receive is None else self.routes.union(state).union(self.to_parts(done)).mapPartitions(gathered, preservesPartitioning=True)

    def kept(self, rdd: RDD, old: RDD | None = None) -> RDD:
        """rdd, worked out once and written to the shared folder, in place of old; shuffles that only old states need can go."""
        _folder(self.spark)
        rdd.persist(StorageLevel.DISK_ONLY)
        rdd.checkpoint()
        rdd.count()
        if old is not None:
            old.unpersist()
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        return rdd


def _first(state):
    return state[0] if isinstance(state, tuple) else state


def _chunks(block: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Lengths of rows, places of their words and counts."""
    return ((ints(n), ints(a), ints(c)) for n, a, c in zip(*block, strict=True))


def table_of(spark: SparkSession, rdd: RDD, key: str, columns: str, f: Callable) -> DataFrame:
    """A table of key and columns, which f makes of a value: few rows of long binaries."""
    return spark.createDataFrame(rdd.map(lambda x: (x[0], *f(x[1]))), f"{key} long, {columns}")
