"""Topic models on tf-idf vectors, of all documents and all words. What a model holds for each word stays a table; the driver
holds some numbers a topic. Steps over documents are those of blocks.Corpus."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import LocalLDAModel
from pyspark.ml.feature import CountVectorizerModel, IDFModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import Corpus, ints, words
from .lineage import scratch

__all__ = ["words"]
#: Of the gamma distribution that topics start from, and when the topics of a document stand still. Spark's values.
SHAPE, STILL = 100.0, 1e-3
#: Words that inference works on at once, and steps until it takes plain ones alone.
NEAR, MOST = 100_000, 2_000


def digamma(x: np.ndarray) -> np.ndarray:
    u = x * (x + 5)  # of x + 6, less 1 / (x + i) for i from 0 to 5
    less, x = (2 * x + 5) * (1 / u + 1 / (u + 4) + 1 / (u + 6)), x + 6
    y = 1 / (x * x)
    return np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y * (1 / 132 - y * (691 / 32760)))))) - less


def trigamma(x: np.ndarray) -> np.ndarray:
    x, more = np.array(x, np.float64), 0.0
    for _ in range(6):
        low = x < 6
        more, x = more + np.where(low, 1 / (x * x), 0.0), x + low
    y = 1 / (x * x)
    return 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y * (1 / 30 - y * 5 / 66)))) + more


def _bits(x: np.ndarray) -> np.ndarray:
    """Mixed bits of 64-bit numbers."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn(names: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k draws for each name from the gamma distribution of mean 1 that topics start from (by Wilson and Hilferty), which
    depend on name and seed alone, so that a task that runs again draws the same."""
    own = _bits(names.astype(np.int64).view(np.uint64) ^ _bits(np.array([seed], np.int64).view(np.uint64)))[:, None] + np.arange(2 * k, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    u = ((_bits(own) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    z = np.sqrt(-2 * np.log(u[:, :k])) * np.cos(2 * np.pi * u[:, k:])
    return (1 - 1 / (9 * SHAPE) + z / (3 * np.sqrt(SHAPE))) ** 3


def infer(lengths: np.ndarray, weights: np.ndarray, beta: np.ndarray, alpha: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Variational inference of documents with known topics: gamma (topic x document), its exponential and weight / norm of each
    word. lengths: words of each document, at least 1; beta: topic x word. A document's steps end when one moves it by
    STILL at most. Documents near a saddle need thousands of plain steps, so two plain steps are followed by a squared
    extrapolation along them (SQUAREM), which has the same fixed points; after MOST steps all are plain, which surely end."""
    d, k = len(lengths), len(alpha)
    first, order = np.cumsum(lengths) - lengths, np.argsort(lengths, kind="stable")
    gamma, theta, ratio, a = np.empty((k, d)), np.empty((k, d)), np.empty(len(weights)), 0
    while a < d:  # documents of about one length, filled up to the longest with words of no weight
        z = a + 1
        while z < d and (z + 1 - a) * lengths[order[z]] <= NEAR and lengths[order[z]] <= 1.25 * lengths[order[a]] + 8:
            z += 1
        some = order[a:z]
        has = np.arange(lengths[some[-1]]) < lengths[some][:, None]
        at = np.where(has, first[some][:, None] + np.arange(has.shape[1]), 0)
        b = np.ascontiguousarray(beta[:, at].transpose(1, 0, 2), np.float64)
        gamma[:, some], theta[:, some], r = _inferred(np.where(has, weights[at], 0.0), b, alpha, start)
        ratio[at[has]] = r[has]
        a = z
    return gamma, theta, ratio


def _expected(gamma: np.ndarray) -> np.ndarray:
    return np.exp(digamma(gamma) - digamma(gamma.sum(1))[:, None])


def _inferred(weights: np.ndarray, beta: np.ndarray, alpha: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As infer, of weights (document x word) and beta (document x topic x word)."""
    ratio = lambda theta, w, b: w / (np.matmul(theta[:, None, :], b)[:, 0] + 1e-100)

    def moved(gamma: np.ndarray) -> np.ndarray:
        theta = _expected(gamma)
        return theta * np.matmul(b, ratio(theta, w, b)[:, :, None])[:, :, 0] + alpha

    w, b, row, steps = weights, beta, np.arange(len(weights)), 0
    gamma, out = np.repeat(start[None], len(row), 0), np.empty((len(row), len(alpha)))
    going, farthest = np.ones(len(row), bool), np.full(len(row), 4.0)
    while len(row):
        one = moved(gamma)
        step = one - gamma
        still = going & (np.abs(step).mean(1) <= STILL)
        out[row[still]] = one[still]
        going &= ~still
        if going.sum() <= 0.8 * len(row):  # to look at some of those that stand still costs less than cutting them out
            w, b, row, one, step, gamma, farthest = (x[going] for x in (w, b, row, one, step, gamma, farthest))
            going = np.ones(len(row), bool)
        steps += 2
        two = moved(one)
        if steps > MOST:
            gamma = two
            continue
        turn = two - one - step
        far = np.sqrt((step * step).sum(1) / np.maximum((turn * turn).sum(1), 1e-300))
        farthest = np.where(far >= farthest, farthest * 4, farthest)
        far = np.clip(far, 1.0, farthest / 4)[:, None]
        gamma = np.maximum(gamma + 2 * far * step + far * far * turn, alpha)
    theta = _expected(out)
    return out.T, theta.T, ratio(theta, weights, beta)


def _weighted(chunks, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each chunk of rows: words with a weight in each row, their places and weights."""
    for n, at, counts in chunks:
        w = counts * idf[at]
        row = np.repeat(np.arange(len(n)), n)
        has = w > 0
        yield np.bincount(row[has], minlength=len(n)), at[has], w[has]


def _binaries(*x: np.ndarray) -> tuple[bytearray, ...]:
    return tuple(bytearray(np.ascontiguousarray(a).tobytes()) for a in x)


def _idf(n: int):
    return lambda df: np.log((n + 1) / (ints(df, np.int64) + 1.0))


class Vectoriser:
    """Words and their idf, as a table of parts: part, terms, idf and what a model has for each word, all in one order."""

    def __init__(self, spark: SparkSession, table: DataFrame, corpus: Corpus | None = None):
        self.spark, self.table, self.corpus = spark, table, corpus

    @cached_property
    def _words(self) -> tuple[list[str], np.ndarray]:
        rows = self.table.select("terms", "idf").collect()
        return [t for r in rows for t in r.terms], np.concatenate([ints(r.idf, np.float64) for r in rows] or [np.empty(0)])

    @cached_property
    def pipeline(self) -> PipelineModel:
        """The same as models of Spark's library, for vocabularies that fit the driver."""
        terms, idf = self._words
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        df = sc._gateway.new_array(jvm.long, len(idf))
        old = jvm.org.apache.spark.mllib.feature.IDFModel(jvm.org.apache.spark.mllib.linalg.Vectors.dense(_doubles(sc, idf)), df, 0)
        model = IDFModel(jvm.org.apache.spark.ml.feature.IDFModel(f"IDF_{uuid4().hex[:12]}", old))
        return PipelineModel([CountVectorizerModel.from_vocabulary(terms, "words", "counts"), model._set(inputCol="counts", outputCol="tfidf"), *self._more()])

    def _more(self) -> list:
        return []

    @property
    def stages(self) -> list:
        return self.pipeline.stages

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.pipeline.transform(rows)


def _doubles(sc, x: np.ndarray):
    out = sc._gateway.new_array(sc._jvm.double, len(x))
    for i, v in enumerate(x.tolist()):
        out[i] = v
    return out


class TopicModel(Vectoriser):
    """Topics: beside idf, the weight of each word in each topic (lambda)."""

    def __init__(self, spark: SparkSession, table: DataFrame, alpha: list[float], sums: list[float], seed: int, corpus: Corpus | None = None):
        super().__init__(spark, table, corpus)
        self.alpha, self.sums, self.seed = np.array(alpha), np.array(sums), seed

    @property
    def start(self) -> np.ndarray:
        return drawn(np.array([-1]), len(self.alpha), self.seed)[0]

    def beta(self, weights: np.ndarray) -> np.ndarray:
        return np.exp(digamma(weights) - digamma(self.sums))

    def _more(self) -> list:
        k, jvm, sc = len(self.alpha), self.spark._jvm, self.spark.sparkContext
        weights = np.concatenate([ints(r.weights, np.float64).reshape(-1, k) for r in self.table.select("weights").collect()] or [np.empty((0, k))])
        ml = jvm.org.apache.spark.mllib
        old = ml.clustering.LocalLDAModel(ml.linalg.Matrices.dense(len(weights), k, _doubles(sc, weights.T.ravel())), ml.linalg.Vectors.dense(_doubles(sc, self.alpha)), 1.0 / k, SHAPE)
        return [LocalLDAModel(jvm.org.apache.spark.ml.clustering.LocalLDAModel(f"LDA_{uuid4().hex[:12]}", len(weights), old, self.spark._jsparkSession))._set(k=k, featuresCol="tfidf")]


def fit_lda(docs: DataFrame, k: int = 5, vocabulary: int | None = None, iterations: int = 10, seed: int = 1) -> TopicModel:
    """Variational Bayes in which every row takes part in every iteration, with steps of full length and a prior of topics that
    is learned: of all documents and, unless vocabulary says how many, all words."""
    c = Corpus(docs, vocabulary)
    idf = c.on_parts(_idf(c.n), "idf", c.parts.select("part", "df"))
    places, alpha = c.placed(idf), np.full(k, 1.0 / k)
    state, more = c.kept(c.on_parts(lambda h: (drawn(ints(h, np.int64), k, seed), []), "state", c.parts.select("part", "hash"))), []

    def sums(state: RDD) -> tuple[np.ndarray, list]:
        found = state.map(lambda x: (x[0], x[1][1][0].sum(0), x[1][1][1])).collect()  # a row for each part
        found.sort(key=lambda x: x[0])
        return np.sum([x[1] for x in found], 0) if found else np.ones(k), [m for x in found for m in x[2]]

    total, _ = sums(state)
    for i in range(iterations):
        scale, prior, start, eta = np.exp(-digamma(total)), alpha.copy(), drawn(np.array([i]), k, seed)[0], 1.0 / k

        def work(chunks, idf, rows, scale=scale, prior=prior, start=start):
            back, logs, docs = np.zeros(rows.shape), np.zeros(k), 0
            for n, at, w in _weighted(chunks, idf):
                n = n[n > 0]
                if not len(n):
                    continue
                gamma, theta, ratio = infer(n, w, rows[:, at] * scale[:, None], prior, start)
                for topic in range(k):
                    back[topic] += np.bincount(at, np.repeat(theta[topic], n) * ratio, len(idf))
                logs += (digamma(gamma) - digamma(gamma.sum(0))).sum(1)
                docs += len(n)
            return back, (logs, docs)

        def receive(state, back, more, scale=scale, eta=eta):
            old = state[0]
            return (np.zeros(old.shape) if back is None else back) * np.exp(digamma(old)) * scale + eta, more

        state = c.kept(c.step(state, places, lambda s: np.exp(digamma(s[0])), work, receive), state)
        total, more = sums(state)
        logs, n = sum((m[0] for m in more), np.zeros(k)), sum(m[1] for m in more)
        if n:
            # Newton's step for the prior.
            f = n * (digamma(alpha.sum()) - digamma(alpha) + logs / n)
            z, q = n * trigamma(alpha.sum()), -n * trigamma(alpha)
            b = (f / q).sum() / (1 / z + (1 / q).sum())
            new = alpha - (f - b) / q
            alpha = new if (new > 0).all() else alpha
    path, number = scratch(c.spark), _idf(c.n)
    weights = c.spark.createDataFrame(state.map(lambda x: (x[0], *_binaries(x[1][1][0]))), "part int, weights binary")
    own = c.parts.withColumn("idf", F.udf(lambda df: bytearray(number(df).tobytes()), "binary")("df")).select("part", "terms", "idf", "hash")
    own.join(weights, "part").write.parquet(path)
    return TopicModel(c.spark, c.spark.read.parquet(path), alpha.tolist(), total.tolist(), seed, c)


def _rows(model: TopicModel, f, schema: str) -> DataFrame:
    """f(terms, idf, weights) as record batches of each part of the model."""
    k = len(model.alpha)

    def of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                yield f(b.column(0)[i].values, ints(b.column(1)[i].as_py(), np.float64), ints(b.column(2)[i].as_py(), np.float64).reshape(-1, k))

    return model.table.select("terms", "idf", "weights").mapInArrow(of_parts, schema)


def _own_topics(model: TopicModel, idf: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Topics of each word as a document of its own; zeros where it has no weight."""
    out, has = np.zeros(weights.shape), idf > 0
    for some in np.array_split(np.flatnonzero(has), 1 + has.sum() // 200_000):
        if len(some):
            gamma = infer(np.ones(len(some), np.int64), idf[some], model.beta(weights[some]).T, model.alpha, model.start)[0]
            out[some] = (gamma / gamma.sum(0)).T
    return out


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x, np.float64).ravel()))


def _numbers_of(model: TopicModel, c: Corpus) -> DataFrame:
    """part, idf, weights in the order of the parts of c: 0 and 1 for words that the model does not know."""
    if c is model.corpus:
        return model.table.select("part", "idf", "weights")
    k = len(model.alpha)
    known = _rows(model, lambda t, idf, w: pa.RecordBatch.from_arrays([t, pa.array(idf), _lists(w)], names=["term", "x", "w"]), "term string, x double, w array<double>")
    own = c.parts.select("part", F.posexplode("terms").alias("i", "term")).join(known, "term", "left").repartition(c.size, "part").sortWithinPartitions("part", "i")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if len(b)]
        if not found:
            return
        t = pa.Table.from_batches(found)
        part, x = np.asarray(t["part"]), np.asarray(t["x"].fill_null(0.0))
        w, has = np.ones((len(x), k)), ~np.asarray(t["w"].is_null())
        w[has] = np.asarray(t["w"].combine_chunks().flatten()).reshape(-1, k)
        for some in np.split(np.arange(len(x)), np.flatnonzero(np.diff(part)) + 1):
            yield pa.RecordBatch.from_arrays([pa.array(part[some[:1]], pa.int32()), pa.array([x[some].tobytes()]), pa.array([w[some].tobytes()])], names=["part", "idf", "weights"])

    path = scratch(c.spark)
    own.select("part", "x", "w").mapInArrow(packed, "part int, idf binary, weights binary").write.parquet(path)
    return c.spark.read.parquet(path)


def _corpus(model: TopicModel, docs: DataFrame) -> Corpus:
    return model.corpus if model.corpus is not None and docs.sameSemantics(model.corpus.docs) else Corpus(docs)


def _on_blocks(model: TopicModel, c: Corpus, send, work) -> DataFrame:
    """block, a binary for each array of work's result."""
    k, numbers = len(model.alpha), _numbers_of(model, c)
    places = c.placed(c.on_parts(lambda x: ints(x, np.float64), "idf", numbers.select("part", "idf")))
    state = c.on_parts(lambda x, w: send(ints(x, np.float64), ints(w, np.float64).reshape(-1, k)), "state", numbers.select("part", "idf", "weights"))
    number = {i: b for b, i in c.numbers.items()}
    found = c.step(state, places, lambda s: s, lambda chunks, idf, rows: (None, _binaries(*work(chunks, idf, rows))))
    return found.map(lambda x: (number[x[0]], list(x[1]))).toDF("block long, found array<binary>")


def _topics_of(model: TopicModel, n: np.ndarray, at: np.ndarray, w: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Document x topic; zeros for documents without a weight."""
    out, has = np.zeros((len(n), len(model.alpha))), n > 0
    if has.any():
        gamma = infer(n[has], w, beta[:, at].astype(np.float64), model.alpha, model.start)[0]
        out[has] = (gamma / gamma.sum(0)).T
    return out


def _plain(model: TopicModel) -> TopicModel:
    """The model's numbers without its tables, as tasks take it."""
    return TopicModel(None, None, model.alpha, model.sums, model.seed)


def document_topics(model: TopicModel, docs: DataFrame) -> DataFrame:
    """doc_id, topics: an array that sums to 1, or zeros without a word that the model knows."""
    c, m, k = _corpus(model, docs), _plain(model), len(model.alpha)

    def work(chunks, idf, rows):
        return (np.concatenate([_topics_of(m, n, at, w, rows) for n, at, w in _weighted(chunks, idf)]),)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                yield pa.RecordBatch.from_arrays([b.column(0)[i].values, _lists(ints(b.column(1)[i].as_py()[0], np.float64).reshape(-1, k))], names=["doc_id", "topics"])

    kind = docs.schema["doc_id"].dataType
    rows = c.table.select("block", "ids").join(_on_blocks(model, c, lambda x, w: m.beta(w), work), "block").select("ids", "found")
    return rows.mapInArrow(spread, T.StructType([T.StructField("doc_id", kind), T.StructField("topics", T.ArrayType(T.DoubleType()))]))


def topic_words(model: TopicModel, k: int = 10) -> DataFrame:
    """topic, rank, term, weight: each part gives its own k best, equal ones by term."""
    n, total = len(model.alpha), model.sums

    def best(terms: pa.Array, idf: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
        share, found = weights / total, []
        for topic in range(n):
            least = np.partition(share[:, topic], -k)[-k] if len(share) > k else -1.0
            at = np.flatnonzero(share[:, topic] >= least)
            some = sorted(zip(share[at, topic].tolist(), terms.take(pa.array(at)).to_pylist(), strict=True), key=lambda x: (-x[0], x[1].encode()))[:k]
            found += [(topic, t, x) for x, t in some]
        columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int32(), pa.string(), pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, names=["topic", "term", "weight"])

    w = Window.partitionBy("topic").orderBy(F.desc("weight"), "term")
    return _rows(model, best, "topic int, term string, weight double").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("topic", "rank", "term", "weight")


def word_topics(model: TopicModel, terms: DataFrame) -> DataFrame:
    """term, topics: each word as a document of its own; zeros for words that the model does not know."""
    m, k = _plain(model), len(model.alpha)
    known = _rows(model, lambda t, idf, w: pa.RecordBatch.from_arrays([t, _lists(_own_topics(m, idf, w))], names=["term", "topics"]), "term string, topics array<double>")
    return terms.select("term").join(known, "term", "left").select("term", F.coalesce("topics", F.array_repeat(F.lit(0.0), k)).alias("topics"))


def cosine(a: str, b: str):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def topic_keywords(model: TopicModel, docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, rank, term, similarity: the document's words whose topics are most like its own. Words are compared and ranked
    inside their block."""
    c, m, n_topics = _corpus(model, docs), _plain(model), len(model.alpha)

    def work(chunks, idf, rows):
        found, before = [], 0
        for n, at, w in _weighted(chunks, idf):
            t, own = _topics_of(m, n, at, w, rows[:n_topics]), rows[n_topics:, at].astype(np.float64)
            row = np.repeat(np.arange(len(n)), n)
            of = t[row].T
            like = np.einsum("kn,kn->n", own, of) / np.sqrt(np.einsum("kn,kn->n", own, own) * np.einsum("kn,kn->n", of, of))
            order = np.lexsort((-like, row))
            first = np.cumsum(n) - n
            least = np.repeat(like[order][np.minimum(first + np.minimum(n, k) - 1, len(order) - 1)] if len(order) else like, n)
            keep = order[like[order] >= least]
            found.append((row[keep] + before, at[keep], like[keep]))
            before += len(n)
        row, at, like = (np.concatenate([f[i] for f in found] or [np.empty(0)]) for i in range(3))
        return row.astype(np.int64), at.astype(np.int64), like.astype(np.float64)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                data = b.column(2)[i].as_py()
                row, at, like = ints(data[0], np.int64), ints(data[1], np.int64), ints(data[2], np.float64)
                terms = b.column(1)[i].values.take(pa.array(at)).to_pylist()
                found = sorted(zip(row.tolist(), like.tolist(), terms, strict=True), key=lambda f: f[2].encode(), reverse=True)
                found.sort(key=lambda f: (f[0], -f[1]))
                out, last, rank = [], -1, 0
                for f in found:
                    last, rank = f[0], rank + 1 if f[0] == last else 1
                    if rank <= k:
                        out.append((*f, rank))
                ids = b.column(0)[i].values.take(pa.array([f[0] for f in out], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([f[3] for f in out], pa.int32()), pa.array([f[2] for f in out], pa.string()), pa.array([f[1] for f in out], pa.float64())], names=["doc_id", "rank", "term", "similarity"])

    found = _on_blocks(model, c, lambda x, w: np.hstack([m.beta(w), _own_topics(m, x, w)]), work)
    rows = c.table.select("block", "ids", "terms").join(found, "block").select("ids", "terms", "found")
    return rows.mapInArrow(ranked, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("rank", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("similarity", T.DoubleType())]))


def _rotated(state: tuple, turn: list[np.ndarray] | None) -> list[np.ndarray]:
    """X, its image, P, its image and the next directions, of rows of a part. turn: how they come of the columns kept."""
    basis, image = state
    if turn is None:
        return [basis[:, :0]] * 4 + [basis]
    c, p, values, scale = turn
    x, gx = basis @ c, image @ c
    return [x, gx, basis @ p, image @ p, ((gx - x * values) * scale).astype(np.float32).astype(np.float64)]


def _singular(c: Corpus, places: RDD, k: int, tolerance: float, most: int) -> tuple[RDD, np.ndarray, np.ndarray]:
    """The basis in which the k greatest singular vectors lie, how they lie in it, and the values: a locally optimal block
    method (LOBPCG) on words, in which some vectors more than k are carried. The driver holds products of vectors only."""
    more, turn = k + 3, None
    state = c.kept(c.on_parts(lambda h: (np.log(drawn(ints(h, np.int64), more, 7)), None), "state", c.parts.select("part", "hash")))

    def work(chunks, idf, rows):
        back = np.zeros(rows.shape)
        for n, at, w in _weighted(chunks, idf):
            row = np.repeat(np.arange(len(n)), n)
            for i in range(len(rows)):
                back[i] += np.bincount(at, w * np.bincount(row, w * rows[i, at], len(n))[row], len(idf))
        return back, None

    for _ in range(most):

        def receive(state, back, _, turn=turn):
            x, gx, p, gp, w = _rotated(state, turn)
            return np.hstack([x, p, w]), np.hstack([gx, gp, np.zeros(w.shape) if back is None else back])

        state = c.kept(c.step(state, places, lambda s, turn=turn: _rotated(s, turn)[-1], work, receive), state)
        found = state.map(lambda x: (x[0], [a.T @ b for s, g in [x[1][1]] for a, b in ((s, s), (s, g), (g, g))])).collect()  # a row for each part
        if not found:
            return state, np.zeros((0, 0)), np.zeros(0)
        ss, sg, gg = (sum(m[i] for _, m in sorted(found, key=lambda x: x[0])) for i in range(3))
        size = 1 / np.sqrt(np.maximum(np.diag(ss), 1e-300))
        d, u = np.linalg.eigh(ss * size * size[:, None])
        t = size[:, None] * u[:, d > 1e-9 * d[-1]] / np.sqrt(d[d > 1e-9 * d[-1]])
        values, v = np.linalg.eigh(t.T @ (sg + sg.T) / 2 @ t)
        values, x = values[::-1][:more], (t @ v[:, ::-1])[:, :more]
        p = x.copy()
        p[: turn[0].shape[1] if turn else more] = 0.0
        rest = np.sqrt(np.maximum(np.diag(x.T @ gg @ x) - 2 * values * np.diag(x.T @ sg @ x) + values**2 * np.diag(x.T @ ss @ x), 0))
        turn = [x, p[:, np.abs(p).max(0) > 0], values, 1 / np.maximum(rest, 1e-300) * (rest > 1e-9 * values[0])]
        if (rest[:k] <= tolerance * values[0]).all():
            break
    has = values[:k] > 1e-13 * values[0]
    return state, x[:, :k][:, has], np.sqrt(values[:k][has])


def fit_lsi(docs: DataFrame, k: int = 5, vocabulary: int | None = None, tolerance: float = 1e-6, most: int = 100) -> tuple[Vectoriser, list[float], DataFrame]:
    """Truncated SVD of the tf-idf matrix: the vectoriser, the singular values, and term, weights (one per dimension). A step
    multiplies vectors by the matrix and back, block by block; it ends when what is left is tolerance of the greatest, or after
    most steps."""
    c, path = Corpus(docs, vocabulary), scratch(docs.sparkSession)
    number = _idf(c.n)
    c.parts.withColumn("idf", F.udf(lambda df: bytearray(number(df).tobytes()), "binary")("df")).select("part", "terms", "idf").write.parquet(path)
    vec = Vectoriser(c.spark, c.spark.read.parquet(path), c)
    state, x, values = _singular(c, c.placed(c.on_parts(number, "idf", c.parts.select("part", "df"))), k, tolerance, most)
    weights = c.spark.createDataFrame(state.map(lambda s: (s[0], *_binaries(s[1][1][0] @ x))), "part int, weights binary")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                terms = b.column(0)[i].values
                yield pa.RecordBatch.from_arrays([terms, _lists(ints(b.column(1)[i].as_py(), np.float64).reshape(len(terms), -1))], names=["term", "weights"])

    terms = vec.table.join(weights, "part").select("terms", "weights").mapInArrow(spread, "term string, weights array<double>")
    return vec, values.tolist(), terms


def save(model: TopicModel, path: str) -> None:
    model.table.write.mode("overwrite").parquet(f"{path}/words")
    numbers = model.spark.createDataFrame([(model.alpha.tolist(), model.sums.tolist(), model.seed)], "alpha array<double>, sums array<double>, seed long")
    numbers.write.mode("overwrite").parquet(f"{path}/numbers")


def load(path: str) -> TopicModel:
    spark = SparkSession.active()
    return TopicModel(spark, spark.read.parquet(f"{path}/words"), *spark.read.parquet(f"{path}/numbers").select("alpha", "sums", "seed").first())
