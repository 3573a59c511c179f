"""Spelling: k-gram candidates, edit distance and Soundex, over a vocabulary (term).

Candidates come from an equi-join on k-grams, so a word meets only words that share one with it, never the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thresher.functions import text as tx

from .boolean import Node, Not, Op, Phrase, Word, leaves, parse
from .index import AT_ONCE, gathered
from .lineage import checkpoint


#: Words to correct whose grams are broadcast at most; beyond, both sides are shuffled by gram.
FEW = 10_000


def vocabulary(docs: DataFrame) -> DataFrame:
    """term: every distinct word. Words are made distinct per document first."""
    return docs.select(F.explode(F.array_distinct(tx.tokens("text"))).alias("term")).distinct()


def gram_table(vocab: DataFrame) -> DataFrame:
    """term, grams."""
    return vocab.select("term", tx.kgrams("term").alias("grams"))


def soundex_table(vocab: DataFrame) -> DataFrame:
    return vocab.select("term", tx.soundex("term").alias("code"))


def candidates(words: DataFrame, vocab: DataFrame, least: float = 0.3, top: int = 5) -> DataFrame:
    """word, term, jaccard, distance, rank: for each word the terms whose sets of k-grams are more alike than least, the
    best by likeness, then term. |union| follows from the sizes, so only shared grams are joined."""
    grams = lambda df, c: df.select(c, F.array_distinct(tx.kgrams(c)).alias("g")).select(c, F.size("g").alias(f"n_{c}"), F.explode("g").alias("gram"))
    asked = checkpoint(words.select("word").distinct())
    few = asked.limit(FEW + 1).count() <= FEW  # then no gram of the vocabulary is shuffled
    mine = grams(asked, "word")
    pairs = (F.broadcast(mine) if few else mine).join(grams(vocab.select("term"), "term"), "gram").groupBy("word", "term", "n_word", "n_term").agg(F.count("*").alias("both"))
    alike = pairs.select("word", "term", (F.col("both") / (F.col("n_word") + F.col("n_term") - F.col("both"))).alias("jaccard")).where(F.col("jaccard") > least)
    ranked = alike.withColumn("rank", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("jaccard"), "term"))).where(F.col("rank") <= top)
    return ranked.withColumn("distance", F.levenshtein("word", "term"))


def correct(words: DataFrame, vocab: DataFrame, pick: str = "edit", nearest: int = 4, least: float = 0.3, top: int = 5) -> DataFrame:
    """word, corrected: the word if the vocabulary has it; else its best candidate nearer than ``nearest`` edits, by edit
    distance (pick "edit") or likeness ("jaccard"); else the first term by name with its Soundex code; else the word."""
    if pick not in ("edit", "jaccard"):
        raise ValueError(f"pick {pick!r}: edit or jaccard")
    words = words.select("word").distinct()
    vocab = checkpoint(vocab.select("term"))  # used three times, and made from all texts
    unknown = words.join(vocab.select(F.col("term").alias("word")), "word", "left_anti")
    first = candidates(unknown, vocab, least, top)
    if pick == "jaccard":
        first = first.where("rank = 1")
    by_gram = first.where(F.col("distance") < nearest).groupBy("word").agg(F.min(F.struct("distance", "rank", "term"))["term"].alias("by_gram"))
    codes = unknown.withColumn("code", tx.soundex("word")).where("code != '0000'")
    by_sound = soundex_table(vocab).join(F.broadcast(codes.select("code").distinct()), "code").groupBy("code").agg(F.min("term").alias("by_sound"))
    out = words.join(by_gram, "word", "left").join(codes.join(by_sound, "code").select("word", "by_sound"), "word", "left")
    return out.select("word", F.coalesce("by_gram", "by_sound", "word").alias("corrected"))


def correct_query(spark: SparkSession, query: str, vocab: DataFrame, **options) -> Node:
    """A parsed query with its words corrected; what is collected is one row per query word."""
    tree = parse(query)
    words = sorted({w for x in leaves(tree) for w in ([x.text] if isinstance(x, Word) else x.words)})
    fixed = {r.word: r.corrected for r in correct(spark.createDataFrame([(w,) for w in words], "word string"), vocab, **options).collect()}

    def walk(n: Node) -> Node:
        if isinstance(n, Word):
            return Word(fixed[n.text])
        if isinstance(n, Phrase):
            return Phrase(tuple(fixed[w] for w in n.words))
        return Not(walk(n.of)) if isinstance(n, Not) else Op(n.kind, tuple(map(walk, n.parts)))

    return walk(tree)


def wildcard_terms(vocab: DataFrame, pattern: str) -> DataFrame:
    """Terms that match a pattern in which * stands for any characters."""
    like = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")
    return vocab.where(F.col("term").like(like)).select("term")


def biwords(docs: DataFrame) -> DataFrame:
    """w1, w2, n_docs: neighbouring words and how many documents (rows) hold them. Pairs are numbers of words, made distinct and
    counted where they are read, over many rows at once; what is shuffled is a pair's count there."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in gathered(batches, 0, 4 * AT_ONCE):
            words = some.column(0)
            row, d = np.repeat(np.arange(len(words)), np.asarray(words.value_lengths(), np.int64)), words.flatten().dictionary_encode()
            code, n = np.asarray(d.indices, np.int64), max(1, len(d.dictionary))
            same = row[1:] == row[:-1]
            pair, at = (code[:-1] * n + code[1:])[same], row[1:][same]
            order = np.argsort(pair, kind="stable")  # and rows stay in order
            pair, at = pair[order], at[order]
            once = np.flatnonzero((np.diff(pair, prepend=-1) != 0) | (np.diff(at, prepend=-1) != 0))
            pair = pair[once]
            first = np.flatnonzero(np.diff(pair, prepend=-1))
            word = lambda c: d.dictionary.take(pa.array(c))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([word(pair[first] // n), word(pair[first] % n), pa.array(np.diff(np.r_[first, len(pair)]), pa.int64())], names=["w1", "w2", "n"])

    counts = docs.select(tx.tokens("text").alias("w")).mapInArrow(counted, "w1 string, w2 string, n long")
    return counts.groupBy("w1", "w2").agg(F.sum("n").alias("n_docs"))
