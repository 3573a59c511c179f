"""Boolean queries with phrases: a lexer, a parser, and a compiler to one filter.

Grammar, from weak to strong: ``||``, ``&&``, ``!``; parentheses; a word; a quoted phrase. Over documents the query becomes
one expression of each document's array of words, so it runs inside the scan without a shuffle. Over an index it becomes
one aggregation of the postings of the query's words, joined to all documents, so that negation sees those without any.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thresher.functions import text as tx

from .index import Index

_LEX = re.compile(r"\s+|(?P<or>\|\|)|(?P<and>&&)|(?P<not>!)|(?P<open>\()|(?P<close>\))|(?P<quote>\")|(?P<word>[^\s()!\"&|]+)")


class QueryError(ValueError):
    """The query is not well formed."""


@dataclass(frozen=True)
class Word:
    text: str


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]


@dataclass(frozen=True)
class Not:
    of: Node


@dataclass(frozen=True)
class Op:
    kind: str  # "and" or "or"
    parts: tuple[Node, ...]


Node = Word | Phrase | Not | Op


def lex(query: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(query):
        m = _LEX.match(query, at)
        if not m:
            raise QueryError(f"{query[at]!r} at {at}")
        if m.lastgroup:
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return out


def parse(query: str, fold_case: bool = True) -> Node:
    """fold_case: words are lower-cased, as those of documents are."""
    toks, at = lex(query), 0

    def peek() -> str:
        return toks[at][0] if at < len(toks) else ""

    def take(kind: str) -> str:
        nonlocal at
        if peek() != kind:
            raise QueryError(f"expected {kind}, found {peek() or 'the end'}")
        at += 1
        word = toks[at - 1][1]
        return word.lower() if fold_case else word

    def chain(kind: str, part: Callable[[], Node]) -> Node:
        parts = [part()]
        while peek() == kind:
            take(kind)
            parts.append(part())
        return parts[0] if len(parts) == 1 else Op(kind, tuple(parts))

    def either() -> Node:
        return chain("or", both)

    def both() -> Node:
        return chain("and", single)

    def single() -> Node:
        if peek() == "not":
            take("not")
            return Not(single())
        if peek() == "open":
            take("open")
            inner = either()
            take("close")
            return inner
        if peek() == "quote":
            take("quote")
            words = []
            while peek() == "word":
                words.append(take("word"))
            take("quote")
            if not words:
                raise QueryError("an empty phrase")
            return Phrase(tuple(words))
        return Word(take("word"))

    tree = either()
    if at < len(toks):
        raise QueryError(f"{toks[at][1]!r} after the query's end")
    return tree


def leaves(tree: Node) -> list[Word | Phrase]:
    """Words and phrases, each once, in order."""
    if isinstance(tree, (Word, Phrase)):
        return [tree]
    return list(dict.fromkeys(x for part in ([tree.of] if isinstance(tree, Not) else tree.parts) for x in leaves(part)))


def compile_(tree: Node, leaf: Callable[[Word | Phrase], Column]) -> Column:
    if isinstance(tree, Not):
        return ~compile_(tree.of, leaf)
    if isinstance(tree, Op):
        out = compile_(tree.parts[0], leaf)
        for p in tree.parts[1:]:
            out = out & compile_(p, leaf) if tree.kind == "and" else out | compile_(p, leaf)
        return out
    return leaf(tree)


def search(docs: DataFrame, query: str | Node, stop_words: list[str] | None = None) -> DataFrame:
    """doc_id of the documents that match. stop_words: words that no document counts as having."""
    tree = parse(query) if isinstance(query, str) else query
    stop = set(stop_words or ())

    def leaf(x: Word | Phrase) -> Column:
        if isinstance(x, Phrase):
            return tx.has_phrase("__words", list(x.words))
        return F.lit(False) if x.text in stop else F.array_contains("__words", x.text)

    return docs.select("doc_id", tx.tokens("text").alias("__words")).where(compile_(tree, leaf)).select("doc_id")


def search_index(index: Index, query: str | Node) -> DataFrame:
    tree = parse(query) if isinstance(query, str) else query
    found = leaves(tree)
    words = [x for x in found if isinstance(x, Word)]
    flags = index.postings.where(F.col("term").isin([w.text for w in words])).select("doc_id", *(F.col("term").eqNullSafe(w.text if isinstance(w, Word) else None).alias(f"f{k}") for k, w in enumerate(found)))
    for k, x in enumerate(found):
        if isinstance(x, Phrase):
            flags = flags.union(index.phrase(list(x.words)).select("doc_id", *(F.lit(j == k) for j in range(len(found)))))
    flags = flags.groupBy("doc_id").agg(*(F.bool_or(f"f{k}").alias(f"f{k}") for k in range(len(found))))
    every = index.documents.select("doc_id").join(flags, "doc_id", "left")
    at = {x: k for k, x in enumerate(found)}
    return every.where(compile_(tree, lambda x: F.coalesce(F.col(f"f{at[x]}"), F.lit(False)))).select("doc_id")


def count_hits(docs: DataFrame, words: list[str]) -> DataFrame:
    """term, n_docs: how selective each part of a conjunction is, by rising count."""
    flags = docs.select(tx.tokens("text").alias("w")).agg(*(F.count_if(F.array_contains("w", x)).alias(x) for x in words))
    return flags.select(F.explode(F.array(*(F.struct(F.lit(x).alias("term"), F.col(f"`{x}`").alias("n_docs")) for x in words))).alias("s")).select("s.*").orderBy("n_docs", "term")
