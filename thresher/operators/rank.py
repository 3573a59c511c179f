"""Ranking: the vector-space model with a page's rank, cosine, BM25 over fields, rotations and wildcards.

Only words of the query become rows: documents are filtered to them in the scan, so what is shuffled is at most one row
per document and query word. Those rows are kept in the shared folder, so that texts are cut into words once.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thresher.functions import text as tx

from .index import document_count, term_frequencies, with_idf
from .lineage import checkpoint

#: What a document without a rank counts as. Fixed value.
NO_RANK = 1e-6
K1, B = 1.2, 0.75


def query_terms(spark: SparkSession, query: str | list[str], add: str = "") -> DataFrame:
    """term, qtf. add: words put after the query for one user."""
    words = query.split() if isinstance(query, str) else list(query)
    return spark.createDataFrame(sorted(Counter(words + add.split()).items()), "term string, qtf long")


def _matched(docs: DataFrame, query: str | list[str], add: str, all_terms: bool) -> DataFrame:
    """doc_id, tf, idf, qtf for query words that some document has; with all_terms only of documents that have all."""
    q = query_terms(docs.sparkSession, query, add)
    words = [r.term for r in q.collect()]  # the query itself, not data
    tf = checkpoint(term_frequencies(docs, words))
    stats = with_idf(tf.groupBy("term").agg(F.count("*").alias("df")), document_count(docs))
    rows = tf.join(F.broadcast(stats.join(F.broadcast(q), "term")), "term")
    if all_terms:
        full = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.collect_list(F.struct("tf", "idf", "qtf")).alias("w"))
        known = stats.agg(F.count("*").alias("known"))
        rows = full.join(F.broadcast(known), F.col("n") == F.col("known")).select("doc_id", F.inline("w"))
    return rows


def vsm_scores(docs: DataFrame, query: str | list[str], add: str = "", ranks: DataFrame | None = None, all_terms: bool = True) -> DataFrame:
    """doc_id, score = (q . d) / (d . d) * rank over the query's words, each as often as the query has it; a document's
    weight is tf * idf. ranks: (doc_id, value). Documents without any weight score null."""
    rows = _matched(docs, query, add, all_terms)
    num = F.sum(F.col("qtf") * (F.col("qtf") * F.col("idf")) * (F.col("tf") * F.col("idf")))
    den = F.sum(F.col("qtf") * F.pow(F.col("tf") * F.col("idf"), 2))
    out = rows.groupBy("doc_id").agg((num / F.nullif(den, F.lit(0.0))).alias("score"))
    if ranks is not None:
        out = out.join(ranks.select("doc_id", "value"), "doc_id", "left").select("doc_id", (F.col("score") * F.coalesce("value", F.lit(NO_RANK))).alias("score"))
    return out


def cosine_scores(docs: DataFrame, query: str | list[str]) -> DataFrame:
    """doc_id, score: the cosine of the query's and the document's weights over the query's words."""
    rows = _matched(docs, query, "", False)
    q, d = F.col("qtf") * F.col("idf"), F.col("tf") * F.col("idf")
    return rows.groupBy("doc_id").agg((F.sum(q * d) / F.nullif(F.sqrt(F.sum(q * q)) * F.sqrt(F.sum(d * d)), F.lit(0.0))).alias("score"))


def top(scores: DataFrame, k: int = 10, ascending: bool = False, round_to: int = 9) -> DataFrame:
    """The k best by score, ties by doc_id. Scores are rounded first, so that the order of a sum can't decide. Ascending
    takes the smallest."""
    s = scores.where("score IS NOT NULL").withColumn("score", F.round("score", round_to))
    return s.orderBy(F.asc("score") if ascending else F.desc("score"), "doc_id").limit(k)


def bm25_scores(docs: DataFrame, query: str | list[str], fields: dict[str, float] | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """doc_id, score. fields: columns and their weights; a word's frequencies, each normalised by its field's mean length,
    are weighed and summed before saturation."""
    fields = fields or {"text": 1.0}
    words = sorted(set(query.split() if isinstance(query, str) else query))
    wanted = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    base = docs.select("doc_id", *(tx.tokens(f).alias(f"w_{f}") for f in fields))
    base = base.select("doc_id", *(F.size(f"w_{f}").cast("long").alias(f"n_{f}") for f in fields), *(F.filter(f"w_{f}", lambda x: F.array_contains(wanted, x)).alias(f"w_{f}") for f in fields))
    base = checkpoint(base)
    means = base.agg(F.count("*").alias("n"), *(F.avg(f"n_{f}").alias(f"avg_{f}") for f in fields))
    parts = [
        base.select("doc_id", F.col(f"n_{f}").alias("length"), F.explode(f"w_{f}").alias("term")).groupBy("doc_id", "term", "length").agg(F.count("*").alias("tf"))
        .crossJoin(F.broadcast(means)).select("doc_id", "term", "n", (F.lit(w) * F.col("tf") / (1 - b + b * F.col("length") / F.col(f"avg_{f}"))).alias("x"))
        for f, w in fields.items()
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.groupBy("doc_id", "term").agg(F.sum("x").alias("x"), F.first("n").alias("n"))
    df = rows.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return rows.join(F.broadcast(df), "term").groupBy("doc_id").agg(F.sum(idf * F.col("x") * (k1 + 1) / (F.col("x") + k1)).alias("score"))


def rotation_scores(docs: DataFrame, query: str, **options) -> DataFrame:
    """The vector-space model over all rotations of each query word."""
    words = [w[i:] + w[:i] for w in query.split() for i in range(len(w))]
    return vsm_scores(docs, words, all_terms=False, **options)


def wildcard_documents(docs: DataFrame, pattern: str) -> DataFrame:
    """doc_id of documents with a word that matches; * stands for any characters. Decided within each row."""
    like = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")
    return docs.where(F.exists(tx.tokens("text"), lambda x: x.like(like))).select("doc_id")


def attachments(files: DataFrame, query: str, last_only: bool = False) -> DataFrame:
    """Distinct rows of files (hook, linked_url) whose hook holds a word of the query; last_only: the last word's."""
    words = query.split()[-1:] if last_only else query.split()
    if not words:
        return files.limit(0)
    found = F.contains(F.col("hook"), F.lit(words[0]))
    for w in words[1:]:
        found = found | F.contains(F.col("hook"), F.lit(w))
    return files.where(found).distinct()
