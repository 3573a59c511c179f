"""Exact deduplication by progressive refinement: length, then a hash of the prefix, then a hash of the whole text.

The first round counts lengths, the second hashes the prefixes of rows whose length another row has, the third hashes the
whole texts of rows that share both with another. No text is shuffled: all that moves are ids, lengths and hashes, and
counts are partly aggregated before each shuffle, so one huge group of copies is no hot task. The rows are read once a
round.

Cases: a null text is an empty text. A null id is smaller than any other. A row that is repeated with its id counts in
group_size, and one of the repeats stays. Very long texts are hashed whole by the rounds that they reach. An empty table
gives an empty result. Other columns are not looked at and may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, checkpoint, quoted, read, without_rows

#: Keys (16 bytes each) of surviving groups that are broadcast at most; beyond, the hashes are made before the join.
BROADCAST_KEYS = 1_000_000


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def _where(rows: DataFrame, keys: DataFrame, on: list[str], how: str, add: Callable[[DataFrame], DataFrame], most: int) -> DataFrame:
    """rows that meet keys (or none, as how says) with what add makes of their text t, which is dropped. Where the keys are
    few, only rows that are left are hashed; else hashes are made first, so that no text is shuffled."""
    if keys.limit(most + 1).count() <= most:
        return add(rows.join(F.broadcast(keys), on, how)).drop("t")
    return add(rows).drop("t").join(keys, on, how)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, digest_all: bool = False, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, d (binary SHA-256 of the normalised text, null for rows
    that an earlier round told apart; with digest_all it is made for those too, for the output alone)."""
    text = F.coalesce(quoted(text_col), F.lit(""))
    rows = docs.select(quoted(id_col).alias("id"), F.octet_length(text).alias("n"), text.alias("t"))  # case keeps the length
    start = F.xxhash64(ascii_lower(F.substring("t", 1, prefix)))
    digest = F.unhex(F.sha2(ascii_lower(F.col("t")), 256))
    lengths = checkpoint(rows.groupBy("n").agg(F.count("*").alias("c")).where("c > 1").select("n"))
    met = _where(rows, lengths, ["n"], "left_semi", lambda x: x.withColumn("p", start), broadcast_keys)
    # Grouped by a struct, not by n and p: else a join's partitions by n would serve the groups too, and one length that
    # very many rows have could not be split.
    pairs = met.groupBy(F.struct("n", "p").alias("g")).agg(F.count("*").alias("c")).where("c > 1")
    pairs = checkpoint(pairs.select("g.n", "g.p"))
    begun = rows.withColumn("p", start)
    left = _where(begun, pairs, ["n", "p"], "left_semi", lambda x: x.withColumn("d", digest), broadcast_keys)
    # Numbers for rows must not change between uses: they are made once and kept in the shared folder.
    left = checkpoint(left.select("id", "n", "d").withColumn("row", F.monotonically_increasing_id()))
    groups = checkpoint(left.groupBy("n", "d").agg(F.count("*").alias("group_size"), F.max(F.struct("id", "row")).alias("m")))
    alone = _where(begun, pairs, ["n", "p"], "left_anti", lambda x: x.withColumn("d", digest if digest_all else F.lit(None).cast("binary")), broadcast_keys)
    alone = alone.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "d")
    met = left.join(groups, ["n", "d"]).select("id", F.col("m.id").alias("keep_id"), "group_size", (F.col("row") == F.col("m.row")).alias("kept"), "d")
    return alone.unionByName(met)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows whose text another row repeats; all columns as they were."""
    found = exact_groups(docs, id_col, text_col, **options).where(F.col("group_size") > 1)
    found = checkpoint(found.select("id", F.col("d").alias("digest"), F.col("id").eqNullSafe(F.col("keep_id")).alias("stays")).groupBy("id", "digest", "stays").agg(F.count("*").alias("n")))
    digest = F.unhex(F.sha2(normalised(quoted(text_col)), 256))
    return without_rows(docs, quoted(id_col), digest, found.where("NOT stays").select("id", "digest"), found.where("stays AND n > 1").select("id", "digest"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_groups(read(spark, sf_dir, "documents"), digest_all=True)
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("d")).alias("text_sha256"))


OP4_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents
), h AS (SELECT doc_id, sha256(x) AS text_sha256 FROM t)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM h
"""
