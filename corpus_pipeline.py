"""A corpus pipeline: toxicity, exact dedup, SimHash near-dedup, packing. Each stage works on all that its predecessor
kept; all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thresher.llm.common import checkpoint, read, unused
from thresher.llm.exact_dedup import exact_dedup
from thresher.llm.packing import pack, token_pieces
from thresher.llm.simhash import simhash_dedup
from thresher.llm.toxicity import learned_from, score_texts, train
from thresher.ship import shipped


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more. The model learns as that of the operator's query does. A null text is empty,
    repeated rows stay or go together, an empty table stays empty, and other columns may have any name."""
    model = train(docs.select("doc_id", "text"), learned_from(read(spark, sf_dir, "labels")))
    (score,) = unused(docs, "score")
    return score_texts(docs, model, tuple(docs.columns), score_col=score).where(F.col(score) < 0.5).drop(score)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the largest doc_id stays. A null text is empty, a null id is the
    smallest, of a repeated row one stays, an empty table stays empty, and other columns may have any name."""
    return exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 or more of their five-word shingles, the smallest doc_id
    stays. Texts without words are one group, a row without an id stays only in a group where no row has one, of a
    repeated row one stays, an empty table stays empty, and other columns may have any name."""
    return simhash_dedup(docs, similarity=0.8)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 2048 tokens. A null text is the end token alone, each row is a
    document even if its id is null or repeated, an empty table gives no pieces, and other columns are not looked at."""
    import public_tokenizers

    return pack(token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))).drop("certified")


STAGES = [(f.__name__, shipped(f)) for f in (toxicity, exact_copies, near_copies, packing)]

#: SQL can express neither the model nor the fingerprints; tests/llm/test_pipeline.py has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
