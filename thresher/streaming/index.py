"""The index as a stream: files of documents that arrive are tokenised and appended to the postings of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from thresher.operators.index import Index, write_batch


def document_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """doc_id, text of Parquet files that arrive in a folder."""
    return spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", files_per_batch).parquet(path)


def follow(docs: DataFrame, path: str, state: str, once: bool = True) -> StreamingQuery:
    """Appends each batch to the index at path. A batch has a folder of its own, written in place of what an interrupted
    try left, so each document is indexed once. state: the stream's checkpoint."""

    def batch(df: DataFrame, k: int) -> None:
        write_batch(df, path, str(k))

    w = docs.writeStream.foreachBatch(batch).option("checkpointLocation", state)
    return (w.trigger(availableNow=True) if once else w).start()


def opened(spark: SparkSession, path: str) -> Index:
    """The index that a stream has written so far."""
    return Index(spark, path)
