"""Line deduplication over a corpus with DataFrame functions only.

Hashes of lines go to ranges of (hash, document, position) and are sorted there, so the first occurrence of a line is
streamed past first; as the ranges also cut within a hash, one line that a third of all documents share is spread over
many tasks. Each task reports a hash once (a count of documents and the first place), and the reports are merged. The
decision returns to the documents as runs of dropped line numbers, a run-length coded bitmap, not as text.

Cases: a null or empty text is one empty line. Rows of equal id (or null) and equal text are one document where documents
are counted, as the check's SQL counts distinct ids; a null id counts like any other, and rows of one id with different
texts are documents of their own. Equal rows get equal decisions; mode "first" keeps the line in each of them. Lines whose
key is shorter than min_chars always stay. Very long texts are split whole. An empty table gives an empty result. n_lines,
n_dropped and the text take the place of input columns of their names; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, checkpoint, hash128, quoted, read, unused


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _document_key(id_col: str, text_col: str) -> list[Column]:
    return hash128(quoted(id_col), F.coalesce(quoted(text_col), F.lit("")), name="k")


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, mode: str = "all") -> DataFrame:
    """Per document that loses lines: k1, k2 (its key) and dropped, an array of runs (start, stop) of line numbers, from
    0, stop exclusive. Mode "all": lines in at least min_docs documents go everywhere; "first": they stay where they
    come first by id and position."""
    if mode not in ("all", "first"):
        raise ValueError(f"mode {mode!r}: all or first")
    lines = docs.select(quoted(id_col).alias("id"), *_document_key(id_col, text_col), F.posexplode(F.split(F.coalesce(quoted(text_col), F.lit("")), "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("line", line_key(F.col("line"))).where(F.char_length("line") >= max(min_chars, 0))
    lines = checkpoint(lines.select("id", "k1", "k2", "pos", *hash128(F.col("line"))))
    once = lines.groupBy("h1", "h2", "k1", "k2").agg(F.count("*").alias("c"), F.min(F.struct("id", "pos")).alias("at"))
    ranged = once.repartitionByRange("h1", "h2", "at", "k1", "k2").sortWithinPartitions("h1", "h2", "at", "k1", "k2")
    found = ranged.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.min("at").alias("first"))
    found = checkpoint(found.where(F.col("docs") >= min_docs))
    gone = lines.join(found, ["h1", "h2"])
    if mode == "first":
        gone = gone.where(~F.struct("id", "pos").eqNullSafe(F.col("first")))
    places = gone.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("pos")).alias("p"))
    starts = F.filter("p", lambda x, i: (i == 0) | (F.get("p", i - 1) != x - 1))
    stops = F.transform(F.filter("p", lambda x, i: (i == F.size("p") - 1) | (F.get("p", i + 1) != x + 1)), lambda x: x + 1)
    return places.select("k1", "k2", F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), b.alias("stop"))).alias("dropped"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with its text cut, and n_lines (before) and n_dropped."""
    a, b, runs, all_lines = unused(docs, "k1", "k2", "runs", "lines")
    text = F.coalesce(quoted(text_col), F.lit(""))
    k1, k2 = _document_key(id_col, text_col)
    both = docs.withColumns({a: k1, b: k2}).join(bitmaps.select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("dropped").alias(runs)), [a, b], "left")
    both = both.withColumn(all_lines, F.split(text, "\n", -1))
    ends = F.concat(F.transform(runs, lambda r: r["start"]), F.array(F.size(all_lines)))
    begins = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["stop"]))
    kept = F.flatten(F.zip_with(begins, ends, lambda x, y: F.slice(all_lines, x + 1, y - x)))
    both = both.withColumns({
        "n_lines": F.size(all_lines).cast("long"),
        "n_dropped": F.coalesce(F.aggregate(runs, F.lit(0).cast("long"), lambda s, r: s + (r["stop"] - r["start"])), F.lit(0).cast("long")),
        text_col: F.when(F.col(runs).isNull(), text).otherwise(F.array_join(kept, "\n")),
    })
    return both.drop(a, b, runs, all_lines)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    return apply_bitmaps(docs, line_bitmaps(docs, id_col, text_col, **options), id_col, text_col)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs, min_docs=10, min_chars=1, mode="all").select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id
"""
