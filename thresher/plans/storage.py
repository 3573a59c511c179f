"""The registered queries of readers, writers, the stored index and the stream, each with the SQL that checks it.

A query writes a table in the form it is about to the shared folder, and returns what is read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from thresher.functions import text as tx
from thresher.operators import crawl, index, kg, rank
from thresher.operators.lineage import scratch
from thresher.plans import sql as S
from thresher.plans.queries import _FIELDS, _STATEMENT, _TEXT, _TP, DIGITS, SQL, _edges_of_rule, _predictions, documents, joined, pages, query
from thresher.sources import files, sinks
from thresher.streaming import index as stream

# --- files of texts -----------------------------------------------------------------------------------------------

#: Names of nations in one file for each region: a table of constant size.
_REGIONS = "string_agg(n_name, chr(10) ORDER BY n_name) || chr(10) AS text FROM nation GROUP BY n_regionkey"


def _regions(spark, sf) -> str:
    path = scratch(spark)
    spark.read.parquet(f"{sf}/nation.parquet").select("n_regionkey", "n_name").repartition("n_regionkey").sortWithinPartitions("n_regionkey", "n_name").write.partitionBy("n_regionkey").text(path)
    return path


@query("directory_scan", f"SELECT n_regionkey::BIGINT AS doc_id, {_REGIONS}")
def _(spark, sf):
    return files.read_texts(spark, _regions(spark, sf)).select("doc_id", "text")


@query("block_scan", f"SELECT 'n_regionkey=' || n_regionkey AS block, {_REGIONS}")
def _(spark, sf):
    return files.read_blocks(spark, _regions(spark, sf)).select("block", "text")


@query("line_scan", r"SELECT trim(unnest(regexp_split_to_array(text, '\r\n|\r|\n')), ' ') AS text FROM documents WHERE text IS NOT NULL")
def _(spark, sf):
    path = scratch(spark)
    documents(spark, sf).select("text").where("text IS NOT NULL").write.text(path)
    return files.read_lines(spark, path)


@query("stop_word_file", "SELECT DISTINCT event_type AS word FROM events WHERE event_type <> ''")
def _(spark, sf):
    path = scratch(spark)
    spark.read.parquet(f"{sf}/events.parquet").select("event_type").where("event_type IS NOT NULL").write.text(path)
    return files.read_words(spark, path)


@query("csv_links", f'WITH {S.LINKS} SELECT CAST(n AS VARCHAR) AS "index", hook, href AS link, base_url AS base FROM links')
def _(spark, sf):
    path = scratch(spark)
    crawl.links(pages(spark, sf)).select("n", "hook", "href", "base_url").write.csv(path)
    return files.read_links(spark, path)


@query("json_triples", f"WITH {S.FRAMES} SELECT CAST(doc_id AS VARCHAR) AS text, m_name AS subject, rel AS predicate, n_name AS object FROM tr")
def _(spark, sf):
    path = scratch(spark)
    _predictions(spark, sf).select(F.col("doc_id").cast("string").alias("text"), "spo_list").write.json(path)
    return files.read_triples(spark, path).select("text", F.inline("spo_list"))


@query("predicate_ids", "SELECT event_type AS predicate, row_number() OVER (ORDER BY event_type DESC) - 1 AS id FROM (SELECT DISTINCT event_type FROM events)")
def _(spark, sf):
    path = scratch(spark)
    kinds = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("predicate")).distinct()
    kinds.coalesce(1).sortWithinPartitions(F.desc("predicate")).write.json(path)  # a handful of kinds, whose order in the file counts
    return files.read_predicates(spark, path)


# --- writers ------------------------------------------------------------------------------------------------------


@query("page_sink", f"SELECT page_id, url, {_TEXT} AS text FROM pages WHERE length({_TEXT}) > 10")
def _(spark, sf):
    path = scratch(spark)
    sinks.write_page_texts(pages(spark, sf).select("page_id", "url", crawl.page_text(F.col("html")).alias("text")), path)
    return spark.read.parquet(path)


@query("statement_files", f"WITH {S.FRAMES} SELECT {_STATEMENT} AS line FROM tr")
def _(spark, sf):
    path = scratch(spark)
    sinks.write_statements(_edges_of_rule(spark, sf), path)
    return files.read_statements(spark, path).select("line")


@query("graph_store", f"WITH {S.FRAMES} SELECT m_label, m_name, rel, n_label, n_name, 2 * count(*) AS value FROM tr GROUP BY ALL")
def _(spark, sf):
    # Statements read from files are merged into a stored graph, twice: the second time all edges are there already.
    found = _edges_of_rule(spark, sf)
    first, lines = scratch(spark), scratch(spark)
    sinks.write_statements(found, lines)
    sinks.replace(kg.merge_edges(kg.parse_statements(files.read_statements(spark, lines))), first)
    return kg.merge_edges(kg.parse_statements(files.read_statements(spark, lines)), spark.read.parquet(first))


@query("prediction_sink", SQL["spo_compare"].replace("SELECT doc_id, count(*) FILTER (it AND ip) AS n_right,", "SELECT CAST(doc_id AS VARCHAR) AS text,"))
def _(spark, sf):
    path = scratch(spark)
    sinks.write_predictions(_predictions(spark, sf).withColumn("text", F.col("doc_id").cast("string")), path)
    back = spark.read.json(path, schema="text string, new array<struct<s:string>>, lack array<struct<s:string>>")
    return back.select("text", *(F.size(c).cast("long").alias(f"n_{c}") for c in ("new", "lack")))


@query("query_log", "SELECT user, kind, query FROM (VALUES ('u1', 'normal', 'the of'), ('u1', 'phrase', '\"the of\"'), ('u2', 'normal', 'the of')) v(user, kind, query)")
def _(spark, sf):
    path = scratch(spark)
    for row in (("u1", "normal", "the of"), ("u1", "phrase", '"the of"'), ("u2", "normal", "the of")):
        sinks.log_query(spark, path, *row)
    return spark.read.parquet(path).where("ts IS NOT NULL").select("user", "kind", "query")


_FIELD_WORDS = " UNION ALL ".join(f"SELECT '{f}' AS field, url AS path, unnest(range(len(w))) AS pos, unnest(w) AS term FROM (SELECT url, {S.WORDS.replace('(text,', f'({f},')} AS w FROM p)" for f in ("title", "content"))


@query("fielded_postings", f"WITH {_FIELDS.replace(', url FROM', f', {_TEXT} AS content, url FROM')}, x AS ({_FIELD_WORDS}) SELECT field, term, path, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM x GROUP BY field, term, path")
def _(spark, sf):
    path = scratch(spark)
    sinks.write_fields(pages(spark, sf).select(crawl.page_title(F.col("html")).alias("title"), F.col("url").alias("path"), crawl.page_text(F.col("html")).alias("content")), path)
    return spark.read.parquet(path).select("field", "term", "path", joined("positions"))


@query("search_limit", f"SELECT * FROM ({SQL['bm25_fields']}) ORDER BY score DESC, doc_id LIMIT 10")
def _(spark, sf):
    docs = pages(spark, sf).select(F.col("page_id").alias("doc_id"), F.coalesce(crawl.page_title(F.col("html")), F.lit("")).alias("title"), "url")
    return rank.top(rank.bm25_scores(docs, "the example en", {"title": 2.0, "url": 1.0}), 10, round_to=DIGITS)


# --- the stored index ---------------------------------------------------------------------------------------------


@query("index_lookup", f"WITH {S.TOKS} SELECT doc_id, count(*) AS tf, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM toks WHERE term = 'the' GROUP BY doc_id")
def _(spark, sf):
    ix = index.Index.build(documents(spark, sf), scratch(spark))
    return ix.lookup("the").select("doc_id", "tf", joined("positions"))


@query("index_scan", SQL["invert_postings"])
def _(spark, sf):
    return index.Index.build(documents(spark, sf), scratch(spark)).scan().select("term", joined("docs"))


@query("index_append", f"WITH {S.STATS} SELECT term, cf, df FROM stats")
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ix = index.Index.build(docs.where("lang <=> 'en'").select("doc_id", "text"), scratch(spark))
    ix.append(docs.select("doc_id", "text"))  # English ones are there already
    return ix.stats


@query("index_stream", f"WITH {S.STATS} SELECT term, cf, df FROM stats")
def _(spark, sf):
    arrived, path, state = scratch(spark), scratch(spark), scratch(spark)
    documents(spark, sf).repartition(4).write.parquet(arrived)
    stream.follow(stream.document_stream(spark, arrived, 2), path, state).awaitTermination()
    return stream.opened(spark, path).stats


@query("id_map_stored", SQL["id_map"])
def _(spark, sf):
    path, found = scratch(spark), crawl.links(pages(spark, sf)).select("base_url", "n", "hook")
    index.IdMap.build(found, "hook", ["base_url", "n"]).save(path)
    ids = index.IdMap.load(spark, path)
    return ids.with_strings(ids.with_ids(found, "hook").select("base_url", "n", "id"))


# --- words --------------------------------------------------------------------------------------------------------


@query("subsequence_search", f"WITH {S.DOCS} SELECT doc_id, CAST(coalesce(list_min(list_filter(range(0, len(w) - 1), lambda i: w[i + 1] = 'of' AND w[i + 2] = 'the')), -1) AS INTEGER) AS start FROM d")
def _(spark, sf):
    words = documents(spark, sf).select("doc_id", tx.tokens("text").alias("w"))
    return words.select("doc_id", tx.find_sequence(F.array(F.lit("of"), F.lit("the")), "w").alias("start"))


@query("tokenize_contractions", f"WITH c AS (SELECT doc_id, {S.CONTRACTED} AS text FROM documents), d AS (SELECT doc_id, coalesce(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), []) AS w FROM c) SELECT doc_id, len(w) AS n_tokens, array_to_string(w, ' ') AS words FROM d")
def _(spark, sf):
    words = documents(spark, sf).select("doc_id", tx.tokens("text", contractions=True).alias("w"))
    return words.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.array_join("w", " ").alias("words"))
