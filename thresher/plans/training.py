"""The registered queries of training examples, batches, epochs and averaged weights, and of tables in a database, each with
the SQL that checks it."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thresher.functions import text as tx
from thresher.operators import training
from thresher.operators.lineage import scratch
from thresher.plans import sql as S
from thresher.plans.queries import _TP, _predictions, documents, query
from thresher.sources import files, sinks

# --- examples and batches -----------------------------------------------------------------------------------------

#: Two triples that a rule makes of each run of eight words: (1 2, A1, 4) and (3, A2, 5 6). The last run may be shorter.
_PREDICATES = ["A1", "A2"]


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    w = documents(spark, sf).select("doc_id", tx.tokens("text").alias("w"))
    t = w.select("doc_id", F.posexplode(tx.runs("w", 8)).alias("k", "tokens"))
    part = lambda a, n: F.slice("tokens", a, n)
    triple = lambda s, p, o: F.struct(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"))
    both = F.array(F.when(F.size("tokens") >= 4, triple(part(1, 2), "A1", part(4, 1))), F.when(F.size("tokens") >= 6, triple(part(3, 1), "A2", part(5, 2))))
    return t.select(F.concat_ws(":", "doc_id", "k").alias("id"), "doc_id", "k", "tokens", F.array_compact(both).alias("spo_list"))


def _find(part: str) -> str:
    return f"list_min(list_filter(range(0, len(t) - len({part}) + 1), lambda i: t[i + 1 : i + len({part})] = {part}))"


def _draw(what: str, n: str) -> str:
    return f"CAST(('0x' || substr(md5('0:' || doc_id || ':' || k || ':{what}'), 1, 7))::BIGINT % len({n}) AS INTEGER) + 1"


_EXAMPLES = f"""{S.DOCS}, runs AS (SELECT doc_id, CAST(k AS INTEGER) AS k, w[8 * k + 1 : 8 * k + 8] AS t FROM (SELECT doc_id, w, unnest(range((len(w) + 7) // 8)) AS k FROM d)),
parts AS (SELECT doc_id, k, t, 0 AS p, t[1:2] AS s, t[4:4] AS o FROM runs WHERE len(t) >= 4 UNION ALL SELECT doc_id, k, t, 1, t[3:3], t[5:6] FROM runs WHERE len(t) >= 6),
f AS (SELECT doc_id, k, p, {_find("s")} AS ss, {_find("s")} + len(s) - 1 AS se, {_find("o")} AS os, {_find("o")} + len(o) - 1 AS oe FROM parts),
l AS (SELECT doc_id, k, list(ss ORDER BY ss, se) AS sl, list(se ORDER BY ss, se) AS el, string_agg(ss || '-' || se, ',' ORDER BY ss, se) AS subjects FROM (SELECT DISTINCT doc_id, k, ss, se FROM f) GROUP BY doc_id, k),
l1 AS (SELECT *, sl[{_draw("start", "sl")}] AS st FROM l), l2 AS (SELECT *, list_filter(el, lambda e: e >= st) AS later FROM l1),
ex AS (SELECT doc_id, k, sl, el, subjects, st, later[{_draw("end", "later")}] AS en FROM l2)"""
_OBJECTS = "coalesce((SELECT string_agg(o, ',' ORDER BY o) FROM (SELECT DISTINCT os || '-' || oe || '-' || p AS o FROM f WHERE f.doc_id = ex.doc_id AND f.k = ex.k AND ss = st AND se = en)), '')"


@query("training_examples", f"WITH {_EXAMPLES} SELECT doc_id || ':' || k AS id, subjects, CAST(st AS INTEGER) AS subject_start, CAST(en AS INTEGER) AS subject_end, {_OBJECTS} AS objects FROM ex")
def _(spark, sf):
    e = training.span_examples(_runs(spark, sf), _PREDICATES)
    spans = lambda c, *f: F.array_join(F.array_sort(F.transform(c, lambda x: F.concat_ws("-", *(x[n] for n in f)))), ",").alias(c)
    return e.select("id", spans("subjects", "start", "end"), F.col("subject.start").alias("subject_start"), F.col("subject.end").alias("subject_end"), spans("objects", "start", "end", "predicate"))


@query("training_batches", f"""WITH {_EXAMPLES}, n AS (SELECT doc_id || ':' || k AS id, t, sl, el, row_number() OVER (ORDER BY doc_id || ':' || k) - 1 AS nth FROM ex JOIN runs USING (doc_id, k)),
b AS (SELECT *, max(len(t)) OVER (PARTITION BY nth // 32) AS width FROM n)
SELECT nth // 32 AS batch, CAST(nth % 32 AS INTEGER) AS place, id, array_to_string(list_concat(t, list_transform(range(width - len(t)), lambda i: '-')), ' ') AS tokens,
array_to_string(list_transform(range(width), lambda i: CASE WHEN list_contains(sl, i) THEN '1' ELSE '0' END || CASE WHEN list_contains(el, i) THEN '1' ELSE '0' END), ' ') AS labels FROM b""")
def _(spark, sf):
    b = training.batches(training.span_examples(_runs(spark, sf), _PREDICATES), 32, ["id"], pad="-")
    rows = b.select("batch", F.posexplode("rows").alias("place", "r"))
    labels = F.transform(training.subject_labels(F.col("r.subjects"), F.size("r.tokens")), lambda x: F.array_join(x.cast("array<string>"), ""))
    return rows.select("batch", "place", "r.id", F.array_join("r.tokens", " ").alias("tokens"), F.array_join(labels, " ").alias("labels"))


# --- after an epoch -----------------------------------------------------------------------------------------------


@query("training_epochs", f"""{_TP}, j AS (SELECT (SELECT count(*) FROM t JOIN p USING (doc_id, m_name, rel, n_name)) AS x, (SELECT count(*) FROM p) AS y, (SELECT count(*) FROM t) AS z),
e AS (SELECT epoch, 2.0 * x / (y + z) AS f1, x / y AS "precision", x / z AS recall FROM j, (VALUES (0), (2)) v(epoch) UNION ALL SELECT epoch, 1, 1, 1 FROM (VALUES (1), (3)) v(epoch))
SELECT epoch, round(f1, 9) AS f1, round("precision", 9) AS "precision", round(recall, 9) AS recall, round(max(f1) OVER (ORDER BY epoch), 9) AS best, epoch <> 2 AS kept FROM e""")
def _(spark, sf):
    p, own = _predictions(spark, sf), ("spo_list_pred", "spo_list")
    rows = p.select("spo_list", F.posexplode(F.array(*(F.col(own[e % 2]) for e in range(4)))).alias("epoch", "spo_list_pred"))
    return training.epochs(rows).select("epoch", *(F.round(c, 9).alias(c) for c in ("f1", "precision", "recall", "best")), "kept")


@query("averaged_weights", """WITH RECURSIVE s AS (SELECT vec_id % 10 AS name, row_number() OVER (PARTITION BY vec_id % 10 ORDER BY vec_id) - 1 AS step, list_transform(embedding, lambda x: x::DOUBLE) AS w FROM embeddings),
r AS (SELECT name, step, w FROM s WHERE step = 0 UNION ALL SELECT s.name, s.step, list_transform(list_zip(r.w, s.w), lambda x: 0.999 * x[1] + (1 - 0.999) * x[2]) FROM r JOIN s ON s.name = r.name AND s.step = r.step + 1),
l AS (SELECT name, w FROM r WHERE (name, step) IN (SELECT (name, max(step)) FROM s GROUP BY name))
SELECT name, CAST(unnest(range(len(w))) AS INTEGER) AS i, round(unnest(w), 7) AS weight FROM l""")
def _(spark, sf):
    # Ids are dense from 0, so every tenth is the next step of an array of the same name.
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select((F.col("vec_id") % 10).alias("name"), F.expr("vec_id div 10").alias("step"), F.col("embedding").alias("weights"))
    return training.averaged_weights(e).select("name", F.posexplode("weights").alias("i", "x")).select("name", "i", F.round("x", 7).alias("weight"))


# --- tables in a database -----------------------------------------------------------------------------------------

_DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


@query("database_tables", "SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey < 10")
def _(spark, sf):
    # Without thresher.jdbc.url, a server that all executors reach, an embedded database: in local mode Spark's tasks use it;
    # on a cluster it is the driver's, who alone can.
    url, path = spark.conf.get("thresher.jdbc.url", ""), scratch(spark)
    options = {} if url else {"driver": _DERBY}
    alone = not url and re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is None
    url = url or (f"jdbc:derby:{tempfile.mkdtemp()}/db;create=true" if alone else f"jdbc:derby:memory:{path.rsplit('/', 1)[1]};create=true")
    write = sinks.write_embedded if alone else sinks.write_jdbc
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    rows, few = s.select("s_suppkey", "s_name"), s.where("s_nationkey < 10").select("s_suppkey", "s_name")
    write(few, url, "suppliers", "overwrite", **options)
    write(rows, url, "suppliers", "overwrite", **options)
    write(few, url, "suppliers", **options)
    if alone:
        return files.read_embedded(spark, url, "suppliers", path, **options)
    return files.reconnecting(lambda: files.read_jdbc(spark, url, "suppliers", **options), attempts=3)
