"""PageRank over an edge list.

Only nodes that are linked and link themselves (the core) have a value of their own in each iteration. Nodes that nothing
links all have one value, a number; those without links count by their sum, which is what the others lack to 1, and get
their values in the last iteration. So a crawl whose links lead out of it takes a few passes whatever the iterations.

An iteration over the core joins its ranks to the links inside it, by numbers of nodes, and sums what each node gets with
map-side partial sums. Its ranks are checkpointed to the shared folder, so the plan stays short and a lost executor costs
little. Joins on a source are on a struct of it, which gives both sides a shuffle of their own: adaptive execution splits a
hub's links only between two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import checkpoint

#: Links of a source in one list, about.
LINKS = 1024


def edges_of(links: DataFrame, source: str = "base_url", target: str = "linked_url", reverse: bool = False) -> DataFrame:
    """src, dst: parallel links are one edge. reverse: from the linked page to the one that links."""
    a, b = (target, source) if reverse else (source, target)
    return links.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct()


def pagerank(edges: DataFrame, alpha: float = 0.85, iterations: int | None = None, tolerance: float = 1e-6, most: int = 100) -> DataFrame:
    """node, value; values sum to 1. With iterations, exactly so many; else until the L1 change is sure to be below
    N * tolerance or ``most`` are done. No edges: an empty result."""
    edges = checkpoint(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL"))
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("ins")).union(edges.select("dst", F.lit(0), F.lit(1)))
    nodes = checkpoint(ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("ins").alias("ins")).withColumn("id", F.monotonically_increasing_id()))
    n, linking, core = nodes.agg(F.count("*"), F.count_if(F.col("out") > 0), F.count_if((F.col("out") > 0) & (F.col("ins") > 0))).first()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("value"))
    sources = nodes.where("out > 0").select(F.struct(F.col("node").alias("src")).alias("g"), "out", F.when(F.col("ins") > 0, F.col("id")).alias("core"))
    spread = edges.withColumn("g", F.struct("src")).join(sources, "g").select("dst", "out", "core")
    inner = ranks = None
    if core:
        spread = checkpoint(spread)
        inner, ranks = _core(nodes, spread, 1 / n)
    unlinked, root, total, change = linking - core, 1 / n, core / n, None
    for k in range(1, iterations or most):
        base, had = (alpha * (1 - unlinked * root - total) + 1 - alpha) / n, unlinked * root + total
        moved = 0.0
        if core:
            ranks = checkpoint(_step(ranks, inner, root, base, alpha))
            total, moved = ranks.agg(F.sum("value"), F.sum(F.abs(F.col("value") - F.col("old")))).first()
        moved, root = moved + unlinked * abs(base - root), base
        # What the next step changes over all nodes: at most what it passes on by links and by the sum of nodes without links.
        if iterations is None and alpha * (moved + abs(unlinked * root + total - had)) < n * tolerance:
            break
    base = (alpha * (1 - unlinked * root - total) + 1 - alpha) / n
    parts = spread.select("dst", (F.lit(root) / F.col("out")).alias("part"))
    if core:
        own = ranks.select(F.struct(F.col("id").alias("core")).alias("g"), "value")
        parts = spread.where("core IS NULL").select("dst", (F.lit(root) / F.col("out")).alias("part"))
        parts = parts.union(spread.where("core IS NOT NULL").withColumn("g", F.struct("core")).join(own, "g").select("dst", F.col("value") / F.col("out")))
    got = parts.groupBy(F.col("dst").alias("node")).agg(F.sum("part").alias("got"))
    return nodes.join(got, "node", "left").select("node", (F.lit(base) + alpha * F.coalesce("got", F.lit(0.0))).alias("value"))


def _core(nodes: DataFrame, spread: DataFrame, value: float) -> tuple[DataFrame, DataFrame]:
    """Links inside the core (core, out, to: lists, which share out a hub's links), and its nodes with what a value of 1
    of all unlinked nodes gives them (id, given, value, old)."""
    names = nodes.where("out > 0 AND ins > 0").select("id", F.col("node").alias("dst"))
    into = spread.join(names, "dst").select("core", "out", "id")
    given = into.where("core IS NULL").groupBy("id").agg(F.sum(1 / F.col("out")).alias("given"))
    chunk = F.pmod(F.xxhash64("id"), F.ceil(F.col("out") / LINKS)).alias("chunk")
    inner = into.where("core IS NOT NULL").groupBy("core", "out", chunk).agg(F.collect_list("id").alias("to")).drop("chunk")
    ranks = names.select("id").join(given, "id", "left").select("id", F.coalesce("given", F.lit(0.0)).alias("given"), F.lit(value).alias("value"), F.lit(value).alias("old"))
    return checkpoint(inner), checkpoint(ranks)


def _step(ranks: DataFrame, inner: DataFrame, root: float, base: float, alpha: float) -> DataFrame:
    """The core's ranks (id, given, value, old) one step on, given the value of unlinked nodes before and after."""
    own = ranks.select(F.struct(F.col("id").alias("core")).alias("g"), "value")
    passed = inner.withColumn("g", F.struct("core")).join(own, "g").select(F.explode("to").alias("id"), (F.col("value") / F.col("out")).alias("part"))
    got = passed.groupBy("id").agg(F.sum("part").alias("got"))
    value = F.lit(base) + alpha * (root * F.col("given") + F.coalesce("got", F.lit(0.0)))
    return ranks.join(got, "id", "left").select("id", "given", value.alias("value"), F.col("value").alias("old"))


def with_ranks(pages: DataFrame, ranks: DataFrame, url_col: str = "url", default: float = 1e-6) -> DataFrame:
    """pages with value; a page without a rank gets the default."""
    named = ranks.select(F.col("node").alias("__node"), "value")
    return pages.join(named, F.col(url_col) == F.col("__node"), "left").drop("__node").withColumn("value", F.coalesce("value", F.lit(default)))


def graph_of_csv(spark: SparkSession, path: str, reverse: bool = True) -> DataFrame:
    """Edges of a CSV file of links: index, hook, link, base."""
    from thresher.sources.files import read_links

    return edges_of(read_links(spark, path), "base", "link", reverse)
