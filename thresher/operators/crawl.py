"""What a crawl takes from pages, and its frontier, as set operations on tables.

Pages are read with linear patterns inside the scan. Scripts, styles and comments go first, as they may hold markup.
Link rules are independent: an href that meets two gives two rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIDDEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def visible(html: Column) -> Column:
    return F.regexp_replace(html, HIDDEN, "")


def plain(markup: Column) -> Column:
    """Without tags, common references decoded."""
    out = F.regexp_replace(markup, "<[^>]*>", "")
    for a, b in REFERENCES.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def page_title(html: Column) -> Column:
    """The first title; null without one."""
    return F.when(F.regexp_like(html, F.lit(r"(?is)<title[^>]*>.*?</title>")), F.btrim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def page_text(html: Column, shortest: int = 6, without: str = "copyright") -> Column:
    """Paragraphs that hold text alone, are long enough and lack a word, trimmed and joined by spaces."""
    inner = F.regexp_extract_all(visible(html), F.lit(r"(?is)<p(?:\s[^>]*)?>([^<]*)</p>"), 1)
    kept = F.filter(F.transform(inner, plain), lambda x: ~F.contains(x, F.lit(without)) & (F.char_length(x) >= shortest))
    return F.array_join(F.transform(kept, lambda x: F.btrim(x)), " ")


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """base_url, n (place on the page, from 0), href, hook (the link's text), one row per link."""
    found = F.regexp_extract_all(visible(F.col(html_col)), F.lit(r'(?is)(<a\s[^>]*?href="[^"]*"[^>]*>.*?)</a>'), 1)
    rows = pages.select(F.col(url_col).alias("base_url"), F.posexplode(found).alias("n", "a"))
    return rows.select("base_url", "n", F.regexp_extract("a", r'(?is)href="([^"]*)"', 1).alias("href"), F.btrim(plain(F.col("a"))).alias("hook"))


def link_rules(found: DataFrame, domain: str, forum: str = "bbs", page_mark: str = ".htm", pdf_mark: str = ".pdf", office_mark: str = ".doc") -> DataFrame:
    """base_url, hook, linked_url, kind: site, page, pdf, doc. site: the href holds the domain, is not the page itself and
    not of the forum; page: a relative href with the page mark in its last 6 characters, on a page whose url has none
    there; pdf and doc: a relative href with the mark in its last 5."""
    href, base = F.col("href"), F.col("base_url")
    whole = F.concat(base, href)
    last = lambda c, n, mark: F.contains(F.right(c, F.lit(n)), F.lit(mark))
    rules = F.array(
        F.when(F.contains(href, F.lit(domain)) & (href != base) & ~F.contains(href, F.lit(forum)), F.struct(F.lit("site").alias("kind"), href.alias("linked_url"))),
        F.when(F.startswith(href, F.lit("/")) & last(href, 6, page_mark) & ~last(base, 6, page_mark), F.struct(F.lit("page").alias("kind"), whole.alias("linked_url"))),
        F.when(F.startswith(href, F.lit("/")) & last(href, 5, pdf_mark), F.struct(F.lit("pdf").alias("kind"), whole.alias("linked_url"))),
        F.when(F.startswith(href, F.lit("/")) & last(href, 5, office_mark), F.struct(F.lit("doc").alias("kind"), whole.alias("linked_url"))),
    )
    return found.select("base_url", "hook", F.inline(F.array_compact(rules))).select("base_url", "hook", "linked_url", "kind")


def absolute(found: DataFrame) -> DataFrame:
    """base_url, hook, linked_url with hrefs from / resolved against the page's scheme and host."""
    root = F.regexp_extract("base_url", r"^([^:]*://[^/?#]*)", 1)
    return found.select("base_url", "hook", F.when(F.startswith("href", F.lit("/")), F.concat(root, "href")).otherwise(F.col("href")).alias("linked_url"))


def new_urls(urls: DataFrame, unused: DataFrame, used: DataFrame) -> DataFrame:
    """Distinct urls (url) that are in neither table."""
    fresh = urls.select("url").where("url IS NOT NULL").distinct()
    return fresh.join(unused.select("url"), "url", "left_anti").join(used.select("url"), "url", "left_anti")


def frontier_step(urls: DataFrame, unused: DataFrame, used: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One level of a breadth-first crawl: what is fetched next (all that waits and is not used), and the used table with
    it. Every url of a level is taken at once, where a single crawler would pop one."""
    waiting = unused.select("url").union(new_urls(urls, unused, used)).distinct()
    todo = waiting.join(used.select("url"), "url", "left_anti")
    return todo, used.select("url").union(todo)


def with_titles(used: DataFrame, titles: DataFrame) -> DataFrame:
    """used (id, url, title) with titles (url, title) filled in where a page gave one."""
    new = titles.groupBy("url").agg(F.max("title").alias("__new"))
    return used.join(new, "url", "left").select("id", "url", F.coalesce("__new", "title").alias("title"))


def remove_urls(table: DataFrame, gone: DataFrame) -> DataFrame:
    return table.join(gone.select("url"), "url", "left_anti")


def storable(pages: DataFrame, text_col: str = "text", longer_than: int = 10) -> DataFrame:
    """Pages whose text is long enough to keep."""
    return pages.where(F.char_length(text_col) > longer_than)


def agreement(a: DataFrame, b: DataFrame, urls: DataFrame) -> DataFrame:
    """n, n_agree: for how many urls the two tables agree on whether they hold it."""
    flag = lambda t, c: t.select("url").distinct().withColumn(c, F.lit(True))
    both = urls.select("url").join(flag(a, "a"), "url", "left").join(flag(b, "b"), "url", "left")
    return both.agg(F.count("*").alias("n"), F.count_if(F.coalesce("a", F.lit(False)) == F.coalesce("b", F.lit(False))).alias("n_agree"))
