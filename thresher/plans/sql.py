"""Pieces of DuckDB SQL that the checks share."""

from __future__ import annotations

from thresher.functions.text import STOP_WORDS

# What the engine's constants must amount to, written out here so that a wrong one doesn't pass on both sides.
PUNCTUATION = r"[!-/:-@\[\]^-`{-~]+"
SOUNDEX = ("AEIOUYHW", "BFPV", "CGJKQSXZ", "DT", "L", "MN", "R")
HIDDEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&amp;": "&"}
CONTRACTIONS = {"cannot": "can not", "gonna": "gon na", "gotta": "got ta", "wanna": "wan na", "gimme": "gim me", "lemme": "lem me"}


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


WORDS = rf"list_filter(string_split_regex(lower(regexp_replace(text, {q(PUNCTUATION)}, ' ', 'g')), '\s+'), lambda x: x <> '')"
STOP = listed(STOP_WORDS)
DOCS = f"d AS (SELECT doc_id, coalesce({WORDS}, []) AS w FROM documents)"
TOKS = f"{DOCS}, toks AS (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS term FROM d)"
TF = f"{TOKS}, tf AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY doc_id, term)"
STATS = f"{TF}, stats AS (SELECT term, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df FROM tf GROUP BY term)"
CONTRACTED = f"lower(regexp_replace(text, {q(PUNCTUATION)}, ' ', 'g'))"
for _whole, _parts in CONTRACTIONS.items():
    CONTRACTED = rf"regexp_replace({CONTRACTED}, '\b{_whole}\b', '{_parts}', 'g')"
VOCAB = f"{TOKS}, vocab AS (SELECT DISTINCT term FROM toks)"
CONTENT = f"{DOCS}, c AS (SELECT doc_id, list_filter(w, lambda x: length(x) >= 2 AND x NOT IN {STOP}) AS w FROM d)"


def grams(w: str) -> str:
    return f"list_transform(range(1, greatest(1, length({w})) + 1), lambda i: substr('$' || {w} || '$', CAST(i AS INTEGER), 3))"


def soundex(w: str) -> str:
    letters = f"upper(regexp_replace({w}, '[^A-Za-z]', '', 'g'))"
    digits = f"translate({letters}, '{''.join(SOUNDEX)}', '{''.join(str(d) * len(x) for d, x in enumerate(SOUNDEX))}')"
    for d in "0123456":
        digits = f"regexp_replace({digits}, '{d}+', '{d}', 'g')"
    return f"substr(rpad(substr({letters}, 1, 1) || replace(substr({digits}, 2), '0', ''), 4, '0'), 1, 4)"


def plain(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for a, b in REFERENCES.items():
        out = f"replace({out}, {q(a)}, {q(b)})"
    return out


VISIBLE = f"regexp_replace(html, {q(HIDDEN)}, '', 'g')"
LINKS = rf"""l0 AS (SELECT url AS base_url, regexp_extract_all({VISIBLE}, '(?is)(<a\s[^>]*?href="[^"]*"[^>]*>.*?)</a>', 1) AS l FROM pages),
l1 AS (SELECT base_url, unnest(range(len(l))) AS n, unnest(l) AS a FROM l0),
links AS (SELECT base_url, n, regexp_extract(a, '(?is)href="([^"]*)"', 1) AS href, trim({plain("a")}) AS hook FROM l1),
abs AS (SELECT base_url, hook, CASE WHEN starts_with(href, '/') THEN regexp_extract(base_url, '^([^:]*://[^/?#]*)', 1) || href ELSE href END AS linked_url FROM links)"""
EDGES = f"{LINKS}, e AS (SELECT DISTINCT base_url AS src, linked_url AS dst FROM abs)"


def pagerank(iterations: int, alpha: float = 0.85) -> str:
    """Common tables e, nodes and r<iterations>."""
    out = f"""{EDGES}, deg AS (SELECT src, count(*) AS o FROM e GROUP BY src),
nodes AS (SELECT node, o FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) LEFT JOIN deg ON node = src), nn AS (SELECT count(*) AS n FROM nodes),
r0 AS (SELECT node, 1.0::DOUBLE / n AS value FROM nodes, nn)"""
    for k in range(1, iterations + 1):
        out += f""",
g{k} AS (SELECT dst AS node, sum(value / o) AS got FROM e JOIN deg USING (src) JOIN r{k - 1} ON r{k - 1}.node = e.src GROUP BY dst),
l{k}x AS (SELECT coalesce(sum(value), 0) AS loose FROM r{k - 1} JOIN nodes USING (node) WHERE o IS NULL),
r{k} AS (SELECT node, {alpha} * (coalesce(got, 0) + loose / n) + {1 - alpha} / n AS value FROM nodes LEFT JOIN g{k} USING (node), l{k}x, nn)"""
    return out


def pagerank_limit(iterations: int, alpha: float = 0.85) -> str:
    """A common table r (k, node, value) by recursion, for many iterations. Every node has a link of no weight to itself,
    which brings it into each step, and by which a node without links says what it has to share out."""
    return f"""RECURSIVE {EDGES}, deg AS (SELECT src, count(*) AS o FROM e GROUP BY src),
nodes AS (SELECT node, o FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) LEFT JOIN deg ON node = src), nn AS (SELECT count(*) AS n FROM nodes),
w AS (SELECT src, dst, 1.0::DOUBLE / o AS w, 0.0::DOUBLE AS loose FROM e JOIN deg USING (src) UNION ALL SELECT node, node, 0, CASE WHEN o IS NULL THEN 1 ELSE 0 END FROM nodes),
r AS (SELECT 0 AS k, node, 1.0::DOUBLE / n AS value FROM nodes, nn
  UNION ALL SELECT k + 1, node, {alpha} * (got + sum(loose) OVER () / n) + {1 - alpha} / n
  FROM (SELECT k, dst AS node, sum(value * w) AS got, sum(value * loose) AS loose FROM r JOIN w ON node = src WHERE k < {iterations} GROUP BY k, dst), nn)"""


#: Frames that a rule makes of every document: the third word of each run of eight is a predicate; the last run may be shorter.
FRAMES = f"""{DOCS}, runs AS (SELECT doc_id, CAST(k AS INTEGER) AS k, w[8 * k + 1 : 8 * k + 8] AS t FROM (SELECT doc_id, w, unnest(range((len(w) + 7) // 8)) AS k FROM d)),
tr AS (SELECT doc_id, k, 'A0' AS m_label, t[1] || '_' || t[2] AS m_name, t[3] AS rel, n_label, CASE n_label WHEN 'A1' THEN t[4] ELSE t[5] || '_' || t[6] END AS n_name
  FROM runs, (VALUES ('A1', 4), ('A2', 6)) v(n_label, least) WHERE len(t) >= least)"""
