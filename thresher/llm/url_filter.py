"""URL filters over a sorted digest array.

Rules (a host with its subdomains, a path prefix, a verdict) are one file: sorted 64-bit xxhash keys of host + path, then
offsets, verdicts and the full strings. The file goes to the executors with Spark's own file server; all Python workers
of a machine map the same pages. For a batch of urls, each suffix of the host with each prefix of the path is a candidate
if some rules have such lengths, so a long url has no more candidates than a short one; candidates are hashed, found by one vectorised binary search, and confirmed against the full string,
so a collision of hashes never decides.

Cases: a null url, or one without ://, has an empty host and path and meets no rule. The longest rule string wins, of
equal strings the one with the longer host; a rule given twice keeps its last verdict, and a rule with an empty host meets
nothing. Urls of any length are read whole. Repeated rows get repeated results, an empty table an empty one. No rules: the
default verdict for all. host, path, rule and verdict take the place of kept columns of their names; other columns may
have any name.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import map_texts, publish, quoted, read

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
LOWER = {x: x + 32 for x in range(65, 91)}
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)


def split_url(url: str | None) -> tuple[str, str]:
    found = _URL.search(url or "")
    return (found[1].translate(LOWER), found[2]) if found else ("", "")


def pack_rules(rules: Iterable[tuple[str, str, str]], hashed=xxhash.xxh64_intdigest) -> tuple[str, bytes]:
    """Name and content of the file of rules; the name follows from the content. hashed: for tests of collisions."""
    by = {(host.translate(LOWER), path): verdict for host, path, verdict in rules}
    rows = sorted((hashed(f"{h}\n{p}".encode()), f"{h}\n{p}".encode(), v) for (h, p), v in by.items())
    verdicts = sorted({v for *_, v in rows})
    ends = np.cumsum([0, *(len(s) for _, s, _ in rows)], dtype="<u8")
    head = json.dumps({"n": len(rows), "verdicts": verdicts, "lengths": sorted({len(p) for _, p in by}), "hosts": sorted({len(h) for h, _ in by})}).encode()
    head = len(head).to_bytes(8, "little") + head + b" " * (-len(head) % 8)
    body = head + np.array([k for k, *_ in rows], "<u8").tobytes() + ends.tobytes() + bytes(verdicts.index(v) for *_, v in rows) + b"".join(s for _, s, _ in rows)
    return f"url-rules-{hashlib.sha256(body).hexdigest()[:24]}.bin", body


class Rules:
    def __init__(self, path: str, hashed=xxhash.xxh64_intdigest):
        data = np.memmap(path, np.uint8, "r")
        size = int.from_bytes(data[:8].tobytes(), "little")
        head = json.loads(data[8 : 8 + size].tobytes())
        n, at = head["n"], 8 + size + -size % 8
        self.keys = data[at : at + 8 * n].view("<u8")
        self.ends = data[at + 8 * n : at + 16 * n + 8].view("<u8")
        self.kinds = data[at + 16 * n + 8 : at + 17 * n + 8]
        self.blob = data[at + 17 * n + 8 :]
        self.lengths, self.hosts, self.verdicts, self.hashed = head["lengths"], head["hosts"], head["verdicts"], hashed

    def match(self, urls: list[str | None], default: str) -> list[tuple[str, str, str | None, str]]:
        parts = [split_url(u) for u in urls]
        who: list[int] = []
        what: list[tuple[int, int, bytes]] = []
        for k, (host, path) in enumerate(parts):
            for size in self.hosts:
                at = len(host) - size
                if not size or at < 0 or at and host[at - 1] != ".":
                    continue
                suffix = host[at:]
                for n in self.lengths:
                    if n > len(path):
                        break
                    who.append(k)
                    what.append((len(suffix) + n, len(suffix), f"{suffix}\n{path[:n]}".encode()))
        best: dict[int, tuple[int, int, str, str]] = {}
        if what and len(self.keys):
            keys = np.fromiter((self.hashed(s) for *_, s in what), np.uint64, len(what))
            lo = np.searchsorted(self.keys, keys, "left")
            for i in np.flatnonzero(self.keys[np.minimum(lo, len(self.keys) - 1)] == keys):
                j, (size, of_host, s) = lo[i], what[i]
                while j < len(self.keys) and self.keys[j] == keys[i]:  # equal digests of different strings
                    if self.blob[int(self.ends[j]) : int(self.ends[j + 1])].tobytes() == s:
                        mine = (size, of_host, s.decode().replace("\n", "", 1), self.verdicts[self.kinds[j]])
                        if mine[:2] > best.get(who[i], (-1, -1))[:2]:
                            best[who[i]] = mine
                        break
                    j += 1
        return [(h, p, *best[k][2:]) if k in best else (h, p, None, default) for k, (h, p) in enumerate(parts)]


@lru_cache(4)
def _rules(path: str) -> Rules:
    return Rules(path)


def filter_urls(df: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, url_col: str = "url", keep: tuple[str, ...] = (), default: str = "allow") -> DataFrame:
    """The columns named in keep with host, path, rule and verdict for each row."""
    spark = df.sparkSession
    name, data = pack_rules(rules)
    publish(spark, name, data)
    made = [(x, T.StringType()) for x in ("host", "path", "rule", "verdict")]

    def judged(urls: pa.Array) -> list[pa.Array]:
        found = _rules(SparkFiles.get(name)).match(urls.to_pylist(), default)
        return [pa.array(c, pa.string()) for c in (zip(*found, strict=True) if found else [()] * 4)]

    return map_texts(df, keep, quoted(url_col), made, judged, rows=10_000)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"), keep=("page_id",))


_HOST = "translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP1_SQL = rf"""
WITH u AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN {_HOST} ELSE '' END AS host,
    CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages
), r(h, p, v) AS (VALUES {", ".join(str(x) for x in RULES)}),
m AS (
  SELECT DISTINCT page_id, host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id, host, path
)
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.v, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id, host, path)
"""
