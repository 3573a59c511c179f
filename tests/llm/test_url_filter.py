"""Rules against a plain search over all rules, collisions of digests, and odd rows."""

from __future__ import annotations

import random
import time

from thresher.llm.url_filter import RULES, Rules, filter_urls, pack_rules, split_url


def brute(url, rules, default="allow"):
    host, path = split_url(url)
    best = None
    for h, p, v in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and host:
            if best is None or (len(h + p), len(h)) > best[0]:
                best = ((len(h + p), len(h)), h + p, v)
    return (host, path, best[1], best[2]) if best else (host, path, None, default)


def test_split():
    assert split_url("http://A.Com:80/x?y#z") == ("a.com:80", "/x")
    assert split_url("http://É.Com") == ("É.com", "") and split_url("a.com/x") == ("", "") == split_url(None) == split_url("")
    assert split_url("x://h#f://g/p") == ("h", "") and split_url("://h/p") == ("h", "/p")


def packed(tmp_path, rules, **options):
    name, data = pack_rules(rules, **options)
    (tmp_path / name).write_bytes(data)
    return Rules(str(tmp_path / name), **options)


def test_random_rules_with_and_without_collisions(tmp_path):
    rng = random.Random(6)
    hosts = ["com", "a.com", "b.a.com", "net", "é.net", "x.y.z", ""]
    paths = ["/", "/a", "/a/", "/a/b", "/é", ""]
    rules = list({(h, p): (h, p, rng.choice(["allow", "block", "review"])) for h in hosts[:6] for p in paths if rng.random() < 0.6}.values())
    urls = [f"http://{rng.choice(['', 'w.', 'W.q.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'b/c', '?q'])}" for _ in range(500)] + [None, "", "com/", "http://xcom/"]
    want = [brute(u, rules) for u in urls]
    assert packed(tmp_path, rules).match(urls, "allow") == want
    assert packed(tmp_path, rules, hashed=lambda s: len(s) % 3).match(urls, "allow") == want  # digests that collide


def test_odd_rows(spark):
    rows = [(1, "http://www.example.com/en/x", "h"), (1, "http://www.example.com/en/x", "h"), (2, "http://q.example.com/en/", None), (None, None, "h"), (3, "http://a.net/fr/" + "z/" * 50_000, "h")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string").selectExpr("*", "1 AS k0", "1 AS x", "1 AS `a.b`")
    found = filter_urls(df, keep=("page_id", "host", "k0", "x", "a.b"))
    assert found.columns == ["page_id", "k0", "x", "a.b", "host", "path", "rule", "verdict"]
    got = found.collect()
    assert [(r[0], r.rule, r.verdict) for r in sorted(got, key=lambda r: (r[0] or 0))] == [(None, None, "allow"), (1, "www.example.com/en/", "allow"), (1, "www.example.com/en/", "allow"), (2, "example.com/en/", "block"), (3, "net/fr/", "block")]
    assert filter_urls(df.limit(0)).count() == 0
    assert {r.verdict for r in filter_urls(df.select("url"), [], default="keep").collect()} == {"keep"}
    assert RULES[0] == ("com", "/", "allow")


def test_long_hosts_cost_no_more_than_their_length(tmp_path):
    rules = packed(tmp_path, RULES)

    def seconds(n):
        urls = [f"http://{'a.' * n}net/fr/{'b/' * n}"] * 20
        at = time.perf_counter()
        assert {x[2:] for x in rules.match(urls, "allow")} == {("net/fr/", "block")}
        return time.perf_counter() - at

    seconds(1000)
    small, large = min(seconds(4000) for _ in range(5)), min(seconds(32_000) for _ in range(3))
    assert large < 24 * small + 0.05  # eight times as long; quadratic would be 64
