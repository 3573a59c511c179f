"""Fetching from a server of this process, archives, and tables of a database."""

from __future__ import annotations

import gzip
import io
import threading
import zipfile
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from thresher.sources import files, sinks, web


@pytest.fixture(scope="module")
def server():
    seen = Counter()
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("0/a.txt", "first text")
        z.writestr("1/b.txt", "")
    pages = {"/a": "größer".encode(), "/bad": b"x\xff", "/empty": b"", "/z.zip": packed.getvalue(), "/gz": gzip.compress(b"unpacked"), "/bomb": gzip.compress(b"0" * 5000)}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            seen[self.path] += 1
            body = pages.get(self.path, b"late" if self.path == "/late" and seen["/late"] > 2 else b"")
            self.send_response(404 if self.path == "/none" else 200)
            if self.path in ("/gz", "/bomb"):
                self.send_header("Content-Encoding", "gzip")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_fetch(spark, server):
    urls = spark.createDataFrame([(f"{server}/{x}", 1) for x in ("a", "bad", "empty", "none", "gz")] + [(None, 1), ("no url", 1), ("http://127.0.0.1:1/", 1)], "url string, status int")
    got = {r.url: (r.status, r.html) for r in web.fetch(urls, pause=0.01).collect()}
    assert got == {f"{server}/a": (200, "größer"), f"{server}/bad": (200, "x�"), f"{server}/empty": (200, ""), f"{server}/none": (404, None), f"{server}/gz": (200, "unpacked"), None: (None, None), "no url": (None, None), "http://127.0.0.1:1/": (None, None)}
    assert web.fetch(urls.limit(0)).count() == 0
    errors = {r.url: r.error for r in web.fetch(urls, pause=0.01).collect()}
    assert errors[f"{server}/a"] is None and all(errors[u] for u in (f"{server}/none", None, "no url", "http://127.0.0.1:1/"))


def test_fetch_again_when_empty(spark, server):
    urls = spark.createDataFrame([(f"{server}/late",), (f"{server}/empty",)], "url string").coalesce(1)
    got = {r.url.rsplit("/", 1)[1]: (r.html, r.attempts) for r in web.fetch(urls, attempts=3, pause=0.01, empty_is_null=True).collect()}
    assert got == {"late": ("late", 3), "empty": (None, 3)}


def test_long_bodies_are_errors(spark, server):
    urls = spark.createDataFrame([(f"{server}/bomb",), (f"{server}/a",)], "url string")
    got = {r.url.rsplit("/", 1)[1]: (r.html, r.error) for r in web.fetch(urls, largest=100).collect()}
    assert got == {"bomb": (None, "longer than 100 bytes"), "a": ("größer", None)}


def test_download_and_unzip(spark, server, tmp_path):
    web.download(spark, f"{server}/z.zip", str(tmp_path / "z.zip"))
    web.download(spark, f"{server}/z.zip", str(tmp_path / "z.zip"))
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["z.zip"]
    (tmp_path / "broken.zip").write_bytes(b"none")
    got = {(r.archive.rsplit("/", 1)[1], r.name): (r.content, r.error is None) for r in web.read_zip(spark, str(tmp_path / "*.zip")).collect()}
    assert got == {("z.zip", "0/a.txt"): (b"first text", True), ("z.zip", "1/b.txt"): (b"", True), ("broken.zip", None): (None, False)}


def test_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.createDataFrame([(1, "http://a", None), (2, "http://b", "B")], "id int, url string, title string")
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    read = lambda: {tuple(r) for r in files.read_jdbc(spark, url, "used", **options).collect()}
    sinks.write_jdbc(rows, url, "used", "overwrite", **options)
    assert read() == {(1, "http://a", None), (2, "http://b", "B")}
    sinks.write_jdbc(spark.createDataFrame([(3, "http://c", "C")], rows.schema), url, "used", **options)
    assert len(read()) == 3
    sinks.write_jdbc(rows.where("id = 2"), url, "used", "overwrite", **options)
    assert read() == {(2, "http://b", "B")}
    assert files.read_jdbc(spark, url, "used", **options).where("id = 1").count() == 0


def test_database_that_comes_back(spark, tmp_path):
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("gone")
        return "here"

    assert files.reconnecting(flaky, attempts=5, pause=0) == "here" and len(calls) == 3
    calls.clear()
    with pytest.raises(OSError, match="gone"):
        files.reconnecting(flaky, attempts=2, pause=0)
    assert len(calls) == 2
    with pytest.raises(ValueError, match="other"):
        files.reconnecting(lambda: (_ for _ in ()).throw(ValueError("other")), attempts=5, pause=0)
