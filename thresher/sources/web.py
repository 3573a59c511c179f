"""Fetching pages and archives over HTTP. Pages are fetched by the tasks that hold their urls, so what a lost executor held
is fetched again and nothing is gathered on the driver.
"""

from __future__ import annotations

import gzip
import http.client
import time
import urllib.error
import urllib.request
import zipfile
import zlib
from collections.abc import Iterator
from io import BytesIO
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

FETCHED = "url string, status int, html string, attempts int, error string"
MEMBERS = "archive string, name string, content binary, error string"
_FETCHED = pa.schema([("url", pa.string()), ("status", pa.int32()), ("html", pa.string()), ("attempts", pa.int32()), ("error", pa.string())])
_MEMBERS = pa.schema([("archive", pa.string()), ("name", pa.string()), ("content", pa.binary()), ("error", pa.string())])


def _get(url: str | None, headers: dict[str, str], timeout: float, largest: int) -> tuple[int | None, str | None, str | None]:
    """status, text, error of one request. A body is never cut: a longer one than the bound is an error."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url or "", headers=headers), timeout=timeout) as answer:
            body = answer.read(largest + 1)
            if len(body) <= largest and answer.headers.get("Content-Encoding") == "gzip":
                body = gzip.GzipFile(fileobj=BytesIO(body)).read(largest + 1)
            if len(body) > largest:
                return answer.status, None, f"longer than {largest} bytes"
            return answer.status, body.decode("utf-8", "replace") if answer.status == 200 else None, None
    except urllib.error.HTTPError as e:
        return e.code, None, str(e)
    except (OSError, ValueError, EOFError, zlib.error, http.client.HTTPException) as e:
        return None, None, f"{type(e).__name__}: {e}"


def fetch(urls: DataFrame, headers: dict[str, str] | None = None, attempts: int = 1, pause: float = 1.0, empty_is_null: bool = False, timeout: float = 30.0, largest: int = 64 << 20) -> DataFrame:
    """url, status, html, attempts, error: one row for each row of urls (url), repeated ones too, so give distinct ones.
    html is the body as UTF-8 where the status is 200, else null; status is null without an answer. After an empty body
    the task waits, and asks again while attempts are left; a body that stays empty is an empty string, or null if
    empty_is_null. Nulls and what is no url give an error, not a failure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url in batch.column(0).to_pylist():
                status, text, error = _get(url, headers or {}, timeout, largest)
                tried = 1
                while text == "":
                    time.sleep(pause)
                    if tried >= attempts:
                        text = None if empty_is_null else ""
                        break
                    status, text, error = _get(url, headers or {}, timeout, largest)
                    tried += 1
                yield pa.RecordBatch.from_pylist([{"url": url, "status": status, "html": text, "attempts": tried, "error": error}], _FETCHED)

    return urls.select(urls["url"].cast("string").alias("url")).mapInArrow(run, FETCHED)


def download(spark: SparkSession, url: str, path: str) -> None:
    """Copies what a url gives to a path of any store that Spark writes, in pieces. The path appears when it is whole."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    to, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid4().hex}.part")
    store = to.getFileSystem(conf)
    try:
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(jvm.java.net.URI(url).toURL().openStream(), store.create(part), conf, True)
        store.delete(to, False)
        if not store.rename(part, to):
            raise OSError(f"can't write {path}")
    finally:
        store.delete(part, False)


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """archive, name, content, error: one row for each file in the zip archives that a path names, unpacked by the tasks.
    What can't be unpacked has an error and no content; an archive that is none is one row without a name. An archive
    and each of its files must fit in a task's memory, as Spark reads binary files whole (2 GB at most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(archive: str, name: str | None, content: bytes | None, error: str | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"archive": archive, "name": name, "content": content, "error": error}], _MEMBERS)

        for batch in batches:
            for archive, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    with zipfile.ZipFile(pa.BufferReader(data.as_buffer())) as z:
                        for member in z.infolist():
                            if member.is_dir():
                                continue
                            try:
                                content, error = z.read(member), None
                            except (zipfile.BadZipFile, RuntimeError, NotImplementedError, zlib.error, EOFError) as e:
                                content, error = None, f"{type(e).__name__}: {e}"
                            yield row(archive, member.filename, content, error)
                except zipfile.BadZipFile as e:
                    yield row(archive, None, None, f"BadZipFile: {e}")

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, MEMBERS)
