"""Lines of gzip or plain files behind HTTP as a Spark source, in batch and as a stream: a task a file."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "url string, line long, value string"
#: Compressed bytes that are read at once, and lines a batch.
CHUNK, BATCH = 1 << 18, 8192


class File(InputPartition):
    def __init__(self, url: str):
        self.url = url


def fetched(url: str, tries: int, wait: float, timeout: float) -> Iterator[bytes]:
    """The bytes of ``url``. A connection that breaks is taken up again where it broke, ``tries`` times without any progress at most."""
    at, whole, failed = 0, None, 0
    while whole is None or at < whole:
        try:
            asked = urllib.request.Request(url, headers={"Range": f"bytes={at}-"} if at else {})
            with urllib.request.urlopen(asked, timeout=timeout) as got:
                skip = at if at and got.status != 206 else 0  # a server that knows no ranges sends all again
                size = got.headers.get("Content-Length")
                whole = None if size is None else int(size) + (at if got.status == 206 else 0)
                while data := got.read(CHUNK):
                    fresh, skip = data[skip:], max(0, skip - len(data))
                    at, failed = at + len(fresh), 0
                    if fresh:
                        yield fresh
            if whole is None:
                return  # no length was given, and the answer ended in order
            if at < whole:
                raise ConnectionError(f"{url} ended after {at} of {whole} bytes")
        except (OSError, urllib.error.URLError) as e:
            final = isinstance(e, urllib.error.HTTPError) and e.code < 500 and e.code != 429
            failed += 1
            if final or failed > tries:
                raise
            time.sleep(wait * failed)


def plain(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Unzipped chunks, of one gzip member after the other; chunks of a file that isn't gzip as they are."""
    start = b""
    for chunk in chunks:
        start += chunk
        if len(start) >= 2:
            break
    if start[:2] != b"\x1f\x8b":
        yield start
        yield from chunks
        return
    unzip, data = zlib.decompressobj(31), start
    while True:
        while data:
            out = unzip.decompress(data)
            if out:
                yield out
            data = unzip.unused_data if unzip.eof else b""
            if unzip.eof:
                unzip = zlib.decompressobj(31)
        data = next(chunks, b"")
        if not data:
            return


def batches(url: str, chunks: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """Batches of ``url``, ``line`` (from 0) and ``value``; line ends go, bytes that aren't UTF-8 are replaced, a last line needs no end."""
    held: list[str] = []
    number, rest = 0, b""

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([url] * len(held), pa.string()), pa.array(range(number - len(held), number), pa.int64()), pa.array(held, pa.string())], ["url", "line", "value"])

    for chunk in chunks:
        parts = (rest + chunk).split(b"\n") if b"\n" in chunk else None
        if parts is None:
            rest += chunk
            continue
        rest = parts.pop()
        for part in parts:
            held.append(part.removesuffix(b"\r").decode("utf-8", "replace"))
            number += 1
            if len(held) == BATCH:
                yield out()
                held.clear()
    if rest:
        held.append(rest.removesuffix(b"\r").decode("utf-8", "replace"))
        number += 1
    if held:
        yield out()


class _Reading:
    def __init__(self, options: dict[str, str]):
        self.tries, self.wait, self.timeout = int(options.get("tries", "5")), float(options.get("wait", "1")), float(options.get("timeout", "60"))
        self.urls, self.index = json.loads(options.get("urls", "[]")), options.get("index")
        self.most = int(options.get("maxfilespertrigger", options.get("maxFilesPerTrigger", "1000")))

    def listing(self) -> list[str]:
        """The urls that are named, then those of the index: a file with one a line, to which lines are only added."""
        found = list(self.urls)
        if self.index:
            lines = b"".join(fetched(self.index, self.tries, self.wait, self.timeout)).decode().split("\n")
            found += [x.strip() for x in lines[:-1] if x.strip()]  # a last line without its end isn't whole yet
        return found

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        yield from batches(partition.url, plain(fetched(partition.url, self.tries, self.wait, self.timeout)))


class BatchReader(_Reading, DataSourceReader):
    def partitions(self) -> list[File]:
        return [File(u) for u in self.listing()]


class StreamReader(_Reading, DataSourceStreamReader):
    """Offsets count the files of the listing that were read; a batch is read again from the same listing."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.done = 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"files": max(self.done, min(len(self.listing()), self.done + self.most))}

    def partitions(self, start: dict, end: dict) -> list[File]:
        self.done = max(self.done, end["files"])
        return [File(u) for u in self.listing()[start["files"] : end["files"]]]

    def commit(self, end: dict) -> None:
        self.done = max(self.done, end["files"])


class RemoteLines(DataSource):
    """Format ``remote_lines``. Options: ``urls`` (a JSON list) or ``index`` (a url that lists urls), ``tries``, ``wait``, ``timeout``, ``maxFilesPerTrigger``."""

    @classmethod
    def name(cls) -> str:
        return "remote_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BatchReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return StreamReader(dict(self.options))


def read_remote_lines(spark: SparkSession, urls: list[str], **options: str) -> DataFrame:
    """url, line, value of the files at ``urls``. A gzip file can't be entered midway, so each is one task; deal rows out anew where few files are large."""
    spark.dataSource.register(RemoteLines)
    return spark.read.format("remote_lines").options(urls=json.dumps(urls), **options).load()


def stream_remote_lines(spark: SparkSession, index: str, **options: str) -> DataFrame:
    """The same as a stream of the files that ``index`` lists, in its order."""
    spark.dataSource.register(RemoteLines)
    return spark.readStream.format("remote_lines").options(index=index, **options).load()
