"""Files behind HTTP that break and come back, and a file a key."""

import gzip
import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from kelpline.sources import remote
from kelpline.sources.remote import fetched, plain, read_remote_lines, stream_remote_lines
from kelpline.sources.sinks import write_documents

LINES = [f'{{"parent_asin": "B{i:05}", "text": "äö {i * i}"}}' for i in range(20_000)]


class Server:
    """Serves bytes by path; ``broken`` answers of a path end early, ``down`` answers are errors; ``ranges`` tells whether parts can be asked for."""

    def __init__(self, files, ranges=True, port=0):
        self.files, self.broken, self.down, self.asked = files, {}, {}, []
        outer = self

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_GET(self):  # noqa: N802
                name = self.path[1:]
                outer.asked.append((name, self.headers.get("Range")))
                if outer.down.get(name, 0):
                    outer.down[name] -= 1
                    return self.send_error(503)
                if name not in outer.files:
                    return self.send_error(404)
                data, at = outer.files[name], 0
                if ranges and self.headers.get("Range"):
                    at = int(self.headers["Range"].removeprefix("bytes=").removesuffix("-"))
                self.send_response(206 if at else 200)
                self.send_header("Content-Length", str(len(data) - at))
                self.end_headers()
                part = data[at:]
                if outer.broken.get(name, 0):
                    outer.broken[name] -= 1
                    part = part[: len(part) // 2]
                self.wfile.write(part)

            def log_message(self, *_):
                pass

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", port), Handler)
        self.port = self.server.server_port
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def url(self, name):
        return f"http://127.0.0.1:{self.port}/{name}"

    def stop(self):
        self.server.shutdown()
        self.server.server_close()


@pytest.fixture
def files():
    half = len(LINES) // 2
    two = gzip.compress("\n".join(LINES[:half]).encode() + b"\n") + gzip.compress("\n".join(LINES[half:]).encode())
    return {"two.gz": two, "plain.jsonl": b"one\r\ntwo\n\n\xff three", "empty.gz": gzip.compress(b""), "nothing": b""}


@pytest.mark.parametrize("ranges", [True, False])
def test_files_that_break_are_taken_up_again(spark, files, ranges, monkeypatch):
    server = Server(files, ranges)
    server.broken["two.gz"], server.down["two.gz"] = 3, 2
    try:
        df = read_remote_lines(spark, [server.url(n) for n in files], wait="0.01")
        assert df.rdd.getNumPartitions() == 4
        rows = df.orderBy("url", "line").collect()
        by = {n: [r["value"] for r in rows if r["url"].endswith(n)] for n in files}
        assert by == {"two.gz": LINES, "plain.jsonl": ["one", "two", "", "� three"], "empty.gz": [], "nothing": []}
        assert [r["line"] for r in rows if r["url"].endswith("two.gz")] == list(range(len(LINES)))
        assert (("two.gz", None) in server.asked) and any(n == "two.gz" and at for n, at in server.asked)
    finally:
        server.stop()


def test_errors_that_stay_are_raised(files):
    server = Server(files)
    server.down["two.gz"] = 9
    try:
        for name in ("two.gz", "absent"):
            with pytest.raises(OSError):
                b"".join(fetched(server.url(name), 2, 0.0, 5))
        assert len([a for a in server.asked if a[0] == "two.gz"]) == 3 and len([a for a in server.asked if a[0] == "absent"]) == 1
    finally:
        server.stop()


def test_a_cut_gzip_file_and_small_chunks():
    data = gzip.compress(b"abc\ndef")
    assert b"".join(plain(iter([data[i : i + 1] for i in range(len(data))]))) == b"abc\ndef"
    assert [b.to_pydict() for b in remote.batches("u", iter([b"a", b"b\nc", b"\n", b"d"]))] == [{"url": ["u"] * 3, "line": [0, 1, 2], "value": ["ab", "c", "d"]}]


def test_a_stream_goes_on_after_the_server_was_down(spark, files, tmp_path):
    server = Server({**files, "index": b""})
    port, out, check = server.port, str(tmp_path / "out"), str(tmp_path / "check")

    def run(tries="1"):
        stream = stream_remote_lines(spark, f"http://127.0.0.1:{port}/index", wait="0.01", tries=tries, maxFilesPerTrigger="1")
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    names = ["plain.jsonl", "two.gz"]
    server.files["index"] = f"{server.url(names[0])}\n{server.url(names[1])}\nhttp://127.0.0.1:{port}/not-whole".encode()
    server.down["two.gz"] = 100  # the first file comes, the second doesn't
    with pytest.raises(Exception, match="503"):
        run()
    server.stop()
    server = Server({**files, "index": server.files["index"] + b"-yet\n", "not-whole-yet": b"last"}, port=port)
    try:
        run()
        run()
    finally:
        server.stop()
    got = spark.read.schema(remote.SCHEMA).parquet(out).groupBy(F.element_at(F.split("url", "/"), -1).alias("name")).agg(F.count("*").alias("n"), F.countDistinct("line").alias("d")).collect()
    assert {(r["name"], r["n"], r["d"]) for r in got} == {("plain.jsonl", 4, 4), ("two.gz", len(LINES), len(LINES)), ("not-whole-yet", 1, 1)}


def test_a_file_a_key(spark, tmp_path):
    out = tmp_path / "out"
    df = spark.range(500).select(F.concat(F.lit("SN/"), "id").alias("k"), (F.col("id") / 3).alias("x"), F.lit("ä\n\"").alias("t")).repartition(7)
    write_documents(df, "k", str(out))
    assert len(list(out.iterdir())) == 500 and json.loads((out / "SN_7.json").read_text()) == {"k": "SN/7", "x": 2.3333, "t": 'ä\n"'}
    write_documents(df.limit(0), "k", str(out))
    write_documents(df.filter("k = 'SN/7'").withColumn("x", F.lit(1.0)), "k", str(out))
    assert len(list(out.iterdir())) == 500 and json.loads((out / "SN_7.json").read_text())["x"] == 1.0


def test_failed_tasks_leave_nothing(spark, tmp_path):
    out = tmp_path / "out"
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, x int")
    write_documents(df, "k", str(out))
    for bad in ([("a", 9), ("a_b", 1), ("a/b", 2)], [("a", 9), (None, 1)]):
        with pytest.raises(Exception, match="two documents or none"):
            write_documents(spark.createDataFrame(bad, "k string, x int"), "k", str(out))
        assert sorted(p.name for p in out.rglob("*") if p.is_file()) == ["a.json", "b.json", "c.json"] and json.loads((out / "a.json").read_text())["x"] == 1
