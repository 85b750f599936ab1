"""The fetch queue against a server of the test's own."""

import shutil
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from tidemark.sources import fetch


class Server:
    """/ok/x gives x; /flaky/n/x fails n times first; /short/x promises more bytes than it sends; /never fails."""

    def __init__(self):
        asked, busy, outer = Counter(), [0, 0], self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):  # noqa: N802
                with outer.lock:
                    asked[self.path] += 1
                    busy[0] += 1
                    busy[1] = max(busy[1], busy[0])
                time.sleep(0.05)
                with outer.lock:  # before the answer, after which the task may ask again
                    busy[0] -= 1
                kind, *rest = self.path.strip("/").split("/")
                ok = kind == "ok" or kind == "short" or (kind == "flaky" and asked[self.path] > int(rest[0]))
                self.send_response(200 if ok else 503)
                body = rest[-1].encode() if ok else b""
                self.send_header("Content-Length", str(len(body) + 9 * (kind == "short")))
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *_):
                pass

        self.lock, self.asked, self.busy = threading.Lock(), asked, busy
        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.http.server_port}"
        threading.Thread(target=self.http.serve_forever, daemon=True).start()


@pytest.fixture
def server():
    s = Server()
    yield s
    s.http.shutdown()


def test_rounds_until_nothing_waits(spark, tmp_path, server):
    path, out = str(tmp_path / "queue"), str(tmp_path / "out")
    rows = [(f"{server.url}/ok/a{i}", f"d/{i}") for i in range(12)] + [(f"{server.url}/flaky/{n}/f", f"f{n}") for n in (1, 2, 6)] + [(f"{server.url}/short/s", "s"), (f"{server.url}/never", "n"), (None, "x"), ("junk://", "j"), (f"{server.url}/ok/zz", "d/0")]
    requests = spark.createDataFrame(rows, "url string, name string")
    assert fetch.added(requests, path) == 18 and fetch.added(requests, path) == 0
    got = {r.name: r for r in fetch.fetched(spark, path, out, 2, 3, 0.05).collect()}
    assert {n: (r.status, r.attempts) for n, r in got.items() if not n.startswith("d/")} == {"f1": ("done", 2), "f2": ("done", 3), "f6": ("failed", 3), "s": ("failed", 3), "n": ("failed", 3), "j": ("failed", 3)}
    assert all(r.status == "done" and r.attempts == 1 for n, r in got.items() if n.startswith("d/")) and got["s"].error
    assert sorted(str(p.relative_to(out)) for p in (tmp_path / "out").rglob("*") if p.is_file()) == sorted([f"d/{i}" for i in range(12)] + ["f1", "f2"])
    assert (tmp_path / "out/d/3").read_text() == "a3" and server.busy[1] <= 2  # tasks of the whole cluster


def test_a_killed_run_fetches_nothing_twice(spark, tmp_path, server):
    """The objects of a round are there, its version of the queue isn't."""
    path, out = str(tmp_path / "queue"), str(tmp_path / "out")
    fetch.added(spark.createDataFrame([(f"{server.url}/ok/a{i}", str(i)) for i in range(5)], "url string, name string"), path)
    assert fetch.round_of(spark, path, out, 0.0) == 5
    shutil.rmtree(tmp_path / "queue" / "version=1")
    assert {r.status for r in fetch.queue(spark, path).collect()} == {"waiting"}
    assert {r.status for r in fetch.fetched(spark, path, out).collect()} == {"done"} and set(server.asked.values()) == {1}


def test_a_request_waits_for_its_time(spark, tmp_path, server):
    path = str(tmp_path / "queue")
    assert fetch.queue(spark, path).count() == 0 and fetch.round_of(spark, path, str(tmp_path), 0.0) == 0
    fetch.added(spark.createDataFrame([(f"{server.url}/never", "n")], "url string, name string"), path)
    for now, tried in ((100.0, 1), (105.0, 0), (110.0, 1), (129.0, 0), (130.0, 1)):
        assert fetch.round_of(spark, path, str(tmp_path / "o"), now, attempts=9, pause=10.0) == tried
    assert fetch.queue(spark, path).first().due == 170.0
