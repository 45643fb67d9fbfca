"""The paged source against a small backend: batch, pushed filters, failures, and a stream that reads the same rows."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

import pytest

from wavemesh.sources import paged

SCHEMA = "id long, heard_ms long, role string, snr double, path array<string>, extra string"


class Backend:
    """Rows behind a server on this machine; `failing` answers of a page fail before one succeeds."""

    def __init__(self, rows, failing=0):
        self.rows, self.seen, self.failing = rows, [], failing
        outer, failed = self, Counter()

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                about = dict(parse_qsl(urlsplit(self.path).query))
                outer.seen.append(about)
                if about.get("offset") == "7" and failed["7"] < outer.failing:
                    failed["7"] += 1
                    return self.send_error(503)
                found = [r for r in sorted(outer.rows, key=lambda r: r["heard_ms"]) if int(about.get("since", 0)) <= r["heard_ms"] <= int(about.get("until", 10**15)) and about.get("role", r["role"]) == r["role"]]
                at = int(about["offset"])
                body = json.dumps({"items": found[at : at + int(about["limit"])], "total": len(found)}).encode()
                self.send_response(200)
                self.end_headers()
                return self.wfile.write(body)

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}/packets"


def row(i):
    return {"id": i, "heard_ms": 1000 + i * 10, "role": "repeater" if i % 3 else "sensor", "snr": i if i % 2 else None, "path": ["a", None] if i % 5 else "odd", "extra": {"k": i}}


@pytest.fixture
def backend():
    b = Backend([row(i) for i in range(30)])
    yield b
    b.server.shutdown()


def table(spark, backend, **options):
    paged.register(spark)
    return spark.read.format("mesh_pages").schema(SCHEMA).options(url=backend.url, page_size=7, **options).load()


def test_pages_are_partitions(spark, backend):
    df = table(spark, backend)
    rows = {r.id: r for r in df.collect()}
    assert sorted(rows) == list(range(30)) and df.rdd.getNumPartitions() == 5
    assert rows[1].snr == 1.0 and rows[2].snr is None and rows[1].path == ["a", None] and rows[5].path is None and rows[4].extra == '{"k": 4}'


def test_filters_go_to_the_backend(spark, backend):
    got = table(spark, backend).where("role = 'sensor' AND heard_ms >= 1100 AND heard_ms <= 1200 AND snr > 10").collect()
    assert sorted(r.id for r in got) == [15]
    assert {"role": "sensor", "since": "1100", "until": "1200", "limit": "7", "offset": "0"} in backend.seen
    assert not any(a["offset"] == "7" for a in backend.seen)


def test_failing_pages_are_tried_again(spark, backend):
    backend.failing = 2
    assert table(spark, backend).count() == 30
    assert sum(a["offset"] == "7" for a in backend.seen) == 3


def test_a_page_that_keeps_failing_fails(backend, monkeypatch):
    monkeypatch.setattr(paged, "PAUSE", 0.001)
    backend.failing = 99
    with pytest.raises(RuntimeError, match="failed 4 times"):
        paged.asked(backend.url, limit=7, offset=7)


def test_a_stream_reads_the_same_rows(spark, backend, tmp_path):
    paged.register(spark)
    later, backend.rows = backend.rows[18:], backend.rows[:18]

    def run():
        stream = spark.readStream.format("mesh_pages").schema(SCHEMA).options(url=backend.url, page_size=7).load()
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        assert q.awaitTermination(120) and q.exception() is None
        return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert [r[0] for r in run()] == list(range(18))
    backend.rows = backend.rows + later
    assert run() == sorted(tuple(r) for r in table(spark, backend).collect())
    assert len(run()) == 30  # nothing new, nothing twice
