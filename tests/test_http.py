"""Lookups against a server of this process that refuses some requests."""

import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from ledgerloom.sources import http
from ledgerloom.sources.merge import KeyedTable


@pytest.fixture
def server():
    log, lock, refuse = [], threading.Lock(), {}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            url = urllib.parse.urlparse(self.path)
            with lock:
                log.append(urllib.parse.unquote(self.path))
                for part, left in refuse.items():
                    if part in log[-1] and left:
                        refuse[part] -= 1
                        self.send_response(429)
                        self.end_headers()
                        return
            if url.path == "/works":
                dois = urllib.parse.parse_qs(url.query)["filter"][0].removeprefix("doi:").split("|")
                body = {"results": [{"doi": f"https://doi.org/{d.upper()}", "id": d} for d in dois if not d.endswith("7")]}
            elif url.path.startswith("/works/"):
                body = {"message": {"DOI": urllib.parse.unquote(url.path.removeprefix("/works/"))}}
            else:
                body = {"external-identifier": [url.path]}
            missing = url.path.endswith("missing")
            self.send_response(404 if missing else 200)
            self.end_headers()
            self.wfile.write(b"{}" if missing else json.dumps(body).encode())

        def log_message(self, *a):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_address[1]}", log, refuse
    s.shutdown()


def quick(_):
    pass


def test_services(server):
    base, log, refuse = server
    assert http.Service("openalex", base)(["10.1/a", "10.1/b7"]) == (200, {"10.1/a": {"doi": "https://doi.org/10.1/A", "id": "10.1/a"}})
    assert http.Service("crossref", base)(["10.1/a b"]) == (200, {"10.1/a b": {"DOI": "10.1/a b"}})
    assert http.Service("crossref", base)(["missing"]) == (404, {})
    assert http.Service("orcid", base)(["0000-1"])[1]["0000-1"]["external-identifier"] == ["/0000-1/external-identifiers"]
    assert http.Service("orcid", "http://127.0.0.1:9")(["x"]) == (0, {})
    refuse["10.1/slow"] = 2
    waits = []
    assert http.tried(http.Service("crossref", base), ["10.1/slow"], wait=waits.append)[::2] == (200, 3) and waits == [1.0, 2.0]


def test_fetch_all_stops_and_goes_on(spark, server, tmp_path):
    base, log, refuse = server
    store = KeyedTable(spark, f"{tmp_path}/answers", http.ANSWER, ["key"], 4)
    keys = spark.createDataFrame([(f"10.1/{k}",) for k in range(100)] + [(None,), ("10.1/3",)], "key string")
    refuse["10.1/25"] = 3
    rounds = []

    def two_rounds():
        rounds.append(1)
        return len(rounds) <= 2

    how = dict(lanes=2, size=10, rate=1000.0, round_keys=30, wait=quick)
    with pytest.raises(http.Cancelled):
        http.fetch_all(keys, http.Service("openalex", base), store, should_continue=two_rounds, **how)
    assert store.read().count() == 60
    before = len(log)
    assert http.fetch_all(keys, http.Service("openalex", base), store, **how) == 40
    later = [d for line in log[before:] for d in line.split("doi:")[1].split("&")[0].split("|")]
    assert len(later) == len(set(later)) == 40
    got = {r.key: (r.http, r.record and json.loads(r.record)["id"]) for r in store.read().collect()}
    assert got == {f"10.1/{k}": (200, None if k % 10 == 7 else f"10.1/{k}") for k in range(100)}
    assert http.fetch_all(keys, http.Service("openalex", base), store, **how) == 0


def test_refused_keys_are_left_for_later(spark, server, tmp_path):
    base, log, refuse = server
    store = KeyedTable(spark, f"{tmp_path}/answers", http.ANSWER, ["key"], 2)
    keys = spark.createDataFrame([("10.1/a",), ("10.1/busy",)], "key string")
    refuse["busy"] = 6
    how = dict(lanes=2, size=1, rate=1000.0, wait=quick)
    assert http.fetch_all(keys, http.Service("crossref", base), store, **how) == 2
    assert [r.key for r in store.read().collect()] == ["10.1/a"]
    assert http.fetch_all(keys, http.Service("crossref", base), store, **how) == 1
    assert store.read().count() == 2


def test_rate_is_shared(spark):
    """Each of the lanes waits as many times longer as there are lanes."""
    waits = spark.sparkContext.accumulator(0.0)
    http.ask(spark.createDataFrame([(str(k),) for k in range(40)], "key string"), lambda keys: (200, {}), lanes=4, size=5, rate=2.0, wait=lambda s: waits.add(s)).count()
    assert waits.value >= 8 * 4 / 2.0
