"""The HTTP data source against servers on this machine."""

import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from harrow.functions import policy
from harrow.operators import fetch
from harrow.sources import http


@pytest.fixture
def server():
    """(port, requests): the paths in the order in which they were asked for."""
    asked, lock = [], threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            with lock:
                asked.append((self.headers["Host"].split(":")[0], self.path))
            status = 404 if self.path.endswith("/none") else 200
            body = f"<title>{self.path}</title>".encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    s.daemon_threads = True
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s.server_address[1], asked
    s.shutdown()


def test_reader_fetches_what_is_wanted_and_filters_are_pushed(spark, server, tmp_path):
    port, asked = server
    pages = [(f"http://127.0.0.1:{port}/{k}", k) for k in range(20)] + [(f"http://localhost:{port}/{k}", 30 - k) for k in range(10)] + [(f"http://127.0.0.1:{port}/none", 99), (f"http://127.0.0.1:{port}/3", 7)]
    http.deal(spark.createDataFrame(pages, "url string, rank long").repartition(3), str(tmp_path / "w"))
    http.register(spark, fetch.FetchOptions(retry=None, max_concurrent=4))
    read = spark.read.format("harrow_http").option("path", str(tmp_path / "w")).option("tasks", 3).load()
    got = {r["url"]: r for r in read.collect()}
    assert sorted(got) == sorted({u for u, _ in pages}) and len(asked) == 31
    assert got[f"http://localhost:{port}/4"]["html"] == "<title>/4</title>" and got[f"http://127.0.0.1:{port}/none"]["error"] == policy.PERMANENT
    assert got[f"http://127.0.0.1:{port}/0"]["attempts"][0]["status"] == 200 and got[f"http://127.0.0.1:{port}/0"]["domain"] == f"127.0.0.1:{port}"

    asked.clear()
    one = read.filter(F.col("domain") == f"localhost:{port}").select("url")
    analyzed, physical = one._jdf.queryExecution().toString().split("== Physical Plan ==")
    assert f"= localhost:{port}" in analyzed and f"= localhost:{port}" not in physical  # the source has taken it
    assert one.count() == 10 and {host for host, _ in asked} == {"localhost"}
    asked.clear()
    assert read.filter(F.col("url").isin(f"http://localhost:{port}/4", f"http://127.0.0.1:{port}/4")).filter("status = 200").count() == 2
    assert sorted(asked) == [("127.0.0.1", "/4"), ("localhost", "/4")]


def test_urls_of_a_domain_start_in_the_order_of_their_ranks(spark, server, tmp_path):
    port, asked = server
    pages = [(f"http://{host}:{port}/{(k * 7) % 25}", k) for k in range(25) for host in ("127.0.0.1", "localhost")]
    wanted = spark.createDataFrame(pages, "url string, rank long").repartition(4)
    options = fetch.FetchOptions(retry=None, max_concurrent=4, max_per_domain=1)
    http.deal(wanted, str(tmp_path / "w"))
    http.register(spark, options)
    for read in (spark.read.format("harrow_http").option("path", str(tmp_path / "w")).load(), fetch.fetch(wanted, options)):
        asked.clear()
        assert read.count() == 50
        for host in ("127.0.0.1", "localhost"):
            assert [path for h, path in asked if h == host] == [f"/{(k * 7) % 25}" for k in range(25)]


def test_folders_are_dealt_by_size(spark, tmp_path):
    pages = [(f"http://big.test/{k}-{'x' * 40}", k) for k in range(3000)] + [(f"http://d{j}.test/{k}", k) for j in range(30) for k in range(20)]
    http.deal(spark.createDataFrame(pages, "url string, rank long"), str(tmp_path / "w"), folders=64)
    reader = http._Reader(str(tmp_path / "w"), 4, fetch.FetchOptions(), None)
    shares = reader.partitions()
    big = [x for x in shares if any(http._number("big.test", f) for f in x.folders)]
    folders = [f for x in shares for f in x.folders]
    assert len(shares) == 4 and len(set(folders)) == len(folders) and len(big) == 1
    assert len(big[0].folders) < min(len(x.folders) for x in shares if x is not big[0])
    list(reader.pushFilters([]))
    reader.domains = {"d3.test"}
    assert [len(x.folders) for x in reader.partitions()] == [1]
    reader.domains = {"d3.test", "nowhere.test"} & {"nowhere.test"}
    assert sum(len(x.folders) for x in reader.partitions()) <= 1
    http.deal(spark.createDataFrame([], "url string, rank long"), str(tmp_path / "e"))
    http.register(spark)
    assert spark.read.format("harrow_http").option("path", str(tmp_path / "e")).load().count() == 0


def test_a_slow_domain_does_not_hold_up_the_others():
    """Order of starts in one task: 2 of a domain at most, ranks kept inside it."""
    started, lock = [], threading.Lock()

    def one(name, url):
        with lock:
            started.append(url)
        time.sleep(0.05 if name == "slow" else 0.001)
        return {"url": url}

    rows = [("slow", f"s{k}") for k in range(6)] + [("quick", f"q{k}") for k in range(40)]
    got = [r["url"] for r in fetch._in_turn(iter(rows), 4, 2, one)]
    assert sorted(got) == sorted(u for _, u in rows)
    for name in "sq":  # two threads may change places
        assert all(abs(int(u[1:]) - k) <= 2 for k, u in enumerate(u for u in started if u[0] == name))
    assert started.index("q20") < started.index("s4")
