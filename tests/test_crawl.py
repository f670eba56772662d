"""Facts about crawling, robots, sitemaps, policies and state machines on small data."""

import gzip
import http.server
import threading

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from harrow.functions import policy, text, urls
from harrow.operators import fetch, frontier, html, robots, stats
from harrow.streaming import limits, progress

GRAPH = {
    "/": ["/site/a", "/site/b", "/private/x", "/site/a"], "/site/a": ["/site/a/deep", "/site/b", "/"], "/site/b": ["/site/c", "http://other.test/"],
    "/site/a/deep": ["/site/a/deeper"], "/site/a/deeper": [], "/private/x": ["/private/y"], "/private/y": [],
}
HOST = "http://h.test"


def corpus(spark):
    absolute = lambda u: u if u.startswith("http") else HOST + u
    return spark.createDataFrame([(HOST + k, [absolute(x) for x in v]) for k, v in GRAPH.items()], "url string, links array<string>")


def crawled(spark, **more):
    start = spark.createDataFrame([(HOST + "/", 0)], "url string, seq long")
    pages, seen = frontier.crawl(start, frontier.corpus_fetch(corpus(spark)), same_domain_only=more.pop("same", True), **more)
    return {r["url"].removeprefix(HOST): r for r in pages.collect()}, seen


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_breadth_first_depths_and_filters(spark):
    pages, seen = crawled(spark, max_depth=10)
    assert {u: r["depth"] for u, r in pages.items()} == {"/": 0, "/site/a": 1, "/site/b": 1, "/private/x": 1, "/site/a/deep": 2, "/site/c": 2, "/private/y": 2, "/site/a/deeper": 3}
    assert pages["/site/c"]["error"] == "PermanentError" and sum(r["error"] is None for r in pages.values()) == 7
    assert seen.count() == 8 and seen.agg(F.sum("duplicates")).first()[0] == 1
    assert set(crawled(spark, max_depth=1)[0]) == {"/", "/site/a", "/site/b", "/private/x"}
    assert not any("private" in u for u in crawled(spark, max_depth=10, exclude=["/private"])[0])
    assert set(crawled(spark, max_depth=10, include=["/site/a"])[0]) == {"/", "/site/a", "/site/a/deep", "/site/a/deeper"}
    assert "http://other.test/" in crawled(spark, max_depth=3, same=False)[0]


def test_page_budget_counts_started_pages(spark):
    pages, seen = crawled(spark, max_pages=4, max_depth=10)
    assert list(pages) and len(pages) == 4 and {r["state"] for r in seen.collect()} <= {"fetched", "over_limit"}


def test_blocked_urls_do_not_count(spark):
    block = lambda rows: rows.withColumn("allowed", ~F.col("url").contains("/private"))
    pages, seen = crawled(spark, max_pages=6, max_depth=10, allow=block)
    assert len(pages) == 6 and seen.filter("state = 'blocked'").count() == 1
    assert stats.queue_stats(seen).first().asDict() == {"queued": 0, "processed": 6, "failed": 0, "skipped": 1, "seen": 7, "duplicates": 1}


@pytest.mark.parametrize(
    ("url", "want"),
    [("HTTP://Ex.Test", "http://ex.test/"), ("http://ex.test/A?B=1#c", "http://ex.test/A?B=1"), ("http://ex.test/?", "http://ex.test/"), ("http://u@Ex.test:8080/p;x=1#", "http://u@ex.test:8080/p;x=1")],
)
def test_normalized_urls(spark, url, want):
    assert one(spark, n=urls.normalize(F.lit(url)))["n"] == want


def test_links_of_a_page():
    base = "http://h.test/a/b/c.html"
    hrefs = ["/root", "rel", "../up", "../../top", "//cdn.test/x", "?q=1", "rel#part", "#here", "mailto:a@b.c", "javascript:void(0)", "tel:1", " /root ", "http://[broken", "ftp://x.test/f"]
    got = html.parse_page(base, "".join(f'<a href="{h}">x</a>' for h in hrefs))["links"]
    assert got == ["http://h.test/root", "http://h.test/a/b/rel", "http://h.test/a/up", "http://h.test/top", "http://cdn.test/x", "http://h.test/a/b/c.html?q=1"]


def test_broken_page_still_parses():
    got = html.parse_page("http://h.test/", "<html><body><h1>Title<p>text<a href=/x>l</a><table><tr><td>1<td>2<tr><td>3</table><ul><li>a<li>b</ul>")
    assert got["headings"]["h1"] == ["Title"] and got["links"] == ["http://h.test/x"]
    assert got["tables"] == [[["1", "2"], ["3"]]] and got["lists"] == [["a", "b"]] and got["parse_errors"] == []


def test_fields_of_a_valid_page(spark):
    page = """<html><head><title> A |
      B </title><meta name="description" content=" d "><meta name="keywords" content="k"><style>s{}</style></head><body><h2>x <b>y</b></h2>
      <script>no()</script><!-- no --><img src="i.png" alt=" z "><img src=""><div class="c main" id="m"><p>one</p><p>two &amp; 2</p></div><ol><li>1<ul><li>in</li></ul></li></ol></body></html>"""
    row = html.parse_html(spark.createDataFrame([("http://h.test/d/", page), ("http://h.test/e", None)], "url string, html string")).orderBy("url").collect()
    r = row[0]
    assert r["title"] == "A | B" and r["metadata"].asDict() == {"title": "A | B", "description": "d", "keywords": "k"}
    assert [i.asDict() for i in r["images"]] == [{"src": "http://h.test/d/i.png", "alt": "z"}]
    assert "no" not in r["text"] and r["text"].endswith("one two & 2 1 in") and r["headings"]["h2"] == ["xy"]
    assert r["lists"] == [["1in"], ["in"]] and row[1]["text"] == "" and row[1]["links"] == []
    assert [x["text"] for x in html.select_text(spark.createDataFrame([("u", page)], "url string, html string"), "div.main p, #none").collect()] == ["one\ntwo & 2"]


def test_robots_matrix(spark):
    said = "User-agent: *\nDisallow: /private\nAllow: /private/open\nDisallow: /*.pdf$\nDisallow:\nCrawl-delay: 2\nUser-agent: Good\nUser-agent: better # both\nDisallow: /bots\nSitemap: http://h.test/s.xml\nDisallow: /more\n"
    rules = robots.parse_robots(spark.createDataFrame([("h.test", 200, said), ("gone.test", 404, None), ("down.test", 500, None), ("lost.test", None, None)], "domain string, status int, text string")).cache()

    def ask(agent, *paths):
        pages = spark.createDataFrame([(p if "://" in p else HOST + p,) for p in paths], "url string")
        got = {r["url"].removeprefix(HOST): r["allowed"] for r in robots.allowed(pages, rules, agent).collect()}
        return [got[p] for p in paths]

    assert ask("any", "/", "/private", "/private/open/x", "/a.pdf", "/a.pdf?x", "/robots.txt", "/bots") == [True, False, True, False, True, True, True]
    assert ask("Goodbot/1", "/private", "/bots/x", "/more") == [True, False, False]
    assert ask("any", "http://gone.test/x", "http://down.test/x", "http://lost.test/x", "http://new.test/x") == [True, False, False, True]
    delays = lambda a: {r["domain"]: r["crawl_delay"] for r in robots.crawl_delays(rules, a).collect()}
    assert delays("any")["h.test"] == 2.0 and delays("goodbot")["h.test"] == 0.0
    sites = spark.createDataFrame([("h.test", "http"), ("x.test", "https")], "domain string, scheme string")
    assert {r["sitemap"] for r in robots.sitemaps_of(sites, rules).collect()} == {"http://h.test/s.xml", "https://x.test/sitemap.xml"}


def test_many_rules_of_a_domain_equal_the_rules_one_by_one(spark, monkeypatch):
    """A thousand rules of one domain, by prefixes and by trying every rule; another domain has few."""
    import random

    rng = random.Random(8)
    part = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 3)))
    lines = [f"{rng.choice(['Allow', 'Disallow'])}: /{'/'.join(part() for _ in range(rng.randint(1, 3)))}{rng.choice(['', '', '', '$', '*', '*b$', '/*/a', '$x'])}" for _ in range(1000)]
    said = "User-agent: *\n" + "\n".join([*lines, "Allow: *aab", "Disallow: /"])
    rules = robots.parse_robots(spark.createDataFrame([("big.test", 200, said), ("small.test", 200, "User-agent: *\nDisallow: /a\n")], "domain string, status int, text string")).cache()
    pages = spark.createDataFrame([(k, f"http://{rng.choice(['big', 'small', 'other'])}.test/{'/'.join(part() for _ in range(rng.randint(1, 4)))}{rng.choice(['', '$x', '?q=aab', ';p'])}") for k in range(600)] + [(900, "http://big.test"), (901, "http://big.test/robots.txt")], "k long, url string")
    got = {r["k"]: r["allowed"] for r in robots.allowed(pages, rules).collect()}
    monkeypatch.setattr(robots, "FEW_RULES", 10_000)
    want = {r["k"]: r["allowed"] for r in robots.allowed(pages, rules).collect()}
    assert len(got) == 602 and got == want and 20 < sum(got.values()) < 580 and got[901] and not got[900]


def test_last_delay_line_counts_wherever_its_row_lies(spark):
    said = "User-agent: *\nCrawl-delay: 9\nDisallow: /x\nCrawl-delay: 2\nUser-agent: good\nCrawl-delay: 1\nCrawl-delay: bad\nCrawl-delay: 4\n"
    rules = robots.parse_robots(spark.createDataFrame([("h.test", 200, said)], "domain string, status int, text string"))
    for n in range(1, 5):
        for order in (F.desc("line"), F.asc("line")):
            dealt = rules.repartition(n, "crawl_delay", "line").sortWithinPartitions(order)
            assert [robots.crawl_delays(dealt, a).first()["crawl_delay"] for a in ("any", "goodbot")] == [2.0, 4.0]


def test_links_of_any_form_equal_those_of_the_parser(spark):
    anchors = ['<a href="/root">', "<a href='../x'>", "<a href=bare>", '<a href="rel">', '<a href="//cdn.test/y">', '<a class="b" href="?q=1">', '<a HREF = "/spaced">', '<a href="/a/../b">', '<a href="/caf&eacute;">', '<a href="/and&amp;">', '<a href="#x">', '<a href="">', '<a href="mailto:a@b">', '<a data-href="/no" href="/yes">', '<a href="http://o.test/p#f">', "<a name=x>", '<a href=" /pad ">', "<b>"]
    pages = [(k, "http://h.test/d/e/f", f"<p>{a}t</a>") for k, a in enumerate(anchors)] + [(99, "http://h.test/d/e/f", "".join(anchors)), (100, "http://h.test/", None), (101, None, '<a href="/x">')]
    got = {r["k"]: r["links"] for r in html.with_links(spark.createDataFrame(pages, "k long, url string, html string")).collect()}
    assert len(got) == len(pages) and got[100] == []
    for k, url, page in pages:
        if url and page:
            assert got[k] == html.parse_page(url, page)["links"], (k, page)


@pytest.mark.parametrize(
    ("selector", "want"),
    [
        ("ul > li", "abcd"), ("ul li", "abcd"), ("li + li", "bcd"), ("li.on ~ li", "cd"), ("li:first-child", "ax"), ("ul > li:last-child", "d"), ("ul > li:nth-child(2n+1)", "ac"), ("ul > li:nth-child(even)", "bd"), ("ul > li:nth-child(-n+2)", "ab"),
        ("ul > li:nth-last-child(2)", "c"), ("li[data-k]", "bc"), ('li[data-k="v w"]', "b"), ("li[data-k~=w]", "b"), ("li[data-k^='v']", "bc"), ("li[data-k$=W i]", "b"), ("li[data-k*=-]", "c"), ("li[data-k|=v]", "c"), ("#top > ul > li.on.two", "b"),
        ("li:not(.on):not(:last-child)", "acx"[:2]), ("ol li, ul>li:nth-child(1)", "ax"), ("div > li", ""), ("li:only-child", "x"), ("ol > *", "x"), ("nothing, li[data-k='v, w']", ""),
    ],
)
def test_selectors(selector, want):
    page = "<div id=top><ul><li>a<li class='on two' data-k='v w'>b<li data-k=v-u>c<li>d</ul></div><ol><li>x</li></ol>"
    assert [html.plain(n) for n in html.select(html.tree(page), selector)] == list(want)


@pytest.mark.parametrize("selector", ["", "a,", "a >", "> a", "a:hover", "a[", "li:nth-child(x)", "a..b", "::before"])
def test_selectors_that_are_not_known(selector):
    with pytest.raises(ValueError, match="selector not supported"):
        html.select(html.tree("<p>"), selector)


def test_sitemap_bodies():
    assert text.sitemap_locations(b"<urlset><url><loc> a </loc><x>1</x></url></urlset>") == ("urlset", ["a"], None)
    assert text.sitemap_locations(gzip.compress(b"<sitemapindex><sitemap><loc>b</loc></sitemap></sitemapindex>"))[:2] == ("sitemapindex", ["b"])
    assert text.sitemap_locations(b"<urlset>")[2] and text.sitemap_locations(None)[2] and text.sitemap_locations(b"\x1f\x8bxx")[2]


def test_large_sitemap_is_never_a_tree():
    import tracemalloc

    def body(n):
        return b"<urlset xmlns='x'>" + b"".join(b"<url><loc>http://h.test/%d</loc><lastmod>2024-01-01</lastmod><changefreq>daily</changefreq></url>\n" % k for k in range(n)) + b"</urlset>"

    n = 100_000
    for data in (body(n), gzip.compress(body(n)), gzip.compress(b"<urlset>") + gzip.compress(b"<url><loc>http://h.test/0</loc></url></urlset>") + b"\0\0"):
        tracemalloc.start()
        kind, found, error = text.sitemap_locations(data)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert (kind, error, found[0]) == ("urlset", None, "http://h.test/0") and len(found) in (1, n)
        assert peak < 2.5 * 100 * len(found) + 3_000_000 + len(data)  # the locations and a few pieces
    assert text.sitemap_locations(gzip.compress(body(1000))[:-30])[1:] == ([], "empty or broken body")
    assert text.sitemap_locations(body(1000)[:-40])[1] == [] and "ParseError" in text.sitemap_locations(body(1000)[:-40])[2]
    assert "unknown root" in text.sitemap_locations(b"<html><url><loc>a</loc></url></html>")[2]


def test_policies(spark):
    p = policy.RetryPolicy()
    rows = spark.createDataFrame([(200,), (404,), (408,), (429,), (500,), (503,), (None,)], "status int").withColumn("error", policy.classify_status(F.col("status")))
    got = [(r["error"], r["again"], r["n"]) for r in rows.select("error", policy.should_retry(F.col("error"), p).alias("again"), policy.max_retries_for(F.col("error"), F.col("status"), p).alias("n")).collect()]
    assert got == [(None, False, 3), ("PermanentError", False, 3), ("TransientError", True, 3), ("RateLimitedError", True, 3), ("TransientError", True, 1), ("TransientError", True, 3), ("NetworkError", True, 2)]
    d = one(spark, a=policy.backoff_delay(F.lit(3), p), b=policy.backoff_delay(F.lit(1), p, F.lit("RateLimitedError"), F.lit(7.0)), c=policy.backoff_delay(F.lit(1), p, F.lit("RateLimitedError"), F.lit(700.0)))
    assert tuple(d) == (2.0, 7.0, 30.0)
    assert [p.delay(n, e, a) for n, e, a in ((1, "NetworkError", None), (2, "RateLimitedError", None), (1, "RateLimitedError", 7.0), (3, "TransientError", None), (9, "TransientError", None))] == [1.0, 4.0, 7.0, 2.0, 30.0]
    general = policy.RetryPolicy(retry_on=("TransientError",), max_by_type={"TransientError": 1}, delay_by_type={"CrawlerError": 4.0})
    assert set(general.retried) == {"TransientError", "RateLimitedError"} and general.retries("RateLimitedError", 429) == 1 and general.delay(1, "ParseError") == 4.0
    g = rows.select("status", policy.should_retry(F.col("error"), general).alias("again"), policy.max_retries_for(F.col("error"), F.col("status"), general).alias("n"), policy.backoff_delay(F.lit(1), general, F.col("error")).alias("d")).filter("status = 429").first()
    assert (g["again"], g["n"], g["d"]) == (True, 1, 4.0)
    r = one(spark, a=policy.parse_retry_after(F.lit("5")), b=policy.parse_retry_after(F.lit("-1")), c=policy.parse_retry_after(F.lit("nan")), d=policy.parse_retry_after(F.lit("Wed, 21 Oct 2015")))
    assert tuple(r) == (5.0, 0.0, 0.0, None)


def test_formats(spark):
    r = one(spark, a=text.format_int(F.lit(1234567)), b=text.nice_step(F.lit(37.0)), c=text.format_duration(F.lit(3725)), d=text.format_duration(F.lit(65)), e=text.format_seconds(F.lit(90)))
    assert tuple(r) == ("1 234 567", 50, "1:02:05", "1:05", "1 min 30 s")
    e = progress.estimate(30, 50, 5, 10.0, 60)
    assert (e["percent"], e["speed"], e["eta"]) == (50.0, 3.0, 10.0) and "30/60 50% 3.0/s 0:10" in progress.line(30, e)


def test_listener_feeds_the_reporter():
    import io
    from types import SimpleNamespace

    out = io.StringIO()
    out.isatty = lambda: False
    listener = progress.ProgressListener(progress.Reporter(20, 0.0, out))
    for n in (4, 6):
        listener.onQueryProgress(SimpleNamespace(progress=SimpleNamespace(numInputRows=n)))
    listener.onQueryTerminated(None)
    lines = out.getvalue().splitlines()
    assert " 4/4 " in lines[0] and " 10/10 " in lines[-1]


def test_statistics_of_six_rows(spark):
    rows = [(0.5, "http://a.test/1", 200, None, 0, "abcd"), (0.9, "http://a.test/2", 200, None, 1, "ab"), (1.2, "http://b.test/1", 404, "PermanentError", 1, None), (2.5, "http://b.test/2", 200, None, 1, "abc"), (3.1, "http://a.test/3", None, "NetworkError", 2, None), (4.0, "http://c.test/1", 200, None, 2, "abc")]
    log = spark.createDataFrame(rows, "t double, url string, status int, error string, depth int, text string")
    t = stats.totals(log, 4.0).first()
    assert (t["successful"], t["failed"], t["pages_per_second"], round(t["success_rate"], 1), t["avg_text_chars"]) == (4, 2, 1.5, 66.7, 3.0)
    bins = stats.timeline(log, 4.0).orderBy("bin").collect()
    assert [r["pages"] for r in bins] == [2, 1, 1, 2] and [r["failed"] for r in bins] == [0, 1, 0, 1]
    assert [r["domain"] for r in stats.top_domains(log, 2).collect()] == ["a.test", "b.test"]
    assert [r["status"] for r in stats.status_histogram(log).orderBy(*stats.status_order()).collect()] == ["200", "404", "no response"]


def test_retry_statistics(spark):
    rows = [("a", 1, "TransientError", 0.1), ("a", 2, None, None), ("b", 1, "TransientError", 0.1), ("b", 2, "TransientError", None), ("c", 1, "PermanentError", None), ("d", 1, None, None)]
    log = spark.createDataFrame(rows, "url string, attempt long, error string, delay double")
    assert stats.retry_stats(log).first() == Row(retries=2, recovered=1, exhausted=1, avg_delay=0.1)
    assert {r["error"]: r["attempts"] for r in stats.attempt_errors(log).collect()} == {"TransientError": 3, "PermanentError": 1}


def test_limiter_and_breaker(spark):
    m = limits.Limiter(0.0, 0.2)
    assert [m.step(0, o)[2] for o in (False, False, None, False, True, True)] == [0.2, 0.4, 0.4, 0.8, 0.0, 0.0]
    b = limits.Breaker(3, 0.5)
    assert [b.step(t, o)[0] for t, o in ((0, False), (0.1, False), (0.2, False), (0.3, True), (0.8, True), (0.9, False))] == [True, True, True, False, True, True]
    assert (b.times_opened, b.rejected, b.is_open) == (1, 1, 0)
    strict, fixed = limits.Breaker(1, 1.0, strict=True), limits.Breaker(1, 1.0)
    for x in (strict, fixed):
        x.step(0, False), x.step(2, None)
    assert not strict.step(9, True)[0] and fixed.step(9, True)[0]


def test_streams_agree_with_batch(spark, tmp_path):
    rows = [(f"d{i % 3}", i, i * 0.7, None if i % 7 == 0 else i % 4 != 0) for i in range(90)]
    log = spark.createDataFrame(rows, "domain string, id long, t double, outcome boolean")
    for k in range(3):
        log.filter(f"id >= {30 * k} and id < {30 * k + 30}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    import os
    import time

    for k, f in enumerate(sorted((p for p in os.listdir(tmp_path / "in") if p.endswith(".parquet")), key=lambda p: spark.read.parquet(f"{tmp_path}/in/{p}").agg(F.min("id")).first()[0])):
        os.utime(tmp_path / "in" / f, (time.time() - 100 + k, time.time() - 100 + k))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for name, live, batch in (("lim", limits.stream_limiter(stream, 1.0, 0.5), limits.limiter_trace(log, 1.0, 0.5)), ("brk", limits.stream_breaker(stream, 2, 3.0), limits.breaker_trace(log, 2, 3.0))):
        q = live.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.awaitTermination(120)
        assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, batch.collect()))


def test_stream_of_unseen_urls(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for _ in range(2):
            spark.range(40).selectExpr("concat('u', id % 15) as url").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("url string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = limits.stream_unseen(stream).writeStream.format("memory").queryName("unseen").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
        q.awaitTermination(120)
        assert sorted(r["url"] for r in spark.table("unseen").collect()) == sorted(f"u{i}" for i in range(15))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


class Clock:
    def __init__(self):
        self.now = 0.0

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.now += s


def outcomes(*answers):
    it = iter(answers)

    def get(url, agent, timeout):
        x = next(it)
        if isinstance(x, Exception):
            raise x
        return x if isinstance(x, tuple) else (x, "text/html", b"ok", None)

    return get


def run_one(*answers, **more):
    clock = Clock()
    o = fetch.FetchOptions(retry=policy.RetryPolicy(base_delay=0.1, delay_by_type={}), **more)
    import itertools

    return fetch.fetch_one("http://h.test/", itertools.cycle(["a"]), fetch.Domain(o, "h.test", clock), o, outcomes(*answers), clock.sleep), clock


def test_retries_of_one_url():
    r, clock = run_one(503, 503, 200)
    assert r["error"] is None and [a["delay"] for a in r["attempts"]] == [0.1, 0.2, 0.0] and abs(clock.now - 0.3) < 1e-9
    assert len(run_one(500, 500)[0]["attempts"]) == 2 and len(run_one(404)[0]["attempts"]) == 1
    assert [a["error"] for a in run_one(*[ConnectionResetError()] * 3)[0]["attempts"]] == ["NetworkError"] * 3
    assert run_one((429, None, b"", "3"), 200)[0]["attempts"][0]["delay"] == 3.0
    r, _ = run_one(503, 503, failure_threshold=2, recovery_timeout=30)
    assert r["error"] == policy.BREAKER and [a["error"] for a in r["attempts"]] == ["TransientError", "TransientError", policy.BREAKER]


def test_what_counts_as_a_failure_of_a_domain():
    def opened(threshold, *answers):
        clock = Clock()
        o = fetch.FetchOptions(retry=None, failure_threshold=threshold, recovery_timeout=30)
        d = fetch.Domain(o, "h.test", clock)
        got = [fetch.fetch_one("http://h.test/", iter(["a"]), d, o, outcomes(x), clock.sleep)["error"] for x in answers]
        return got.count(policy.BREAKER), d.state()["times_opened"]

    assert opened(2, 503, 404, 503, 200) == (1, 1)  # 404 is neither success nor failure
    assert opened(5, 429, 429, 429, 429, 429, 200) == (1, 1)
    assert opened(2, 503, 200, 503, 200) == (0, 0)
    assert opened(2, 404, 403, 404, 200) == (0, 0)


def test_backoff_of_a_domain():
    clock = Clock()
    o = fetch.FetchOptions(retry=None, rate=policy.RatePolicy(error_backoff=0.2))
    d = fetch.Domain(o, "h.test", clock)
    waits = [fetch.fetch_one("http://h.test/", iter(["a"]), d, o, outcomes(x), clock.sleep)["wait"] for x in (500, 500, 404, 500, 200, 200)]
    assert [round(w, 6) for w in waits] == [0.0, 0.2, 0.4, 0.0, 0.8, 0.0]


def test_bodies_are_decoded_as_they_say():
    assert fetch.decode("é".encode("latin-1"), "text/html; charset=ISO-8859-1") == "é"
    assert fetch.decode('<meta charset="windows-1251">Ж'.encode("cp1251")) == '<meta charset="windows-1251">Ж'
    assert fetch.decode("é".encode("utf-16")) == "é" and fetch.decode(b"\xef\xbb\xbfa") == "a"
    assert fetch.decode(b"a\xe9b") == "a\ufffdb" and fetch.decode("é".encode(), "text/html; charset=no-such") == "é" and fetch.decode(None) is None


def test_requests_at_once_keep_to_their_limits(spark):
    """Thirty requests of three domains at 0.05 s each: in parallel, two of a domain at most."""
    wanted = spark.createDataFrame([(f"http://d{k % 3}.test/{k}",) for k in range(30)], "url string")

    def slow(url, agent, timeout):
        import time

        time.sleep(0.05)
        return 200, "text/html", b"ok", None

    rows = fetch.fetch(wanted, fetch.FetchOptions(max_concurrent=8, max_per_domain=2), get=slow).cache()
    assert rows.filter("error is null").count() == 30
    peaks = {r["domain"]: r["peak"] for r in stats.peak_concurrency(rows, "domain", "began", "ended").collect()}
    assert len(peaks) == 3 and max(peaks.values()) == 2
    total = rows.agg(F.max("ended") - F.min("began")).first()[0]
    assert total < 30 * 0.05


def test_state_of_a_domain_lasts(spark):
    wanted = spark.createDataFrame([("http://a.test/1",), ("http://b.test/1",)], "url string")
    down = lambda url, agent, timeout: (503 if "a.test" in url else 200, None, b"", None)
    o = fetch.FetchOptions(retry=None, failure_threshold=1, recovery_timeout=1000)
    first = fetch.fetch(wanted, o, get=down).cache()
    states = fetch.latest_states(first)
    later = fetch.fetch(spark.createDataFrame([("http://a.test/2",), ("http://b.test/2",)], "url string"), o, get=down, states=states).cache()
    assert {r["domain"]: r["error"] for r in later.collect()} == {"a.test": policy.BREAKER, "b.test": None}
    end = fetch.breaker_stats(fetch.latest_states(later, states)).first()
    assert (end["times_opened"], end["rejected"], end["open_domains"]) == (1, 1, ["a.test"])


def test_windows_agree_with_one_pass_over_each_key(spark):
    """Rows of several days, days without rows, ties, a null key."""
    import datetime
    import random

    rng = random.Random(5)
    start = datetime.datetime(2024, 1, 1)
    rows = [(rng.choice(["a", "b", None]), i, start + datetime.timedelta(seconds=rng.choice([0, 3, 86398, 86401, 3 * 86400, 9 * 86400]) + rng.randrange(5)), rng.random() < 0.3) for i in range(400)]
    log = spark.createDataFrame(rows, "domain string, id long, ts timestamp, ok boolean").withColumn("t", F.col("ts").cast("double"))
    got = {name: {r["id"]: r[c] for r in f(log).collect()} for name, c, f in (("gap", "gap", stats.request_gaps), ("recent", "recent", stats.trailing_count), ("streak", "streak", stats.failure_streak), ("start", "start", lambda x: stats.rate_schedule(x, 7.0)))}
    for key in ("a", "b", None):
        mine = sorted((ts.timestamp(), i, ok) for k, i, ts, ok in rows if k == key)
        before, streak, free = None, 0, float("-inf")
        for t, i, ok in mine:
            streak = 0 if ok else streak + 1
            begin = max(t, free)
            assert got["gap"][i] == (None if before is None else t - before)
            assert got["recent"][i] == sum(t - 5 <= u <= t for u, _, _ in mine)
            assert got["streak"][i] == streak and abs(got["start"][i] - begin) < 1e-6
            before, free = t, begin + 7.0


def test_parsing_keeps_rows_and_columns(spark):
    pages = spark.createDataFrame([(1, "http://h.test/", "<title>a</title>", 7), (2, "http://h.test/", "<title>b</title>", 8), (3, None, None, None)], "page_id int, url string, html string, text int")
    got = html.parse_html(pages, ("metadata", "text")).orderBy("page_id").collect()
    assert [(r["page_id"], r["url"], r["title"], r["text"]) for r in got] == [(1, "http://h.test/", "a", "a"), (2, "http://h.test/", "b", "b"), (3, None, "", "")]
    own = lambda url, page, fields, same_domain: {"text": page.upper() if page else "", "parse_errors": []}
    assert [r["text"] for r in html.parse_html(pages, ("text",), parser=own).orderBy("page_id").collect()] == ["<TITLE>A</TITLE>", "<TITLE>B</TITLE>", ""]


class Server(http.server.BaseHTTPRequestHandler):
    hits: list = []

    def do_GET(self):
        self.hits.append(self.path)
        host = f"http://127.0.0.1:{self.server.server_port}"
        pages = {
            "/robots.txt": "User-agent: *\nDisallow: /private\n", "/": '<title>home</title><a href="/a">a</a><a href="/private/x">p</a><a href="/missing">m</a>',
            "/a": '<title>A</title><a href="/">home</a><a href="/b#x">b</a>', "/b": "<title>B é</title>", "/map.xml": f"<urlset><url><loc>{host}/b</loc></url></urlset>",
        }
        body = pages.get(self.path, "").encode("latin-1")
        self.send_response(200 if self.path in pages else 404)
        self.send_header("Content-Type", "text/html; charset=iso-8859-1")
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


@pytest.fixture
def site():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    Server.hits.clear()
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_crawl_over_http(spark, site, tmp_path):
    from harrow.cli import main
    from harrow.config import from_dict
    from harrow.engine import CrawlEngine
    from harrow.sources import records

    config = from_dict({"start_urls": [site + "/"], "crawler": {"respect_robots": True}, "storage": {"type": "jsonl", "path": f"{tmp_path}/out.jsonl"}, "output": {"html_report": f"{tmp_path}/r.html"}, "progress": {"enabled": False}})
    engine = CrawlEngine(spark, config)
    assert {r["title"] for r in engine.crawl().collect()} == {"home", "A", "B é"}
    engine.close()
    s = engine.get_stats()
    assert (s["totals"]["successful"], s["totals"]["failed"], s["queue"]["skipped"], s["storage"]["saved"]) == (3, 1, 1, 3)
    assert (s["queue"]["processed"], s["queue"]["failed"], s["peaks"]["total"] >= 1, s["breaker"]["times_opened"], s["partial_parses"]) == (3, 1, True, 0, 0)
    assert [(e["error"], e["status"], e["attempts"]) for e in s["errors_of"]] == [("PermanentError", 404, 1)] and s["rates"][0]["total"] == 4
    times = [r["t"] for r in engine.pages.collect()]
    assert len(set(times)) == 4 and min(times) >= 0
    assert "/private/x" not in Server.hits and Server.hits.count("/robots.txt") == 1 and len(Server.hits) == len(set(Server.hits))
    assert records.read_json(spark, f"{tmp_path}/out.jsonl").count() == 3 and "<svg" in (tmp_path / "r.html").read_text()
    assert main(["--sitemap", site + "/map.xml", "--max-depth", "0", "--no-progress", "--output", f"{tmp_path}/p.db"], spark) == 0
    from harrow.sources import sqlite

    assert [r["title"] for r in sqlite.read_sqlite(spark, f"{tmp_path}/p.db").collect()] == ["B é"]
