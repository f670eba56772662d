"""The crawl as one object: settings in, pages, statistics and reports out."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow import config as conf
from harrow import logs, report
from harrow.functions import policy, urls
from harrow.operators import fetch, frontier, html, robots, stats
from harrow.sources import sinks
from harrow.streaming.progress import Reporter


class CrawlEngine:
    """Crawls with a fetcher: HTTP, or any function of (url, agent, timeouts); and a parser, see ``html.parse_html``."""

    def __init__(self, spark: SparkSession, config: conf.Config, get: Callable = fetch.http_get, fields=tuple(html.FIELDS), on_page_done: Callable[[DataFrame], None] | None = None, parser: Callable = html.parse_page):
        if problems := conf.validate(config):
            raise conf.ConfigError("; ".join(problems))
        self.spark, self.config, self.get, self.fields, self.hook = spark, config, get, fields, on_page_done
        self.parser = parser
        c = config.crawler
        self.log = logs.setup(**vars(config.logging))
        self.agents = c.user_agents or [c.user_agent or "harrow/1.0"]
        self.sink = sinks.make_sink(config.storage.type, config.storage.path, config.storage.batch_size, config.storage.overwrite)
        r = config.retry
        self.options = fetch.FetchOptions(
            user_agents=self.agents, connect_timeout=c.connect_timeout, read_timeout=c.read_timeout, total_timeout=c.total_timeout, max_concurrent=c.max_concurrent, max_per_domain=c.max_per_domain,
            retry=policy.RetryPolicy(r.max_retries, r.backoff_factor, r.base_delay, r.max_delay) if r.enabled else None,
            rate=policy.RatePolicy(c.rate_limit, c.min_delay, c.jitter, c.error_backoff, per_domain=c.rate_per_domain),
            failure_threshold=config.circuit_breaker.failure_threshold if config.circuit_breaker.enabled else None, recovery_timeout=config.circuit_breaker.recovery_timeout,
        )
        self.rules = self.pages = self.seen = self.states = None
        self.run_id = 0

    #: Rows of each list that ``get_stats`` holds in memory; ``tables`` and the JSON file have them all.
    MOST = 1000

    @classmethod
    def from_config(cls, spark: SparkSession, path: str, **more) -> CrawlEngine:
        return cls(spark, conf.load(path), **more)

    def _robots(self, of: DataFrame) -> DataFrame:
        """Rules of the domains of ``of``, each fetched once in the life of the engine."""
        sites = of.select(urls.domain_of(F.col("url")).alias("domain"), urls.scheme_of(F.col("url")).alias("scheme")).dropDuplicates(["domain"])
        if self.rules is not None:
            sites = sites.join(self.rules.select("domain").distinct(), "domain", "left_anti")
        wanted = sites.select(F.concat("scheme", F.lit("://"), "domain", F.lit("/robots.txt")).alias("url"))
        plain = fetch.FetchOptions(self.agents, total_timeout=10.0, max_concurrent=self.options.max_concurrent)
        got = fetch.raw_bodies(wanted, plain, get=self.get).select("domain", "status", text_of("body").alias("text"))
        fresh = frontier.cut(robots.parse_robots(got))
        self.rules = fresh if self.rules is None else self.rules.unionByName(fresh)
        return self.rules

    def _remember(self, results: DataFrame) -> None:
        """Limiters and breakers go on with the next fetch where this one left them."""
        self.states = frontier.cut(fetch.latest_states(results, self.states))

    def _fetch(self, wanted: DataFrame) -> DataFrame:
        paced = wanted
        if self.rules is not None:
            delays = robots.crawl_delays(self.rules, self.agents[0]).filter("crawl_delay > 0").withColumnRenamed("domain", "_domain")
            paced = wanted.withColumn("_domain", urls.domain_of(F.col("url"))).join(delays, "_domain", "left").drop("_domain")
        got = frontier.cut(fetch.fetch(paced, self.options, get=self.get, states=self.states).drop("body"))
        self._remember(got)
        rows = wanted.join(got.drop("state"), "url").withColumn("t", F.col("ended") - self.began)
        out = frontier.cut(html.parse_html(rows, self.fields, parser=self.parser).withColumn("run_id", F.lit(self.run_id)))
        if self.sink is not None:
            self.sink.save(out)
        if self.hook is not None:
            try:
                self.hook(out)
            except Exception:
                self.log.exception("on_page_done")
        self.done += out.count()
        if self.reporter:
            self.reporter.update(self.done)
        return out

    def sitemap_urls(self) -> DataFrame | None:
        """(url, rank) from configured sitemaps and, if asked for, those the start sites name; None if there are no sitemaps."""
        roots = list(self.config.sitemaps)
        if self.config.use_sitemap and self.config.start_urls:
            start = self.spark.createDataFrame([(u,) for u in self.config.start_urls], "url string")
            sites = start.select(urls.domain_of(F.col("url")).alias("domain"), urls.scheme_of(F.col("url")).alias("scheme")).distinct()
            roots += [r["sitemap"] for r in robots.sitemaps_of(sites, self._robots(start)).collect()]
        if not roots:
            return None
        frame = self.spark.createDataFrame(list(enumerate(dict.fromkeys(roots))), "seq long, sitemap string")
        files, known = None, frame.select(F.col("sitemap").alias("url"))
        for _ in range(4):  # indexes are read before their files, three levels deep
            got = frontier.cut(fetch.raw_bodies(known, self.options, get=self.get, states=self.states))
            self._remember(got)
            got = got.select(F.col("url").alias("sitemap"), "status", "body")
            files = got if files is None else files.unionByName(got)
            found, _ = frontier.expand_sitemaps(self.spark, frame, files, max_urls=self.config.limits.max_pages)
            inner = files.select("sitemap", F.explode(html_sitemaps(F.col("body"))).alias("loc")).select(urls.join_url(F.col("sitemap"), F.col("loc")).alias("url")).distinct()
            known = frontier.cut(inner.join(files.select(F.col("sitemap").alias("url")), "url", "left_anti"))
            if known.isEmpty():
                break
        return found

    def crawl(self) -> DataFrame:
        """Successful pages of a run; a second call is a new run with fresh statistics into the same sink."""
        self.run_id, self.began, self.done, self.states = self.run_id + 1, time.time(), 0, None
        start = list(dict.fromkeys(self.config.start_urls))
        seeds, found = self.spark.createDataFrame([(u, k) for k, u in enumerate(start)], "url string, seq long"), self.sitemap_urls()
        if found is not None:
            seeds = frontier.cut(seeds.unionByName(found.select("url", (F.col("rank") + len(start)).alias("seq"))))
        if not start and (found is None or seeds.isEmpty()):
            raise conf.ConfigError("start_urls: at least one address or sitemap is wanted")
        p, lim, fil = self.config.progress, self.config.limits, self.config.filters
        self.reporter = Reporter(lim.max_pages, p.interval) if p.enabled else None
        allow = None
        if self.config.crawler.respect_robots:
            allow = lambda rows: robots.allowed(rows, self._robots(rows), self.agents[0])
        self.pages, self.seen = frontier.crawl(seeds, self._fetch, lim.max_pages, lim.max_depth, fil.same_domain_only, fil.exclude_patterns, fil.include_patterns, allow)
        if self.sink is not None:
            self.sink.flush()
        self.duration = time.time() - self.began
        if self.reporter:
            self.reporter.update(self.done, final=True)
        if self.config.output.stats_json:
            self.export_to_json(self.config.output.stats_json)
        if self.config.output.html_report:
            self.export_to_html_report(self.config.output.html_report)
        return self.pages.filter("error is null")

    def tables(self) -> dict[str, DataFrame]:
        """The parts of the statistics that grow with the crawl, whole."""
        p = self.pages
        return {
            "permanent_urls": stats.permanent_urls(p).select("url"),
            "errors_of": p.filter("error is not null").select("url", "error", "status", "reason", F.size("attempts").alias("attempts")).orderBy("url"),
            "rates": stats.rate_stats(p.withColumns({"ts": F.timestamp_seconds("began"), "id": F.col("url")}), time.time(), wait=F.col("wait")).orderBy("domain"),
            "backoff": self.states.filter("state.backoff > 0").select("domain", "state.backoff").orderBy("domain"),
            "peaks_by_domain": stats.peak_concurrency(p, "domain", "began", "ended").orderBy("domain"),
        }

    def get_stats(self, top_n: int = 10) -> dict:
        """The statistics; of each of ``tables`` the first ``MOST`` rows."""
        rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
        p = self.pages
        head = {name: rows(df.limit(self.MOST)) for name, df in self.tables().items()}
        attempts = p.select("url", F.explode("attempts").alias("a")).select("url", "a.*")
        t = rows(stats.totals(p, self.duration))[0]
        t |= {"success_rate": round(t["success_rate"], 1), "pages_per_second": round(t["pages_per_second"], 2), "duration": round(t["duration"], 3)}
        return {
            "start_urls": list(self.config.start_urls), "totals": t, "status": rows(stats.status_histogram(p).orderBy(*stats.status_order())),
            "top_domains": rows(stats.top_domains(p, top_n)), "errors": rows(stats.errors_by_type(p).orderBy(F.desc("pages"))), "depth": rows(stats.depth_distribution(p).orderBy("depth")),
            "timeline": rows(stats.timeline(p, max(self.duration, 0.001)).orderBy("bin")), "failures": rows(stats.failures_head(p)), "permanent_urls": [r["url"] for r in head["permanent_urls"]],
            "queue": rows(stats.queue_stats(self.seen, p))[0], "retries": rows(stats.retry_stats(attempts))[0] | {"errors": rows(stats.attempt_errors(attempts).orderBy("error"))},
            "errors_of": head["errors_of"], "rates": head["rates"], "backoff": head["backoff"], "breaker": rows(fetch.breaker_stats(self.states))[0],
            "peaks": {"total": rows(stats.peak_concurrency(p.withColumn("all", F.lit("")), "all", "began", "ended"))[0]["peak"], "by_domain": head["peaks_by_domain"]},
            "partial_parses": p.filter("error is null and size(parse_errors) > 0").count(), "skipped_by_depth": rows(stats.skipped_by_depth(p, self.config.limits.max_depth))[0]["skipped"],
            "storage": self.sink.stats() if self.sink else None,
        }

    def export_to_json(self, path: str) -> None:
        sinks.write_stats_json(self.get_stats(), path, self.tables())

    def export_to_html_report(self, path: str) -> None:
        report.write(self.get_stats(), path)

    def close(self) -> None:
        if self.sink is not None:
            self.sink.close()


@F.pandas_udf(T.StringType())
def text_of(body):
    return body.map(fetch.decode)


@F.pandas_udf(T.ArrayType(T.StringType()))
def html_sitemaps(body):
    """Locations of a body that is a sitemap index, none for other bodies."""
    from harrow.functions.text import sitemap_locations

    return body.map(lambda b: (lambda k: k[1] if k[0] == "sitemapindex" else [])(sitemap_locations(b)))
