"""Command line: ``python -m harrow --urls https://… --max-pages 50 --output pages.jsonl``."""

from __future__ import annotations

import argparse
import json
import sys

from harrow import config as conf
from harrow.sources import sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m harrow", description="Crawl a site, store its pages, count what happened.")
    # fixed values: the flags of the command line
    yes_no = {"action": argparse.BooleanOptionalAction, "default": None}
    for flag, more in (
        ("--urls", {"nargs": "+"}), ("--config", {}), ("--max-pages", {"type": int}), ("--max-depth", {"type": int}), ("--output", {}), ("--respect-robots", yes_no), ("--rate-limit", {"type": float}), ("--concurrency", {"type": int}),
        ("--sitemap", {"nargs": "+"}), ("--use-sitemap", {"action": "store_true"}), ("--same-domain", yes_no), ("--report", {}), ("--stats-json", {}), ("--log-file", {}), ("--log-level", {"choices": conf.LEVELS[:4]}), ("--user-agent", {}), ("--user-agents", {"nargs": "+"}), ("--no-progress", {"action": "store_true"}),
    ):
        p.add_argument(flag, **more)
    return p


#: Flag to the settings it overrides.
FLAGS = {"urls": "start_urls", "max_pages": "limits.max_pages", "max_depth": "limits.max_depth", "respect_robots": "crawler.respect_robots", "rate_limit": "crawler.rate_limit", "concurrency": "crawler.max_concurrent", "sitemap": "sitemaps", "same_domain": "filters.same_domain_only", "report": "output.html_report", "stats_json": "output.stats_json", "log_file": "logging.file", "log_level": "logging.level", "user_agent": "crawler.user_agent", "user_agents": "crawler.user_agents"}


def config_of(args: argparse.Namespace) -> conf.Config:
    """Defaults, then the file, then flags."""
    c = conf.load(args.config) if args.config else conf.Config()
    for flag, path in FLAGS.items():
        if (value := getattr(args, flag)) is not None:
            *section, name = path.split(".")
            setattr(getattr(c, section[0]) if section else c, name, value)
    if args.use_sitemap:
        c.use_sitemap = True
    if args.no_progress:
        c.progress.enabled = False
    if args.output:
        try:
            c.storage.type, c.storage.path = sinks.type_of(args.output), args.output
        except ValueError as e:
            raise conf.ConfigError(str(e)) from e
    if not (c.start_urls or c.sitemaps):
        raise conf.ConfigError("no address: --urls, --sitemap or start_urls in a configuration")
    if problems := conf.validate(c):
        raise conf.ConfigError("; ".join(problems))
    return c


def main(argv: list[str] | None = None, spark=None) -> int:
    try:
        config = config_of(parser().parse_args(argv))
    except conf.ConfigError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from harrow.engine import CrawlEngine

    engine = CrawlEngine(spark or SparkSession.builder.appName("harrow").getOrCreate(), config)
    try:
        engine.crawl()
        print(json.dumps(engine.get_stats()["totals"], ensure_ascii=False, indent=2))
        return 0
    except conf.ConfigError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        return 130
    finally:
        engine.close()
