"""Crawl analytics and corpus preparation on Spark DataFrames."""

from importlib import import_module

#: Public name to its module; modules are loaded when a name is first asked for, so that workers load only what they run.
_FROM = {
    "CrawlEngine": "engine", "Config": "config", "ConfigError": "config", "load": "config", "from_dict": "config", "setup": "logs",
    "FetchOptions": "operators.fetch", "Timeouts": "operators.fetch", "fetch": "operators.fetch", "raw_bodies": "operators.fetch",
    "crawl": "operators.frontier", "corpus_fetch": "operators.frontier", "expand_sitemaps": "operators.frontier",
    "parse_html": "operators.html", "select_text": "operators.html", "parse_robots": "operators.robots", "allowed": "operators.robots",
    "RetryPolicy": "functions.policy", "RatePolicy": "functions.policy", "Limiter": "streaming.limits", "Breaker": "streaming.limits",
    "Sink": "sources.sinks", "JsonArray": "sources.sinks", "JsonLines": "sources.sinks", "Csv": "sources.sinks", "Sqlite": "sources.sinks", "Multi": "sources.sinks",
    "Reporter": "streaming.progress", "ProgressListener": "streaming.progress",
}
__all__ = sorted(_FROM)


def __getattr__(name: str):
    if name not in _FROM:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_FROM[name]}"), name)
