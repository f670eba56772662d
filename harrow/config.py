"""Settings of a crawl: dataclasses, files, checks. Driver side only."""

from __future__ import annotations

import dataclasses
import difflib
import json
import re
import types
import typing
from dataclasses import dataclass, field
from pathlib import Path

from harrow.sources.sinks import TYPES


class ConfigError(ValueError):
    pass


# Names and defaults below are the contract of the configuration file.
@dataclass
class Limits:
    max_pages: int = 100
    max_depth: int = 2


@dataclass
class Filters:
    same_domain_only: bool = True
    include_patterns: list[str] = field(default_factory=list)
    exclude_patterns: list[str] = field(default_factory=list)


@dataclass
class Crawler:
    max_concurrent: int = 10
    max_per_domain: int | None = None
    rate_limit: float | None = None
    rate_per_domain: bool = True
    min_delay: float = 0.0
    jitter: float = 0.0
    error_backoff: float = 0.0
    respect_robots: bool = False
    user_agent: str | None = None
    user_agents: list[str] = field(default_factory=list)
    connect_timeout: float = 10.0
    read_timeout: float = 15.0
    total_timeout: float = 30.0


@dataclass
class Retry:
    enabled: bool = False
    max_retries: int = 3
    backoff_factor: float = 2.0
    base_delay: float = 0.5
    max_delay: float = 30.0


@dataclass
class CircuitBreaker:
    enabled: bool = False
    failure_threshold: int = 5
    recovery_timeout: float = 30.0


@dataclass
class Storage:
    type: str = "none"
    path: str | None = None
    batch_size: int = 50
    overwrite: bool = True


@dataclass
class Logging:
    level: str = "INFO"
    console_level: str = "WARNING"
    file: str | None = None
    max_bytes: int = 1_000_000
    backup_count: int = 3
    format: str = "text"


@dataclass
class Output:
    html_report: str | None = None
    stats_json: str | None = None


@dataclass
class Progress:
    enabled: bool = True
    interval: float = 0.5


@dataclass
class Config:
    start_urls: list[str] = field(default_factory=list)
    sitemaps: list[str] = field(default_factory=list)
    use_sitemap: bool = False
    limits: Limits = field(default_factory=Limits)
    filters: Filters = field(default_factory=Filters)
    crawler: Crawler = field(default_factory=Crawler)
    retry: Retry = field(default_factory=Retry)
    circuit_breaker: CircuitBreaker = field(default_factory=CircuitBreaker)
    storage: Storage = field(default_factory=Storage)
    logging: Logging = field(default_factory=Logging)
    output: Output = field(default_factory=Output)
    progress: Progress = field(default_factory=Progress)


LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")


def _value(kind, value, at: str):
    """``value`` as the declared type, or an error that names the key."""
    if isinstance(kind, types.UnionType):
        if value is None:
            return None
        kind = next(k for k in typing.get_args(kind) if k is not type(None))
    if typing.get_origin(kind) is list:
        value = [value] if isinstance(value, str) else value  # one string is a list of one
        if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
            raise ConfigError(f"{at}: a list of strings is wanted, not {value!r}")
        return list(value)
    if dataclasses.is_dataclass(kind):
        return _build(kind, value or {}, at)
    if kind is float and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if not isinstance(value, kind) or kind is not bool and isinstance(value, bool):
        raise ConfigError(f"{at}: {kind.__name__} is wanted, not {value!r}")
    return value


def _build(kind, data, at: str = ""):
    if not isinstance(data, dict):
        raise ConfigError(f"{at or 'configuration'}: a mapping is wanted, not {data!r}")
    hints, out = typing.get_type_hints(kind), {}
    for key, value in data.items():
        where = f"{at}.{key}" if at else str(key)
        if key not in hints:
            near = difflib.get_close_matches(str(key), hints, 1)
            raise ConfigError(f"{where}: no such setting" + (f"; is {near[0]!r} meant?" if near else ""))
        out[key] = _value(hints[key], value, where)
    return kind(**out)


def from_dict(data: dict) -> Config:
    config = _build(Config, data)
    if problems := validate(config):
        raise ConfigError("; ".join(problems))
    return config


def load(path: str) -> Config:
    """A .yaml, .yml or .json file."""
    file = Path(path)
    try:
        said = file.read_text(encoding="utf-8")
    except OSError as e:
        raise ConfigError(f"{path}: {e.strerror}") from e
    try:
        if file.suffix.lower() in (".yaml", ".yml"):
            import yaml

            data = yaml.safe_load(said)
        elif file.suffix.lower() == ".json":
            data = json.loads(said)
        else:
            raise ConfigError(f"{path}: .yaml or .json is wanted")
    except ConfigError:
        raise
    except Exception as e:
        raise ConfigError(f"{path}: {e}") from e
    return from_dict(data or {})


def validate(c: Config) -> list[str]:
    """What is wrong with the values, all of it."""
    out = []
    for at, x, least in (("limits.max_pages", c.limits.max_pages, 1), ("limits.max_depth", c.limits.max_depth, 0), ("crawler.max_concurrent", c.crawler.max_concurrent, 1), ("storage.batch_size", c.storage.batch_size, 1), ("retry.max_retries", c.retry.max_retries, 0), ("circuit_breaker.failure_threshold", c.circuit_breaker.failure_threshold, 1), ("crawler.min_delay", c.crawler.min_delay, 0), ("crawler.jitter", c.crawler.jitter, 0), ("crawler.error_backoff", c.crawler.error_backoff, 0), ("retry.base_delay", c.retry.base_delay, 0), ("logging.max_bytes", c.logging.max_bytes, 1), ("logging.backup_count", c.logging.backup_count, 0)):
        if x < least:
            out.append(f"{at}: {least} at least")
    for at, x in (("crawler.total_timeout", c.crawler.total_timeout), ("crawler.connect_timeout", c.crawler.connect_timeout), ("crawler.read_timeout", c.crawler.read_timeout), ("progress.interval", c.progress.interval), ("crawler.rate_limit", 1 if c.crawler.rate_limit is None else c.crawler.rate_limit)):
        if x <= 0:
            out.append(f"{at}: more than 0")
    if c.storage.type not in TYPES:
        out.append(f"storage.type: one of {', '.join(TYPES)}")
    elif c.storage.type != "none" and not c.storage.path:
        out.append("storage.path: wanted for this storage type")
    for at, x in (("logging.level", c.logging.level), ("logging.console_level", c.logging.console_level)):
        if x.upper() not in LEVELS:
            out.append(f"{at}: one of {', '.join(LEVELS)}")
    if c.logging.format not in ("text", "json"):
        out.append("logging.format: text or json")
    for at, patterns in (("filters.include_patterns", c.filters.include_patterns), ("filters.exclude_patterns", c.filters.exclude_patterns)):
        for p in patterns:
            try:
                re.compile(p)
            except re.error as e:
                out.append(f"{at}: {p!r}: {e}")
    if any(not x.strip() for x in c.crawler.user_agents):
        out.append("crawler.user_agents: no blank ones")
    for u in [*c.start_urls, *c.sitemaps]:
        if not u.startswith(("http://", "https://")):
            out.append(f"{u!r}: an http or https address is wanted")
    return out
