"""Fetching pages over HTTP inside tasks, with retries, rate slots and a breaker for each domain.

URLs are dealt by domain, so the limits of a domain hold inside one task without
coordination. Each task has its share of ``max_concurrent`` threads and starts
URLs in the order of their ``rank`` (where there is one), passing over those whose
domain has ``max_per_domain`` under way, so a slow domain does not hold up the
others. Of a task's URLs ``AHEAD`` are in memory at once. What limiter and breaker
know of a domain comes back with every row (``state``) and is handed to the next
fetch (``states``), so it lasts for a whole crawl. With one rate for all domains
each task takes its share of the rate. Every outcome is a row, never an exception.

``fetch`` runs inside a plan; ``harrow.sources.http`` reads the same rows as a data
source, which deals domains by size.
"""

from __future__ import annotations

import codecs
import heapq
import http.client
import itertools
import random
import re
import socket
import threading
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field, replace
from typing import NamedTuple
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions import policy, urls
from harrow.streaming.limits import Breaker, Limiter

STATE = "next:double,backoff:double,streak:int,opened:double,is_open:int,probing:int,times_opened:long,rejected:long"
RESULT = f"url string, status int, content_type string, body binary, html string, error string, reason string, began double, ended double, wait double, attempts array<struct<attempt:int,status:int,error:string,delay:double>>, domain string, state struct<{STATE}>"
STATES = f"domain string, state struct<{STATE}>"
#: Rows that a task hands on at once, and URLs that it looks at ahead.
ROWS, AHEAD = 64, 4096


class Timeouts(NamedTuple):
    """Seconds for connecting, for each wait for data, and for the whole request."""

    connect: float
    read: float
    total: float

    def times(self, growth: float) -> Timeouts:
        return Timeouts(*(x * growth for x in self))


@dataclass
class FetchOptions:
    user_agents: list[str] = field(default_factory=lambda: ["harrow/1.0"])
    connect_timeout: float = 10.0
    read_timeout: float = 15.0
    total_timeout: float = 30.0
    retry: policy.RetryPolicy | None = field(default_factory=policy.RetryPolicy)
    rate: policy.RatePolicy = field(default_factory=policy.RatePolicy)
    failure_threshold: int | None = None
    recovery_timeout: float = 30.0
    crawl_delay: dict[str, float] = field(default_factory=dict)
    max_concurrent: int = 10
    max_per_domain: int | None = None

    @property
    def timeouts(self) -> Timeouts:
        return Timeouts(self.connect_timeout, self.read_timeout, self.total_timeout)


def _opener(read: float) -> urllib.request.OpenerDirector:
    """Connects within the request's own timeout, then waits ``read`` seconds for data at most."""

    def timed(base):
        class Timed(base):
            def connect(self):
                super().connect()
                self.sock.settimeout(read)

        return Timed

    class Plain(urllib.request.HTTPHandler):
        def http_open(self, req):
            return self.do_open(timed(http.client.HTTPConnection), req)

    class Secure(urllib.request.HTTPSHandler):
        def https_open(self, req):
            return self.do_open(timed(http.client.HTTPSConnection), req, context=self._context)

    return urllib.request.build_opener(Plain, Secure)


def _read(response, until: float) -> bytes:
    parts = []
    while part := response.read1(1 << 16):
        parts.append(part)
        if time.monotonic() > until:
            raise TimeoutError("total timeout")
    return b"".join(parts)


def http_get(url: str, agent: str, timeout: Timeouts) -> tuple[int, str | None, bytes, str | None]:
    """(status, content type, body, Retry-After) of one GET; a status is never an exception."""
    request = urllib.request.Request(url, headers={"User-Agent": agent})
    until = time.monotonic() + timeout.total
    try:
        with _opener(min(timeout.read, timeout.total)).open(request, timeout=min(timeout.connect, timeout.total)) as r:
            return r.status, r.headers.get("Content-Type"), _read(r, until), None
    except urllib.error.HTTPError as e:
        return e.code, e.headers.get("Content-Type"), _read(e, until), e.headers.get("Retry-After")


_CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)


def decode(body: bytes | None, content_type: str | None = None) -> str | None:
    """Text of a body: byte order mark, charset of the header, then of a meta tag, else UTF-8; bad bytes are replaced."""
    if body is None:
        return None
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if body.startswith(mark):
            return body.decode(name, "replace")
    said = _CHARSET.search(content_type or "") or _CHARSET.search(body[:2048].decode("latin-1"))
    try:
        return body.decode(said.group(1) if said else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def kind_of(status: int) -> str | None:
    """Error type of a status, None for success."""
    if status < 400:
        return None
    if status == 429:
        return policy.RATE_LIMITED
    return policy.TRANSIENT if status >= 500 or status in policy.PASSING_STATUSES else policy.PERMANENT


def kind_of_exception(e: BaseException) -> str:
    if isinstance(e, urllib.error.URLError) and isinstance(e.reason, BaseException):
        e = e.reason
    if isinstance(e, (TimeoutError, socket.timeout)):
        return policy.TRANSIENT
    if isinstance(e, (OSError, http.client.HTTPException)):
        return policy.NETWORK
    return policy.BY_EXCEPTION.get(type(e).__name__.lower(), policy.OTHER)


def wait_seconds(value: str | None) -> float | None:
    try:
        seconds = float(value)
    except (TypeError, ValueError):
        return None
    return max(0.0, seconds) if seconds == seconds else 0.0


class Domain:
    """Limiter and breaker of one domain, for the threads of one task; ``known`` is an earlier ``state``."""

    def __init__(self, options: FetchOptions, name: str, clock=time.time, known=None, share: float = 1.0, delay: float = 0.0):
        r = options.rate
        gap = max(share / r.requests_per_second if r.requests_per_second else 0.0, r.min_delay, options.crawl_delay.get(name, 0.0), delay)
        self.limiter = Limiter(gap, r.error_backoff, r.max_backoff)
        self.breaker = Breaker(options.failure_threshold, options.recovery_timeout) if options.failure_threshold else None
        self.clock, self.jitter, self.lock = clock, r.jitter, threading.Lock()
        for m in (self.limiter, self.breaker):
            for k in vars(m) if m and known else ():
                if known.get(k) is not None and k in STATE_FIELDS:
                    setattr(m, k, known[k])
        if self.breaker:
            self.breaker.probing = 0  # no probe outlives its fetch

    def admits(self) -> bool:
        """False while the breaker is open; after the timeout one probe goes through."""
        with self.lock:
            return self.breaker is None or self.breaker.admits(self.clock())

    def slot(self) -> float:
        """How long to wait for the next start."""
        with self.lock:
            now = self.clock()
            return self.limiter.take(now, random.uniform(0, self.jitter) if self.jitter else 0.0) - now

    def over(self, error: str | None) -> None:
        """Timeouts, 5xx, 429 and network errors are failures; other errors count as neither."""
        outcome = True if error is None else False if error in policy.FAILURES else None
        with self.lock:
            for m in (self.limiter, self.breaker):
                if m:
                    m.report(self.clock(), outcome)

    def state(self) -> dict:
        with self.lock:
            return {k: v for m in (self.limiter, self.breaker) if m for k, v in vars(m).items() if k in STATE_FIELDS}


STATE_FIELDS = [c.split(":")[0] for c in STATE.split(",")]


def fetch_one(url: str, agents, state: Domain, options: FetchOptions, get=http_get, sleep=time.sleep) -> dict:
    """One URL with its retries; every attempt asks the breaker and takes a slot. Waits before retries hold no slot."""
    tries, attempt, waited, began, p = [], 0, 0.0, None, options.retry
    while True:
        attempt += 1
        status = ctype = body = after = reason = None
        if not state.admits():
            error, reason = policy.BREAKER, "circuit open"
        else:
            waited += (slot := max(0.0, state.slot()))
            sleep(slot)
            began = state.clock() if began is None else began
            growth = p.timeout_growth ** (attempt - 1) if p else 1.0
            try:
                status, ctype, body, after = get(url, next(agents), options.timeouts.times(growth))
                error = kind_of(status)
                reason = f"HTTP {status}" if error else None
            except Exception as e:
                error, reason = kind_of_exception(e), f"{type(e).__name__}: {e}"
            state.over(error)
        again = bool(p and error in p.retried and attempt <= p.retries(error, status))
        delay = p.delay(attempt, error, wait_seconds(after)) if again else 0.0
        tries.append({"attempt": attempt, "status": status, "error": error, "delay": delay})
        if not again:
            ended = state.clock()
            return {"url": url, "status": status, "content_type": ctype, "body": None if error else body, "error": error, "reason": reason, "began": ended if began is None else began, "ended": ended, "wait": waited, "attempts": tries}
        sleep(delay)


def bytes_of_one(url: str, agents, state: Domain, options: FetchOptions, get=http_get, sleep=time.sleep) -> dict:
    """One answer as it is: any status is one, none is tried again; the rate slot counts, the breaker does not."""
    sleep(slot := max(0.0, state.slot()))
    began, status, body, reason = state.clock(), None, None, None
    try:
        status, _, body, _ = get(url, next(agents), options.timeouts)
    except Exception as e:
        reason = f"{type(e).__name__}: {e}"
    return {"url": url, "status": status, "body": body, "reason": reason, "began": began, "ended": state.clock(), "wait": slot}


def _in_turn(rows: Iterable[tuple], threads: int, per_domain: int, one: Callable[..., dict]) -> Iterator[dict]:
    """Results as they come of rows (domain, url, ...), started in their order where the domain allows.

    A domain has ``per_domain`` requests under way at most, all together ``threads``.
    ``ready`` has, of every domain that may start one, the place of its next row.
    """
    rows, waiting, active, ready, busy, held, place = iter(rows), {}, {}, [], {}, 0, 0
    with ThreadPoolExecutor(threads) as pool:
        while True:
            while held < AHEAD and (row := next(rows, None)) is not None:
                own = waiting.setdefault(row[0], deque())
                own.append((place, row))
                if len(own) == 1 and active.get(row[0], 0) < per_domain:
                    heapq.heappush(ready, (place, row[0]))
                held, place = held + 1, place + 1
            while ready and len(busy) < threads:
                name = heapq.heappop(ready)[1]
                busy[pool.submit(one, *waiting[name].popleft()[1])] = name
                active[name], held = active.get(name, 0) + 1, held - 1
                if waiting[name] and active[name] < per_domain:
                    heapq.heappush(ready, (waiting[name][0][0], name))
            if not busy:
                return
            for f in wait(busy, return_when=FIRST_COMPLETED).done:
                name = busy.pop(f)
                active[name] -= 1
                if waiting[name] and active[name] == per_domain - 1:
                    heapq.heappush(ready, (waiting[name][0][0], name))
                elif not waiting[name] and not active[name]:
                    del waiting[name], active[name]
                yield f.result()


def fetched_rows(rows: Iterable[tuple], options: FetchOptions, get: Callable, one: Callable, tasks: int, text: bool) -> Iterator[dict]:
    """Result rows (see ``RESULT``) of one task's rows (domain, url, state, delay), as they come."""
    threads = max(1, options.max_concurrent // tasks)
    share = 1.0 if options.rate.per_domain else float(tasks)
    domains, agents, lock = {}, itertools.cycle(options.user_agents), threading.Lock()

    def agent():
        while True:
            with lock:
                name = next(agents)
            yield name

    def do(name, url, known, delay):
        key = name if options.rate.per_domain else ""
        with lock:
            if key not in domains:
                domains[key] = Domain(options, name, known=known, share=share, delay=delay or 0.0)
        state = domains[key]
        got = dict.fromkeys(RESULT_FIELDS) | one(url, agent(), state, options, get) | {"domain": name, "state": state.state()}
        if text:
            got["html"] = decode(got["body"], got["content_type"])
        return got

    yield from _in_turn(rows, threads, options.max_per_domain or threads, do)


RESULT_FIELDS = [c.split(" ")[0] for c in RESULT.split(", ")]


def wanted_rows(wanted: DataFrame, url_col: str = "url", states: DataFrame | None = None) -> DataFrame:
    """domain, url, state, delay, rank of each distinct URL: what limiter and breaker know is joined as a column.

    rank and delay (seconds between requests of the domain) come from ``wanted``
    where it has such columns; else the order is that of a hash, which mixes domains.
    """
    have = set(wanted.columns)
    rank = F.min("rank").cast("long") if "rank" in have else F.min(F.xxhash64(url_col))
    delay = F.max("crawl_delay").cast("double") if "crawl_delay" in have else F.lit(None).cast("double")
    each = wanted.groupBy(F.col(url_col).alias("url")).agg(rank.alias("rank"), delay.alias("delay")).withColumn("domain", urls.domain_of(F.col("url")))
    each = each.join(states, "domain", "left") if states is not None else each.withColumn("state", F.lit(None).cast(f"struct<{STATE}>"))
    return each.select("domain", "url", "state", "delay", "rank")


def _fetched(wanted: DataFrame, options: FetchOptions, url_col: str, get: Callable, one: Callable, states: DataFrame | None, text: bool) -> DataFrame:
    each = wanted_rows(wanted, url_col, states)
    tasks = min(options.max_concurrent, each.sparkSession.sparkContext.defaultParallelism)
    dealt = each.repartition(tasks, "domain").sortWithinPartitions("rank", "url")

    def run(batches):
        rows = ((name, url, None if known is None else dict(known), None if pd.isna(delay) else delay) for b in batches for name, url, known, delay in zip(b["domain"], b["url"], b["state"], b["delay"], strict=True))
        got = fetched_rows(rows, options, get, one, tasks, text)
        while part := list(itertools.islice(got, ROWS)):
            out = pd.DataFrame(part, columns=RESULT_FIELDS)
            out["status"] = out["status"].astype("Int32")
            yield out

    return dealt.mapInPandas(run, RESULT)


def fetch(wanted: DataFrame, options: FetchOptions | None = None, url_col: str = "url", get: Callable = http_get, states: DataFrame | None = None) -> DataFrame:
    """A result row for each distinct URL; successes have ``error`` null and ``html`` decoded.

    began and ended are seconds since the epoch, wait is for rate slots. wanted may
    have rank (the order in which URLs start) and crawl_delay. states: (domain, state)
    of an earlier fetch, see ``latest_states``.
    """
    return _fetched(wanted, options or FetchOptions(), url_col, get, fetch_one, states, text=True)


def raw_bodies(wanted: DataFrame, options: FetchOptions | None = None, url_col: str = "url", get: Callable = http_get, states: DataFrame | None = None) -> DataFrame:
    """(url, status, body, domain, ended, state) without retries or breaker: any status is an answer, null means none came."""
    options = replace(options or FetchOptions(), failure_threshold=None)
    return _fetched(wanted, options, url_col, get, bytes_of_one, states, text=False).select("url", "status", "body", "domain", "ended", "state")


def latest_states(results: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(domain, state) after ``results``; what ``before`` says of other domains stays."""
    now = results.groupBy("domain").agg(F.max_by("state", "ended").alias("state"))
    if before is None:
        return now
    return now.unionByName(before.join(now, "domain", "left_anti"))


def breaker_stats(states: DataFrame) -> DataFrame:
    """One row: times_opened, rejected, open_domains."""
    s = F.col("state")
    opened = F.array_sort(F.collect_list(F.when(s["is_open"] == 1, F.col("domain"))))
    return states.agg(F.coalesce(F.sum(s["times_opened"]), F.lit(0)).alias("times_opened"), F.coalesce(F.sum(s["rejected"]), F.lit(0)).alias("rejected"), opened.alias("open_domains"))


def successes(results: DataFrame) -> DataFrame:
    """(url, html) of what was fetched without error, each URL once."""
    return results.filter("error is null").select("url", "html").dropDuplicates(["url"])
