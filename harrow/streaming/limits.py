"""Rate limiter and circuit breaker as ordered state for each domain: in batch, in a stream and in the fetch.

Both are small state machines over the requests of a domain in order of (t, id).
In batch a domain's rows are a sorted stretch of a partition that is read once,
row by row; in a stream they are keyed state; the fetch asks the same machines
before and after each request. So all three agree. Where no error slows a
domain down the limiter is a running maximum and needs no ordered pass at all.

outcome of a request: True (success), False (a failure that counts), None (an
answer that counts as neither, such as 404).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from harrow.operators import stats

LIMITED = "domain string, id long, t double, start double, wait double, backoff double"
#: Rows that a step in a stream puts out at once.
PIECE = 10_000
BROKEN = "domain string, id long, t double, admitted boolean, state string, times_opened long, rejected long"


@dataclass
class Limiter:
    """Starts at least ``gap`` apart; failures double a backoff up to ``cap``, success clears it."""

    gap: float
    base: float = 0.0
    cap: float = 60.0
    next: float = float("-inf")
    backoff: float = 0.0

    def take(self, t: float, more: float = 0.0) -> float:
        """The start of a request that comes at ``t``; ``more`` is added to the gap after it."""
        start = max(t, self.next)
        self.next = start + self.gap + more
        return start

    def report(self, t: float, outcome: bool | None) -> None:
        if outcome:
            self.backoff = 0.0
        elif outcome is False and self.base:
            self.backoff = min(self.cap, 2 * self.backoff or self.base)
            self.next = max(self.next, t + self.backoff)

    def step(self, t: float, outcome: bool | None) -> tuple[float, float, float]:
        """A request whose answer comes at once: (start, wait, backoff)."""
        start = self.take(t)
        self.report(start, outcome)
        return start, start - t, self.backoff


@dataclass
class Breaker:
    """Opens after ``threshold`` failures in a row, admits one probe after ``recovery`` seconds.

    With ``strict`` a probe that ends in None keeps the probe place taken, so the
    domain stays shut; else it closes the breaker.
    """

    threshold: int
    recovery: float
    strict: bool = False
    streak: int = 0
    opened: float = float("-inf")
    is_open: int = 0
    probing: int = 0
    times_opened: int = 0
    rejected: int = 0

    def admits(self, t: float) -> bool:
        if self.is_open:
            if self.probing or t - self.opened < self.recovery:
                self.rejected += 1
                return False
            self.probing = 1
        return True

    def report(self, t: float, outcome: bool | None) -> None:
        if outcome is None:
            if self.probing and not self.strict:
                self.is_open = self.probing = self.streak = 0
        elif outcome:
            self.is_open = self.probing = self.streak = 0
        else:
            self.streak += 1
            if self.probing or self.streak >= self.threshold:
                if self.probing or not self.is_open:
                    self.times_opened += 1
                self.is_open, self.opened, self.probing = 1, t, 0

    def step(self, t: float, outcome: bool | None) -> tuple[bool, str]:
        """A request whose answer comes at once: (admitted, state)."""
        if not self.admits(t):
            return False, "open"
        self.report(t, outcome)
        return True, "open" if self.is_open else "closed"


def _limited(m: Limiter, t: float, outcome: bool | None) -> tuple:
    return m.step(t, outcome)


def _broken(m: Breaker, t: float, outcome: bool | None) -> tuple:
    admitted, state = m.step(t, outcome)
    return admitted, state, m.times_opened, m.rejected


def _trace(log: DataFrame, machine: Callable, step: Callable, schema: str) -> DataFrame:
    """One pass over each domain's sorted rows; a domain may be longer than memory."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        domain, m = None, machine()
        for b in batches:
            rows = []
            for d, i, t, o in zip(*(b.column(c).to_pylist() for c in ("domain", "id", "t", "outcome")), strict=True):
                if d != domain:
                    domain, m = d, machine()
                rows.append((d, i, t, *step(m, t, o)))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=shape)

    shape = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[c.split()[1]]) for n, c in zip(names, schema.split(", "), strict=True)])
    return log.select("domain", "id", "t", "outcome").repartition("domain").sortWithinPartitions("domain", "t", "id").mapInArrow(run, schema)


def limiter_trace(log: DataFrame, gap: float, base: float = 0.0, cap: float = 60.0) -> DataFrame:
    """log (domain, id, t, outcome) with start, wait and backoff of each request."""
    if not base:
        slots = stats.rate_schedule(log.select("domain", "id", "t"), gap)
        return slots.select("domain", "id", "t", "start", "wait", F.lit(0.0).alias("backoff"))
    return _trace(log, lambda: Limiter(gap, base, cap), _limited, LIMITED)


def breaker_trace(log: DataFrame, threshold: int, recovery: float, strict: bool = False) -> DataFrame:
    """log (domain, id, t, outcome) with whether each request was admitted."""
    return _trace(log, lambda: Breaker(threshold, recovery, strict), _broken, BROKEN)


def breaker_stats(trace: DataFrame) -> DataFrame:
    """One row: times_opened, rejected, open_domains."""
    per = trace.groupBy("domain").agg(F.max("times_opened").alias("opened"), F.max("rejected").alias("rejected"), F.max_by("state", F.struct("t", "id")).alias("state"))
    return per.agg(F.sum("opened").alias("times_opened"), F.sum("rejected").alias("rejected"), F.array_sort(F.collect_list(F.when(F.col("state") == "open", F.col("domain")))).alias("open_domains"))


def _stream(machine: Callable, fields: list[str], step: Callable, schema: str) -> Callable:
    names = [c.split()[0] for c in schema.split(", ")]

    def update(key, batches, state: GroupState):
        m = machine()
        if state.exists:
            for f, x in zip(fields, state.get, strict=True):
                setattr(m, f, x)
        # a domain's rows must be ordered, so they are held: as bare numbers, about 25 bytes a row; what is made of them goes out in pieces
        held = [(p["t"].to_numpy(float), p["id"].to_numpy(), p["outcome"].map({True: 1, False: 0}).fillna(-1).to_numpy(np.int8)) for p in batches]
        t, ids, told = (np.concatenate(c) for c in zip(*held, strict=True))
        del held
        order = np.lexsort((ids, t))
        for k in range(0, len(order), PIECE):
            at = order[k : k + PIECE]
            made = [step(m, x, None if o < 0 else bool(o)) for x, o in zip(t[at].tolist(), told[at].tolist(), strict=True)]
            out = pd.DataFrame(made, columns=names[3:])
            if k + PIECE >= len(order):
                state.update(tuple(getattr(m, f) for f in fields))
            yield pd.concat([pd.DataFrame({names[0]: [key[0]] * len(at), names[1]: ids[at], names[2]: t[at]}), out], axis=1)

    return update


def stream_limiter(log: DataFrame, gap: float, base: float = 0.0, cap: float = 60.0) -> DataFrame:
    """``limiter_trace`` over a stream; rows of a batch are ordered, batches come as they come."""
    update = _stream(lambda: Limiter(gap, base, cap), ["next", "backoff"], _limited, LIMITED)
    return log.select("domain", "id", "t", "outcome").groupBy("domain").applyInPandasWithState(update, LIMITED, "next double, backoff double", "append", GroupStateTimeout.NoTimeout)


def stream_breaker(log: DataFrame, threshold: int, recovery: float, strict: bool = False) -> DataFrame:
    """``breaker_trace`` over a stream."""
    fields = ["streak", "opened", "is_open", "probing", "times_opened", "rejected"]
    update = _stream(lambda: Breaker(threshold, recovery, strict), fields, _broken, BROKEN)
    state = "streak long, opened double, is_open long, probing long, times_opened long, rejected long"
    return log.select("domain", "id", "t", "outcome").groupBy("domain").applyInPandasWithState(update, BROKEN, state, "append", GroupStateTimeout.NoTimeout)


class FirstSeen(StatefulProcessor):
    """Keeps the first row of each key for ever, or for ``ttl_ms``: a frontier's seen set."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl = ttl_ms

    def init(self, handle):
        self.seen = handle.getValueState("seen", StructType([StructField("n", LongType())]), self.ttl)

    def handleInputRows(self, key, rows, timerValues):
        first = next(iter(rows), None)
        if first is not None and not self.seen.exists():
            self.seen.update((1,))
            yield first.head(1)

    def close(self):
        pass


def stream_unseen(links: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """First row of each ``url`` of a stream (RocksDB state store)."""
    return links.select("url").groupBy("url").transformWithStateInPandas(FirstSeen(ttl_ms), "url string", "append", "none")
