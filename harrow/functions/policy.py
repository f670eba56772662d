"""Retry, rate and error policy as column expressions, with their parameters as dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Statuses besides 5xx that may pass if tried again.
PASSING_STATUSES = [408, 425]
RATE_LIMITED, TRANSIENT, PERMANENT, NETWORK, PARSE, BREAKER, OTHER = "RateLimitedError", "TransientError", "PermanentError", "NetworkError", "ParseError", "CircuitOpenError", "CrawlerError"
#: Error types that say the domain is not well (for limiter and breaker).
FAILURES = (TRANSIENT, RATE_LIMITED, NETWORK)
#: An error type to the more general one that it is a case of.
KIND_OF = {RATE_LIMITED: TRANSIENT, **dict.fromkeys((TRANSIENT, PERMANENT, NETWORK, PARSE, BREAKER), OTHER)}


def by_type(table: dict, error: str | None):
    """What ``table`` says of an error type, or else of the next more general one it names."""
    while error is not None and error not in table:
        error = KIND_OF.get(error)
    return table.get(error)


# The names and defaults of both policies are those of the settings file.
@dataclass
class RetryPolicy:
    max_retries: int = 3
    backoff_factor: float = 2.0
    base_delay: float = 0.5
    max_delay: float = 30.0
    retry_on: tuple[str, ...] = (TRANSIENT, NETWORK, RATE_LIMITED)
    delay_by_type: dict[str, float] = field(default_factory=lambda: {RATE_LIMITED: 2.0, NETWORK: 1.0})
    max_by_type: dict[str, int] = field(default_factory=lambda: {NETWORK: 2})
    max_by_status: dict[int, int] = field(default_factory=lambda: {500: 1})
    timeout_growth: float = 1.5

    @property
    def retried(self) -> list[str]:
        """The types in ``retry_on`` and all that are cases of these."""
        wanted = dict.fromkeys(self.retry_on, True)
        return [k for k in (*KIND_OF, OTHER) if by_type(wanted, k)]

    def retries(self, error: str | None, status: int | None) -> int:
        """How often at most a request is tried again after this error."""
        limits = (self.max_retries, by_type(self.max_by_type, error), self.max_by_status.get(status))
        return min(x for x in limits if x is not None)

    def delay(self, attempt: int, error: str | None, asked: float | None = None) -> float:
        """Seconds before the retry that follows attempt number ``attempt``; ``asked`` is the server's Retry-After."""
        base = by_type(self.delay_by_type, error)
        seconds = (self.base_delay if base is None else base) * self.backoff_factor ** (attempt - 1)
        if error == RATE_LIMITED and asked is not None:
            seconds = max(seconds, asked)
        return min(seconds, self.max_delay)


@dataclass
class RatePolicy:
    requests_per_second: float | None = None
    min_delay: float = 0.0
    jitter: float = 0.0
    error_backoff: float = 0.0
    max_backoff: float = 60.0
    per_domain: bool = True


def classify_status(status: Column) -> Column:
    """Error type of an HTTP status; null for success, network error where there was no response."""
    return (
        F.when(status.isNull(), NETWORK)
        .when(status < 400, F.lit(None).cast("string"))
        .when(status == 429, RATE_LIMITED)
        .when((status >= 500) | status.isin(PASSING_STATUSES), TRANSIENT)
        .otherwise(PERMANENT)
    )


#: Exception class name (lower case, without package) to error type.
BY_EXCEPTION = {
    "timeouterror": TRANSIENT, "sockettimeout": TRANSIENT, "servertimeouterror": TRANSIENT, "connecttimeout": TRANSIENT,
    "clientconnectorerror": NETWORK, "clientoserror": NETWORK, "serverdisconnectederror": NETWORK, "clientpayloaderror": NETWORK,
    "connectionreseterror": NETWORK, "connectionrefusederror": NETWORK, "connectionerror": NETWORK, "gaierror": NETWORK, "urlerror": NETWORK, "remotedisconnected": NETWORK, "sslerror": NETWORK,
    "unicodedecodeerror": PARSE, "invalidurl": PERMANENT, "valueerror": PERMANENT,
}


def classify_exception(name: Column) -> Column:
    """Error type of an exception's class name."""
    bare = F.lower(F.element_at(F.split(name, r"\."), -1))
    out = F.when(name.isNull(), F.lit(None).cast("string"))
    for k, v in BY_EXCEPTION.items():
        out = out.when(bare == k, v)
    return out.otherwise(OTHER)


def parse_retry_after(value: Column) -> Column:
    """Seconds (0 at least); null for a date or anything else that is no number."""
    number = F.trim(value).try_cast("double")
    return F.when(F.isnan(number), 0.0).when(number.isNotNull(), F.greatest(F.lit(0.0), number))


def _of_type(error: Column, table: dict) -> Column:
    """What ``table`` says of an error type by name or by its more general types; null if nothing."""
    out = F.lit(None)
    for kind in (RATE_LIMITED, TRANSIENT, PERMANENT, NETWORK, PARSE, BREAKER, OTHER):
        if (value := by_type(table, kind)) is not None:
            out = F.when(error == kind, value).otherwise(out)
    return out


def backoff_delay(attempt: Column, policy: RetryPolicy, error: Column | None = None, retry_after: Column | None = None) -> Column:
    """Delay before the retry that follows attempt number ``attempt`` (1 is the first)."""
    base = F.lit(policy.base_delay)
    if error is not None:
        base = F.coalesce(_of_type(error, policy.delay_by_type).cast("double"), base)
    delay = base * F.pow(F.lit(policy.backoff_factor), attempt - 1)
    if error is not None and retry_after is not None:
        delay = F.when((error == RATE_LIMITED) & retry_after.isNotNull(), F.greatest(delay, retry_after)).otherwise(delay)
    return F.least(delay, F.lit(policy.max_delay))


def max_retries_for(error: Column, status: Column, policy: RetryPolicy) -> Column:
    """The least of the general limit, that of the error type (or a more general one) and that of the status."""
    limits = [F.lit(policy.max_retries), _of_type(error, policy.max_by_type).cast("int")]
    limits += [F.when(status == k, v) for k, v in policy.max_by_status.items()]
    return F.least(*limits)


def should_retry(error: Column, policy: RetryPolicy) -> Column:
    return F.coalesce(error.isin(policy.retried), F.lit(False))


def timeout_for(attempt: Column, timeout: float, policy: RetryPolicy) -> Column:
    return F.lit(timeout) * F.pow(F.lit(policy.timeout_growth), attempt - 1)


def base_interval(policy: RatePolicy, crawl_delay: Column | float = 0.0) -> Column:
    """Least gap between two starts of one key, in seconds."""
    delay = crawl_delay if isinstance(crawl_delay, Column) else F.lit(float(crawl_delay))
    rate = 1.0 / policy.requests_per_second if policy.requests_per_second else 0.0
    return F.greatest(F.lit(rate), F.lit(float(policy.min_delay)), F.coalesce(delay, F.lit(0.0)))


def jittered(gap: Column, policy: RatePolicy, seed: int = 0) -> Column:
    return gap + F.rand(seed) * policy.jitter


def rotated(seq: Column, agents: list[str]) -> Column:
    """The user agent of request number ``seq`` (0 is the first), round robin."""
    return F.element_at(F.array(*map(F.lit, agents)), (F.pmod(seq, F.lit(len(agents))) + 1).cast("int"))
