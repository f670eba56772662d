"""Crawl statistics: aggregates over results, request logs, attempts and storage runs.

A result row has: t (seconds since the start), url, status, error (null: success),
depth, text. Everything is one partial aggregation and a small final one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions import urls

NO_RESPONSE = "no response"


def failed() -> Column:
    return F.col("error").isNotNull()


def totals(results: DataFrame, duration: float | Column | None = None) -> DataFrame:
    """total, successful, failed, success_rate, pages_per_second, duration, avg_text_chars, total_domains; not rounded."""
    out = results.agg(
        F.count("*").alias("total"),
        F.count_if(~failed()).alias("successful"),
        F.count_if(failed()).alias("failed"),
        F.max("t").cast("double").alias("last"),
        F.sum(F.when(~failed(), F.length("text"))).alias("chars"),
        F.count_distinct(domain_label()).alias("total_domains"),
    )
    length = F.col("last") if duration is None else duration if isinstance(duration, Column) else F.lit(float(duration))
    per = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return out.select(
        "total", "successful", "failed", (100.0 * per(F.col("successful"), F.col("total"))).alias("success_rate"),
        per(F.col("total"), length).alias("pages_per_second"), length.alias("duration"), per(F.col("chars"), F.col("successful")).alias("avg_text_chars"), "total_domains",
    )


def domain_label() -> Column:
    host = urls.domain_of(F.col("url"))
    return F.when(host == "", "?").otherwise(host)


def status_histogram(results: DataFrame) -> DataFrame:
    """(status, pages); sort with ``status_order``."""
    return results.groupBy(F.coalesce(F.col("status").cast("string"), F.lit(NO_RESPONSE)).alias("status")).agg(F.count("*").alias("pages"))


def status_order(column: str = "status") -> list[Column]:
    """Numeric codes ascending, no response last."""
    return [F.col(column).try_cast("int").asc_nulls_last()]


def domains(results: DataFrame) -> DataFrame:
    return results.groupBy(domain_label().alias("domain")).agg(F.count("*").alias("pages"), F.min("t").alias("first_seen"))


def top_domains(results: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` domains of most pages; of equals the one seen first."""
    return domains(results).orderBy(F.desc("pages"), "first_seen", "domain").limit(n)


def errors_by_type(results: DataFrame) -> DataFrame:
    kind = F.when(F.col("error") == "", "CrawlerError").otherwise(F.col("error"))
    return results.filter(failed()).groupBy(kind.alias("error")).agg(F.count("*").alias("pages"))


def permanent_urls(results: DataFrame) -> DataFrame:
    return results.filter(F.col("error") == "PermanentError").select("url").distinct().orderBy("url")


def depth_distribution(results: DataFrame) -> DataFrame:
    return results.filter("depth is not null").groupBy("depth").agg(F.count("*").alias("pages"))


def timeline(results: DataFrame, duration: float, bins: int = 60) -> DataFrame:
    """(bin, bin_seconds, pages, failed) without gaps; what lies beyond the end is in the last bin."""
    width = max(1, -(-int(duration) // bins) if duration == int(duration) else int(duration / bins) + 1)
    n = max(1, -(-int(duration) // width) if duration == int(duration) else int(duration / width) + 1)
    at = F.least(F.floor(F.col("t") / width), F.lit(n - 1)).cast("int")
    counted = results.groupBy(at.alias("bin")).agg(F.count("*").alias("pages"), F.count_if(failed()).alias("failed"))
    every = results.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select("bin", F.lit(width).alias("bin_seconds"), F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("failed", F.lit(0)).alias("failed"))


def failures_head(results: DataFrame, n: int = 200) -> DataFrame:
    """The first ``n`` failures with how many there are in all."""
    bad = results.filter(failed())
    count = bad.agg(F.count("*").alias("of"))
    return bad.orderBy("t", "url").limit(n).crossJoin(F.broadcast(count)).select("t", "url", "status", "error", "of")


def skipped_by_depth(results: DataFrame, max_depth: int) -> DataFrame:
    """How many links on the deepest pages were not followed."""
    return results.filter(F.col("depth") == max_depth).agg(F.coalesce(F.sum(F.size("links")), F.lit(0)).alias("skipped"))


def queue_stats(frontier: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """queued, processed, failed, skipped, seen, duplicates over a frontier with ``state`` and ``duplicates``.

    Whether a fetched page failed is in ``results``; without these none has.
    """
    is_ = lambda s: F.count_if(F.col("state") == s)
    of = frontier.agg(is_("over_limit").alias("queued"), is_("fetched").alias("fetched"), is_("blocked").alias("skipped"), F.count("*").alias("seen"), F.sum("duplicates").alias("duplicates"))
    if results is None:
        of = of.withColumn("failed", F.lit(0).cast("long"))
    else:
        of = of.crossJoin(F.broadcast(results.agg(F.count_if(failed()).alias("failed"))))  # one row each
    return of.select("queued", (F.col("fetched") - F.col("failed")).alias("processed"), "failed", "skipped", "seen", "duplicates")


def retry_stats(attempts: DataFrame) -> DataFrame:
    """One row over attempts (url, attempt, error, delay): errors by type come from ``attempt_errors``."""
    per = attempts.groupBy("url").agg(F.count("*").alias("n"), F.max_by(F.col("error").isNotNull(), "attempt").alias("lost"))
    out = per.agg(F.sum(F.col("n") - 1).alias("retries"), F.count_if((F.col("n") > 1) & ~F.col("lost")).alias("recovered"), F.count_if((F.col("n") > 1) & F.col("lost")).alias("exhausted"))
    return out.crossJoin(F.broadcast(attempts.agg(F.avg("delay").alias("avg_delay"))))


def attempt_errors(attempts: DataFrame) -> DataFrame:
    return attempts.filter("error is not null").groupBy("error").agg(F.count("*").alias("attempts"))


def storage_stats(runs: DataFrame) -> DataFrame:
    """saved, failed, batches, write_errors over batch reports (rows, ok, write_errors)."""
    return runs.agg(F.coalesce(F.sum(F.when(F.col("ok"), F.col("rows"))), F.lit(0)).alias("saved"), F.coalesce(F.sum(F.when(~F.col("ok"), F.col("rows"))), F.lit(0)).alias("failed"), F.count_if("ok").alias("batches"), F.coalesce(F.sum("write_errors"), F.lit(0)).alias("write_errors"))


# ---- logic over ordered rows
#
# A key may hold a large share of all rows, so no window below runs over all rows of a key. Rows are windowed by
# (key, stretch of ``DAY`` seconds); what a stretch passes on to the next (its last start, its sum, its streak) is
# worked out over one row for each stretch and joined back.

DAY = 86_400.0


def _seconds(ts: str) -> Column:
    return F.col(ts).cast("timestamp").cast("double")


def _stretches(log: DataFrame, at: Column) -> DataFrame:
    return log.withColumn("_b", F.floor(at / DAY))


def _passed_on(rows: DataFrame, key: str, of: dict[str, Column], onward: dict) -> DataFrame:
    """``rows`` with the columns of ``onward``: functions of the window over a key's stretches, by what ``of`` says of each."""
    order = Window.partitionBy("_k").orderBy("_c")
    per = rows.groupBy(F.col(key).alias("_k"), F.col("_b").alias("_c")).agg(*[v.alias(k) for k, v in of.items()])
    per = per.select("_k", "_c", *[f(order).alias(k) for k, f in onward.items()])
    return rows.join(per, F.col(key).eqNullSafe(F.col("_k")) & F.col("_b").eqNullSafe(F.col("_c")), "left").drop("_k", "_c")


def _before(order):
    return order.rowsBetween(Window.unboundedPreceding, -1)


def request_gaps(log: DataFrame, key: str = "domain", ts: str = "ts", tie: str = "id") -> DataFrame:
    """``log`` with ``gap``: seconds since the start before of the same key."""
    rows = _stretches(log.withColumn("_at", _seconds(ts)), F.col("_at"))
    rows = _passed_on(rows, key, {"_last": F.max("_at")}, {"_prior": lambda order: F.max("_last").over(_before(order))})
    here = F.lag("_at").over(Window.partitionBy(key, "_b").orderBy(ts, tie))
    return rows.withColumn("gap", F.col("_at") - F.coalesce(here, F.col("_prior"))).drop("_at", "_b", "_prior")


def trailing_count(log: DataFrame, seconds: float = 5.0, key: str = "domain", ts: str = "ts") -> DataFrame:
    """``log`` with ``recent``: starts of the key in the ``seconds`` up to each row, and ``rps``. ``seconds``: a day at most.

    A row that later rows of the next stretch look back to is counted there as well.
    """
    if not 0 <= seconds <= DAY:
        raise ValueError("seconds: 0 to a day")
    micros, width = int(seconds * 1_000_000), int(DAY * 1_000_000)
    rows = log.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp")))
    mine, later = F.floor(F.col("_at") / width), F.floor((F.col("_at") + micros) / width)
    where = F.when(later > mine, F.array(F.struct(mine.alias("b"), F.lit(True).alias("own")), F.struct(later.alias("b"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(mine.alias("b"), F.lit(True).alias("own"))))
    rows = rows.withColumn("_w", F.explode(where))
    over = Window.partitionBy(key, "_w.b").orderBy("_at").rangeBetween(-micros, 0)
    return rows.withColumn("recent", F.count("*").over(over)).filter("_w.own").withColumn("rps", F.col("recent") / seconds).drop("_at", "_w")


def failure_streak(log: DataFrame, key: str = "domain", ts: str = "ts", tie: str = "id", ok: str = "ok") -> DataFrame:
    """``log`` with ``streak``: failures in a row up to each row, 0 on success (two running sums)."""
    rows = _stretches(log, _seconds(ts))
    order = Window.partitionBy(key, "_b").orderBy(ts, tie)
    rows = rows.withColumn("_island", F.sum(F.col(ok).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(key, "_b", "_island").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_run", F.sum((~F.col(ok)).cast("int")).over(run))
    # the streak at the end of the stretch before: the failures at its end, and those at the ends of stretches before it back to a success
    tails = {"_tail": F.max_by("_run", F.struct(ts, tie)), "_oks": F.max(F.col(ok).cast("int"))}
    per = rows.groupBy(F.col(key).alias("_k"), F.col("_b").alias("_c")).agg(*[v.alias(k) for k, v in tails.items()])
    by = Window.partitionBy("_k").orderBy("_c")
    per = per.withColumn("_part", F.sum("_oks").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    per = per.withColumn("_end", F.sum("_tail").over(Window.partitionBy("_k", "_part").orderBy("_c").rowsBetween(Window.unboundedPreceding, 0)))
    per = per.select("_k", "_c", F.coalesce(F.lag("_end").over(by), F.lit(0)).alias("_before"))
    rows = rows.join(per, F.col(key).eqNullSafe(F.col("_k")) & F.col("_b").eqNullSafe(F.col("_c")), "left")
    streak = F.col("_run") + F.when(F.col("_island") == 0, F.col("_before")).otherwise(0)
    return rows.withColumn("streak", streak).drop("_b", "_k", "_c", "_island", "_run", "_before")


def backoff_schedule(log: DataFrame, base: float, cap: float = 60.0, **keys) -> DataFrame:
    """``failure_streak`` with ``backoff``: doubles with each failure in a row, up to ``cap``."""
    out = failure_streak(log, **keys)
    return out.withColumn("backoff", F.when(F.col("streak") > 0, F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(2.0), F.col("streak") - 1))).otherwise(0.0))


def rate_schedule(log: DataFrame, gap: float, key: str = "domain", at: str = "t", tie: str = "id") -> DataFrame:
    """``log`` with ``start``: when each request may start if starts of a key lie ``gap`` seconds apart at least.

    Closed form of start = max(arrival, start before + gap): a running maximum.
    """
    rows = _stretches(log, F.col(at))
    rows = _passed_on(rows, key, {"_n": F.count("*")}, {"_rows": lambda order: F.coalesce(F.sum("_n").over(_before(order)), F.lit(0))})
    order = Window.partitionBy(key, "_b").orderBy(at, tie)
    rows = rows.withColumn("_slot", (F.col("_rows") + F.row_number().over(order) - 1) * F.lit(float(gap)))
    rows = rows.withColumn("_late", F.col(at) - F.col("_slot"))
    rows = _passed_on(rows, key, {"_most": F.max("_late")}, {"_prior": lambda order: F.max("_most").over(_before(order))})
    late = F.greatest(F.col("_prior"), F.max("_late").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("start", F.col("_slot") + late).withColumn("wait", F.col("start") - F.col(at)).drop("_b", "_rows", "_slot", "_late", "_prior")


def peak_concurrency(spans: DataFrame, key: str = "domain", start: str = "start", end: str = "end") -> DataFrame:
    """(key, peak): most spans open at once; one that ends frees its place before one that starts then."""
    steps = spans.select(key, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("s")).groupBy(key, "s.at", "s.d").agg(F.sum("s.d").alias("n"))
    steps = _passed_on(_stretches(steps, F.col("at")), key, {"_sum": F.sum("n")}, {"_open": lambda order: F.coalesce(F.sum("_sum").over(_before(order)), F.lit(0))})
    here = F.sum("n").over(Window.partitionBy(key, "_b").orderBy("at", "d").rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("open", F.col("_open") + here).groupBy(key).agg(F.max("open").alias("peak"))


def rate_stats(log: DataFrame, now: float, seconds: float = 5.0, key: str = "domain", ts: str = "ts", tie: str = "id", wait: Column | None = None) -> DataFrame:
    """Per key: total, current_rps (the last ``seconds`` before ``now``, in seconds since the epoch), avg_interval, avg_wait."""
    recent = F.count_if(F.col(ts).cast("timestamp").cast("double") >= F.lit(now - seconds))
    return request_gaps(log, key, ts, tie).groupBy(key).agg(F.count("*").alias("total"), (recent / seconds).alias("current_rps"), F.avg("gap").alias("avg_interval"), F.avg(wait if wait is not None else F.lit(0.0)).alias("avg_wait"))


def upsert_latest(old: DataFrame, new: DataFrame, key: str | list[str] = "url") -> DataFrame:
    """Last write per key (one column or several); an existing id stays. Both have ``id`` (null in new rows is allowed) and ``seq``."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key)
    first_id = F.min("id").over(w)
    last = F.row_number().over(w.orderBy(F.desc("_new"), F.desc("seq")))
    return both.withColumns({"_first": first_id, "_last": last}).filter("_last = 1").withColumn("id", F.col("_first")).drop("_new", "_first", "_last")
