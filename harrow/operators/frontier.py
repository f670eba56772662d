"""Level-by-level crawling and sitemap expansion as driver loops over DataFrames.

Only the number of links of a level comes to the driver; frontiers, seen URLs
and results stay distributed. Each level is cut with a reliable checkpoint, so
plans do not grow and a lost executor costs one level at most. What earlier levels
have seen is not read again for a new URL (``harrow.operators.seen``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrow.checkpoints import cut, cut_counted, shared_folder
from harrow.functions import text, urls

from .seen import SeenSet

#: So many rows are numbered in one task; more by ranges.
FEW = 50_000


def follow_filter(url: Column, exclude=(), include=(), domains: list[str] | None = None) -> Column:
    """Whether a link is followed: own domains, no exclude pattern, an include pattern if there are any."""
    ok = F.lit(True) if domains is None else urls.domain_of(url).isin(domains)
    for p in exclude:
        ok = ok & ~url.rlike(p)
    if include:
        some = F.lit(False)
        for p in include:
            some = some | url.rlike(p)
        ok = ok & some
    return ok


def rank_few(df: DataFrame, order: list, count: int, name: str = "rank") -> DataFrame:
    """``rank_rows`` of ``count`` rows, in one task if these are few."""
    if count > FEW:
        return rank_rows(df, order, name)
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


def rank_rows(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """``df`` with a gapless global rank from 1 without bringing all rows to one task.

    Rows are range-partitioned by ``order``; the counts of the partitions (one
    row each) are summed and added to the ranks inside them.
    """
    parts = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))
    local = parts.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return local.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_local")).drop("_part", "_before", "_local")


def crawl(
    start: DataFrame,
    fetch: Callable[[DataFrame], DataFrame],
    max_pages: int = 100,
    max_depth: int = 2,
    same_domain_only: bool = False,
    exclude=(),
    include=(),
    allow: Callable[[DataFrame], DataFrame] | None = None,
    folders: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Breadth-first crawl from ``start`` (url, seq): (pages, frontier).

    fetch: (url, depth, rank) -> the same url with ``links`` and ``error``
    (null: success). allow: (url, ...) -> the same with ``allowed``; what is not
    allowed is skipped and does not count towards ``max_pages``. Start URLs
    are exempt from the filters. A level's order is that of its parents, then of
    the link's place; of several ways to a URL the first at the least depth
    counts, so the result does not depend on timing.

    frontier: url, depth, rank, state (fetched, blocked, over_limit), one row per URL
    ever added; duplicates: how many more times it was offered at its level. folders:
    into how many the seen URLs are dealt, by default as many as shuffle partitions.
    """
    level = start.select(urls.normalize(F.col("url")).alias("url"), F.col("seq").cast("double").alias("key"), F.lit(0).alias("pos"))
    domains = level.select(urls.domain_of(F.col("url")).alias("domain")).distinct()
    spark, pages, left = start.sparkSession, None, max_pages
    seen = SeenSet(spark, shared_folder(spark, "seen"), folders or int(spark.conf.get("spark.sql.shuffle.partitions")))
    for depth in range(max_depth + 1):
        offered = level.groupBy("url").agg(F.min(F.struct("key", "pos")).alias("at"), F.count("*").alias("offered"))
        fresh = seen.unseen(offered).select("url", F.col("at.key").alias("key"), F.col("at.pos").alias("pos"), (F.col("offered") - 1).alias("duplicates"))
        fresh, count = cut_counted(allow(fresh) if allow else fresh.withColumn("allowed", F.lit(True)))
        fresh = rank_few(fresh, [F.desc("allowed"), "key", "pos", "url"], count)
        state = F.when(~F.col("allowed"), "blocked").when(F.col("rank") <= left, "fetched").otherwise("over_limit")
        fresh = seen.add(fresh.select("url", F.lit(depth).alias("depth"), "rank", state.alias("state"), "duplicates"))
        taken = fresh.filter("state = 'fetched'").select("url", "depth", "rank")
        n = taken.count()
        if not n:
            break
        got = cut(fetch(taken))
        pages = got if pages is None else pages.unionByName(got)
        left -= n
        if left <= 0 or depth == max_depth:
            break
        out = got.filter("error is null").select(F.col("rank").cast("double").alias("key"), F.posexplode("links").alias("pos", "link"))
        out = out.filter(follow_filter(F.col("link"), exclude, include))
        out = out.withColumn("url", urls.normalize(F.col("link")))
        if same_domain_only:
            out = out.join(domains, urls.domain_of(F.col("url")) == domains["domain"], "left_semi")
        level = out.select("url", "key", "pos")
    every = seen.read().select("url", "depth", "rank", "state", "duplicates")
    return (pages if pages is not None else fetch(every.filter("false").select("url", "depth", "rank"))), every


def corpus_fetch(corpus: DataFrame, url_col: str = "url", links_col: str = "links") -> Callable[[DataFrame], DataFrame]:
    """A fetcher that reads stored pages; a URL that is not there fails with 404."""
    stored = corpus.select(urls.normalize(F.col(url_col)).alias("url"), F.col(links_col).alias("links"))

    def fetch(wanted: DataFrame) -> DataFrame:
        got = wanted.join(stored, "url", "left")
        return got.select("url", "depth", "rank", "links", F.when(F.col("links").isNull(), "PermanentError").alias("error"), F.when(F.col("links").isNull(), 404).otherwise(200).alias("status"))

    return fetch


def expand_sitemaps(spark: SparkSession, roots: DataFrame, files: DataFrame, max_depth: int = 3, max_urls: int | None = None) -> tuple[DataFrame, DataFrame]:
    """URLs of sitemaps and of the indexes that lead to them: (urls, errors).

    roots: sitemap, seq. files: sitemap, status, body (bytes, gzip or not). Every
    file is read once; an index below ``max_depth`` is not followed; a missing or
    broken file is an error row and costs nothing else. urls: url, rank, in the
    order of their sitemaps, each once.
    """
    level = roots.select("sitemap", F.array(F.col("seq").cast("long")).alias("path"))
    seen, found, errors = None, None, None
    for depth in range(max_depth + 1):
        level = level.groupBy("sitemap").agg(F.min("path").alias("path"))
        if seen is not None:
            level = level.join(seen, "sitemap", "left_anti")
        got = level.join(files, "sitemap", "left").withColumn("parsed", text.parse_sitemap(F.col("body")))
        missing = F.coalesce((F.col("status") < 200) | (F.col("status") >= 300), F.lit(True))
        error = F.when(missing, F.concat(F.lit("status "), F.coalesce(F.col("status").cast("string"), F.lit("none")))).otherwise(F.col("parsed.error"))
        got = cut(got.select("sitemap", "path", error.alias("error"), "parsed.kind", "parsed.locations"))
        seen = got.select("sitemap") if seen is None else seen.union(got.select("sitemap"))
        bad = got.filter("error is not null").select("sitemap", "error")
        errors = bad if errors is None else errors.union(bad)
        each = got.filter("error is null").select("sitemap", "kind", "path", F.posexplode("locations").alias("pos", "loc"))
        each = each.select("kind", F.concat("path", F.array(F.col("pos").cast("long"))).alias("path"), urls.join_url(F.col("sitemap"), F.col("loc")).alias("url")).filter(urls.is_page_url(F.col("url")))
        leaves = each.filter("kind = 'urlset'").select("url", "path")
        found = leaves if found is None else found.union(leaves)
        level = each.filter("kind = 'sitemapindex'").select(F.col("url").alias("sitemap"), "path")
        if depth < max_depth and level.isEmpty():
            break
    ranked = rank_rows(found.groupBy("url").agg(F.min("path").alias("path")), ["path"]).select("url", "rank")
    return (ranked if max_urls is None else ranked.filter(F.col("rank") <= max_urls)), errors
