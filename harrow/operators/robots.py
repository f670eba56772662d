"""robots.txt: parsing into rule tables and deciding URLs by a join on the domain."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions import urls

RULES = "domain string, mode string, agent string, kind string, pattern string, crawl_delay double, sitemap string, line int"


def mode_of(status: int | None) -> str:
    """What an answer of this status means: rules, allow_all (4xx) or disallow_all (anything else)."""
    if status is not None and 200 <= status < 300:
        return "rules"
    return "allow_all" if status is not None and 400 <= status < 500 else "disallow_all"


def parse_text(text: str) -> list[tuple]:
    """(agent, kind, pattern, crawl_delay, sitemap, line) rows; each agent has a row of kind "agent"."""
    out, agents, fresh = [], [], False
    for line, raw in enumerate(text.splitlines(), 1):
        name, colon, value = raw.split("#", 1)[0].strip().partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "user-agent":
            agents = [*agents, value.lower()] if fresh else [value.lower()]
            fresh = True
            out.append((value.lower(), "agent", None, None, None, line))
            continue
        fresh = False
        if name == "sitemap":
            out.append((None, "sitemap", None, None, value, line))
        elif name in ("allow", "disallow") and value:
            out += [(a, name, value, None, None, line) for a in agents]
        elif name == "crawl-delay":
            try:
                out += [(a, "delay", None, float(value), None, line) for a in agents]
            except ValueError:
                pass
    return out


def parse_robots(files: DataFrame) -> DataFrame:
    """Rule rows of robots files (domain, status, text); null status: the fetch failed."""

    def run(batches):
        for b in batches:
            rows = []
            for domain, status, text in zip(b["domain"], b["status"], b["text"], strict=True):
                mode = mode_of(None if pd.isna(status) else int(status))
                rows.append((domain, mode, None, "site", None, None, None, 0))
                if mode == "rules":
                    rows += [(domain, mode, *r) for r in parse_text(text or "")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RULES.split(", ")]).astype({"crawl_delay": float})

    return files.select("domain", "status", "text").mapInPandas(run, RULES)


def pick_groups(rules: DataFrame, user_agent: str) -> DataFrame:
    """(domain, agent) that speaks to the user agent: the longest token it contains, else "*"."""
    ua = F.lit((user_agent or "*").lower())
    named = rules.filter("kind = 'agent'").select("domain", "agent").distinct()
    fit = named.filter((F.col("agent") == "*") | ua.contains(F.col("agent")))
    rank = F.when(F.col("agent") == "*", -1).otherwise(F.length("agent"))
    return fit.groupBy("domain").agg(F.max_by("agent", rank).alias("agent"))


def target_of(url: Column) -> Column:
    """Path and query that rules are matched against; parameters of the path do not count."""
    path = F.regexp_replace(urls.path_of(url), r";[^/]*$", "")
    query = urls.query_of(url)
    return F.concat(F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


#: Rules of a domain that every page of it may be compared with one by one.
FEW_RULES = 64
#: What a pattern starts with before its first ``*`` or the ``$`` at its end.
_PREFIX = r"^([^*]*?)(?:\$?$|\*)"


def _verdicts(targets: DataFrame, mine: DataFrame) -> DataFrame:
    """(_domain, _target, _best) for domains of many rules, by way of their prefixes.

    A rule can only match a target that starts with its literal prefix. So a target
    looks up its own beginnings, one for each length of a prefix in its domain, in a
    join on (domain, beginning), as a walk down a trie would; only rules met there are
    matched, and only those with ``*`` or ``$`` need their expression. How many other
    rules a domain has does not matter.
    """
    plain = ~F.col("pattern").contains("*") & ~F.col("pattern").endswith("$")
    rules = mine.select(F.col("domain").alias("_domain"), F.regexp_extract("pattern", _PREFIX, 1).alias("_start"), F.struct(F.length("pattern").alias("n"), (F.col("kind") == "allow").alias("ok")).alias("rule"), F.when(~plain, F.col("regex")).alias("regex"))
    lengths = rules.groupBy("_domain").agg(F.collect_set(F.length("_start")).alias("lengths"))
    asked = targets.join(lengths, "_domain").select("_domain", "_target", F.explode(F.filter("lengths", lambda n: n <= F.length("_target"))).alias("n"))
    met = asked.withColumn("_start", F.left("_target", F.col("n"))).join(rules, ["_domain", "_start"])
    hits = met.filter(F.col("regex").isNull() | F.rlike(F.col("_target"), F.col("regex")))
    return hits.groupBy("_domain", "_target").agg(F.max("rule").alias("_best"))


def allowed(pages: DataFrame, rules: DataFrame, user_agent: str = "*", url_col: str = "url") -> DataFrame:
    """``pages`` with ``allowed``: the longest matching rule decides, Allow on a tie.

    A domain without a robots file allows all. The rules of a domain are one row
    if they are at most ``FEW_RULES``; each page meets that row once and is judged in
    place, so pages are neither made distinct nor joined back. Targets in domains of
    more rules are judged once each, see ``_verdicts``. Rules are broadcast where their
    measured size allows; else adaptive execution splits domains of many pages.
    """
    mine = rules.join(pick_groups(rules, user_agent), ["domain", "agent"]).filter("kind in ('allow', 'disallow')").select("domain", "kind", "pattern", urls.robots_regex(F.col("pattern")).alias("regex")).distinct()
    sizes = mine.groupBy("domain").agg(F.count("*").alias("_size"))
    each = mine.join(sizes, "domain")
    per_domain = each.filter(F.col("_size") <= FEW_RULES).groupBy("domain").agg(F.collect_list(F.struct(F.length("pattern").alias("n"), (F.col("kind") == "allow").alias("ok"), "regex")).alias("_rules"))
    sites = rules.filter("kind = 'site'").select("domain", "mode").distinct().join(per_domain, "domain", "left").join(sizes, "domain", "left")
    sites = sites.select(F.col("domain").alias("_domain"), F.col("mode").alias("_mode"), (F.coalesce("_size", F.lit(0)) > FEW_RULES).alias("_many"), "_rules")
    judged = pages.withColumns({"_domain": urls.domain_of(F.col(url_col)), "_target": target_of(F.col(url_col))}).join(sites, "_domain", "left")
    hits = F.filter("_rules", lambda r: F.rlike(F.col("_target"), r["regex"]))
    best = F.array_max(F.transform(hits, lambda r: F.struct(r["n"], r["ok"])))["ok"]
    many = each.filter(F.col("_size") > FEW_RULES)
    if not many.isEmpty():
        own = pages.select(urls.domain_of(F.col(url_col)).alias("_domain"), target_of(F.col(url_col)).alias("_target")).join(many.select(F.col("domain").alias("_domain")).distinct(), "_domain", "left_semi").distinct()
        judged = judged.join(_verdicts(own, many), ["_domain", "_target"], "left")
        best = F.when(F.col("_many"), F.col("_best.ok")).otherwise(best)
    verdict = (
        F.when(F.col("_mode").isNull() | (urls.path_of(F.col(url_col)) == "/robots.txt") | (F.col("_mode") == "allow_all"), True)
        .when(F.col("_mode") == "disallow_all", False)
        .otherwise(F.coalesce(best, F.lit(True)))
    )
    return judged.withColumn("allowed", verdict).select(*[F.col(f"`{c}`") for c in pages.columns], "allowed")


def crawl_delays(rules: DataFrame, user_agent: str = "*") -> DataFrame:
    """(domain, crawl_delay) of the chosen group, 0 where it names none (the last line counts)."""
    delays = rules.filter("kind = 'delay'").groupBy("domain", "agent").agg(F.max_by("crawl_delay", "line").alias("crawl_delay"))
    sites = rules.filter("kind = 'site'").select("domain").distinct()
    chosen = pick_groups(rules, user_agent).join(delays, ["domain", "agent"], "left")
    return sites.join(chosen, "domain", "left").select("domain", F.coalesce("crawl_delay", F.lit(0.0)).alias("crawl_delay"))


def sitemaps_of(sites: DataFrame, rules: DataFrame) -> DataFrame:
    """(domain, sitemap) from ``Sitemap:`` lines, else the usual place. ``sites``: domain, scheme."""
    said = rules.filter("kind = 'sitemap'").select("domain", "sitemap").distinct()
    joined = sites.join(said, "domain", "left")
    return joined.select("domain", F.coalesce("sitemap", F.concat("scheme", F.lit("://"), "domain", F.lit("/sitemap.xml"))).alias("sitemap"))
